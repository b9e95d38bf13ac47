"""The queries of the library over the given tables, and the same in SQL."""

from . import catalog, periods, rows, scalars, shaping  # noqa: F401
from ._base import QUERIES, SQL  # noqa: F401

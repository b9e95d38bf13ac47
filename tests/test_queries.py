"""Every query of the library against its SQL, and those without SQL for rows."""

import pytest
from compare import same, views

from grainwise.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

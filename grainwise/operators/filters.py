"""Predicates, name resolution and checks over rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_id_like

_COMPARE = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def one_of(column: str | Column, values: Sequence) -> Column:
    """Membership of a literal set; an empty set is refused."""
    if not values:
        raise ValueError("a set of values must not be empty")
    return (F.col(column) if isinstance(column, str) else column).isin(*values)


def admissible(condition: Column, frame: DataFrame) -> bool:
    """True if the condition is a boolean on the frame's columns, without aggregates."""
    try:
        return frame.filter(condition).select(condition).dtypes[0][1] == "boolean"
    except AnalysisException:
        return False


def owner(columns: DataFrame, name: str, owner_col: str) -> DataFrame:
    """(name, owner, owners): the owner of each name that has exactly one."""
    n = F.count_distinct(owner_col)
    return columns.groupBy(name).agg(F.when(n == 1, F.min(owner_col)).alias("owner"), n.alias("owners"))


def report_filters(rows: DataFrame, scopes: Mapping[str, Sequence[Mapping]]) -> DataFrame:
    """Filters of a report, then its page, then its visual. A top-N keeps the groups of largest aggregate, ties by value."""
    for scope in ("report", "page", "visual"):
        for f in scopes.get(scope, ()):
            c, op = F.col(f["column"]), f["op"]
            if op in _COMPARE:
                rows = rows.filter(_COMPARE[op](c, F.lit(f["value"])))
            elif op in ("in", "not in"):
                kept = one_of(c, f["values"])
                rows = rows.filter(kept if op == "in" else ~kept)
            elif op == "top":
                top = rows.groupBy(f["column"]).agg(f["by"].alias("_by")).orderBy(F.desc("_by"), f["column"]).limit(f["n"]).select(f["column"])
                rows = rows.join(top, f["column"], "left_semi")
            else:
                raise ValueError(f"filter {op!r} can't be read")
    return rows


def resolve_fields(fields: DataFrame, measures: DataFrame, columns: DataFrame) -> DataFrame:
    """fields (field) with `resolved`: a measure of that name first, else a column, else unresolved."""
    m = measures.toDF("_m").distinct()
    c = columns.toDF("_c").distinct()
    found = F.when(F.col("_m").isNotNull(), "measure").when(F.col("_c").isNotNull(), "column").otherwise("unresolved")
    return fields.join(m, F.col("field") == F.col("_m"), "left").join(c, F.col("field") == F.col("_c"), "left").withColumn("resolved", found).drop("_m", "_c")


def implicit_measures(shown: DataFrame, columns: DataFrame, authored: DataFrame) -> DataFrame:
    """(name, agg, table, col, tiles) of the aggregations that visuals declare, shown (tile, agg, table, col), over columns (table, col, data_type).

    Numbers only, no sums or means of ids; a column name that visuals take from several tables is told apart by its table;
    a name that authored (name) has is the author's.
    """
    numeric = F.col("data_type").rlike("int|double|decimal|currency|number|float|money|real")
    allowed = numeric & ~(F.col("agg").isin("sum", "avg") & is_id_like(F.col("col")))
    found = shown.groupBy("agg", "table", "col").agg(F.count_distinct("tile").alias("tiles"))
    shared = found.groupBy(F.lower("col").alias("_low")).agg((F.count_distinct("table") > 1).alias("_shared"))
    kept = found.join(columns, ["table", "col"]).filter(allowed | F.col("agg").isin("count", "count_distinct")).join(shared, F.lower("col") == F.col("_low"))
    shown_as = F.when(F.col("_shared"), F.concat("table", F.lit("["), "col", F.lit("]"))).otherwise(F.col("col"))
    named = kept.withColumn("name", F.concat(F.initcap(F.replace("agg", F.lit("_"), F.lit(" "))), F.lit(" of "), shown_as))
    theirs = authored.select(F.lower("name").alias("_known")).distinct()
    return named.join(theirs, F.lower("name") == F.col("_known"), "left_anti").select("name", "agg", "table", "col", "tiles")


def additive(parts: DataFrame, wholes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(measure, additive): whether the parts (measure, value) add up to the whole."""
    summed = parts.groupBy("measure").agg(F.sum("value").alias("_sum"))
    gap = F.abs(F.col("_sum") - F.col("value"))
    return wholes.join(summed, "measure").select("measure", (gap <= tolerance * F.greatest(F.abs("value"), F.lit(1.0))).alias("additive"))

"""Folding, ranking and ordering of split figures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import numeric_order
from ..sources.staging import staged
from .steps import add_index, add_index_within


def top_fold(parts: DataFrame, most: int = 10, by: Sequence[str] = ("measure",), label: str = "label", value: str = "value") -> DataFrame:
    """The largest `most` labels of each measure; the rest summed as 'N more'."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), label))
    many = F.count("*").over(Window.partitionBy(*by))
    ranked = parts.withColumn("_nth", nth).withColumn("_many", many)
    folded = F.col("_nth") > most
    name = F.when(folded, F.concat((F.col("_many") - most).cast("string"), F.lit(" more"))).otherwise(F.col(label))
    return ranked.withColumn("_label", name).withColumn("folded", folded).groupBy(*by, F.col("_label").alias(label), "folded").agg(F.sum(value).alias(value))


def rank_abs(value: Column, tie: Column, by: Sequence[str] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(value)), tie))


def ranked_by_size(rows: DataFrame, value: str, tie: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """rows with their rank by magnitude in each group, ties by `tie`; a group may span many tasks."""
    order = [F.desc(F.abs(value)), F.col(tie)]
    return add_index_within(rows, by, order, name, start=1) if by else add_index(rows, order, name, start=1)


def share(value: Column, by: Sequence[str] = ()) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*by))


def last_n(series: DataFrame, n: int, by: Sequence[str], at: str = "period") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))
    return series.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def first_per(rows: DataFrame, by: Sequence[str], *order) -> DataFrame:
    """The first row of each group in the order."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def disjoint_spans(spans: DataFrame, by: Sequence[str], low: str = "low", high: str = "high") -> DataFrame:
    """(by, disjoint): whether each span of a group ends before the next begins."""
    later = F.lead(low).over(Window.partitionBy(*by).orderBy(low, high))
    ends = spans.withColumn("_ok", later.isNull() | (F.col(high) < later))
    return ends.groupBy(*by).agg(F.bool_and("_ok").alias("disjoint"))


def positions(parts: DataFrame, order: str, label: str = "label", value: str = "value", key: str | None = None) -> DataFrame:
    """parts with `position`, from 1, under an order: largest, smallest, label (numbers by size) or time (by key, missing last). Positions are counted over ranges of the order."""
    by = {
        "largest": [F.desc(value), F.col(label)],
        "smallest": [F.asc(value), F.col(label)],
        "label": [numeric_order(F.col(label)), F.col(label)],
        "time": [F.col(key or label).asc_nulls_last(), F.col(label)],
    }[order]
    return add_index(parts, by, "position", start=1)


def key_is_number(kind: str) -> bool:
    return kind in ("int", "bigint", "smallint", "tinyint", "float", "double") or kind.startswith("decimal")


def sort_key(value: Column, kind: str) -> Column:
    """A declared sort column's value as text that sorts like it: numbers from 0 are padded."""
    if key_is_number(kind):
        return F.when(value >= 0, F.format_string("%018.4f", value.cast("double"))).otherwise(value.cast("string"))
    return value.cast("string")


def medians(rows: DataFrame, by: Sequence[str], value: str, name: str = "median", accuracy: int = 10_000) -> DataFrame:
    """(by, name): the exact median of each group, nulls left out, without holding a group's values.

    Approximate percentiles a little below and above the middle, whose ranks err by 1 / accuracy at most, enclose it; the
    rows below are counted, and only those between are ordered: some four of `accuracy`.
    """
    near = F.percentile_approx(value, [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy)
    ends = rows.groupBy(*by).agg(F.count(value).alias("_n"), near.alias("_ends")).select(*[F.col(b).alias(f"_{b}") for b in by], "_n", F.col("_ends")[0].alias("_lo"), F.col("_ends")[1].alias("_hi"))
    # Written, so that its size is known: of few groups, Spark broadcasts it, where it would otherwise deal all rows by group to as few tasks.
    ends = staged(ends, "ends")
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    there = rows.select(*by, F.col(value).alias("_v")).join(ends, same).select(*by, "_v", "_n", "_lo", "_hi")
    middle = there.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*by, "_v", "_n").agg(F.count("*").alias("_times"))
    below = there.filter(F.col("_v") < F.col("_lo")).groupBy(*by).agg(F.count("*").alias("_below")).select(*[F.col(b).alias(f"_{b}") for b in by], "_below")
    upto = F.sum("_times").over(Window.partitionBy(*by).orderBy("_v"))
    placed = middle.join(below, same, "left").withColumn("_upto", F.coalesce("_below", F.lit(0)) + upto)
    holds = lambda rank: (F.col("_upto") - F.col("_times") < rank) & (rank <= F.col("_upto"))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    found = placed.groupBy(*by).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name))
    none = ends.filter("_n = 0").select(*[F.col(f"_{b}").alias(b) for b in by], F.lit(None).cast("double").alias(name))
    return found.unionByName(none)

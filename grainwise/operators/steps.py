"""Steps of a load as DataFrame operations, and a log of the rows that go in and come out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def row_range(df: DataFrame, order: Sequence, first: int = 0, count: int | None = None, drop_last: int = 0) -> DataFrame:
    """Rows `first` to `first + count` in a stated order, less the last `drop_last`.

    Rows are numbered by ranges of the order and the counts before them, so no task sorts the whole table.
    """
    numbered = add_index(df, order, "_nth")
    if count is not None:
        numbered = numbered.filter(F.col("_nth") < first + count)
    if drop_last:
        total = df.agg(F.count("*").alias("_total"))
        numbered = numbered.crossJoin(total).filter(F.col("_nth") < F.col("_total") - drop_last).drop("_total")  # one row
    return numbered.filter(F.col("_nth") >= first).drop("_nth")


def ranged(df: DataFrame, order: Sequence) -> DataFrame:
    """df in ranges of an order, written: `_part` is a range's number and `_at` a row's place, both rising with the order."""
    found = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return found.withColumn("_part", F.shiftright("_at", 33))


def add_index(df: DataFrame, order: Sequence, name: str = "index", start: int = 0) -> DataFrame:
    """A gapless index in a stated order. The ranges are written before they are counted, so that both uses see the same."""
    rows = ranged(df, order).withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.col("_local") + start).drop("_at", "_part", "_local", "_before")


def add_index_within(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "index", start: int = 0) -> DataFrame:
    """A gapless index within each group of `by`: all rows are numbered by ranges, and a group's first number is taken off, so a group may span many ranges."""
    rows = add_index(df, [*[F.col(c) for c in by], *order], "_index")
    first = rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("_index").alias("_first"))
    return rows.join(first, same_group(by)).withColumn(name, F.col("_index") - F.col("_first") + start).drop("_index", "_first", *[f"_by_{c}" for c in by])


def same_group(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True))


def nested_join(left: DataFrame, right: DataFrame, on: Column, key: Sequence[str], name: str) -> DataFrame:
    """left with the matching rows of right as an array column; none give an empty array.

    An array has all partners of one key in one row, so it is for keys of some thousands at most; join and keep rows beyond.
    """
    picked = [c for c in right.columns]
    rows = left.join(right, on, "left")
    present = F.col(picked[0]).isNotNull()
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(present, F.struct(*picked)))).alias(name))


def expand(df: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """A nested column as rows; an empty one leaves a row of nulls."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(name).alias("_row")).select(*others, *[F.col(f"_row.{f}").alias(f) for f in fields])


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def replace_value(df: DataFrame, column: str, old, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).eqNullSafe(F.lit(old)), F.lit(new)).otherwise(F.col(column)))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Values that don't fit become null."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def pivot(df: DataFrame, by: Sequence[str], column: str, values: Sequence, agg: Column) -> DataFrame:
    return df.groupBy(*by).pivot(column, list(values)).agg(agg)


def unpivot_others(df: DataFrame, keep: Sequence[str], name: str = "attribute", value: str = "value") -> DataFrame:
    return df.unpivot(list(keep), [c for c in df.columns if c not in keep], name, value)


def fill(df: DataFrame, column: str, by: Sequence[str], order: Sequence, down: bool = True) -> DataFrame:
    """Nulls take the last value before them in the order (down), or the next after (up), within each group.

    A scan over ranges: each range fills what it can; what a group has last (or first) in each of its ranges is carried over
    those that have nothing, a row a range; and the rest of a range takes what is carried into it. So a group, or the whole
    table, may span any number of ranges.
    """
    rows = ranged(df, [*[F.col(c) for c in by], *order])
    inside = Window.partitionBy("_part", *by).orderBy(F.asc("_at") if down else F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_filled", F.last(column, ignorenulls=True).over(inside))
    latest = F.max_by if down else F.min_by
    ends = rows.groupBy("_part", *by).agg(latest(F.struct(F.col(column).alias("v")), F.when(F.col(column).isNotNull(), F.col("_at"))).alias("_end"))
    over = Window.partitionBy(*by).orderBy(F.asc("_part") if down else F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_part").alias("_into"), *[F.col(c).alias(f"_by_{c}") for c in by], F.last("_end.v", ignorenulls=True).over(over).alias("_carried")).filter("_carried IS NOT NULL")
    found = filled.join(carried, (F.col("_part") == F.col("_into")) & same_group(by), "left").withColumn(column, F.coalesce("_filled", "_carried"))
    return found.select(*df.columns)


def calendar(df: DataFrame, column: str) -> DataFrame:
    """(date): every day from the first year's first to the last year's last day of a column."""
    ends = df.agg(F.trunc(F.min(column), "year").alias("a"), F.last_day(F.add_months(F.trunc(F.max(column), "year"), 11)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date"))


def logged(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """(result, log): log has (n, step, rows_in, rows_out) of each step. What a step gives is written, and the next one reads it."""
    count = lambda x, name: x.agg(F.count("*").alias(name))
    log, rows_in = [], count(df, "rows_in")
    for n, (name, step) in enumerate(steps):
        df = staged(step(df), "step")
        log.append(rows_in.crossJoin(count(df, "rows_out")).select(F.lit(n).alias("n"), F.lit(name).alias("step"), "rows_in", "rows_out"))  # one row each
        rows_in = count(df, "rows_in")
    return df, reduce(DataFrame.unionByName, log)

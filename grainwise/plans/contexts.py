"""What a measure may change about the rows it is evaluated over: other grains, other periods, running spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = ("year", "quarter", "month", "day", "hour")
STEP = {"year": "1 YEAR", "quarter": "3 MONTHS", "month": "1 MONTH", "day": "1 DAY", "hour": "1 HOUR"}
_MONTHS = {"year": 12, "quarter": 3, "month": 1}
_HOURS = {"day": 24, "hour": 1}


@dataclass(frozen=True)
class Over:
    """Columns of the grain and filters that a measure sees. removed: tables, 'table.column' or 'period' that it doesn't, None for all of them; kept: exceptions to that."""

    removed: tuple[str, ...] | None = None
    kept: tuple[str, ...] = ()

    def keeps(self, column: str) -> bool:
        names = {column, column.split(".")[0]}
        return bool(names & set(self.kept)) or (self.removed is not None and not names & set(self.removed))


def everything() -> Over:
    """All rows, whatever the grain and the filters."""
    return Over()


def without(*names: str) -> Over:
    """Without grouping and filters on these tables or columns."""
    return Over(names)


def all_except(table: str, *columns: str) -> Over:
    """Without grouping and filters on a table but for some of its columns."""
    return Over((table,), columns)


def only(*names: str) -> Over:
    """With no grouping and filters but those on these tables or columns."""
    return Over(None, names)


@dataclass(frozen=True)
class Span:
    """Periods that a running figure covers: 'to_date', from the unit's start; 'trailing', the last n units; 'whole', the unit n units on (earlier if negative)."""

    kind: str
    unit: str
    n: int = 0


def to_date(unit: str) -> Span:
    return Span("to_date", unit)


def trailing(n: int, unit: str) -> Span:
    return Span("trailing", unit, n)


def parallel(n: int, unit: str) -> Span:
    return Span("whole", unit, n)


@dataclass(frozen=True)
class States:
    """Aggregates of a period that can be merged over several: parts of the rows kept, the aggregate that merges each, the figure made of the merged ones, and the figure over no rows."""

    parts: Callable[[Callable], Sequence[Column]]
    merge: Sequence[Callable[[Column], Column]]
    finish: Callable[..., Column] = lambda x: x
    nothing: int | None = None


def periods_in(unit: str, period: str) -> int | None:
    """How many periods a unit has; None if that differs from unit to unit, or is no whole number."""
    for sizes in (_MONTHS, _HOURS):
        if unit in sizes and period in sizes and sizes[unit] % sizes[period] == 0:
            return sizes[unit] // sizes[period]
    return None


def index(period: str, moment: Column) -> Column:
    """The number of a period, such that the next one has the next number."""
    if period == "day":
        return F.unix_date(F.to_date(moment)).cast("long")
    if period == "hour":
        return F.floor(F.unix_timestamp(moment) / 3600).cast("long")
    parts = {"year": F.year(moment), "quarter": F.year(moment) * 4 + F.quarter(moment), "month": F.year(moment) * 12 + F.month(moment)}
    return parts[period].cast("long")


def moved(moment: Column, n: int, unit: str) -> Column:
    """A moment n units on; days that a month lacks are its last."""
    if unit in _MONTHS:
        day = F.add_months(F.to_date(moment), n * _MONTHS[unit])
        return day.cast("timestamp") + (moment - F.date_trunc("day", moment))
    return moment + F.expr(f"INTERVAL {n * _HOURS[unit]} HOURS")


def spine(rows: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Every group of the keys but `period` with every period from the first to the last of all, with `_at`, its number; what rows lack is null. Rows without a period stay, without a number."""
    groups = [k for k in keys if k != "period"]
    ends = rows.agg(F.min("period").alias("_first"), F.max("period").alias("_last"))
    dated = rows.filter("period IS NOT NULL")
    grid = dated.select(*groups).distinct().crossJoin(ends) if groups else ends  # one row
    grid = grid.select(*[F.col(g).alias(f"_{g}") for g in groups], F.explode(F.sequence("_first", "_last", F.expr(f"INTERVAL {STEP[period]}"))).alias("_period"))
    same = F.col("_period") == F.col("period")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    others = [c for c in rows.columns if c not in keys]
    full = grid.join(dated, same, "left").select(*[F.col(f"_{g}").alias(g) for g in groups], F.col("_period").alias("period"), *others)
    return full.unionByName(rows.filter("period IS NULL").select(*groups, "period", *others)).withColumn("_at", index(period, F.col("period")))


def frame_of(span: Span, groups: Sequence[str], period: str):
    """The window over a spine that a span covers."""
    here = F.col("period").isNull()  # rows without a period are by themselves
    if span.kind == "to_date":
        return Window.partitionBy(*groups, here, F.date_trunc(span.unit, "period")).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    if span.kind == "trailing":
        return Window.partitionBy(*groups, here).orderBy("_at").rangeBetween(1 - span.n * periods_in(span.unit, period), 0)
    return Window.partitionBy(*groups, here).orderBy(index(span.unit, F.col("period"))).rangeBetween(span.n, span.n)


def covered_by(span: Span, period: str) -> tuple[Column, Column]:
    """Numbers of the first and last period whose span covers the period `period`."""
    at = index(period, F.col("period"))
    if span.kind == "trailing":
        return at, at + (span.n * periods_in(span.unit, period) - 1)
    start = F.date_trunc(span.unit, "period")
    if span.kind == "to_date":
        return at, index(period, moved(start, 1, span.unit)) - 1
    return index(period, moved(start, -span.n, span.unit)), index(period, moved(start, 1 - span.n, span.unit)) - 1


def distinct_over(rows: DataFrame, grid: DataFrame, span: Span, groups: Sequence[str], period: str, name: str) -> DataFrame:
    """grid, a spine, with the number of distinct values (`_value` of rows) that a span covers.

    A value counts in the periods whose spans cover one of its own. Those are intervals, one a period it occurs in; where
    they overlap the later one is shortened, so each value adds 1 where an interval begins, takes it away after its end, and
    the counts are running sums. So no set of values is ever held, and a value has at most a row for each period.
    """
    first, last = covered_by(span, period)
    seen = rows.filter("period IS NOT NULL AND _value IS NOT NULL").select(*groups, "period", "_value").distinct()
    seen = seen.select(*groups, "_value", first.alias("_from"), last.alias("_to"))
    before = Window.partitionBy(*groups, "_value").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_from", F.greatest("_from", F.coalesce(F.max("_to").over(before) + 1, F.col("_from")))).filter("_from <= _to")
    turns = seen.select(*groups, F.explode(F.array(F.struct(F.col("_from").alias("_at"), F.lit(1).alias("_turn")), F.struct((F.col("_to") + 1).alias("_at"), F.lit(-1).alias("_turn")))).alias("_e"))
    turns = turns.groupBy(*groups, F.col("_e._at").alias("_at")).agg(F.sum("_e._turn").alias("_turn"))
    both = grid.withColumn("_own", F.lit(True)).unionByName(turns, allowMissingColumns=True)
    upto = Window.partitionBy(*groups).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.coalesce(F.sum("_turn").over(upto), F.lit(0))).filter("_own").drop("_own", "_turn")


def shifted(grid: DataFrame, value: str, n: int, unit: str, keys: Sequence[str], period: str, name: str) -> DataFrame:
    """grid, a spine, with a column's value n units on (earlier if negative); null where the spine has no such period."""
    groups = [k for k in keys if k != "period"]
    if (size := periods_in(unit, period)) is not None:
        w = Window.partitionBy(*groups, F.col("period").isNull()).orderBy("_at").rangeBetween(n * size, n * size)
        return grid.withColumn(name, F.first(value).over(w))
    there = grid.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("period").alias("_there"), F.col(value).alias(name))
    same = F.col("_there") == moved(F.col("period"), n, unit)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return grid.join(there, same, "left").drop("_there", *[f"_{g}" for g in groups])

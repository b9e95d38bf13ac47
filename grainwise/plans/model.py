"""Tables, relationships and measures, and their evaluation at any grain as one Spark plan.

A measure is a PySpark aggregate over its base table and what that reaches by relationships; Spark plans the joins.
Measures of different bases are aggregated before they are joined, so facts never fan each other out.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import shuffle_tasks
from .contexts import PERIODS, STEP, Over, Span, States  # noqa: F401


class Keep:
    """The rows one aggregate sees: a condition put around each value, and more conditions joined on with &."""

    def __init__(self, condition: Column | None = None):
        self.condition = condition

    def __call__(self, value: Column) -> Column:
        return value if self.condition is None else F.when(self.condition, value)

    def __and__(self, condition: Column) -> Keep:
        return Keep(condition if self.condition is None else self.condition & condition)

    def rows(self) -> Column:
        return F.count(self(F.lit(1)))


@dataclass(frozen=True)
class Relationship:
    """many and one are 'table.column'; integrity: every key of the many side is known to exist."""

    many: str
    one: str
    active: bool = True
    integrity: bool = False
    both_directions: bool = False


@dataclass(frozen=True)
class Measure:
    """Either an aggregate over `base` (build), or a function of other measures (inputs, fn), or one of them a period earlier
    (previous), at another grain (over), so many units of time on (shift), or running over periods (span).

    A running figure needs aggregates that can be merged over periods: `states`, or of a count of distinct values, `distinct`.
    """

    name: str
    base: str | None = None
    build: Callable[[Keep], Column] | None = None
    reads: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    fn: Callable[..., Column] | None = None
    previous: str | None = None
    format: str | None = None
    over: Over | None = None
    shift: tuple[int, str] | None = None
    span: Span | None = None
    states: States | None = None
    distinct: Callable[[], Column] | None = None

    @property
    def moves(self) -> bool:
        return bool(self.over or self.shift or self.span)


def total(name: str, base: str, value: Callable[[], Column], **more) -> Measure:
    """A sum that can run over periods."""
    return Measure(name, base, lambda keep: F.sum(keep(value())), states=States(lambda keep: [F.sum(keep(value()))], [F.sum]), **more)


def row_count(name: str, base: str, condition: Callable[[], Column] | None = None, **more) -> Measure:
    """A count of rows, of those that meet a condition if there is one, that can run over periods."""
    own = lambda keep: keep & condition() if condition else keep
    return Measure(name, base, lambda keep: own(keep).rows(), states=States(lambda keep: [own(keep).rows()], [F.sum], nothing=0), **more)


def mean(name: str, base: str, value: Callable[[], Column], **more) -> Measure:
    """An average that can run over periods: sum and count are merged."""
    parts = lambda keep: [F.sum(keep(value())), F.count(keep(value()))]
    return Measure(name, base, lambda keep: F.avg(keep(value())), states=States(parts, [F.sum, F.sum], F.try_divide), **more)


def lowest(name: str, base: str, value: Callable[[], Column], **more) -> Measure:
    return Measure(name, base, lambda keep: F.min(keep(value())), states=States(lambda keep: [F.min(keep(value()))], [F.min]), **more)


def highest(name: str, base: str, value: Callable[[], Column], **more) -> Measure:
    return Measure(name, base, lambda keep: F.max(keep(value())), states=States(lambda keep: [F.max(keep(value()))], [F.max]), **more)


def distinct_count(name: str, base: str, value: Callable[[], Column], **more) -> Measure:
    """A count of distinct values that can run over periods."""
    return Measure(name, base, lambda keep: F.count_distinct(keep(value())), distinct=value, **more)


class NotComputable(ValueError):
    """A measure that can't be computed as asked; status is BLOCKED or UNSUPPORTED."""

    def __init__(self, status: str, construct: str, reason: str):
        super().__init__(f"{status}: {reason}")
        self.status, self.construct, self.reason = status, construct, reason


FIGURES = "measure string, value double, status string, reason string, implicit boolean"


@dataclass
class Model:
    tables: Mapping[str, DataFrame]
    relationships: Sequence[Relationship] = ()
    measures: dict[str, Measure] = field(default_factory=dict)
    calendar: Mapping[str, str] = field(default_factory=dict)
    #: Tables of which a role sees only some rows: what leads to them is joined, and inner.
    restricted: frozenset[str] = frozenset()

    def add(self, *measures: Measure) -> Model:
        for m in measures:
            self.measures[m.name] = m
        return self

    def using(self, relationship: Relationship) -> Model:
        """A model in which an inactive relationship is the active one between its two tables."""
        pair = {relationship.many.split(".")[0], relationship.one.split(".")[0]}
        turned = [
            Relationship(r.many, r.one, r == relationship, r.integrity, r.both_directions) if {r.many.split(".")[0], r.one.split(".")[0]} == pair else r
            for r in self.relationships
        ]
        return Model(self.tables, turned, dict(self.measures), self.calendar, self.restricted)

    # --- joins ------------------------------------------------------------------------------------------------------

    def path(self, start: str, goal: str) -> list[tuple[Relationship, bool]]:
        """Shortest way over active relationships: (relationship, whether it goes to the one side)."""
        came: dict[str, tuple[str, Relationship, bool] | None] = {start: None}
        queue = deque([start])
        while queue and goal not in came:
            here = queue.popleft()
            for r in self.relationships:
                if not r.active:
                    continue
                many, one = r.many.split(".")[0], r.one.split(".")[0]
                for a, b, to_one in ((many, one, True), (one, many, False)):
                    if a == here and b not in came:
                        came[b] = (a, r, to_one)
                        queue.append(b)
        if goal not in came:
            raise NotComputable("BLOCKED", "relationship", f"no active relationship leads from {start} to {goal}")
        steps = []
        while came[goal]:
            goal, r, to_one = came[goal]
            steps.append((r, to_one))
        return steps[::-1]

    def joined(self, base: str, needed: Iterable[str]) -> DataFrame:
        """base with the tables it needs: LEFT to a one side, so unmatched facts stay; INNER to a many side, under integrity, or on the way to a restricted table."""
        if base not in self.tables:
            raise NotComputable("BLOCKED", "table", f"there is no table {base}")
        narrow = {t for t in self.restricted - {base} if (way := self.ways_up(base).get(t)) is not None}
        strict = {r for t in narrow for r in self.ways_up(base)[t]}
        frame, there = self.tables[base].alias(base), {base}
        for table in sorted({*needed, *narrow} - {base}):
            if table not in self.tables:
                raise NotComputable("BLOCKED", "table", f"there is no table {table}")
            steps = [(r, True) for r in self.ways_up(base)[table]] if table in narrow else self.path(base, table)
            for r, to_one in steps:
                new = (r.one if to_one else r.many).split(".")[0]
                if new not in there:
                    how = "left" if to_one and not r.integrity and r not in strict else "inner"
                    frame = frame.join(self.tables[new].alias(new), F.col(r.many) == F.col(r.one), how)
                    there.add(new)
        return frame

    def ways_up(self, base: str) -> dict[str, tuple[Relationship, ...]]:
        """The tables that base reaches going only to one sides, with the relationships on the way."""
        ways: dict[str, tuple[Relationship, ...]] = {base: ()}
        queue = deque([base])
        while queue:
            here = queue.popleft()
            for r in self.relationships:
                many, one = r.many.split(".")[0], r.one.split(".")[0]
                if r.active and many == here and one not in ways:
                    ways[one] = (*ways[here], r)
                    queue.append(one)
        return ways

    def visible(self, table: str) -> DataFrame:
        """The rows of a table that a restricted model lets through."""
        return self.joined(table, ()).select(f"{table}.*")

    # --- evaluation -------------------------------------------------------------------------------------------------

    def leaves(self, name: str, above: tuple[str, ...] = ()) -> list[Measure]:
        """The aggregates that a measure is made of."""
        if name in above:
            raise NotComputable("BLOCKED", "cycle", " -> ".join((*above, name)))
        if name not in self.measures:
            raise NotComputable("BLOCKED", "measure", f"there is no measure {name}")
        m = self.measures[name]
        if m.build is not None:
            return [m]
        if not m.inputs:
            raise NotComputable("UNSUPPORTED", "constant", f"{name} reads no table")
        found = [leaf for i in m.inputs for leaf in self.leaves(i, (*above, name))]
        shifts = {p for i in (name, *m.inputs) for p in self.shifts(i)} - {"other periods"}
        if len(shifts) > 1:
            raise NotComputable("UNSUPPORTED", "previous", f"{name} looks back by {' and '.join(sorted(shifts))}")
        return found

    def shifts(self, name: str) -> set[str]:
        m = self.measures[name]
        return ({m.previous} if m.previous else set()) | ({"other periods"} if m.shift or m.span else set()) | {p for i in m.inputs if i in self.measures for p in self.shifts(i)}

    def status(self, name: str, grain: Sequence[str] = ()) -> tuple[str, str | None, str | None]:
        """(EXACT | BLOCKED | UNSUPPORTED, construct, reason)."""
        try:
            for leaf in self.leaves(name):
                self.joined(leaf.base, {*leaf.reads, *(g.split(".")[0] for g in grain)})
        except NotComputable as no:
            return no.status, no.construct, no.reason
        return "EXACT", None, None

    def evaluate(
        self,
        names: Sequence[str],
        grain: Sequence[str] = (),
        period: str | None = None,
        year: int | None = None,
        where: Mapping[str, object] | None = None,
        ordered: bool = False,
        dense: bool = False,
    ) -> DataFrame:
        """A row for each group of the grain ('table.column', named by the column) and period, in their order if asked for; a column for each measure.

        dense: each group also has the periods in which it has no rows, from the first to the last of all; every measure is null there.
        """
        where = where or {}
        leaves = {leaf.name: leaf for n in names for leaf in self.leaves(n)}
        if dense or any(self.moving(n) for n in names):
            from . import grains

            frame = grains.evaluate(self, names, grain, period, year, where, dense)
            keys = [*[g.split(".")[-1] for g in grain], *(["period"] if period else [])]
            return frame.orderBy(*keys) if ordered and keys else frame
        keys = [g.split(".")[-1] for g in grain] + (["period"] if period else [])
        by_base: dict[str, list[Measure]] = {}
        for leaf in leaves.values():
            by_base.setdefault(leaf.base, []).append(leaf)
        parts = []
        for base, some in sorted(by_base.items()):
            needed = {c.split(".")[0] for c in (*grain, *where)} | {t for m in some for t in m.reads}
            calendar = self.calendar.get(base)
            if period or year:
                if calendar is None:
                    raise NotComputable("BLOCKED", "calendar", f"{base} has no calendar column")
                needed.add(calendar.split(".")[0])
            frame = self.joined(base, needed)
            if year:
                frame = frame.filter(F.year(calendar) == year)
            for column, value in where.items():
                frame = frame.filter(self.equals(frame, column, value))
            if needed - {base} and (values := [m.distinct() for m in some if m.distinct]):
                # Else a task that joins also holds nearly all its rows' values, as many as adaptive execution gives it.
                keys_of = sorted({r.many for r in self.relationships if r.many.startswith(f"{base}.")})
                frame = frame.repartition(shuffle_tasks(frame.sparkSession), *values, *keys_of)
            by = [F.col(g).alias(g.split(".")[-1]) for g in grain]
            if period:
                by.append(F.date_trunc(period, calendar).alias("period"))
            parts.append(frame.groupBy(*by).agg(*[m.build(Keep()).alias(m.name) for m in some]))
        frame = stitched(parts, keys)
        done = set(leaves)
        for n in names:
            frame = self._derive(frame, n, done, keys)
        frame = frame.select(*keys, *names)
        return frame.orderBy(*keys) if ordered and keys else frame

    @staticmethod
    def equals(frame: DataFrame, column: str, value: object) -> Column:
        """Whether a column has a value, given as it is or as text; None asks for blanks."""
        if value is None:
            return F.col(column).isNull()
        return F.col(column) == F.lit(str(value)).try_cast(frame.select(column).schema[0].dataType)

    def moving(self, name: str) -> bool:
        """Whether a measure, or one it is made of, is seen at another grain or over other periods."""
        m = self.measures[name]
        return m.moves or any(self.moving(i) for i in m.inputs if i != name)

    def scoped(self, leaves: Sequence[Measure], columns: Iterable[str], conditions: Sequence[Mapping[str, object]], year: int | None = None) -> tuple[DataFrame, list[Keep]]:
        """The joined frame of leaves of one base with what the columns need, and for each set of conditions (column to value) the rows it keeps."""
        base = leaves[0].base
        needed = {c.split(".")[0] for c in columns} | {t for m in leaves for t in m.reads}
        calendar = self.calendar.get(base)
        if year:
            if calendar is None:
                raise NotComputable("BLOCKED", "calendar", f"{base} has no calendar column")
            needed.add(calendar.split(".")[0])
        frame = self.joined(base, needed)
        if year:
            frame = frame.filter(F.year(calendar) == year)
        equal = lambda c, v: self.equals(frame, c, v)
        common = [c for c in conditions[0] if all(c in some and some[c] == conditions[0][c] for some in conditions)]
        for c in common:
            frame = frame.filter(equal(c, conditions[0][c]))
        keeps = []
        for some in conditions:
            keep = Keep()
            for c, v in some.items():
                keep = keep if c in common else keep & equal(c, v)
            keeps.append(keep)
        return frame, keeps

    def derived(self, frame: DataFrame, name: str, done: set[str]) -> DataFrame:
        """frame, which has columns of the measures in done, with the measure."""
        return self._derive(frame, name, set(done), [])

    def figures(self, names: Sequence[str] | None = None, implicit: Iterable[str] = ()) -> DataFrame:
        """(measure, value, status, reason, implicit): a figure for each measure over everything, or why there is none.

        What can be computed is computed together. A measure that looks back has a figure for each period, and so no single one.
        """
        names, implicit = list(self.measures) if names is None else list(names), set(implicit)
        states = {n: self.status(n) for n in names}
        refused = {n: (s, why) for n, (s, _, why) in states.items() if s != "EXACT"}
        refused |= {n: ("several rows", "it has a figure for each period, and none for all of them") for n in names if n not in refused and self.shifts(n)}
        whole = [n for n in names if n not in refused]
        spark = next(iter(self.tables.values())).sparkSession
        told = spark.createDataFrame([(n, None, *refused[n], n in implicit) for n in refused], FIGURES)
        if not whole:
            return told
        bases = {n: sorted({leaf.base for leaf in self.leaves(n)}) for n in whole}
        rows = {f"rows of {b}": Measure(f"rows of {b}", b, lambda keep: keep.rows()) for b in sorted({b for some in bases.values() for b in some})}
        counted = Model(self.tables, self.relationships, {**self.measures, **rows}, self.calendar, self.restricted)
        frame = counted.evaluate([*whole, *rows])
        empty = {n: reduce(lambda a, b: a & b, [F.col(f"`rows of {b}`") == 0 for b in bases[n]]) for n in whole}
        found = []
        for n in whole:
            value = F.col(f"`{n}`").try_cast("double") if dict(frame.dtypes)[n] == "string" else F.col(f"`{n}`").cast("double")
            bad = F.isnan(value) | F.abs(value).isin(float("inf"))
            status = F.when(empty[n], "no rows").when(F.col(f"`{n}`").isNull(), "no value").when(value.isNull() | bad, "no number").otherwise("ok")
            found.append(F.struct(F.lit(n).alias("measure"), F.when(status == "ok", value).alias("value"), status.alias("status"), F.lit(n in implicit).alias("implicit")))
        reason = F.when(F.col("status") == "no rows", "its tables have no rows").when(F.col("status") == "no value", "it has no value").when(F.col("status") == "no number", "what it gives is no number")
        return frame.select(F.inline(F.array(*found))).select("measure", "value", "status", reason.alias("reason"), "implicit").unionByName(told)

    def columns_read(self, name: str) -> list[str]:
        """The columns ('table.column') that a measure reads, through the measures it is made of."""
        known = {f"{t}.{c}" for t, df in self.tables.items() for c in df.columns}
        return sorted({c for leaf in self.leaves(name) for c in re.findall(r"\w+\.\w+", str(leaf.build(Keep())))} & known)

    def home(self, name: str) -> str | None:
        """The table a measure belongs to: its base, or that of the first measure it is made of that has one."""
        m = self.measures.get(name)
        return m and (m.base or next((h for i in m.inputs if i != name and (h := self.home(i))), None))

    def lineage(self) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
        """(table, measure, column read) of every measure that can be computed, and (table, measure, reason) of the others."""
        reads, omitted = [], []
        for name in self.measures:
            status, construct, reason = self.status(name)
            table = (None if construct == "cycle" else self.home(name)) or ""
            if status == "EXACT":
                reads += [(table, name, c) for c in self.columns_read(name)]
            else:
                omitted.append((table, name, reason))
        return reads, omitted

    def _derive(self, frame: DataFrame, name: str, done: set[str], keys: list[str]) -> DataFrame:
        if name in done:
            return frame
        m = self.measures[name]
        if m.moves:
            raise NotComputable("UNSUPPORTED", "context", f"{name} is seen at another grain or over other periods")
        for i in m.inputs:
            frame = self._derive(frame, i, done, keys)
        done.add(name)
        if m.previous:
            return frame.withColumn(name, previous(F.col(m.inputs[0]), m.previous, [k for k in keys if k != "period"]))
        return frame.withColumn(name, m.fn(*[F.col(i) for i in m.inputs]))

    def filtered(self, name: str, condition: Column, new: str, reads: tuple[str, ...] = ()) -> str:
        """Declare a measure that is `name` over the rows that also meet the condition; filters inside it stay."""
        m = self.measures[name]
        if m.build is not None:
            states = m.states and replace(m.states, parts=lambda keep: m.states.parts(keep & condition))
            distinct = m.distinct and (lambda: F.when(condition, m.distinct()))
            self.add(replace(m, name=new, build=lambda keep: m.build(keep & condition), reads=(*m.reads, *reads), states=states, distinct=distinct))
        else:
            inputs = tuple(self.filtered(i, condition, f"{new}: {i}", reads) for i in m.inputs)
            self.add(replace(m, name=new, inputs=inputs))
        return new


def previous(value: Column, period: str, partition: Sequence[str], at: str = "period") -> Column:
    """The value a period earlier; NULL unless the row before is that period."""
    w = Window.partitionBy(*partition).orderBy(at)
    return F.when(F.lag(at).over(w) == F.col(at) - F.expr(f"INTERVAL {STEP[period]}"), F.lag(value).over(w))


def stitched(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Aggregates of several bases in one frame: a null-safe FULL join on the keys, or a cross join of single rows without keys."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        if not keys:
            return a.crossJoin(b)  # one row each
        other = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        return a.join(other, same, "full").select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], *[c for c in (*a.columns, *b.columns) if c not in keys])

    return reduce(two, parts)


def as_rows(frame: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, measure, value): one row for each measure, its figure as a double."""
    return frame.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(keys), list(names), "measure", "value")

"""Aggregates that are stored once and answer later questions without the rows.

For each base table the mergeable states of its measures are written at a grain and period. A question is answered from
them if they cover it: each of its measures is made of stored ones, its columns and filters are stored keys, and its period
is a whole number of stored ones. All else goes to the rows, so the answer is the same either way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contexts import periods_in
from .dashboard import dashboard as split_board
from .model import Keep, Measure, Model, NotComputable, stitched


@dataclass(frozen=True)
class Stored:
    """What `store` has written: the model it is of, its path, the key of each column, the period and the measures of each base."""

    model: Model
    path: str
    keys: Mapping[str, str]
    period: str | None
    measures: Mapping[str, tuple[str, ...]]

    def why_not(self, names: Sequence[str], columns: Sequence[str] = (), period: str | None = None, year: int | None = None) -> str | None:
        """What of a question isn't covered; None if all is."""
        known = {n for some in self.measures.values() for n in some}
        for n in names:
            if self.model.moving(n):
                return f"{n} is seen at another grain or over other periods"
            if missing := [leaf.name for leaf in self.model.leaves(n) if leaf.name not in known]:
                return f"{missing[0]} is not stored"
        if missing := [c for c in columns if c not in self.keys]:
            return f"{missing[0]} is no key"
        for asked in ([period] if period else []) + (["year"] if year else []):
            if self.period is None or periods_in(asked, self.period) is None:
                return f"no whole number of stored periods is a {asked}"
        return None

    def own_model(self, base: str) -> Model:
        """The stored aggregates of a base as a table with measures over them."""
        spark = self.model.tables[base].sparkSession
        found = Model({base: spark.read.parquet(f"{self.path}/{base}")}, (), {}, {base: f"{base}.period"} if self.period else {})
        for name in self.measures[base]:
            states = self.model.measures[name].states
            merge = [(lambda keep, name=name, f=f, i=i: f(keep(F.col(f"{base}.`{name} state {i}`")))) for i, f in enumerate(states.merge)]
            rows = lambda keep: F.coalesce(F.sum(keep(F.col(f"{base}.`rows`"))), F.lit(0)) > 0
            found.add(Measure(name, base, lambda keep, m=merge, s=states: F.when(rows(keep), s.finish(*[f(keep) for f in m])).otherwise(F.lit(s.nothing)), format=self.model.measures[name].format))
        return found

    def evaluate(self, names: Sequence[str], grain: Sequence[str] = (), period: str | None = None, year: int | None = None, where: Mapping[str, object] | None = None) -> DataFrame:
        """As Model.evaluate, from the stored aggregates where they cover the question."""
        where = where or {}
        if self.why_not(names, [*grain, *where], period, year):
            return self.model.evaluate(names, grain, period, year, where)
        leaves: dict[str, list[str]] = {}
        for leaf in (leaf for n in names for leaf in self.model.leaves(n)):
            if leaf.name not in leaves.setdefault(leaf.base, []):
                leaves[leaf.base].append(leaf.name)
        keys = [*[g.split(".")[-1] for g in grain], *(["period"] if period else [])]
        parts = []
        for base, some in sorted(leaves.items()):
            at = lambda c: f"{base}.{self.keys[c]}"
            part = self.own_model(base).evaluate(some, [at(g) for g in grain], period, year, {at(c): v for c, v in where.items()})
            parts.append(part.withColumnsRenamed({self.keys[g]: g.split(".")[-1] for g in grain}))
        frame, done = stitched(parts, keys), {n for some in leaves.values() for n in some}
        for n in names:
            frame = self.model._derive(frame, n, done, keys)
        return frame.select(*keys, *[F.col(f"`{n}`") for n in names])

    def dashboard(self, measure: str, splits: Sequence[str], where: Mapping[str, object] | None = None, year: int | None = None) -> DataFrame:
        """As dashboard.dashboard; from the stored aggregates where they cover it and the measure is of one base."""
        where = where or {}
        bases = {leaf.base for leaf in self.model.leaves(measure)}
        if self.why_not([measure], [*splits, *where], year=year) or len(bases) > 1 or self.model.shifts(measure):
            return split_board(self.model, measure, splits, where, year)
        base = bases.pop()
        own = self.own_model(base)
        for m in self.model.measures.values():
            if m.build is None:
                own.add(m)
        at = {c: f"{base}.{k}" for c, k in self.keys.items()}
        board = split_board(own, measure, [at[c] for c in splits], {at[c]: v for c, v in where.items()}, year)
        back = F.create_map(*[F.lit(x) for c in splits for x in (at[c], c)])
        return board.withColumn("by", F.element_at(back, F.col("by")))


def store(model: Model, names: Sequence[str], grain: Sequence[str], path: str, period: str | None = None) -> Stored:
    """Write the states of all that the measures are made of, at a grain ('table.column') and period, for each base under path.

    Measures without states (distinct counts, medians) can't be stored. Two columns of one name have keys of their own.
    """
    leaves: dict[str, dict[str, Measure]] = {}
    for leaf in (leaf for n in names for leaf in model.leaves(n)):
        if leaf.states is None:
            raise NotComputable("UNSUPPORTED", "states", f"{leaf.name} has no states to store")
        leaves.setdefault(leaf.base, {})[leaf.name] = leaf
    keys = {c: f"key{i}_{c.split('.')[-1]}" for i, c in enumerate(grain)}
    for base, some in leaves.items():
        calendar = model.calendar.get(base)
        if period and calendar is None:
            raise NotComputable("BLOCKED", "calendar", f"{base} has no calendar column")
        needed = {c.split(".")[0] for c in grain} | {t for m in some.values() for t in m.reads} | ({calendar.split(".")[0]} if period else set())
        by = [F.col(c).alias(k) for c, k in keys.items()] + ([F.date_trunc(period, calendar).alias("period")] if period else [])
        states = [x.alias(f"{n} state {i}") for n, m in some.items() for i, x in enumerate(m.states.parts(Keep()))]
        model.joined(base, needed).groupBy(*by).agg(*states, Keep().rows().alias("rows")).write.mode("overwrite").parquet(f"{path}/{base}")
    return Stored(model, path, keys, period, {base: tuple(some) for base, some in leaves.items()})

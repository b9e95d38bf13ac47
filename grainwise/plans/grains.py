"""Measures whose parts are seen at several grains, filters and periods, in one result.

Every part of a measure has a context: the columns it is grouped by, the filters it doesn't see, and the span of periods it
runs over. The leaves of one table in all contexts are aggregated in one pass over its rows, by grouping sets, with filters
that differ put around the values; so ratios and distinct counts at a coarser grain come from rows and not from sums of
parts. The aggregates are written once; finer grains then take the coarser figures by a null-safe join on the columns they
share. Spans and shifts work on a spine of all periods, on mergeable states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .contexts import Span, distinct_over, frame_of, periods_in, shifted, spine
from .model import Keep, Measure, Model, NotComputable, previous, stitched


@dataclass(frozen=True)
class Context:
    keys: tuple[str, ...]
    dropped: frozenset[str] = frozenset()
    span: Span | None = None


def checked(model: Model, name: str, context: Context, period: str | None, grain: Mapping[str, str], filters: Sequence[str]) -> list[tuple[str, Context]]:
    """The parts of a measure in the order they are made; refuses what can't be made."""
    m = model.measures[name]
    if m.build is not None:
        if context.span and m.states is None and m.distinct is None:
            raise NotComputable("UNSUPPORTED", "span", f"{name} has no states to merge over periods")
        return [(name, context)]
    inner = within(m, context, grain, filters)
    if m.shift or m.span or m.previous:
        what = f"{name} looks at other periods"
        if "period" not in context.keys:
            raise NotComputable("UNSUPPORTED", "period", f"{what} and needs one in the grain")
        if context.span:
            raise NotComputable("UNSUPPORTED", "span", f"{what}, of which no running figure is made")
        if m.shift and periods_in(m.shift[1], period) is None and (m.shift[1] in ("day", "hour") or period in ("year", "quarter", "month")):
            raise NotComputable("UNSUPPORTED", "period", f"{what} by {m.shift[1]}s, which are no whole {period}s")
        if m.span and periods_in(m.span.unit, period) is None and (m.span.kind == "trailing" or period not in ("day", "hour")):
            raise NotComputable("UNSUPPORTED", "period", f"{what} by {m.span.unit}s, which are no fixed number of {period}s")
    return [part for i in m.inputs for part in checked(model, i, inner, period, grain, filters)] + [(name, context)]


def within(m: Measure, context: Context, grain: Mapping[str, str], filters: Sequence[str]) -> Context:
    """The context of a measure's inputs."""
    if m.over:
        keys = tuple(k for k in context.keys if m.over.keeps(grain[k]))
        return Context(keys, context.dropped | {c for c in filters if not m.over.keeps(c)}, context.span if "period" in keys else None)
    return replace(context, span=m.span) if m.span else context


def evaluate(model: Model, names: Sequence[str], grain: Sequence[str], period: str | None, year: int | None, where: Mapping[str, object], dense: bool) -> DataFrame:
    """As Model.evaluate; dense keeps the periods in which no measure has a figure."""
    own = {g.split(".")[-1]: g for g in grain} | ({"period": "period"} if period else {})
    filters = [*where, *(["period"] if year else [])]
    top = Context(tuple(own))
    parts = list(dict.fromkeys(p for n in names for p in checked(model, n, top, period, own, filters)))
    title = {p: p[0] if p[1] == top else f"{p[0]} \x1f{i}" for i, p in enumerate(parts)}
    leaves = [p for p in parts if model.measures[p[0]].build is not None]
    grids = sorted({p[1].keys for p in parts} | {top.keys}, key=len)
    found = {base: _aggregated(model, base, [p for p in leaves if model.measures[p[0]].base == base], title, grids, own, period, year, where) for base in sorted({model.measures[n].base for n, _ in leaves})}
    made: dict[tuple[str, ...], DataFrame] = {}
    for keys in grids:
        some = [p for p in parts if p[1].keys == keys]
        frame = stitched([pieces[keys] for _, pieces in found.values()], keys)
        timed = any(c.span or model.measures[n].shift for n, c in some)
        if timed:
            frame = spine(staged(frame, "periods"), keys, period)
        for n, c in some:
            frame = _with(frame, model, n, c, title, found, period, own, filters, made)
        if timed:
            shown = [title[p] for p in some if p[1] == top and p[0] in names] if keys == top.keys else []
            if shown and not dense:
                frame = frame.filter(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in shown]))
            frame = frame.drop("_at")
        made[keys] = frame
    return made[top.keys].select(*top.keys, *[F.col(f"`{n}`") for n in names])


def _conditions(model: Model, frame: DataFrame, base: str, year: int | None, where: Mapping[str, object]) -> dict[str, Column]:
    found = {c: model.equals(frame, c, v) for c, v in where.items()}
    return found | ({"period": F.year(model.calendar[base]) == year} if year else {})


def _aggregated(model: Model, base: str, leaves: Sequence[tuple[str, Context]], title, grids, own, period, year, where):
    """(rows, pieces): the joined rows of a base with the conditions on them, and its aggregates for each set of keys."""
    calendar = model.calendar.get(base)
    if (period or year) and calendar is None:
        raise NotComputable("BLOCKED", "calendar", f"{base} has no calendar column")
    measures = {n: model.measures[n] for n, _ in leaves}
    needed = {c.split(".")[0] for k, c in own.items() if k != "period"} | {c.split(".")[0] for c in where} | {t for m in measures.values() for t in m.reads}
    frame = model.joined(base, needed | ({calendar.split(".")[0]} if period or year else set()))
    conditions = _conditions(model, frame, base, year, where)
    contexts = [c for _, c in leaves] + [Context(tuple(own))]
    always = [c for c in conditions if all(c not in x.dropped for x in contexts)]
    for c in always:
        frame = frame.filter(conditions[c])

    def keep(context: Context) -> Keep:
        return reduce(lambda k, c: k & conditions[c], [c for c in conditions if c not in always and c not in context.dropped], Keep())

    by = {k: F.date_trunc(period, calendar) if k == "period" else F.col(c) for k, c in own.items()}
    aggs, columns = [], {keys: [] for keys in grids}
    for n, c in leaves:
        m, name = measures[n], title[n, c]
        if c.span is None:
            made = [(name, m.build(keep(c)))]
        else:
            made = [(f"{name} state {i}", s) for i, s in enumerate(m.states.parts(keep(c)) if m.distinct is None else [])] + [(f"{name} rows", keep(c).rows())]
        aggs += [column.alias(x) for x, column in made]
        columns[c.keys] += [x for x, _ in made]
    top = Context(tuple(own))
    there = f"rows of {base}\x1f"
    aggs.append(keep(top).rows().alias(there))
    frame = frame.select("*", *[column.alias(f"{k}\x1f") for k, column in by.items()])
    cells = {k: F.col(f"`{k}\x1f`") for k in by}
    if len(grids) == 1:
        grouped = frame.groupBy(*[cells[k].alias(k) for k in by]).agg(*aggs)
        return (frame, keep, measures), {grids[0]: grouped.filter(F.col(f"`{there}`") > 0).drop(there) if conditions and len(always) < len(conditions) else grouped.drop(there)}
    sets = [[cells[k] for k in keys] for keys in grids]
    grouped = frame.groupingSets(sets, *cells.values()).agg(*aggs, F.grouping_id().alias("_set"))
    grouped = staged(grouped.withColumnsRenamed({f"{k}\x1f": k for k in by}), "grains")
    bit = {k: 1 << (len(by) - 1 - i) for i, k in enumerate(by)}
    pieces = {}
    for keys in grids:
        rows = grouped.filter(F.col("_set") == sum(b for k, b in bit.items() if k not in keys))
        if keys == top.keys:
            rows = rows.filter(F.col(f"`{there}`") > 0)  # groups that the filters leave
        pieces[keys] = rows.select(*keys, *[F.col(f"`{c}`") for c in columns[keys]])
    return (frame, keep, measures), pieces


def _with(frame: DataFrame, model: Model, name: str, context: Context, title, found, period, own, filters, made) -> DataFrame:
    """frame with one more part, its inputs being there or at a coarser grain."""
    m, new = model.measures[name], title[name, context]
    groups = [k for k in context.keys if k != "period"]
    if m.build is not None:
        if context.span is None:
            return frame
        w = frame_of(context.span, groups, period)
        present = F.sum(f"`{new} rows`").over(w) > 0
        if m.distinct is not None:
            (rows, keep, _), _ = found[m.base]
            values = rows.select(*[F.col(f"`{k}\x1f`").alias(k) for k in context.keys], keep(context)(m.distinct()).alias("_value"))
            frame = frame.withColumn("_present", present)
            frame = distinct_over(values, frame, context.span, groups, period, new)
            return frame.withColumn(new, F.when(F.col("_present"), F.col(f"`{new}`"))).drop("_present")
        merged = [f(F.col(f"`{new} state {i}`")).over(w) for i, f in enumerate(m.states.merge)]
        return frame.withColumn(new, F.when(present, m.states.finish(*merged)))
    inner = within(m, context, own, filters)
    inputs = [title[i, inner] for i in m.inputs]
    if m.over:
        if inner.keys == context.keys:
            return frame.withColumn(new, F.col(f"`{inputs[0]}`"))
        coarse = made[inner.keys].select(*[F.col(k).alias(f"_{k}") for k in inner.keys], F.col(f"`{inputs[0]}`").alias(new))
        if not inner.keys:
            return frame.crossJoin(coarse)  # one row
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in inner.keys])
        return frame.join(coarse, same, "left").drop(*[f"_{k}" for k in inner.keys])
    if m.shift:
        return shifted(frame, f"`{inputs[0]}`", *m.shift, context.keys, period, new)
    if m.span:
        return frame.withColumn(new, F.col(f"`{inputs[0]}`"))
    if m.previous:
        return frame.withColumn(new, previous(F.col(f"`{inputs[0]}`"), m.previous, groups))
    return frame.withColumn(new, m.fn(*[F.col(f"`{i}`") for i in inputs]))

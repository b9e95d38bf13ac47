"""Roles, perspectives and rewritten measures over a model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import Model


def row_role(model: Model, filters: Mapping[str, Column]) -> Model:
    """The model as a role sees it: filtered tables, and of every table on a many side only rows whose one side is left.

    Nothing is joined twice: whatever is evaluated joins the filtered tables it leads to, and inner.
    """
    tables = {t: df.filter(filters[t]) if t in filters else df for t, df in model.tables.items()}
    return Model(tables, model.relationships, model.measures, model.calendar, model.restricted | set(filters))


def hide(model: Model, objects: Sequence[str]) -> Model:
    """The model without some tables ('table') and columns ('table.column')."""
    gone = {o for o in objects if "." not in o}
    columns = {o for o in objects if "." in o}
    tables = {t: df.drop(*[c for c in df.columns if f"{t}.{c}" in columns]) for t, df in model.tables.items() if t not in gone}
    measures = {n: m for n, m in model.measures.items() if m.base not in gone and not gone & set(m.reads)}
    return Model(tables, [r for r in model.relationships if not {r.many.split(".")[0], r.one.split(".")[0]} & gone], measures, model.calendar, model.restricted)


def perspective(model: Model, columns: Mapping[str, Sequence[str]], measures: Sequence[str]) -> Model:
    """Some columns of some tables, the keys of relationships among them, and some measures."""
    keys = {c for r in model.relationships for c in (r.many, r.one)}
    tables = {t: model.tables[t].select(*[c for c in model.tables[t].columns if c in shown or f"{t}.{c}" in keys]) for t, shown in columns.items()}
    kept = [r for r in model.relationships if r.many.split(".")[0] in tables and r.one.split(".")[0] in tables]
    return Model(tables, kept, {n: model.measures[n] for n in measures}, model.calendar, model.restricted)


def calculation_item(model: Model, names: Sequence[str], item: str, rewrite: Callable[[Model, str, str], str]) -> list[str]:
    """Each measure rewritten: rewrite(model, name, new name) declares the variant."""
    return [rewrite(model, n, f"{n}: {item}") for n in names]


def filtered_item(condition: Column, reads: tuple[str, ...] = ()) -> Callable[[Model, str, str], str]:
    return lambda model, name, new: model.filtered(name, condition, new, reads)


def share_item(condition: Column, reads: tuple[str, ...] = ()) -> Callable[[Model, str, str], str]:
    """The measure's share that falls on the rows of a condition."""

    def rewrite(model: Model, name: str, new: str) -> str:
        part = model.filtered(name, condition, f"{new}: part", reads)
        model.add(replace(model.measures[name], name=new, base=None, build=None, inputs=(part, name), fn=lambda a, b: F.try_divide(a, b), previous=None, over=None, shift=None, span=None, states=None, distinct=None))
        return new

    return rewrite


def kpi_status(value: Column, target: Column, near: float = 0.9) -> Column:
    """1: the target is reached; 0: at least `near` of it; -1: less."""
    reached = F.try_divide(value, target)
    return F.when(reached >= 1, 1).when(reached >= near, 0).when(reached.isNotNull(), -1)

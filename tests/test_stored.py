"""Stored aggregates against the rows they are made of."""

import pytest
from test_contexts import model, rows_of  # noqa: F401

from grainwise.plans import dashboard, stored
from grainwise.plans.model import Model, NotComputable


@pytest.fixture(scope="module")
def kept(spark, model, tmp_path_factory):  # noqa: F811
    return stored.store(model, ["value", "share large", "mean", "low", "high"], ["shops.region", "shops.kind"], str(tmp_path_factory.mktemp("stored")), "month")


QUESTIONS = [
    (["value", "sales", "large", "share large", "mean", "low", "high"], ["shops.region"], None, None, {}),
    (["mean", "share large"], ["shops.kind", "shops.region"], "quarter", None, {}),
    (["sales", "value"], [], "year", None, {"shops.region": "North"}),
    (["sales", "mean"], [], None, None, {"shops.region": "nowhere"}),
    (["sales"], ["shops.kind"], "month", 2024, {"shops.region": None}),
]


@pytest.mark.parametrize("question", QUESTIONS)
def test_the_same_answers(kept, model, question):  # noqa: F811
    """From the stored aggregates, whose plan reads no rows, what the rows give."""
    names, grain, period, year, where = question
    assert kept.why_not(names, [*grain, *where], period, year) is None
    got, want = kept.evaluate(*question), model.evaluate(*question)
    assert got.columns == want.columns and rows_of(got, *got.columns) == rows_of(want, *want.columns)
    scans = got._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in scans.lower() and "ExistingRDD" not in scans and "LocalTableScan" not in scans


@pytest.mark.parametrize("names,grain,period,why", [(["buyers"], [], None, "not stored"), (["value"], ["sales.buyer"], None, "no key"), (["value"], [], "day", "no whole number"), (["value"], [], "hour", "no whole number")])
def test_what_is_not_covered_goes_to_the_rows(kept, model, names, grain, period, why):  # noqa: F811
    assert why in kept.why_not(names, grain, period)
    got, want = kept.evaluate(names, grain, period), model.evaluate(names, grain, period)
    assert rows_of(got, *got.columns) == rows_of(want, *want.columns)


def test_without_states(model, tmp_path):  # noqa: F811
    for name in ("buyers", "middle"):
        with pytest.raises(NotComputable, match="no states"):
            stored.store(model, [name], ["shops.region"], str(tmp_path / name))


def test_dashboard(kept, model):  # noqa: F811
    columns = ("by", "label", "value", "folded", "additive", "is_filter")
    for measure, where, year in (("sales", {}, None), ("share large", {"shops.region": "North"}, 2024), ("value", {"shops.kind": "a"}, None)):
        got = kept.dashboard(measure, ["shops.region", "shops.kind"], where, year)
        want = dashboard.dashboard(model, measure, ["shops.region", "shops.kind"], where, year)
        assert rows_of(got, *columns) == rows_of(want, *columns)
    other = kept.dashboard("buyers", ["shops.region"])
    assert rows_of(other, *columns) == rows_of(dashboard.dashboard(model, "buyers", ["shops.region"]), *columns)


def test_of_nothing(model, tmp_path):  # noqa: F811
    empty = Model({**model.tables, "sales": model.tables["sales"].limit(0)}, model.relationships, model.measures, model.calendar)
    kept = stored.store(empty, ["sales", "value"], ["shops.region"], str(tmp_path / "none"))
    assert [tuple(r) for r in kept.evaluate(["sales", "value"]).collect()] == [(0, None)] and kept.evaluate(["sales"], ["shops.region"]).count() == 0

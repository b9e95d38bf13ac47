"""The metrics core on a tiny warehouse whose answers were worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainwise.operators import security
from grainwise.plans import dashboard
from grainwise.plans.model import Measure, Model, NotComputable, Relationship, stitched

D = dt.date


@pytest.fixture(scope="module")
def plant(spark):
    sites = spark.createDataFrame([(1, "North"), (2, "South"), (3, "East")], "site_id int, site_name string")
    batches = spark.createDataFrame(
        [(1, 1, 90, 100, "Released", True, D(2026, 1, 1), D(2026, 1, 11)), (2, 1, 80, 100, "Released", False, D(2026, 1, 1), D(2026, 1, 21)), (3, 2, 50, 100, "Rejected", True, D(2026, 1, 1), D(2026, 1, 6)), (4, 3, 60, 100, "Released", True, D(2026, 1, 1), D(2026, 1, 16))],
        "batch_id int, site_id int, actual int, theoretical int, status string, right_first boolean, made date, released date",
    )
    rows, n = [], 0
    for batch, value in ((1, 10.0), (2, 10.0), (3, 15.0)):
        for i in range(5):
            n += 1
            failed = batch == 1 and i < 2
            rows.append((n, batch, "Fail" if failed else "Pass", (7.0, 5.0)[i] if failed else value, D(2026, 1 if failed else 3, 15)))
    tests = spark.createDataFrame(rows, "test_id int, batch_id int, result string, value double, day date")
    model = Model(
        {"site": sites, "batch": batches, "test": tests},
        [Relationship("batch.site_id", "site.site_id"), Relationship("test.batch_id", "batch.batch_id")],
        {},
        {"test": "test.day", "batch": "batch.made"},
    )
    c = F.col
    return model.add(
        Measure("batches", "batch", lambda k: k.rows()),
        Measure("released", "batch", lambda k: (k & (c("batch.status") == "Released")).rows()),
        Measure("rejected", "batch", lambda k: (k & (c("batch.status") == "Rejected")).rows()),
        Measure("yield", "batch", lambda k: F.try_divide(F.sum(k(c("batch.actual"))), F.sum(k(c("batch.theoretical"))))),
        Measure("days", "batch", lambda k: F.avg(k(F.datediff("batch.released", "batch.made")))),
        Measure("tests", "test", lambda k: k.rows()),
        Measure("failures", "test", lambda k: (k & (c("test.result") == "Fail")).rows()),
        Measure("mean", "test", lambda k: F.avg(k(c("test.value")))),
        Measure("rate", inputs=("failures", "tests"), fn=lambda a, b: F.try_divide(a, b)),
        Measure("rejection rate", inputs=("rejected", "batches"), fn=lambda a, b: F.try_divide(a, b)),
        Measure("quality", inputs=("rejection rate",), fn=lambda r: F.when(r > 0.5, "Above rejection threshold").otherwise("Within expected range")),
        Measure("failures before", inputs=("failures",), previous="month"),
        Measure("failures a year before", inputs=("failures",), previous="year"),
        Measure("both", inputs=("failures before", "failures a year before"), fn=lambda a, b: a + b),
        Measure("a", inputs=("b",), fn=lambda x: x),
        Measure("b", inputs=("a",), fn=lambda x: x),
        Measure("nothing", inputs=(), fn=lambda: F.lit(1)),
    )


def by_site(plant, *names):
    return {r["site_name"]: tuple(r[n] for n in names) for r in plant.evaluate(list(names), ["site.site_name"]).collect()}


def test_by_site(plant):
    assert by_site(plant, "batches", "released", "rejected") == {"North": (2, 2, 0), "South": (1, 0, 1), "East": (1, 1, 0)}
    found = by_site(plant, "yield", "days", "rejection rate", "quality")
    assert found["North"] == (0.85, 15.0, 0.0, "Within expected range")
    assert found["South"] == (0.5, 5.0, 1.0, "Above rejection threshold")


def test_stitching_keeps_a_site_without_tests(plant):
    found = by_site(plant, "tests", "failures", "rate", "mean", "batches")
    assert found == {"North": (10, 2, 0.2, 9.2, 2), "South": (5, 0, 0.0, 15.0, 1), "East": (None, None, None, None, 1)}


def test_previous_month_has_a_gap(plant):
    rows = plant.evaluate(["failures", "failures before"], period="month").orderBy("period").collect()
    assert [(r["period"].month, r["failures"], r["failures before"]) for r in rows] == [(1, 2, None), (3, 0, None)]


def test_refusals(plant):
    assert plant.status("tests", ["site.site_name"]) == ("EXACT", None, None)
    assert plant.status("a")[:2] == ("BLOCKED", "cycle")
    assert plant.status("tests", ["moon.name"])[:2] == ("BLOCKED", "table")
    assert plant.status("nothing")[:2] == ("UNSUPPORTED", "constant")
    assert plant.status("both")[:2] == ("UNSUPPORTED", "previous")
    alone = Model(plant.tables, [], plant.measures)
    assert alone.status("tests", ["site.site_name"])[:2] == ("BLOCKED", "relationship")
    with pytest.raises(NotComputable):
        plant.evaluate(["missing"])


def test_combined_equals_separate(plant):
    together = by_site(plant, "batches", "tests")
    assert {k: v[0] for k, v in together.items()} == {k: v[0] for k, v in by_site(plant, "batches").items()}


def test_stitch_keeps_one_blank_group(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "g string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "g string, b int")
    assert sorted(map(tuple, stitched([a, b], ["g"]).collect()), key=str) == sorted([(None, 1, 3), ("x", 2, None), ("y", None, 4)], key=str)


def test_dashboard_in_one_pass(plant):
    """Splits of a measure over two leaves, against each split by itself; and a refusal where nothing is left."""
    where = {"site.site_name": "North"}
    board = dashboard.dashboard(plant, "rejection rate", ["site.site_name", "batch.status"], where)
    got = {(r["by"], r["label"]): (r["value"], r["is_filter"], r["additive"]) for r in board.collect()}
    assert got == {("site.site_name", "North"): (0.0, True, False), ("site.site_name", "South"): (1.0, True, False), ("site.site_name", "East"): (0.0, True, False), ("batch.status", "Released"): (0.0, False, True)}
    with pytest.raises(NotComputable, match="leave no rows"):
        dashboard.dashboard(plant, "batches", ["batch.status"], {"site.site_name": "Nowhere"})


def test_roles_join_what_they_restrict(plant):
    seen = security.row_role(plant, {"site": F.col("site_name") == "North"})
    assert [tuple(r) for r in seen.evaluate(["batches", "tests"]).collect()] == [(2, 10)]
    assert seen.visible("test").count() == 10 and seen.visible("batch").columns == plant.tables["batch"].columns
    assert seen.evaluate(["batches"], ["site.site_name"]).count() == 1
    both = security.row_role(seen, {"batch": F.col("status") == "Rejected"})
    assert both.evaluate(["tests"]).first()["tests"] == 0


def test_figures_and_reasons(plant):
    found = {r["measure"]: r for r in plant.figures(["batches", "rate", "failures before", "a", "nothing", "quality"], implicit=["rate"]).collect()}
    assert {n: r["status"] for n, r in found.items()} == {"batches": "ok", "rate": "ok", "failures before": "several rows", "a": "BLOCKED", "nothing": "UNSUPPORTED", "quality": "no number"}
    assert found["batches"]["value"] == 4 and found["rate"]["implicit"] and "period" in found["failures before"]["reason"] and "cycle" not in (found["rate"]["reason"] or "")


def test_lineage_goes_through_measures(plant):
    reads, omitted = plant.lineage()
    assert [c for t, m, c in reads if m == "rate"] == ["test.result"] and {t for t, m, _ in reads if m == "rate"} == {"test"}
    assert {m for _, m, _ in omitted} >= {"a", "b", "nothing", "both"}


def test_calendar_needs_one_table(plant, spark):
    days = spark.createDataFrame([(D(2026, 1, d), D(2026, 1, 1)) for d in range(1, 10)], "day date, month date")
    model = Model({**plant.tables, "days": days}, [*plant.relationships, Relationship("test.day", "days.day")])
    dates = {"test": ["day"], "batch": ["made", "released"], "days": ["day", "month"]}
    assert [tuple(r) for r in dashboard.calendar(model, dates).collect()] == [("days", "day", 9)]
    assert dashboard.calendar(model, {**dates, "site": ["opened"]}).count() == 0
    assert dashboard.calendar_tables(model, {**dates, "site": ["opened"]}, marked=["batch"]) == ["batch"]


def test_label_order(spark):
    rows = spark.createDataFrame([("b", 2, D(2020, 1, 1)), ("a", 10, D(2020, 2, 1)), ("b", 3, D(2020, 1, 9)), ("c", 1, D(2020, 1, 20))], "x string, n int, d date")
    of = lambda **k: sorted((r["order_key"], r["label"]) for r in dashboard.label_order(rows, "x", **k).collect())
    assert [x for _, x in of(sort_by="n")] == ["c", "b", "a"] and [x for _, x in of(date="d")] == ["b", "c", "a"]
    assert of() == [] and dashboard.label_order(rows.union(spark.createDataFrame([("b", 1, D(2020, 3, 1))])), "x", date="d").count() == 0
    assert [k for k, _ in of(sort_by="n")] == ["0000000000001.0000", "0000000000002.0000", "0000000000010.0000"]

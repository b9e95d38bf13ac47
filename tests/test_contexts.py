"""Measures at other grains and over other periods, against plain Python over the rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainwise.plans import contexts as ctx
from grainwise.plans.model import Measure, Model, NotComputable, Relationship, distinct_count, highest, lowest, mean, row_count, total

D = dt.date
SHOPS = [(1, "North", "a"), (2, "South", "a"), (3, None, "b")]
#: Shop 3 sells in one month alone; nothing is sold in March; one sale has no day, one no shop, one no buyer.
SALES = [
    (1, 1, 10, 5.0, D(2024, 1, 5)), (2, 1, 11, 7.0, D(2024, 1, 31)), (3, 2, 10, 1.0, D(2024, 2, 1)), (4, 1, 10, 2.0, D(2024, 2, 29)), (5, 1, 12, 4.0, D(2024, 4, 30)),
    (6, 2, 11, 3.0, D(2024, 12, 31)), (7, 3, 13, 8.0, D(2024, 5, 1)), (8, 1, 10, 6.0, D(2025, 1, 2)), (9, 2, 10, 9.0, D(2025, 2, 28)), (10, 1, 14, 1.5, None), (11, None, 15, 2.5, D(2024, 4, 2)), (12, 2, None, 0.5, D(2024, 6, 3)),
]


@pytest.fixture(scope="module")
def model(spark):
    shops = spark.createDataFrame(SHOPS, "shop int, region string, kind string")
    sales = spark.createDataFrame(SALES, "sale int, shop int, buyer int, price double, day date")
    price = lambda: F.col("sales.price")
    return Model({"shops": shops, "sales": sales}, [Relationship("sales.shop", "shops.shop")], {}, {"sales": "sales.day"}).add(
        total("value", "sales", price),
        row_count("sales", "sales"),
        row_count("large", "sales", lambda: F.col("sales.price") > 3),
        mean("mean", "sales", price),
        lowest("low", "sales", price),
        highest("high", "sales", price),
        distinct_count("buyers", "sales", lambda: F.col("sales.buyer")),
        Measure("middle", "sales", lambda keep: F.median(keep(price()))),
        Measure("share large", inputs=("large", "sales"), fn=lambda a, b: F.try_divide(a, b)),
    )


ROWS = [{"sale": s, "shop": p, "buyer": b, "price": x, "day": d, "region": r, "kind": k} for s, p, b, x, d in SALES for r, k in [next(((r, k) for i, r, k in SHOPS if i == p), (None, None))]]


def with_measures(model, *measures):
    return Model(model.tables, model.relationships, dict(model.measures), model.calendar).add(*measures)


def rows_of(df, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((tuple(x.date() if isinstance(x, dt.datetime) else round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in columns))) for r in df.collect()), key=key)


FIGURES = {
    "value": lambda rows: sum(r["price"] for r in rows) if rows else None,
    "sales": lambda rows: len(rows) or None,
    "mean": lambda rows: sum(r["price"] for r in rows) / len(rows) if rows else None,
    "low": lambda rows: min((r["price"] for r in rows), default=None),
    "high": lambda rows: max((r["price"] for r in rows), default=None),
    "buyers": lambda rows: len({r["buyer"] for r in rows} - {None}) if rows else None,
    "share large": lambda rows: sum(r["price"] > 3 for r in rows) / len(rows) if rows else None,
    "middle": lambda rows: (lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2)(sorted(r["price"] for r in rows)) if rows else None,
}


@pytest.mark.parametrize("figure", FIGURES)
def test_other_grains(model, figure):
    """Ratios, medians and distinct counts at the grain that each context leaves, filters removed with it."""
    overs = {"all": ctx.everything(), "just region": ctx.only("shops.region", "sales.price"), "no kind": ctx.without("shops.kind"), "not the filter": ctx.without("sales.price"), "just kind": ctx.all_except("shops", "shops.kind")}
    m = with_measures(model, *[Measure(n, inputs=(figure,), over=o) for n, o in overs.items()])
    got = rows_of(m.evaluate([figure, *overs], ["shops.region", "shops.kind"], where={"sales.price": 3.0}), "region", "kind", figure, *overs)
    want, f = [], FIGURES[figure]
    met = [r for r in ROWS if r["price"] == 3.0]
    for region, kind in sorted({(r["region"], r["kind"]) for r in met}, key=str):
        pick = lambda rows, **k: [r for r in rows if all(r[c] == v for c, v in k.items())]
        want.append((region, kind, f(pick(met, region=region, kind=kind)), f(ROWS), f(pick(met, region=region)), f(pick(met, region=region)), f(pick(ROWS, region=region, kind=kind)), f(pick(met, kind=kind))))
    assert got == [tuple(round(x, 6) if isinstance(x, float) else x for x in w) for w in want]


def test_share_without_rows(model):
    m = with_measures(model, Measure("all", inputs=("sales",), over=ctx.everything()))
    assert m.evaluate(["sales", "all"], ["shops.region"], where={"sales.price": 77.0}).count() == 0
    assert [tuple(r) for r in m.evaluate(["all"], where={"sales.price": 3.0}).collect()] == [(12,)]
    blanks = m.evaluate(["sales"], ["shops.kind"], where={"shops.region": None})
    assert rows_of(blanks, "kind", "sales") == [("b", 1), (None, 1)]


def month(d):
    return d.replace(day=1)


def moved(d, n):
    k = d.year * 12 + d.month - 1 + n
    return D(k // 12, k % 12 + 1, 1)


MONTHS = [moved(D(2024, 1, 1), i) for i in range(14)]
COVERS = {
    "year to date": (ctx.to_date("year"), lambda p, q: q.year == p.year and q <= p),
    "quarter to date": (ctx.to_date("quarter"), lambda p, q: (q.year, (q.month - 1) // 3) == (p.year, (p.month - 1) // 3) and q <= p),
    "last three": (ctx.trailing(3, "month"), lambda p, q: moved(p, -3) < q <= p),
    "last year": (ctx.trailing(1, "year"), lambda p, q: moved(p, -12) < q <= p),
    "quarter before": (ctx.parallel(-1, "quarter"), lambda p, q: (q.year * 4 + (q.month - 1) // 3) == p.year * 4 + (p.month - 1) // 3 - 1),
    "year after": (ctx.parallel(1, "year"), lambda p, q: q.year == p.year + 1),
}


@pytest.mark.parametrize("figure", ["value", "sales", "mean", "low", "high", "buyers", "share large"])
@pytest.mark.parametrize("by_region", [False, True])
def test_running_figures(model, figure, by_region):
    m = with_measures(model, *[Measure(n, inputs=(figure,), span=s) for n, (s, _) in COVERS.items()])
    got = rows_of(m.evaluate(list(COVERS), ["shops.region"] if by_region else [], "month", dense=True).filter("period IS NOT NULL"), *(["region"] if by_region else []), "period", *COVERS)
    dated = [r for r in ROWS if r["day"]]
    want = []
    for region in sorted({r["region"] for r in ROWS}, key=str) if by_region else [()]:
        mine = [r for r in dated if not by_region or r["region"] == region]
        for p in MONTHS:
            found = [FIGURES[figure]([r for r in mine if covers(p, month(r["day"]))]) for _, covers in COVERS.values()]
            want.append((*([region] if by_region else []), p, *[round(x, 6) if isinstance(x, float) else x for x in found]))
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_shifts(model):
    m = with_measures(model, Measure("before", inputs=("sales",), shift=(-1, "month")), Measure("a year on", inputs=("buyers",), shift=(1, "year")), Measure("ytd", inputs=("sales",), span=ctx.to_date("year")), Measure("ytd before", inputs=("ytd",), shift=(-1, "year")))
    frame = m.evaluate(["sales", "before", "a year on", "ytd before"], period="month")
    at = lambda p: [r for r in ROWS if r["day"] and month(r["day"]) == p]
    want = []
    for p in MONTHS:
        ytd = [r for r in ROWS if r["day"] and r["day"].year == p.year - 1 and r["day"].month <= p.month]
        want.append((p, len(at(p)) or None, len(at(moved(p, -1))) or None if moved(p, -1) in MONTHS else None, FIGURES["buyers"](at(moved(p, 12))), len(ytd) or None))
    want = [w for w in want if any(x is not None for x in w[1:])]
    assert rows_of(frame.filter("period IS NOT NULL"), "period", "sales", "before", "a year on", "ytd before") == want
    assert (D(2024, 3, 1), None, 2, None, None) in want  # a gap: no rows, not a count of 0


def test_days_by_months(model):
    """The last days of a longer month look at the last day of a shorter one; hours keep their time."""
    m = with_measures(model, Measure("before", inputs=("sales",), shift=(-1, "month")))
    found = dict(rows_of(m.evaluate(["before"], period="day").filter("period IS NOT NULL AND before IS NOT NULL"), "period", "before"))
    assert {d for d in found if d.month == 3 and d.year == 2024} == {D(2024, 3, d) for d in (1, 29, 30, 31)}
    assert found[D(2024, 3, 30)] == 1 and D(2024, 2, 28) not in found and D(2024, 2, 29) not in found  # the 29th looks at January 29, not 31
    hours = m.evaluate(["before"], period="hour").filter("before IS NOT NULL AND period < '2024-04-01'").collect()
    assert {r["period"] for r in hours} >= {dt.datetime(2024, 2, 5), dt.datetime(2024, 3, 30)}


def test_share_of_running_total(model):
    """A running figure at a coarser grain, and shares of it."""
    m = with_measures(model, Measure("ytd", inputs=("value",), span=ctx.to_date("year")), Measure("ytd of all", inputs=("ytd",), over=ctx.without("shops")), Measure("share", inputs=("ytd", "ytd of all"), fn=lambda a, b: F.try_divide(a, b)))
    got = {(r["region"], r["period"].date()): r["share"] for r in m.evaluate(["share"], ["shops.region"], "month").filter("period IS NOT NULL").collect()}
    total_ = lambda p, rows: sum(r["price"] for r in rows if r["day"] and r["day"].year == p.year and month(r["day"]) <= p)
    for (region, p), share in got.items():
        mine = total_(p, [r for r in ROWS if r["region"] == region])
        assert share == pytest.approx(mine / total_(p, ROWS))


def test_refused_contexts(model):
    m = with_measures(
        model,
        Measure("ytd", inputs=("value",), span=ctx.to_date("year")), Measure("ytd middle", inputs=("middle",), span=ctx.to_date("year")), Measure("twice", inputs=("ytd",), span=ctx.trailing(2, "month")),
        Measure("day before", inputs=("value",), shift=(-1, "day")), Measure("last days", inputs=("value",), span=ctx.trailing(7, "day")),
    )
    for name, period, why in (("ytd", None, "needs one"), ("ytd middle", "month", "no states"), ("twice", "month", "no running figure"), ("day before", "month", "no whole"), ("last days", "month", "no fixed")):
        with pytest.raises(NotComputable, match=why):
            m.evaluate([name], period=period)
    assert {r["measure"]: r["status"] for r in m.figures(["ytd", "value"]).collect()} == {"ytd": "several rows", "value": "ok"}


def test_empty_and_filtered(model):
    m = with_measures(model, Measure("ytd", inputs=("buyers",), span=ctx.to_date("year")), Measure("all", inputs=("buyers",), over=ctx.everything()))
    empty = Model({**m.tables, "sales": m.tables["sales"].limit(0)}, m.relationships, m.measures, m.calendar)
    assert empty.evaluate(["ytd", "all"], ["shops.region"], "month").count() == 0
    m.filtered("ytd", F.col("sales.price") > 3, "large ytd")
    rows = [r for r in ROWS if r["day"] and r["day"].year == 2024 and r["price"] > 3]
    last = {r["period"].date(): r["large ytd"] for r in m.evaluate(["large ytd"], period="month", dense=True).filter("period IS NOT NULL").collect()}
    assert last[D(2024, 12, 1)] == len({r["buyer"] for r in rows}) and last[D(2024, 3, 1)] == 2

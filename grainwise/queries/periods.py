"""Queries over time, windows, order, and the composite jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.names import is_id_like
from ..operators import shape
from ..plans import contexts as ctx
from ..plans import dashboard as dash
from ..plans import stored
from ..plans.model import Measure, Model, Relationship, as_rows, distinct_count, mean
from ..sources.staging import new_path
from ._base import FROM_LINES, SQL, money, query, retail, table

REV = "sum(l_extendedprice * (1 - l_discount))"
MONTHLY = f"SELECT date_trunc('month', o_orderdate)::DATE AS period, {REV} AS revenue FROM {FROM_LINES} GROUP BY 1"


def _gap(model: Model) -> Model:
    """The model without the orders of each March: a month is missing in every year."""
    return Model({**model.tables, "orders": model.tables["orders"].filter(F.month("o_orderdate") != 3)}, [r if r.many != "lineitem.l_orderkey" else type(r)(r.many, r.one, integrity=True) for r in model.relationships], model.measures, model.calendar)


def dated(name, sql):
    """A query whose period is given as text."""

    def add(f):
        query(name, f"SELECT * REPLACE (strftime(period, '%Y-%m-%d') AS period) FROM ({sql})")(lambda spark, d: f(spark, d).withColumn("period", F.date_format("period", "yyyy-MM-dd")))
        return f

    return add


def _dated(df):
    return df.withColumn("period", F.to_date("period"))


@dated("w_prev_period", f"WITH m AS ({MONTHLY}) SELECT period, round(revenue, 4) AS revenue, round(CASE WHEN lag(period) OVER (ORDER BY period) = period - INTERVAL 1 MONTH THEN lag(revenue) OVER (ORDER BY period) END, 4) AS last_month FROM m")
def w_prev_period(spark, d):
    return _dated(retail(spark, d).evaluate(["revenue", "last_month"], period="month")).select("period", *money("revenue", "last_month"))


@dated("w_prev_period_gap", f"""WITH m AS (SELECT c_mktsegment, date_trunc('month', o_orderdate)::DATE AS period, {REV} AS revenue FROM {FROM_LINES} WHERE month(o_orderdate) <> 3 GROUP BY 1, 2)
SELECT c_mktsegment, period, round(CASE WHEN lag(period) OVER w = period - INTERVAL 1 MONTH THEN lag(revenue) OVER w END, 4) AS last_month FROM m WINDOW w AS (PARTITION BY c_mktsegment ORDER BY period)""")
def w_prev_period_gap(spark, d):
    return _dated(_gap(retail(spark, d)).evaluate(["last_month"], ["customer.c_mktsegment"], "month")).select("c_mktsegment", "period", *money("last_month"))


@dated("w_period_variance", f"WITH m AS ({MONTHLY}) SELECT period, round(revenue - CASE WHEN lag(period) OVER (ORDER BY period) = period - INTERVAL 1 MONTH THEN lag(revenue) OVER (ORDER BY period) END, 4) AS month_change FROM m")
def w_period_variance(spark, d):
    return _dated(retail(spark, d).evaluate(["month_change"], period="month")).select("period", *money("month_change"))


BRANDS = f"SELECT p_brand, {REV} AS v FROM {FROM_LINES} LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1"


def _brands(spark, d):
    return retail(spark, d).evaluate(["revenue"], ["part.p_brand"]).select(F.lit("revenue").alias("measure"), F.col("p_brand").alias("label"), F.col("revenue").alias("value"))


@query("w_top_fold", f"""WITH b AS ({BRANDS}), n AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) AS k, count(*) OVER () AS t FROM b)
SELECT CASE WHEN k > 10 THEN (t - 10)::VARCHAR || ' more' ELSE p_brand END AS label, k > 10 AS folded, round(sum(v), 4) AS value FROM n GROUP BY 1, 2""")
def w_top_fold(spark, d):
    return shape.top_fold(_brands(spark, d)).select("label", "folded", *money("value"))


@query("w_first_per_table", "SELECT c_nationkey, min_by(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def w_first_per_table(spark, d):
    return shape.first_per(table(spark, d, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey")


@dated("w_last_n", f"WITH m AS (SELECT c_mktsegment, date_trunc('month', o_orderdate)::DATE AS period, {REV} AS v FROM {FROM_LINES} GROUP BY 1, 2) SELECT c_mktsegment, period, round(v, 4) AS revenue FROM m QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY period DESC) <= 40")
def w_last_n(spark, d):
    series = retail(spark, d).evaluate(["revenue"], ["customer.c_mktsegment"], "month")
    return _dated(shape.last_n(series, 40, ["c_mktsegment"])).select("c_mktsegment", "period", *money("revenue"))


@query("w_disjoint_spans", """WITH s AS (SELECT 'year' AS by_what, year(o_orderdate)::VARCHAR AS lab, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1, 2
UNION ALL SELECT 'status', o_orderstatus, min(o_orderdate), max(o_orderdate) FROM orders GROUP BY 1, 2),
n AS (SELECT *, lead(lo) OVER (PARTITION BY by_what ORDER BY lo, hi) AS nx FROM s) SELECT by_what, bool_and(nx IS NULL OR hi < nx) AS disjoint FROM n GROUP BY 1""")
def w_disjoint_spans(spark, d):
    o = table(spark, d, "orders")
    span = lambda what, c: o.groupBy(F.lit(what).alias("by_what"), c.cast("string").alias("lab")).agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))
    return shape.disjoint_spans(span("year", F.year("o_orderdate")).unionByName(span("status", F.col("o_orderstatus"))), ["by_what"])


@query("w_latest_per_key", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def w_latest_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("w_rank_abs", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey)::BIGINT AS rank FROM customer")
def w_rank_abs(spark, d):
    return shape.ranked_by_size(table(spark, d, "customer"), "c_acctbal", "c_custkey", ["c_nationkey"]).select("c_nationkey", "c_custkey", "rank")


@query("w_share", f"WITH b AS ({BRANDS}) SELECT p_brand, round(v / sum(v) OVER (), 6) AS share FROM b")
def w_share(spark, d):
    return _brands(spark, d).select(F.col("label").alias("p_brand"), F.round(shape.share(F.col("value"), ["measure"]), 6).alias("share"))


@query("l_top_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 400")
def l_top_abs(spark, d):
    return table(spark, d, "customer").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(400).select("c_custkey", "c_acctbal")


@dated("l_first_periods", "SELECT date_trunc('day', o_orderdate)::DATE AS period, count(*)::BIGINT AS order_count FROM orders GROUP BY 1 ORDER BY 1 LIMIT 120")
def l_first_periods(spark, d):
    return _dated(dash.over_time(retail(spark, d), ["order_count"], "day"))


@query("l_order_modes", """WITH p AS (SELECT p_brand AS label, count(*)::BIGINT AS n, min(p_size) AS k FROM part GROUP BY 1)
SELECT 'largest' AS mode, label, row_number() OVER (ORDER BY n DESC, label)::BIGINT AS position FROM p UNION ALL SELECT 'smallest', label, row_number() OVER (ORDER BY n, label)::BIGINT FROM p
UNION ALL SELECT 'label', label, row_number() OVER (ORDER BY regexp_extract(label, '([0-9]+)', 1)::INT, label)::BIGINT FROM p UNION ALL SELECT 'time', label, row_number() OVER (ORDER BY k, label)::BIGINT FROM p""")
def l_order_modes(spark, d):
    parts = table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("value"), F.min("p_size").alias("k"))
    modes = [shape.positions(parts, m, key="k").select(F.lit(m).alias("mode"), "label", F.col("position").cast("long").alias("position")) for m in ("largest", "smallest", "label", "time")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).unionByName(modes[3])


@query("l_sort_by_column", "SELECT p_brand AS label, printf('%018.4f', min(p_size)::DOUBLE) AS order_key FROM part GROUP BY 1")
def l_sort_by_column(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(shape.sort_key(F.min("p_size"), "int").alias("order_key"))


# --- composite jobs -------------------------------------------------------------------------------------------------


@query("d_evaluate_all", f"""SELECT 'revenue' AS measure, round({REV}, 4) AS value FROM lineitem UNION ALL SELECT 'quantity', round(sum(l_quantity), 4) FROM lineitem UNION ALL SELECT 'lines', count(*) FROM lineitem
UNION ALL SELECT 'order_count', count(*) FROM orders UNION ALL SELECT 'order_value', round(sum(o_totalprice), 4) FROM orders UNION ALL SELECT 'return_rate', round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) FROM lineitem""")
def d_evaluate_all(spark, d):
    names = ["revenue", "quantity", "lines", "order_count", "order_value", "return_rate"]
    return as_rows(retail(spark, d).evaluate(names), names).select("measure", *money("value"))


@query("d_calendar_pick", "WITH c AS (SELECT 'o_orderdate' AS column_name, count(DISTINCT o_orderdate::DATE)::BIGINT AS n_distinct FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate::DATE)::BIGINT FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT * FROM c QUALIFY n_distinct = max(n_distinct) OVER () AND count(*) OVER (PARTITION BY n_distinct) = 1")
def d_calendar_pick(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return dash.calendar_choice(rows, ["o_orderdate", "l_shipdate"])


@query("d_calendar", "SELECT 'calendar' AS table_name, 'day' AS column_name, count(DISTINCT o_orderdate::DATE)::BIGINT AS n_distinct FROM orders")
def d_calendar(spark, d):
    m = retail(spark, d)
    days = m.tables["orders"].select(F.to_date("o_orderdate").alias("day"), F.trunc("o_orderdate", "month").alias("month")).distinct()
    with_days = Model({**m.tables, "calendar": days}, [*m.relationships, Relationship("orders.o_orderdate", "calendar.day")], m.measures, m.calendar)
    return dash.calendar(with_days, {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "calendar": ["day", "month"]})


@query("d_usable_periods", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{p}' AS period, count(DISTINCT date_trunc('{p}', ts))::BIGINT AS buckets FROM events" for p in ("year", "quarter", "month", "day", "hour")) + ") SELECT * FROM p WHERE buckets BETWEEN 2 AND 120")
def d_usable_periods(spark, d):
    return dash.usable_periods(table(spark, d, "events"), "ts")


CHARTABLE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c})::BIGINT AS n_distinct FROM {t}" for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("part", "p_size"), ("part", "p_name"), ("nation", "n_name"), ("region", "r_name"), ("customer", "c_name"), ("supplier", "s_name")))


@query("d_chartable", f"SELECT * FROM ({CHARTABLE}) WHERE n_distinct BETWEEN 2 AND 30")
def d_chartable(spark, d):
    return dash.chartable(retail(spark, d), "lineitem").select("table_name", "column_name", "n_distinct")


@query("d_breakdown", f"""WITH b AS ({BRANDS}), n AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) AS k, count(*) OVER () AS t FROM b)
SELECT 'revenue' AS measure, 'part.p_brand' AS by, CASE WHEN k > 10 THEN (t - 10)::VARCHAR || ' more' ELSE p_brand END AS label, k > 10 AS folded, round(sum(v), 4) AS value, true AS additive FROM n GROUP BY ALL""")
def d_breakdown(spark, d):
    return dash.breakdown(retail(spark, d), "revenue", "part.p_brand").select("measure", "by", "label", "folded", "additive", *money("value"))


@query("d_breakdown_ordered", f"""WITH b AS ({BRANDS}), n AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) AS k, count(*) OVER () AS t FROM b), o AS (SELECT p_brand, printf('%018.4f', min(p_size)::DOUBLE) AS order_key FROM part GROUP BY 1)
SELECT CASE WHEN k > 10 THEN (t - 10)::VARCHAR || ' more' ELSE p_brand END AS label, k > 10 AS folded, round(sum(v), 4) AS value, min(CASE WHEN k <= 10 THEN order_key END) AS order_key FROM n LEFT JOIN o USING (p_brand) GROUP BY 1, 2""")
def d_breakdown_ordered(spark, d):
    m = retail(spark, d)
    found = dash.breakdown(m, "revenue", "part.p_brand", order=dash.label_order(m.tables["part"], "p_brand", sort_by="p_size"))
    return found.select("label", "folded", *money("value"), "order_key")


@query("d_period_labels", "SELECT strftime(o_orderdate, '%Y') || ' orders' AS label, min(o_orderdate)::DATE::VARCHAR AS order_key FROM orders GROUP BY 1")
def d_period_labels(spark, d):
    """Years are periods of the order date; order priorities, added to show it, are none, and have no order."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    years = o.withColumn("year", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" orders")))
    return dash.label_order(years, "year", date="day").unionByName(dash.label_order(o, "o_orderpriority", date="day"))


@query("l_ordered_grain", "SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 1")
def l_ordered_grain(spark, d):
    m = retail(spark, d).add(Measure("customers", "customer", lambda keep: keep.rows()))
    return m.evaluate(["customers"], ["nation.n_name"], ordered=True)


@dated("d_over_time", f"SELECT date_trunc('quarter', o_orderdate)::DATE AS period, round({REV}, 4) AS revenue, count(*)::BIGINT AS lines FROM {FROM_LINES} GROUP BY 1 ORDER BY 1 LIMIT 120")
def d_over_time(spark, d):
    return _dated(dash.over_time(retail(spark, d), ["revenue", "lines"], "quarter")).select("period", "lines", *money("revenue"))


def _split_sql(by, column, where, is_filter):
    src = f"SELECT {column} AS label, count(*)::DOUBLE AS value FROM {FROM_LINES} LEFT JOIN part p ON l.l_partkey = p.p_partkey {where} GROUP BY 1"
    return f"""SELECT '{by}' AS by, label, false AS folded, value, {is_filter} AS is_filter FROM ({src}) QUALIFY row_number() OVER (ORDER BY value DESC, label) <= 10
UNION ALL SELECT '{by}', (count(*))::VARCHAR || ' more', true, sum(value), {is_filter} FROM (SELECT * FROM ({src}) QUALIFY row_number() OVER (ORDER BY value DESC, label) > 10) HAVING count(*) > 0"""


@query("d_dashboard", " UNION ALL ".join((_split_sql("region.r_name", "r_name", "WHERE year(o_orderdate) = 1997", "true"), _split_sql("part.p_brand", "p_brand", "WHERE year(o_orderdate) = 1997 AND r_name = 'ASIA'", "false"), _split_sql("orders.o_orderstatus", "o_orderstatus", "WHERE year(o_orderdate) = 1997 AND r_name = 'ASIA'", "false"))))
def d_dashboard(spark, d):
    board = dash.dashboard(retail(spark, d), "lines", ["region.r_name", "part.p_brand", "orders.o_orderstatus"], {"region.r_name": "ASIA"}, 1997)
    return board.select("by", "label", "folded", "value", "is_filter")


_BOARD = SQL["d_dashboard"]


@query("d_dashboard_stored", _BOARD)
def d_dashboard_stored(spark, d):
    """The same board from aggregates that were stored by year; it reads no fact table."""
    m = retail(spark, d)
    kept = stored.store(m, ["lines", "return_rate"], ["region.r_name", "part.p_brand", "orders.o_orderstatus"], new_path(spark, "stored"), "year")
    board = kept.dashboard("lines", ["region.r_name", "part.p_brand", "orders.o_orderstatus"], {"region.r_name": "ASIA"}, 1997)
    return board.select("by", "label", "folded", "value", "is_filter")


@dated("d_stored_figures", f"SELECT date_trunc('quarter', o_orderdate)::DATE AS period, r_name, round({REV}, 4) AS revenue, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS return_rate FROM {FROM_LINES} WHERE year(o_orderdate) = 1998 GROUP BY 1, 2")
def d_stored_figures(spark, d):
    """A ratio and a sum by region and quarter, from months that were stored by region and brand."""
    kept = stored.store(retail(spark, d), ["revenue", "return_rate"], ["region.r_name", "part.p_brand"], new_path(spark, "stored"), "month")
    found = _dated(kept.evaluate(["revenue", "return_rate"], ["region.r_name"], "quarter", 1998))
    return found.select("period", "r_name", *money("revenue"), F.round("return_rate", 6).alias("return_rate"))


@dated("d_sparklines", f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, round(sum(l_quantity), 4) AS quantity, count(*)::DOUBLE AS lines FROM {FROM_LINES} GROUP BY 1),
u AS (UNPIVOT m ON quantity, lines INTO NAME measure VALUE value) SELECT measure, period, value FROM u QUALIFY row_number() OVER (PARTITION BY measure ORDER BY period DESC) <= 40""")
def d_sparklines(spark, d):
    return _dated(dash.sparklines(retail(spark, d), ["quantity", "lines"], "month")).select("measure", "period", *money("value"))


@query("d_places", """WITH c AS (SELECT n_name AS label, n_nationkey * 9.0::DOUBLE - 100 AS lat, n_regionkey * 30.0::DOUBLE - 60 AS lon FROM nation), v AS (SELECT n_name AS label, round(sum(c_acctbal), 4) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT label, lat AS latitude, lon AS longitude, value, min(lat) OVER () AS south, max(lat) OVER () AS north FROM c JOIN v USING (label) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""")
def d_places(spark, d):
    n = table(spark, d, "nation")
    spots = n.select(F.col("n_name").alias("label"), (F.col("n_nationkey") * 9.0 - 100).alias("latitude"), (F.col("n_regionkey") * 30.0 - 60).alias("longitude"))
    values = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("label")).agg(F.round(F.sum("c_acctbal"), 4).alias("value"))
    return dash.places(values, spots).select("label", "latitude", "longitude", "value", "south", "north")


@query("d_map_places", """WITH v AS (SELECT n_name AS label, round(sum(c_acctbal), 4) AS value, any_value(n_nationkey) * 7.0::DOUBLE - 80 AS latitude, any_value(n_regionkey) * 30.0::DOUBLE - 60 AS longitude FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT label, latitude, longitude, value FROM v""")
def d_map_places(spark, d):
    m = retail(spark, d)
    nation = m.tables["nation"].select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") * 7.0 - 80).alias("y"), (F.col("n_regionkey") * 30.0 - 60).alias("Long"))
    m = Model({**m.tables, "nation": nation}, m.relationships, m.measures, m.calendar).add(Measure("balance", "customer", lambda keep: F.sum(keep(F.col("customer.c_acctbal")))))
    return dash.map_places(m, "balance", {"nation": {"y": "Latitude"}}).select("label", "latitude", "longitude", *money("value"))


@query("d_status", "SELECT * FROM (VALUES ('revenue', 'EXACT', NULL), ('last_month', 'EXACT', NULL), ('broken', 'BLOCKED', 'measure'), ('constant', 'UNSUPPORTED', 'constant'), ('lost', 'BLOCKED', 'table'), ('loop', 'BLOCKED', 'cycle')) v(measure, status, construct), (SELECT count(*)::BIGINT AS lines FROM lineitem)")
def d_status(spark, d):
    m = retail(spark, d).add(
        Measure("broken", inputs=("revenue", "no such measure"), fn=lambda a, b: a), Measure("constant", fn=lambda: F.lit(1)), Measure("lost", "no such table", lambda keep: keep.rows()), Measure("loop", inputs=("loop",), fn=lambda a: a)
    )
    rows = [(n, *m.status(n)[:2]) for n in ("revenue", "last_month", "broken", "constant", "lost", "loop")]
    return spark.createDataFrame(rows, "measure string, status string, construct string").crossJoin(m.evaluate(["lines"]))  # one row


_GRAINS = (
    "orders.o_orderstatus", "orders.o_totalprice", "orders.o_orderdate", "orders.o_orderpriority", "part.p_name", "part.p_brand", "part.p_type", "part.p_size", "part.p_retailprice",
    "supplier.s_name", "supplier.s_acctbal", "customer.c_name", "customer.c_acctbal", "customer.c_mktsegment", "nation.n_name", "region.r_name",
)


@query("d_grain_options", "SELECT c AS column_name, (SELECT count(*)::BIGINT FROM lineitem) AS lines FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in _GRAINS) + "]) AS c)")
def d_grain_options(spark, d):
    m = retail(spark, d)
    listed = spark.createDataFrame([(g,) for g in dash.grain_options(m, "lineitem")], "column_name string").filter(~is_id_like(F.col("column_name")))
    return listed.crossJoin(m.evaluate(["lines"]))  # the count of rows they group, one row


# --- measures beyond parity -----------------------------------------------------------------------------------------


FROM_ORDERS = """orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""


def _with_buyers(spark, d) -> Model:
    return retail(spark, d).add(distinct_count("buyers", "orders", lambda: F.col("orders.o_custkey")))


def _share(model: Model, name: str, of: str, over: ctx.Over) -> Model:
    """The model with `name`, a measure's share of itself over other rows."""
    return model.add(Measure(f"{name} whole", inputs=(of,), over=over), Measure(name, inputs=(of, f"{name} whole"), fn=lambda a, b: F.try_divide(a, b)))


@query("e_share_of_all", f"SELECT r_name, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM {FROM_LINES} GROUP BY 1")
def e_share_of_all(spark, d):
    m = _share(retail(spark, d), "share", "lines", ctx.everything())
    return m.evaluate(["share"], ["region.r_name"]).select("r_name", F.round("share", 6).alias("share"))


@query("e_share_distinct", f"""WITH o AS (SELECT * FROM {FROM_ORDERS}),
f AS (SELECT r_name, c_mktsegment, count(DISTINCT o_custkey) AS buyers FROM o WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 GROUP BY 1, 2),
g AS (SELECT r_name, count(DISTINCT o_custkey) AS region_buyers FROM o WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 GROUP BY 1),
s AS (SELECT r_name, c_mktsegment, count(DISTINCT o_custkey) AS any_status FROM o WHERE year(o_orderdate) = 1997 GROUP BY 1, 2)
SELECT f.r_name, f.c_mktsegment, f.buyers, round(f.buyers / g.region_buyers, 6) AS of_region, round(f.buyers / s.any_status, 6) AS of_status, round(f.buyers / (SELECT count(DISTINCT o_custkey) FROM o), 6) AS of_all
FROM f JOIN g ON f.r_name IS NOT DISTINCT FROM g.r_name JOIN s ON f.r_name IS NOT DISTINCT FROM s.r_name AND f.c_mktsegment IS NOT DISTINCT FROM s.c_mktsegment""")
def e_share_distinct(spark, d):
    """Shares of a distinct count, which no sum of parts gives: without the segment, without the filter on the status, and of everything."""
    m = _with_buyers(spark, d)
    for name, over in (("of_region", ctx.all_except("customer", "customer.c_custkey")), ("of_status", ctx.without("orders.o_orderstatus")), ("of_all", ctx.everything())):
        m = _share(m, name, "buyers", over)
    found = m.evaluate(["buyers", "of_region", "of_status", "of_all"], ["region.r_name", "customer.c_mktsegment"], where={"orders.o_orderstatus": "F"}, year=1997)
    return found.select("r_name", "c_mktsegment", "buyers", *[F.round(c, 6).alias(c) for c in ("of_region", "of_status", "of_all")])


@query("e_share_in_period", f"""WITH m AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS period, r_name, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS rate FROM {FROM_LINES} GROUP BY 1, 2),
t AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS period, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS rate FROM {FROM_LINES} GROUP BY 1)
SELECT strftime(m.period, '%Y-%m-%d') AS period, r_name, round(m.lines / t.lines, 6) AS share, round(m.rate - t.rate, 6) AS above FROM m JOIN t ON m.period = t.period""")
def e_share_in_period(spark, d):
    """A region's share of each quarter, and its rate of returns above that of all regions: a ratio at a coarser grain."""
    m = _share(retail(spark, d), "share", "lines", ctx.only("period"))
    m.add(Measure("rate of all", inputs=("return_rate",), over=ctx.without("region")), Measure("above", inputs=("return_rate", "rate of all"), fn=lambda a, b: a - b))
    found = _dated(m.evaluate(["share", "above"], ["region.r_name"], "quarter")).withColumn("period", F.date_format("period", "yyyy-MM-dd"))
    return found.select("period", "r_name", *[F.round(c, 6).alias(c) for c in ("share", "above")])


@query("e_rank", f"WITH b AS ({BRANDS}) SELECT p_brand, rank() OVER (ORDER BY round(v, 4) DESC)::BIGINT AS place FROM b")
def e_rank(spark, d):
    return _brands(spark, d).select(F.col("label").alias("p_brand"), F.rank().over(Window.partitionBy("measure").orderBy(F.desc(F.round("value", 4)))).cast("long").alias("place"))


@query("e_use_relationship", "SELECT n_name, count(*)::BIGINT AS lines FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def e_use_relationship(spark, d):
    m = retail(spark, d)
    over_supplier = next(r for r in m.relationships if r.many == "supplier.s_nationkey")
    # Its tables' other way to the nations is turned off, as the path must be one.
    m = Model(m.tables, [r for r in m.relationships if r.many != "customer.c_nationkey"], m.measures, m.calendar)
    return m.using(over_supplier).evaluate(["lines"], ["nation.n_name"])


@dated("e_same_period_last_year", f"WITH m AS ({MONTHLY}) SELECT a.period, round(a.revenue, 4) AS revenue, round(b.revenue, 4) AS last_year FROM m a LEFT JOIN m b ON b.period = a.period - INTERVAL 1 YEAR")
def e_same_period_last_year(spark, d):
    m = retail(spark, d).add(Measure("last_year", inputs=("revenue",), shift=(-1, "year")))
    return _dated(m.evaluate(["revenue", "last_year"], period="month")).select("period", *money("revenue", "last_year"))


_SPINE = "p AS (SELECT unnest(generate_series((SELECT min(date_trunc('month', o_orderdate)) FROM orders WHERE month(o_orderdate) <> 3), (SELECT max(date_trunc('month', o_orderdate)) FROM orders WHERE month(o_orderdate) <> 3), INTERVAL 1 MONTH))::DATE AS period)"


@dated("e_shifts", f"""WITH {_SPINE}, m AS (SELECT c_mktsegment, date_trunc('month', o_orderdate)::DATE AS period, count(DISTINCT o_custkey)::BIGINT AS buyers, count(*)::BIGINT AS order_count FROM {FROM_ORDERS} WHERE month(o_orderdate) <> 3 GROUP BY 1, 2),
s AS (SELECT DISTINCT c_mktsegment FROM m), y AS (SELECT c_mktsegment, year(period) AS y, sum(order_count)::BIGINT AS n FROM m GROUP BY 1, 2)
SELECT s.c_mktsegment, p.period, m.buyers, a.buyers AS month_before, b.buyers AS year_before, c.buyers AS two_on, y.n AS whole_year_before FROM s CROSS JOIN p
LEFT JOIN m ON m.c_mktsegment = s.c_mktsegment AND m.period = p.period LEFT JOIN m a ON a.c_mktsegment = s.c_mktsegment AND a.period = p.period - INTERVAL 1 MONTH
LEFT JOIN m b ON b.c_mktsegment = s.c_mktsegment AND b.period = p.period - INTERVAL 1 YEAR LEFT JOIN m c ON c.c_mktsegment = s.c_mktsegment AND c.period = p.period + INTERVAL 2 MONTH
LEFT JOIN y ON y.c_mktsegment = s.c_mktsegment AND y.y = year(p.period) - 1
WHERE coalesce(m.buyers, a.buyers, b.buyers, c.buyers, y.n) IS NOT NULL""")
def e_shifts(spark, d):
    """Several shifts of a distinct count in one result, by segment, with each March missing; and the whole year before."""
    m = _with_buyers(spark, d)
    m = Model({**m.tables, "orders": m.tables["orders"].filter(F.month("o_orderdate") != 3)}, m.relationships, m.measures, m.calendar).add(
        Measure("month_before", inputs=("buyers",), shift=(-1, "month")),
        Measure("year_before", inputs=("buyers",), shift=(-1, "year")),
        Measure("two_on", inputs=("buyers",), shift=(2, "month")),
        Measure("whole_year_before", inputs=("order_count",), span=ctx.parallel(-1, "year")),
    )
    return _dated(m.evaluate(["buyers", "month_before", "year_before", "two_on", "whole_year_before"], ["customer.c_mktsegment"], "month"))


@dated("e_shift_days", "WITH m AS (SELECT o_orderdate::DATE AS period, count(*)::BIGINT AS order_count FROM orders GROUP BY 1) SELECT a.period, a.order_count, b.order_count AS month_before FROM m a LEFT JOIN m b ON b.period = a.period - INTERVAL 1 MONTH")
def e_shift_days(spark, d):
    """Days against the same day of the month before; the last days of longer months against its last."""
    m = retail(spark, d).add(Measure("month_before", inputs=("order_count",), shift=(-1, "month")))
    return _dated(m.evaluate(["order_count", "month_before"], period="day").filter("order_count IS NOT NULL"))


@dated("e_year_to_date", f"WITH m AS ({MONTHLY}) SELECT period, round(sum(revenue) OVER (PARTITION BY year(period) ORDER BY period), 4) AS ytd, round(sum(revenue) OVER (ORDER BY period RANGE BETWEEN INTERVAL 2 MONTHS PRECEDING AND CURRENT ROW), 4) AS trailing FROM m")
def e_year_to_date(spark, d):
    m = retail(spark, d).add(Measure("ytd", inputs=("revenue",), span=ctx.to_date("year")), Measure("trailing", inputs=("revenue",), span=ctx.trailing(3, "month")))
    return _dated(m.evaluate(["ytd", "trailing"], period="month")).select("period", *money("ytd", "trailing"))


@dated("e_trailing_distinct", f"""WITH {_SPINE.replace("WHERE month(o_orderdate) <> 3", "")}, o AS (SELECT c_mktsegment, date_trunc('month', o_orderdate)::DATE AS at, o_custkey, o_totalprice FROM {FROM_ORDERS}), s AS (SELECT DISTINCT c_mktsegment FROM o),
t AS (SELECT s.c_mktsegment, period, count(DISTINCT o_custkey)::BIGINT AS buyers_3 FROM s CROSS JOIN p JOIN o ON o.c_mktsegment = s.c_mktsegment AND o.at <= period AND o.at > period - INTERVAL 3 MONTH GROUP BY 1, 2),
q AS (SELECT s.c_mktsegment, period, count(DISTINCT o_custkey)::BIGINT AS buyers_qtd, round(avg(o_totalprice) + 0.00001, 4) AS mean_ytd FROM s CROSS JOIN p JOIN o ON o.c_mktsegment = s.c_mktsegment AND o.at <= period AND year(o.at) = year(period) GROUP BY 1, 2),
r AS (SELECT s.c_mktsegment, period, count(DISTINCT o_custkey)::BIGINT AS buyers_qtd FROM s CROSS JOIN p JOIN o ON o.c_mktsegment = s.c_mktsegment AND o.at <= period AND date_trunc('quarter', o.at) = date_trunc('quarter', period) GROUP BY 1, 2)
SELECT t.c_mktsegment, t.period, t.buyers_3, r.buyers_qtd, q.mean_ytd, l.buyers_3 AS buyers_3_last_year FROM t LEFT JOIN r USING (c_mktsegment, period) LEFT JOIN q USING (c_mktsegment, period) LEFT JOIN t l ON l.c_mktsegment = t.c_mktsegment AND l.period = t.period - INTERVAL 1 YEAR""")
def e_trailing_distinct(spark, d):
    """Distinct buyers of the last three months and of the quarter so far, the year's mean so far, and the first a year earlier. (The mean is put off the ties that two engines round differently.)"""
    m = _with_buyers(spark, d).add(
        mean("mean order", "orders", lambda: F.col("orders.o_totalprice")),
        Measure("buyers_3", inputs=("buyers",), span=ctx.trailing(3, "month")),
        Measure("buyers_qtd", inputs=("buyers",), span=ctx.to_date("quarter")),
        Measure("mean_ytd", inputs=("mean order",), span=ctx.to_date("year")),
        Measure("buyers_3_last_year", inputs=("buyers_3",), shift=(-1, "year")),
    )
    found = _dated(m.evaluate(["buyers_3", "buyers_qtd", "mean_ytd", "buyers_3_last_year"], ["customer.c_mktsegment"], "month"))
    return found.select("c_mktsegment", "period", "buyers_3", "buyers_qtd", F.round(F.col("mean_ytd") + 0.00001, 4).alias("mean_ytd"), "buyers_3_last_year")


@query("e_rollup", "SELECT r_name, n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def e_rollup(spark, d):
    m = retail(spark, d)
    return m.joined("customer", ["nation", "region"]).rollup("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("e_spread", "SELECT l_returnflag, round(stddev_pop(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS v, round(median(l_quantity), 4) AS m FROM lineitem GROUP BY 1")
def e_spread(spark, d):
    q = "l_quantity"
    lines = table(spark, d, "lineitem")
    spread = lines.groupBy("l_returnflag").agg(F.round(F.stddev_pop(q), 4).alias("sd"), F.round(F.var_pop(q), 4).alias("v"))
    return spread.join(shape.medians(lines, ["l_returnflag"], q, "m").withColumn("m", F.round("m", 4)), "l_returnflag")




"""Queries on load steps, security and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import security, steps
from ..streaming import jobs
from ._base import FROM_LINES, money, query, ratio, retail, table


@query("t_rows", "SELECT o_orderkey FROM (SELECT DISTINCT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000) QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) > 100 AND row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= 5100 AND row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) > 50")
def t_rows(spark, d):
    rows = table(spark, d, "orders").filter("o_totalprice > 1000").select("o_orderkey", "o_totalprice").distinct()
    return steps.row_range(rows, ["o_totalprice", "o_orderkey"], 100, 5000, 50).select("o_orderkey")


@query("t_group", "SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def t_group(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("t_combine", "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def t_combine(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return steps.combine([c, table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))])


@query("t_nested_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def t_nested_join(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    nested = steps.nested_join(c, o, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey"], "orders")
    return steps.expand(nested, "orders", ["o_orderkey", "o_totalprice"])


@query("t_columns", "SELECT c_name AS name, c_custkey AS id, c_acctbal FROM customer")
def t_columns(spark, d):
    return table(spark, d, "customer").drop("c_mktsegment", "c_nationkey").withColumnsRenamed({"c_name": "name", "c_custkey": "id"}).select("name", "id", "c_acctbal")


@query("t_transform", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS props, upper(event_type) AS event_type, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS kind, value * 2 AS twice FROM events")
def t_transform(spark, d):
    e = table(spark, d, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("props"), F.upper("event_type").alias("event_type"), F.col("event_type").alias("kind"), (F.col("value") * 2).alias("twice"))
    return steps.replace_value(steps.cast_columns(e, {"props": "int"}), "kind", "click", "tap")


@query("t_index", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS index FROM orders")
def t_index(spark, d):
    return steps.add_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "index")


@query("t_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def t_pivot(spark, d):
    return steps.pivot(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1))).fillna(0)


@query("t_unpivot", "SELECT l_orderkey, attribute, value FROM (SELECT l_orderkey, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR attribute IN (l_discount, l_tax))")
def t_unpivot(spark, d):
    return steps.unpivot_others(table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_tax"), ["l_orderkey"])


@query("t_fill", """WITH v AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS x FROM events)
SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS down, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up FROM v""")
def t_fill(spark, d):
    x = F.when(F.col("event_type") != "error", F.col("event_type"))
    e = table(spark, d, "events").select("user_id", "event_id", "ts", x.alias("down"), x.alias("up"))
    return steps.fill(steps.fill(e, "down", ["user_id"], ["ts", "event_id"]), "up", ["user_id"], ["ts", "event_id"], down=False).select("event_id", "down", "up")


@query("t_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def t_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("t_xml", "SELECT p_partkey, p_name AS name, p_size::BIGINT AS size FROM part")
def t_xml(spark, d):
    xml = F.format_string("<part><name>%s</name><size>%d</size></part>", "p_name", "p_size")
    read = F.from_xml(xml, "name string, size long")
    return table(spark, d, "part").select("p_partkey", read.getField("name").alias("name"), read.getField("size").alias("size"))


@query("t_calendar", "SELECT strftime(unnest(generate_series(date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM orders")
def t_calendar(spark, d):
    return steps.calendar(table(spark, d, "orders"), "o_orderdate").select(F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("t_summarize", f"SELECT r_name, l_returnflag, round(sum(l_quantity), 4) AS quantity, 2 * count(*)::BIGINT AS twice FROM {FROM_LINES} GROUP BY 1, 2")
def t_summarize(spark, d):
    frame = retail(spark, d).evaluate(["quantity", "lines"], ["region.r_name", "lineitem.l_returnflag"])
    return frame.select("r_name", "l_returnflag", *money("quantity"), (2 * F.col("lines")).alias("twice"))


@query("t_logged", "SELECT 0 AS n, 'filter' AS step, (SELECT count(*)::BIGINT FROM orders) AS rows_in, (SELECT count(*)::BIGINT FROM orders WHERE o_totalprice > 1000) AS rows_out UNION ALL SELECT 1, 'statuses', (SELECT count(*)::BIGINT FROM orders WHERE o_totalprice > 1000), (SELECT count(DISTINCT o_orderstatus)::BIGINT FROM orders WHERE o_totalprice > 1000)")
def t_logged(spark, d):
    todo = [("filter", lambda df: df.filter("o_totalprice > 1000")), ("statuses", lambda df: df.select("o_orderstatus").distinct())]
    return steps.logged(table(spark, d, "orders"), todo)[1]


# --- security, rewritten measures -----------------------------------------------------------------------------------


@query("x_row_role", f"SELECT n_name, count(*)::BIGINT AS lines FROM {FROM_LINES} WHERE r_name = 'ASIA' GROUP BY 1")
def x_row_role(spark, d):
    seen = security.row_role(retail(spark, d), {"region": F.col("r_name") == "ASIA"})
    return seen.evaluate(["lines"], ["nation.n_name"])


@query("x_hide_column", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def x_hide_column(spark, d):
    return security.hide(retail(spark, d), ["customer.c_acctbal", "supplier"]).tables["customer"]


@query("x_perspective", f"SELECT c_mktsegment, count(*)::BIGINT AS lines FROM {FROM_LINES} GROUP BY 1")
def x_perspective(spark, d):
    seen = security.perspective(retail(spark, d), {"lineitem": [], "orders": [], "customer": ["c_mktsegment"]}, ["lines"])
    return seen.evaluate(["lines"], ["customer.c_mktsegment"])


@query("x_calc_item", f"SELECT r_name, count(*) FILTER (WHERE l_quantity > 25)::BIGINT AS large_lines, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25)::BIGINT AS large_returned, round(sum(l_quantity) FILTER (WHERE l_quantity > 25) / sum(l_quantity), 4) AS large_share FROM {FROM_LINES} GROUP BY 1")
def x_calc_item(spark, d):
    m, large = retail(spark, d), F.col("lineitem.l_quantity") > 25
    a, b = security.calculation_item(m, ["lines", "returned"], "large", security.filtered_item(large))
    c = security.calculation_item(m, ["quantity"], "share of large", security.share_item(large))[0]
    frame = m.evaluate([a, b, c], ["region.r_name"])
    return frame.select("r_name", F.col(f"`{a}`").alias("large_lines"), F.col(f"`{b}`").alias("large_returned"), F.col(f"`{c}`").alias("large_share")).select("r_name", "large_lines", "large_returned", *ratio("large_share"))


@query("x_kpi_status", f"SELECT c_mktsegment, n_name, CASE WHEN v >= 1 THEN 1 WHEN v >= 0.9 THEN 0 WHEN v IS NOT NULL THEN -1 END AS status FROM (SELECT c_mktsegment, n_name, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) / 0.34 AS v FROM {FROM_LINES} GROUP BY 1, 2)")
def x_kpi_status(spark, d):
    frame = retail(spark, d).evaluate(["return_rate"], ["customer.c_mktsegment", "nation.n_name"])
    return frame.select("c_mktsegment", "n_name", security.kpi_status(F.col("return_rate"), F.lit(0.34)).alias("status"))


# --- streams --------------------------------------------------------------------------------------------------------


def _stream(spark, d):
    # As a pattern: a stream of a plain path must be a folder.
    return jobs.events_stream(spark, f"{d}/events.parque[t]", spark.read.parquet(f"{d}/events.parquet").schema)


@query("st_tumbling", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st_tumbling(spark, d):
    found = jobs.run_available(jobs.tumbling(_stream(spark, d)), "tumbling")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", *money("total"))


@query("st_standing", "SELECT user_id AS id, max_by(event_type, ts) AS verdict FROM events GROUP BY 1")
def st_standing(spark, d):
    return jobs.standing_stream(_stream(spark, d).select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("verdict")))


WEEK = 7 * 24 * 3600
QUOTA = """WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS request, ts FROM events),
w AS (SELECT client, min(ts) AS start FROM e GROUP BY 1 UNION ALL SELECT w.client, min(e.ts) FROM w JOIN e ON e.client = w.client AND e.ts >= w.start + INTERVAL 7 DAYS GROUP BY w.client)
SELECT e.client, e.request, row_number() OVER (PARTITION BY e.client, w.start ORDER BY e.ts, e.request) <= 3 AS allowed FROM e ASOF JOIN w ON e.client = w.client AND e.ts >= w.start"""


@query("st_quota", QUOTA)
def st_quota(spark, d):
    requests = _stream(spark, d).select(F.col("user_id").alias("client"), F.col("event_id").alias("request"), "ts")
    return jobs.quota_stream(requests, seconds=WEEK)


@query("st_quota_batch", QUOTA)
def st_quota_batch(spark, d):
    return jobs.quota_batch(table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request"), "ts"), seconds=WEEK)

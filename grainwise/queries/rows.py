"""Queries on rows: projections, filters, joins, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import shape
from ..plans.model import Measure, Model, Relationship, as_rows, distinct_count
from ..sources import stores
from ..sources import tables as src
from ..sources.staging import new_path
from ._base import FROM_LINES, RELATIONSHIPS, money, query, ratio, retail, table

# --- scans ----------------------------------------------------------------------------------------------------------

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("s_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*)::BIGINT AS n_rows FROM {n}" for n in NAMES))
def s_table_counts(spark, d):
    return src.counts({n: table(spark, d, n) for n in NAMES})


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp"}


@query("s_catalog_columns", "WITH n AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*)::BIGINT AS n_rows FROM {n}" for n in NAMES) + ") SELECT c.table_name, (row_number() OVER (PARTITION BY c.table_name ORDER BY c.column_index) - 1)::INT AS position, c.column_name, CASE c.data_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " ELSE lower(c.data_type) END AS data_type, n.n_rows FROM duckdb_columns() c JOIN n USING (table_name) WHERE c.schema_name = 'main' AND c.database_name NOT IN ('system', 'temp')")
def s_catalog_columns(spark, d):
    for n in NAMES:
        table(spark, d, n).createOrReplaceTempView(n)
    return src.harvest(spark, NAMES)


@query("s_tolerant_json", "SELECT event_type, count(*)::BIGINT AS n_rows, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events WHERE json_valid(props) AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL GROUP BY 1")
def s_tolerant_json(spark, d):
    read = src.tolerant_json(table(spark, d, "events"), "props", "k long", required=("k",))
    return read.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.sum("k").alias("k"))


@query("s_csv", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def s_csv(spark, d):
    """The customers, written as CSV with a header and read back under a schema."""
    path = new_path(spark, "csv")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows.write.csv(path, header=True)
    return src.read_csv(spark, path, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes))


@query("s_snapshot", "SELECT doc_id::VARCHAR AS id, lang AS kind, source AS name, sha256(text) AS fingerprint FROM documents WHERE lang <> 'de'")
def s_snapshot(spark, d):
    """Two snapshots of the documents under one path, of which one is read back."""
    path = new_path(spark, "snapshots")
    objects = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("name"), F.sha2("text", 256).alias("fingerprint"))
    stores.save_snapshot(objects, path, "all")
    stores.save_snapshot(objects.filter("kind <> 'de'"), path, "without German")
    return stores.load_snapshot(spark, path, "without German")


@query("s_decisions", "SELECT doc_id::VARCHAR AS id, CASE quality WHEN 1 THEN 'accepted' ELSE 'rejected' END AS verdict FROM labels WHERE quality IS NOT NULL UNION ALL SELECT item_id::VARCHAR, 'deferred' FROM benchmark")
def s_decisions(spark, d):
    """Decisions appended in three steps; those of an unknown verdict are left out when they are read."""
    path = new_path(spark, "decisions")
    decide = lambda df, key, verdict: df.select(F.col(key).cast("string").alias("id"), F.current_timestamp().alias("at"), verdict.alias("verdict"), F.lit("a reviewer").alias("by"), F.array().cast("array<string>").alias("fingerprints"))
    stores.append_decisions(decide(table(spark, d, "labels"), "doc_id", F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected")), path)
    stores.append_decisions(decide(table(spark, d, "benchmark"), "item_id", F.lit("deferred")), path)
    stores.append_decisions(decide(table(spark, d, "nation"), "n_nationkey", F.lit("perhaps")), path)
    return stores.read_decisions(spark, path).select("id", "verdict")


@query("s_manifest", """SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE quality = 1)::BIGINT AS confident, count(*) FILTER (WHERE quality = 0)::BIGINT AS awaiting_review,
  count(*) FILTER (WHERE doc_id IS NOT NULL AND quality IS NULL)::BIGINT AS gaps, count(DISTINCT lang)::BIGINT AS kinds FROM documents LEFT JOIN labels USING (doc_id)""")
def s_manifest(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return src.manifest(rows, confident=F.col("quality") == 1, awaiting=F.col("quality") == 0, gap=F.col("quality").isNull(), kind="lang")


# --- projections and filters ----------------------------------------------------------------------------------------


@query("p_calc_column", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net FROM lineitem GROUP BY 1")
def p_calc_column(spark, d):
    lines = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lines.groupBy("l_returnflag").agg(F.round(F.sum("net"), 4).alias("net"))


@query("p_compare", """SELECT count(*) FILTER (WHERE l_quantity = 10)::BIGINT AS eq, count(*) FILTER (WHERE l_quantity <> 10)::BIGINT AS ne, count(*) FILTER (WHERE l_quantity < 10)::BIGINT AS lt,
  count(*) FILTER (WHERE l_quantity <= 10)::BIGINT AS le, count(*) FILTER (WHERE l_quantity > 10)::BIGINT AS gt, count(*) FILTER (WHERE l_quantity >= 10)::BIGINT AS ge FROM lineitem""")
def p_compare(spark, d):
    q = F.col("l_quantity")
    tests = {"eq": q == 10, "ne": q != 10, "lt": q < 10, "le": q <= 10, "gt": q > 10, "ge": q >= 10}
    return table(spark, d, "lineitem").agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


@query("p_bool_logic", "SELECT l_linestatus, count(*)::BIGINT AS n FROM lineitem WHERE (l_discount > 0.05 AND NOT l_returnflag = 'A') OR l_tax = 0 GROUP BY 1")
def p_bool_logic(spark, d):
    kept = ((F.col("l_discount") > 0.05) & ~(F.col("l_returnflag") == "A")) | (F.col("l_tax") == 0)
    return table(spark, d, "lineitem").filter(kept).groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("p_in_set", "SELECT l_linestatus, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def p_in_set(spark, d):
    return table(spark, d, "lineitem").filter(flt.one_of("l_returnflag", ["A", "R"])).groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("p_isblank", "SELECT count(*) FILTER (WHERE o_orderkey IS NULL)::BIGINT AS blank, count(*) FILTER (WHERE o_orderkey IS NOT NULL)::BIGINT AS filled FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def p_isblank(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.agg(F.count_if(F.col("o_orderkey").isNull()).alias("blank"), F.count_if(F.col("o_orderkey").isNotNull()).alias("filled"))


@query("p_measure_filter", f"SELECT c_mktsegment, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS returned, count(*)::BIGINT AS lines FROM {FROM_LINES} GROUP BY 1")
def p_measure_filter(spark, d):
    return retail(spark, d).evaluate(["returned", "lines"], ["customer.c_mktsegment"])


@query("p_nested_filter", f"SELECT c_mktsegment, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05)::BIGINT AS deep FROM {FROM_LINES} GROUP BY 1")
def p_nested_filter(spark, d):
    m = retail(spark, d)
    return m.evaluate([m.filtered("returned", F.col("lineitem.l_discount") > 0.05, "deep")], ["customer.c_mktsegment"])


@query("p_admissible", "SELECT 'quantity' AS condition, count(*) FILTER (WHERE l_quantity > 25)::BIGINT AS n FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (WHERE l_returnflag IN ('A', 'R'))::BIGINT FROM lineitem")
def p_admissible(spark, d):
    """Rows that each admissible condition keeps: sums, numbers and columns of other tables are no conditions."""
    lines = table(spark, d, "lineitem")
    asked = {"quantity": F.col("l_quantity") > 25, "flag": F.col("l_returnflag").isin("A", "R"), "aggregate": F.sum("l_quantity") > 1, "number": F.col("l_tax") + 1, "elsewhere": F.col("o_orderkey") > 0}
    kept = {name: c for name, c in asked.items() if flt.admissible(c, lines)}
    return as_rows(lines.agg(*[F.count_if(c).alias(n) for n, c in kept.items()]), list(kept)).select(F.col("measure").alias("condition"), F.col("value").cast("long").alias("n"))


@query("p_year_filter", f"SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {FROM_LINES} WHERE year(o_orderdate) = 1997 GROUP BY 1")
def p_year_filter(spark, d):
    return retail(spark, d).evaluate(["revenue"], ["customer.c_mktsegment"], year=1997).select("c_mktsegment", *money("revenue"))


@query("p_cross_filter", f"SELECT p_brand, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {FROM_LINES} LEFT JOIN part p ON l.l_partkey = p.p_partkey WHERE r_name = 'ASIA' AND p_size = 10 GROUP BY 1")
def p_cross_filter(spark, d):
    return retail(spark, d).evaluate(["revenue"], ["part.p_brand"], where={"region.r_name": "ASIA", "part.p_size": 10}).select("p_brand", *money("revenue"))


@query("p_var_reuse", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * l_tax), 2) AS charged FROM lineitem GROUP BY 1")
def p_var_reuse(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(net + net * F.col("l_tax")), 2).alias("charged"))


@query("p_measure_of_measures", f"SELECT r_name, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS return_rate FROM {FROM_LINES} GROUP BY 1")
def p_measure_of_measures(spark, d):
    return retail(spark, d).evaluate(["return_rate"], ["region.r_name"]).select("r_name", *ratio("return_rate"))


@query("p_column_owner", """WITH cols AS (SELECT props AS name, event_type AS tab FROM events), own AS (SELECT name, count(DISTINCT tab) AS n, min(tab) AS tab FROM cols GROUP BY 1)
SELECT name, CASE WHEN n = 1 THEN tab END AS owner, n::BIGINT AS owners FROM own""")
def p_column_owner(spark, d):
    cols = table(spark, d, "events").select(F.col("props").alias("name"), F.col("event_type").alias("tab"))
    return flt.owner(cols, "name", "tab")


@query("p_report_filter_topn", """WITH top AS (SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('P') AND o_totalprice >= 1000 GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 5)
SELECT c_mktsegment, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT c_nationkey FROM top) AND o_orderstatus NOT IN ('P') AND o_totalprice >= 1000 GROUP BY 1""")
def p_report_filter_topn(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    scopes = {
        "report": [{"column": "o_orderstatus", "op": "not in", "values": ["P"]}],
        "page": [{"column": "o_totalprice", "op": ">=", "value": 1000}],
        "visual": [{"column": "c_nationkey", "op": "top", "n": 5, "by": F.sum("o_totalprice")}],
    }
    return flt.report_filters(rows, scopes).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


# --- joins ----------------------------------------------------------------------------------------------------------


def _orphaned(spark, d, **kind) -> Model:
    """orders and the customers of a positive balance: other orders have no customer."""
    customers = table(spark, d, "customer").filter("c_acctbal > 0")
    m = Model({"orders": table(spark, d, "orders"), "customer": customers}, [Relationship("orders.o_custkey", "customer.c_custkey", **kind)])
    return m.add(
        Measure("n", "orders", lambda keep: keep.rows()),
        Measure("balance", "customer", lambda keep: F.sum(keep(F.col("customer.c_acctbal")))),
    )


@query("j_left_to_one", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1")
def j_left_to_one(spark, d):
    return _orphaned(spark, d).evaluate(["n"], ["customer.c_mktsegment"])


@query("j_inner_to_many", "SELECT o_orderstatus, round(sum(c_acctbal), 4) AS balance FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def j_inner_to_many(spark, d):
    return _orphaned(spark, d).evaluate(["balance"], ["orders.o_orderstatus"]).select("o_orderstatus", *money("balance"))


@query("j_assume_integrity", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def j_assume_integrity(spark, d):
    return _orphaned(spark, d, integrity=True).evaluate(["n"], ["customer.c_mktsegment"])


@query("j_snowflake_path", f"SELECT r_name, n_name, count(*)::BIGINT AS lines FROM {FROM_LINES} GROUP BY 1, 2")
def j_snowflake_path(spark, d):
    return retail(spark, d).evaluate(["lines"], ["region.r_name", "nation.n_name"])


@query("j_inactive_ignored", f"SELECT n_name, count(*)::BIGINT AS lines FROM {FROM_LINES} GROUP BY 1")
def j_inactive_ignored(spark, d):
    # The relationship from supplier to nation is inactive: the way leads over customer.
    return retail(spark, d).evaluate(["lines"], ["nation.n_name"])


@query("j_stitch_full", f"""WITH a AS (SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {FROM_LINES} GROUP BY 1),
b AS (SELECT c_mktsegment, count(*)::BIGINT AS order_count, round(sum(o_totalprice), 4) AS order_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment, revenue, order_count, order_value FROM a FULL JOIN b ON a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment""")
def j_stitch_full(spark, d):
    return retail(spark, d).evaluate(["revenue", "order_count", "order_value"], ["customer.c_mktsegment"]).select("c_mktsegment", "order_count", *money("revenue", "order_value"))


@query("j_stitch_cross", "SELECT (SELECT count(*)::BIGINT FROM lineitem) AS lines, (SELECT count(*)::BIGINT FROM orders) AS order_count")
def j_stitch_cross(spark, d):
    return retail(spark, d).evaluate(["lines", "order_count"])


@query("j_list", " UNION ALL ".join(f"SELECT '{r.many}' AS from_column, '{r.one}' AS to_column, 'many to one' AS cardinality, {str(r.active).lower()} AS active, false AS both_directions, 'LEFT JOIN {r.one.split(chr(46))[0]} ON {r.many} = {r.one}' AS sql_clause, count(*)::BIGINT AS orphans FROM {r.many.split(chr(46))[0]} WHERE {r.many.split(chr(46))[1]} IS NULL OR {r.many.split(chr(46))[1]} NOT IN (SELECT {r.one.split(chr(46))[1]} FROM {r.one.split(chr(46))[0]})" for r in RELATIONSHIPS))
def j_list(spark, d):
    m = retail(spark, d)
    listed = src.relationship_rows(spark, RELATIONSHIPS)
    # With how many keys of the many side have no partner, counted over the tables.
    orphans = [
        m.tables[r.many.split(".")[0]].join(m.tables[r.one.split(".")[0]], F.col(r.many.split(".")[1]) == F.col(r.one.split(".")[1]), "left_anti").agg(F.count("*").alias("orphans")).withColumn("from_column", F.lit(r.many)).withColumn("to_column", F.lit(r.one))
        for r in RELATIONSHIPS
    ]
    found = orphans[0]
    for more in orphans[1:]:
        found = found.unionByName(more)
    return listed.join(found, ["from_column", "to_column"])


@query("j_field_resolve", """WITH f AS (SELECT event_id, event_type AS field FROM events),
m AS (SELECT DISTINCT event_type AS name FROM events WHERE value > 30), c AS (SELECT DISTINCT event_type AS name FROM events WHERE value < 1)
SELECT CASE WHEN m.name IS NOT NULL THEN 'measure' WHEN c.name IS NOT NULL THEN 'column' ELSE 'unresolved' END AS resolved, count(*)::BIGINT AS n
FROM f LEFT JOIN m ON f.field = m.name LEFT JOIN c ON f.field = c.name GROUP BY 1""")
def j_field_resolve(spark, d):
    e = table(spark, d, "events")
    resolved = flt.resolve_fields(e.select(F.col("event_type").alias("field")), e.filter("value > 30").select("event_type"), e.filter("value < 1").select("event_type"))
    return resolved.groupBy("resolved").agg(F.count("*").alias("n"))


@query("j_unresolved_anti", """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no such customer' ELSE 'no line' END AS reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def j_unresolved_anti(spark, d):
    o, c, li = (table(spark, d, n) for n in ("orders", "customer", "lineitem"))
    missing = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return missing.select("o_orderkey", F.when(F.col("c_custkey").isNull(), "no such customer").otherwise("no line").alias("reason"))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("a_basic", "SELECT l_returnflag, round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def a_basic(spark, d):
    q = "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(q), 4).alias("s"), F.round(F.avg(q), 4).alias("a"), F.min(q).alias("lo"), F.max(q).alias("hi"))


@query("a_count_nonnull", "SELECT c_mktsegment, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a_count_nonnull(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n"))


@query("a_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS n FROM lineitem GROUP BY 1")
def a_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))


@query("a_count_rows", "SELECT count(*)::BIGINT AS lines FROM lineitem")
def a_count_rows(spark, d):
    return retail(spark, d).evaluate(["lines"])


@query("a_median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1")
def a_median(spark, d):
    return shape.medians(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("median", 4).alias("m"))


@query("a_conditional", "SELECT l_linestatus, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_suppkey END)::BIGINT AS n, round(avg(CASE WHEN l_tax > 0 THEN l_quantity END), 4) AS q FROM lineitem GROUP BY 1")
def a_conditional(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))).alias("n"), F.round(F.avg(F.when(F.col("l_tax") > 0, F.col("l_quantity"))), 4).alias("q")
    )


@query("a_divide", "SELECT l_returnflag, round(coalesce(count(*) FILTER (WHERE l_quantity > 49) / nullif(count(*) FILTER (WHERE l_tax < 0), 0), -1), 4) AS none, round(sum(l_tax) / nullif(count(*), 0), 4) AS tax FROM lineitem GROUP BY 1")
def a_divide(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("l_quantity") > 49), F.count_if(F.col("l_tax") < 0)), F.lit(-1.0)), 4).alias("none"), F.round(F.try_divide(F.sum("l_tax"), F.count("*")), 4).alias("tax")
    )


@query("a_arith", "SELECT l_returnflag, round(sum(l_extendedprice) - sum(l_extendedprice * l_discount) + 2 * count(*), 4) AS x FROM lineitem GROUP BY 1")
def a_arith(spark, d):
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(p) - F.sum(p * F.col("l_discount")) + 2 * F.count("*"), 4).alias("x"))


@query("a_grain_multi", f"SELECT r_name, c_mktsegment, l_returnflag, count(*)::BIGINT AS lines, round(sum(l_quantity), 4) AS quantity FROM {FROM_LINES} GROUP BY ALL")
def a_grain_multi(spark, d):
    return retail(spark, d).evaluate(["lines", "quantity"], ["region.r_name", "customer.c_mktsegment", "lineitem.l_returnflag"]).select("r_name", "c_mktsegment", "l_returnflag", "lines", *money("quantity"))


@query("a_whole", """SELECT 'revenue' AS measure, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value, 'ok' AS status, false AS implicit FROM lineitem UNION ALL SELECT 'lines', count(*)::DOUBLE, 'ok', true FROM lineitem
UNION ALL SELECT * FROM (VALUES ('nothing', NULL, 'no value', false), ('last_month', NULL, 'several rows', false), ('infinite', NULL, 'no number', false), ('of none', NULL, 'no rows', false), ('worded', NULL, 'no number', false), ('broken', NULL, 'BLOCKED', false), ('constant', NULL, 'UNSUPPORTED', false))""")
def a_whole(spark, d):
    m = retail(spark, d)
    m.filtered("revenue", F.col("lineitem.l_quantity") < 0, "nothing")
    m = Model({**m.tables, "none": m.tables["orders"].filter("o_orderkey < 0")}, m.relationships, m.measures, m.calendar)
    m.add(
        Measure("infinite", inputs=("lines",), fn=lambda n: n * F.lit(float("inf"))), Measure("of none", "none", lambda keep: F.sum(keep(F.col("none.o_totalprice")))), Measure("worded", inputs=("lines",), fn=lambda n: F.when(n > 0, "many")),
        Measure("broken", inputs=("revenue", "no such measure"), fn=lambda a, b: a), Measure("constant", inputs=(), fn=lambda: F.lit(1)),
    )
    found = m.figures(["revenue", "nothing", "lines", "last_month", "infinite", "of none", "worded", "broken", "constant"], implicit=["lines"])
    return found.select("measure", F.round("value", 4).alias("value"), "status", "implicit")


@query("a_combined", f"""WITH a AS (SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_quantity), 4) AS quantity, count(*)::BIGINT AS lines, round(avg(l_discount), 4) AS discount FROM {FROM_LINES} GROUP BY 1),
b AS (SELECT r_name, count(*)::BIGINT AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT coalesce(a.r_name, b.r_name) AS r_name, revenue, quantity, lines, discount, order_count, round(revenue / order_count, 1) AS revenue_per_order FROM a FULL JOIN b ON a.r_name IS NOT DISTINCT FROM b.r_name""")
def a_combined(spark, d):
    names = ["revenue", "quantity", "lines", "discount", "order_count", "revenue_per_order"]
    return retail(spark, d).evaluate(names, ["region.r_name"]).select("r_name", "lines", "order_count", *money("revenue", "quantity"), *ratio("discount"), F.round("revenue_per_order", 1).alias("revenue_per_order"))


@query("a_implicit", """WITH v AS (SELECT l_returnflag AS tile, unnest(['sum', 'avg', 'sum', 'max', 'count']) AS agg, unnest(['quantity', 'tax', 'orderkey', 'discount', 'orderkey']) AS col, 'lineitem' AS tab FROM lineitem
  UNION ALL SELECT o_orderstatus, unnest(['avg', 'count', 'sum']), unnest(['totalprice', 'orderkey', 'orderstatus']), 'orders' FROM orders),
g AS (SELECT agg, tab, col, count(DISTINCT tile)::BIGINT AS tiles, (SELECT count(DISTINCT tab) FROM v w WHERE w.col = v.col) > 1 AS shared FROM v GROUP BY ALL)
SELECT upper(agg[1]) || agg[2:] || ' of ' || CASE WHEN shared THEN tab || '[' || col || ']' ELSE col END AS name, agg, tab AS "table", col, tiles FROM g
WHERE NOT (agg IN ('sum', 'avg') AND (regexp_matches(col, '(id|key)$') OR col = 'orderstatus')) AND NOT (agg = 'max' AND col = 'discount')""")
def a_implicit(spark, d):
    def shown(name, tile, picked):
        fields = F.explode(F.array(*[F.struct(F.lit(a).alias("agg"), F.lit(c).alias("col")) for a, c in picked]))
        return table(spark, d, name).select(F.col(tile).alias("tile"), F.lit(name).alias("table"), fields.alias("f")).select("tile", "table", "f.*")

    tiles = shown("lineitem", "l_returnflag", (("sum", "quantity"), ("avg", "tax"), ("sum", "orderkey"), ("max", "discount"), ("count", "orderkey"))).unionByName(shown("orders", "o_orderstatus", (("avg", "totalprice"), ("count", "orderkey"), ("sum", "orderstatus"))))
    columns = spark.createDataFrame([(t, c.split("_", 1)[1], k) for t in ("lineitem", "orders") for c, k in table(spark, d, t).dtypes], "table string, col string, data_type string")
    return flt.implicit_measures(tiles, columns, spark.createDataFrame([("max of DISCOUNT",)], "name string"))


@query("a_profile", "SELECT 'c_mktsegment' AS column_name, count(DISTINCT c_mktsegment)::BIGINT AS n_distinct, min(c_mktsegment) AS sample FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name)::BIGINT, min(c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey)::BIGINT, min(c_nationkey)::VARCHAR FROM customer")
def a_profile(spark, d):
    return src.profile(table(spark, d, "customer"), ["c_mktsegment", "c_name", "c_nationkey"])


@query("a_additive", f"""WITH p AS (SELECT c_mktsegment, sum(l_quantity) AS q, count(DISTINCT l_partkey) AS parts FROM {FROM_LINES} GROUP BY 1), w AS (SELECT sum(l_quantity) AS q, count(DISTINCT l_partkey) AS parts FROM lineitem)
SELECT 'quantity' AS measure, abs(sum(p.q) - any_value(w.q)) <= 1e-9 * greatest(abs(any_value(w.q)), 1) AS additive FROM p, w UNION ALL SELECT 'parts', abs(sum(p.parts) - any_value(w.parts)) <= 1e-9 * greatest(abs(any_value(w.parts)), 1) FROM p, w""")
def a_additive(spark, d):
    m = retail(spark, d).add(distinct_count("parts", "lineitem", lambda: F.col("lineitem.l_partkey")))
    names = ["quantity", "parts"]
    return flt.additive(as_rows(m.evaluate(names, ["customer.c_mktsegment"]), names, ["c_mktsegment"]), as_rows(m.evaluate(names), names))


@query("a_kind_counts", "SELECT event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*)::BIGINT FROM events")
def a_kind_counts(spark, d):
    counts = table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("event_type", F.lit("total")).alias("kind"), "n")


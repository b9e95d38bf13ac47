"""Queries on definitions: the documents, as definitions in two snapshots, and the keys of the star schema, as a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..plans.catalog import drift, evaluable, graph, listing, reconcile, requirements, rules, search
from ..plans.model import Measure
from ..sources import stores
from ..sources.staging import new_path, shuffle_tasks
from ._base import RELATIONSHIPS, query, retail, table

OBJ = """a AS (SELECT doc_id::VARCHAR AS id, lang AS kind, source || ' ' || doc_id AS name, text AS expression, sha256(text) AS fingerprint FROM documents),
b AS (SELECT CASE WHEN source = 'src5' THEN 'r' || doc_id ELSE doc_id::VARCHAR END AS id, lang AS kind, CASE WHEN lang = 'de' THEN sha256(text || ' + 1') ELSE sha256(text) END AS fingerprint FROM documents WHERE source <> 'src3'
  UNION ALL SELECT 'b' || item_id, 'en', sha256(text) FROM benchmark),
diff AS (SELECT coalesce(a.id, b.id) AS id, coalesce(b.kind, a.kind) AS kind, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.fingerprint = b.fingerprint THEN 'unchanged' ELSE 'changed' END AS status,
  a.fingerprint AS old_fp, b.fingerprint AS new_fp FROM a FULL JOIN b ON a.id = b.id),
gone AS (SELECT id, kind, old_fp AS fp FROM diff WHERE status = 'removed' QUALIFY count(*) OVER (PARTITION BY kind, old_fp) = 1),
come AS (SELECT id, kind, new_fp AS fp FROM diff WHERE status = 'added' QUALIFY count(*) OVER (PARTITION BY kind, new_fp) = 1),
renamed AS (SELECT gone.id AS old_id, come.id AS new_id, gone.kind FROM gone JOIN come USING (kind, fp)),
happened AS (SELECT id, status AS event, true AS is_semantic FROM diff WHERE status <> 'unchanged' AND id NOT IN (SELECT old_id FROM renamed UNION SELECT new_id FROM renamed) UNION ALL SELECT old_id, 'renamed', false FROM renamed),
req AS (SELECT source AS requirement, doc_id::VARCHAR AS id FROM documents),
touched AS (SELECT requirement, count(*)::BIGINT AS n_events, CASE WHEN bool_or(is_semantic) THEN 'revalidate' ELSE 'reference update' END AS action FROM req JOIN happened USING (id) GROUP BY 1)"""


def before(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind"), F.concat("source", F.lit(" "), "doc_id").alias("name"), F.col("text").alias("expression"), fingerprint(F.col("text")).alias("fingerprint")
    )


def after(spark, d):
    """The documents a version later: one source is gone, one is renamed, the German texts are changed, the benchmark is new."""
    docs = table(spark, d, "documents").filter("source <> 'src3'")
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit(" + 1"))).otherwise(F.col("text"))
    doc_id = F.when(F.col("source") == "src5", F.concat(F.lit("r"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    kept = docs.select(doc_id.alias("id"), F.col("lang").alias("kind"), fingerprint(text).alias("fingerprint"))
    new = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("en").alias("kind"), fingerprint(F.col("text")).alias("fingerprint"))
    return kept.unionByName(new)


def _requirements(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("requirement"), F.col("doc_id").cast("string").alias("id"))


def _diff(spark, d):
    return drift.diff(before(spark, d), after(spark, d))


@query("c_snapshot", f"WITH {OBJ} SELECT id, kind, fingerprint FROM a")
def c_snapshot(spark, d):
    return before(spark, d).select("id", "kind", "fingerprint")


@query("c_drift_diff", f"WITH {OBJ} SELECT id, kind, status FROM diff")
def c_drift_diff(spark, d):
    return _diff(spark, d).select("id", "kind", "status")


@query("c_drift_digests", f"WITH {OBJ} SELECT id, kind, status, old_fp AS old_fingerprint, new_fp AS new_fingerprint FROM diff WHERE status <> 'unchanged'")
def c_drift_digests(spark, d):
    """Two stored snapshots compared by the digests of their buckets first."""
    path = new_path(spark, "digested")
    for label, side in (("before", before(spark, d)), ("after", after(spark, d))):
        stores.save_digested(side.select("id", "kind", "fingerprint"), path, label)
    return drift.changes_between(spark, path, "before", "after")


@query("c_rename", f"WITH {OBJ} SELECT * FROM renamed")
def c_rename(spark, d):
    return drift.renames(_diff(spark, d))


@query("c_affected", f"WITH {OBJ} SELECT * FROM touched")
def c_affected(spark, d):
    return drift.affected(_requirements(spark, d), drift.events(_diff(spark, d)))


@query("c_change_rows", f"WITH {OBJ} SELECT h.id, event, CASE event WHEN 'changed' THEN 0 WHEN 'removed' THEN 1 WHEN 'added' THEN 2 ELSE 3 END AS event_order, req.requirement FROM happened h LEFT JOIN req USING (id)")
def c_change_rows(spark, d):
    return drift.change_rows(drift.events(_diff(spark, d)), _requirements(spark, d))


@query("c_drift_gate", f"WITH {OBJ} SELECT (SELECT count(*)::BIGINT FROM happened) AS n_events, (SELECT count(*)::BIGINT FROM happened WHERE is_semantic) AS n_semantic, (SELECT count(*)::BIGINT FROM touched WHERE action = 'revalidate') AS n_revalidate, (SELECT count(*) > 0 FROM happened WHERE is_semantic) AS fails")
def c_drift_gate(spark, d):
    happened = drift.events(_diff(spark, d))
    return drift.gate(happened, drift.affected(_requirements(spark, d), happened), models=("documents", "documents"))


# --- graph ----------------------------------------------------------------------------------------------------------

EDGES = """e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'references' FROM orders
UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'reads' FROM lineitem)"""
NODES = "n AS (" + " UNION ALL ".join(f"SELECT '{t}:' || {k} AS id, '{t}' AS kind FROM {t}" for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))) + ")"


def keys_rows(spark, d):
    """Nodes and edges of the keys, table by table; they may repeat."""
    t = lambda n: table(spark, d, n)
    node = lambda n, k: t(n).select(F.concat(F.lit(f"{n}:"), k).alias("id"), F.lit(n).alias("kind"))
    edge = lambda df, a, b, x, y, kind: df.select(F.concat(F.lit(f"{a}:"), x).alias("src"), F.concat(F.lit(f"{b}:"), y).alias("dst"), F.lit(kind).alias("kind"))
    nodes = [node(n, k) for n, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))]
    edges = [
        edge(t("nation"), "region", "nation", "n_regionkey", "n_nationkey", "contains"),
        edge(t("customer"), "nation", "customer", "c_nationkey", "c_custkey", "contains"),
        edge(t("orders"), "customer", "orders", "o_custkey", "o_orderkey", "references"),
        edge(t("lineitem"), "orders", "part", "l_orderkey", "l_partkey", "reads"),
    ]
    return nodes, edges


def keys_graph(spark, d):
    return graph.build(*keys_rows(spark, d))


@query("c_graph_build", f"WITH {EDGES}, {NODES} SELECT 'node' AS what, kind, count(*)::BIGINT AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*)::BIGINT FROM e GROUP BY 2")
def c_graph_build(spark, d):
    return graph.stats(*keys_graph(spark, d))


@query("s_graph_export", f"WITH {EDGES}, {NODES} SELECT 'node' AS what, id AS a, kind AS b FROM n UNION ALL SELECT 'edge', src, dst FROM e")
def s_graph_export(spark, d):
    nodes, edges = keys_graph(spark, d)
    return nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("kind").alias("b")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"))).repartitionByRange(shuffle_tasks(spark), "what", "a", "b").sortWithinPartitions("what", "a", "b")


@query("c_dependencies", """SELECT 'region:' || n_regionkey AS start, count(DISTINCT n_nationkey)::BIGINT AS nations, count(DISTINCT c_custkey)::BIGINT AS customers, count(DISTINCT o_orderkey)::BIGINT AS orders, count(DISTINCT l_partkey)::BIGINT AS parts
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def c_dependencies(spark, d):
    nodes, edges = map(graph.union, keys_rows(spark, d))
    reach = graph.closure(edges, nodes.filter("kind = 'region'"))
    of = lambda kind: F.count_if(F.col("id").startswith(f"{kind}:"))
    return reach.groupBy("start").agg(of("nation").alias("nations"), of("customer").alias("customers"), of("orders").alias("orders"), of("part").alias("parts"))


@query("c_impact", """SELECT 'nation:' || c_nationkey AS start, 'region:' || n_regionkey AS id, 1 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 1 FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def c_impact(spark, d):
    nodes, edges = keys_graph(spark, d)
    used = edges.filter("kind = 'contains'")
    starts = nodes.filter("kind = 'customer'").select("id").unionByName(used.filter(F.col("dst").startswith("customer:")).select(F.col("src").alias("id")))
    return graph.closure(used, starts, backwards=True)


@query("c_neighbourhood", f"""WITH {EDGES}, {NODES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d1 AS (SELECT DISTINCT dst AS id, 1 AS depth FROM u WHERE src = 'nation:3'),
d2 AS (SELECT DISTINCT dst AS id, 2 AS depth FROM u JOIN d1 ON u.src = d1.id WHERE dst <> 'nation:3' AND dst NOT IN (SELECT id FROM d1)), r AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2)
SELECT id, kind, depth, greatest(count(*) OVER w - 12, 0)::BIGINT AS more FROM r JOIN n USING (id) WINDOW w AS (PARTITION BY kind, depth) QUALIFY row_number() OVER (PARTITION BY kind, depth ORDER BY id) <= 12""")
def c_neighbourhood(spark, d):
    nodes, edges = map(graph.union, keys_rows(spark, d))
    return graph.neighbourhood(edges, nodes, "nation:3")


@query("c_neighbourhood_sources", f"""WITH {EDGES}, {NODES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d1 AS (SELECT DISTINCT dst AS id, 1 AS depth FROM u WHERE src = 'customer:3'),
d2 AS (SELECT DISTINCT dst AS id, 2 AS depth FROM u JOIN d1 ON u.src = d1.id WHERE dst NOT IN (SELECT id FROM d1) AND (starts_with(dst, 'region:') OR starts_with(dst, 'part:'))), r AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2)
SELECT id, kind, depth, greatest(count(*) OVER w - 12, 0)::BIGINT AS more FROM r JOIN n USING (id) WINDOW w AS (PARTITION BY kind, depth) QUALIFY row_number() OVER (PARTITION BY kind, depth ORDER BY id) <= 12""")
def c_neighbourhood_sources(spark, d):
    nodes, edges = map(graph.union, keys_rows(spark, d))
    return graph.neighbourhood(edges, nodes, "customer:3", depth=1, always=("region", "part"))


@query("c_table_refs", "SELECT DISTINCT event_type AS id, name FROM events JOIN (SELECT DISTINCT event_type AS name FROM events WHERE value > 20) ON name = event_type")
def c_table_refs(spark, d):
    e = table(spark, d, "events")
    return graph.table_refs(e.select(F.col("event_type").alias("id"), F.array("event_type", F.lit("nothing")).alias("names")), e.filter("value > 20").select(F.col("event_type").alias("name"))).select("id", "name")


@query("a_resolve_fold", """WITH own AS (SELECT n_nationkey, c_mktsegment FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey), f AS (SELECT 'nation:' || n_nationkey AS id, c_mktsegment AS v FROM own UNION ALL SELECT 'region:' || n_regionkey, c_mktsegment FROM own JOIN nation USING (n_nationkey))
SELECT id, array_to_string(list_sort(list_distinct(list(v))), ',') AS folded FROM f WHERE v IS NOT NULL GROUP BY 1""")
def a_resolve_fold(spark, d):
    nodes, edges = keys_graph(spark, d)
    own = table(spark, d, "customer").groupBy(F.concat(F.lit("nation:"), "c_nationkey").alias("id")).agg(F.collect_set("c_mktsegment").alias("v"))
    inputs = nodes.filter("kind IN ('region', 'nation')").join(own, "id", "left").select("id", F.coalesce("v", F.array().cast("array<string>")).alias("v"))
    return graph.resolve_fold(inputs, edges.filter("kind = 'contains'"), "v").select("id", F.array_join("folded", ",").alias("folded"))


# --- metrics of several platforms -----------------------------------------------------------------------------------


def _metrics(spark, d):
    p = table(spark, d, "part")
    sets = {"tables": F.when(F.col("p_retailprice") > 0, "Priced").otherwise("free"), "columns": F.when(F.col("p_size") > 3, "large").otherwise("small"), "aggregations": F.when(F.col("p_size") > 40, "SUM").otherwise("COUNT")}
    return p.groupBy(F.col("p_type").alias("platform"), F.concat("p_brand", F.lit(" "), "p_name").alias("name")).agg(*[F.collect_set(c).alias(n) for n, c in sets.items()])


@query("c_reconcile", r"""WITH m AS (SELECT p_type AS platform, p_brand || ' ' || p_name AS name, list_sort(list_distinct(list(CASE WHEN p_size > 3 THEN 'large' ELSE 'small' END)))::VARCHAR AS c, list_sort(list_distinct(list(CASE WHEN p_size > 40 THEN 'sum' ELSE 'count' END)))::VARCHAR AS a FROM part GROUP BY 1, 2),
g AS (SELECT regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') AS key, count(DISTINCT platform)::BIGINT AS platforms, count(DISTINCT c) AS c, count(DISTINCT a) AS a FROM m GROUP BY 1)
SELECT key, platforms, CASE WHEN platforms < 2 THEN 'unique' WHEN c > 1 THEN 'divergent' WHEN a > 1 THEN 'review' ELSE 'consistent' END AS verdict FROM g""")
def c_reconcile(spark, d):
    return reconcile.verdicts(_metrics(spark, d))


@query("u_overlap", """WITH s AS (SELECT c_nationkey, list_distinct(list(c_mktsegment)) AS a FROM customer GROUP BY 1), t AS (SELECT c_nationkey, list_distinct(list(c_mktsegment) FILTER (WHERE c_acctbal < 0)) AS b FROM customer GROUP BY 1)
SELECT c_nationkey, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0), 4) AS overlap FROM s JOIN t USING (c_nationkey)""")
def u_overlap(spark, d):
    sets = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("a"), F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))).alias("b"))
    return sets.select("c_nationkey", F.round(reconcile.overlap(F.col("a"), F.col("b")), 4).alias("overlap"))


@query("u_dedupe", "SELECT DISTINCT conv_id, role FROM conversations")
def u_dedupe(spark, d):
    return table(spark, d, "conversations").select("conv_id", "role").dropDuplicates()


@query("c_pairings")
def c_pairings(spark, d):
    p = table(spark, d, "part")
    left = p.groupBy(F.concat("p_name", F.lit(" "), "p_type").alias("name")).agg(F.collect_set("p_brand").alias("columns"))
    right = p.groupBy(F.concat_ws("_", "p_name", F.lower("p_type"), F.lit("x")).alias("name")).agg(F.collect_set(F.concat(F.lit("b"), F.col("p_size").cast("string"))).alias("columns"))
    return reconcile.pairings(left, right)


@query("c_did_you_mean")
def c_did_you_mean(spark, d):
    asked = table(spark, d, "part").select(F.translate("p_name", "aeiou", "eioua").alias("name")).distinct()
    return reconcile.did_you_mean(asked, table(spark, d, "part").select(F.col("p_name").alias("name")))


# --- search, listings, requirements ---------------------------------------------------------------------------------

KINDS = ("region", "nation", "part", "document")


def _searched(spark, d):
    named = [table(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("name"), F.lit(None).cast("string").alias("expression")) for t, c in (("region", "r_name"), ("nation", "n_name"), ("part", "p_name"))]
    docs = before(spark, d).select(F.lit("document").alias("kind"), "name", "expression")
    return graph.union([*[n.distinct() for n in named], docs])


@query("c_search", """WITH o AS (SELECT DISTINCT 'region' AS kind, r_name AS name, NULL AS x, 1 AS k FROM region UNION ALL SELECT DISTINCT 'nation', n_name, NULL, 2 FROM nation UNION ALL SELECT DISTINCT 'part', p_name, NULL, 3 FROM part UNION ALL SELECT 'document', source || ' ' || doc_id, text, 4 FROM documents),
t AS (SELECT *, CASE WHEN lower(name) = 'red' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 WHEN contains(lower(name), 'red') THEN 2 WHEN contains(lower(x), 'red') THEN 3 END AS tier FROM o)
SELECT kind, name, tier, (SELECT count(*) > 40 FROM t WHERE tier IS NOT NULL) AS truncated FROM t WHERE tier IS NOT NULL ORDER BY tier, k, name LIMIT 40""")
def c_search(spark, d):
    return search.search(_searched(spark, d), "Red", KINDS)


def _identified(spark, d):
    return _searched(spark, d).withColumn("id", F.concat_ws(":", "kind", "name"))


_OBJECTS = "o AS (SELECT DISTINCT 'region' AS kind, r_name AS name, NULL AS x, 1 AS k FROM region UNION ALL SELECT DISTINCT 'nation', n_name, NULL, 2 FROM nation UNION ALL SELECT DISTINCT 'part', p_name, NULL, 3 FROM part UNION ALL SELECT 'document', source || ' ' || doc_id, text, 4 FROM documents)"
_ASKED = "q AS (SELECT DISTINCT unnest([p_brand, split_part(p_name, ' ', 1), substr(p_name, 2, 4), left(p_type, 2), substr(p_name, 3, 1)]) AS asked FROM part UNION SELECT r_name FROM region)"


def _asked(spark, d):
    p = table(spark, d, "part")
    parts = F.array("p_brand", F.substring_index("p_name", " ", 1), F.substring("p_name", 2, 4), F.substring("p_type", 1, 2), F.substring("p_name", 3, 1))
    return p.select(F.explode(parts).alias("asked")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("asked"))).distinct()


@query("c_search_many", f"""WITH {_OBJECTS}, {_ASKED},
t AS (SELECT asked, kind, name, k, CASE WHEN lower(name) = lower(asked) THEN 0 WHEN starts_with(lower(name), lower(asked)) THEN 1 WHEN contains(lower(name), lower(asked)) THEN 2 WHEN contains(lower(x), lower(asked)) THEN 3 END AS tier FROM o, q)
SELECT asked, kind, name, tier, count(*) OVER (PARTITION BY asked) > 40 AS truncated FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY tier, k, name) <= 40""")
def c_search_many(spark, d):
    """Whole words, parts of words and single letters, all in one job over a stored index."""
    objects = _identified(spark, d)
    return search.search_many(search.write_index(objects, new_path(spark, "search-index")), objects, _asked(spark, d), KINDS)


@query("c_find_many", f"""WITH {_OBJECTS}, {_ASKED}
SELECT asked, kind, count(*)::BIGINT AS n_objects, sum((length(x) - length(replace(lower(x), lower(asked), ''))) // length(asked))::BIGINT AS n_found FROM o JOIN q ON contains(lower(x), lower(asked)) GROUP BY 1, 2""")
def c_find_many(spark, d):
    objects = _identified(spark, d)
    return search.find_many(search.write_index(objects, new_path(spark, "search-index")), objects, _asked(spark, d))


_EXPRESSIONS = (("document", "documents", "text"), ("page", "pages", "html"), ("turn", "conversations", "text"), ("item", "benchmark", "text"), ("event", "events", "props"))


@query("c_find_in_expr", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (WHERE contains(lower({c}), 'then'))::BIGINT AS n_objects, coalesce(sum((length({c}) - length(replace(lower({c}), 'then', ''))) // 4) FILTER (WHERE contains(lower({c}), 'then')), 0)::BIGINT AS n_found FROM {t}" for k, t, c in _EXPRESSIONS))
def c_find_in_expr(spark, d):
    return search.find_in_expressions(graph.union([table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("expression")) for k, t, c in _EXPRESSIONS]), "Then")


def _model_columns(spark, m):
    """(table_name, column_name, data_type) of a model's tables."""
    return spark.createDataFrame([(t, c, k) for t, df in m.tables.items() for c, k in df.dtypes], "table_name string, column_name string, data_type string")


_TABLE_KINDS = (("region", "data", 2, 0), ("nation", "data", 3, 0), ("customer", "data", 5, 0), ("supplier", "data", 4, 0), ("part", "parameter", 6, 0), ("orders", "data", 6, 2), ("lineitem", "data", 11, 5), ("LocalDateTable_1", "system", 1, 0), ("key figures", "measures", 0, 4))


@query("c_list_tables", "SELECT *, 0::BIGINT AS n_rows FROM (VALUES " + ", ".join(f"('{t}', '{k}', {c}::BIGINT, {m}::BIGINT)" for t, k, c, m in _TABLE_KINDS if " " in t or "_" in t) + ") v(table_name, kind, n_columns, n_measures) UNION ALL " + " UNION ALL ".join(f"SELECT '{t}', '{k}', {c}::BIGINT, {m}::BIGINT, count(*)::BIGINT FROM {t}" for t, k, c, m in _TABLE_KINDS if not (" " in t or "_" in t)))
def c_list_tables(spark, d):
    m = retail(spark, d)
    columns = _model_columns(spark, m).withColumn("parameter", F.col("table_name") == "part").unionByName(spark.createDataFrame([("LocalDateTable_1", "Date", "date", False)], "table_name string, column_name string, data_type string, parameter boolean"))
    measures = spark.createDataFrame([(x.base or "key figures", x.name) for x in m.measures.values()], "table_name string, measure string")
    tables = columns.select("table_name").unionByName(measures.select("table_name")).distinct()
    counts = graph.union([df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in m.tables.items()])
    return listing.list_tables(tables, columns, measures).join(counts, "table_name", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


@query("c_list_measures", "SELECT event_type AS table_name, user_id::VARCHAR AS measure, user_id IN (SELECT doc_id FROM labels) AS documented FROM events")
def c_list_measures(spark, d):
    measures = table(spark, d, "events").select(F.col("event_type").alias("table_name"), F.col("user_id").cast("string").alias("measure"))
    return listing.list_measures(measures, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("measure")))


_KINDS = (("measure", "documents", "doc_id", "source"), ("relationship", "nation", "n_nationkey", "n_name"), ("hierarchy", "region", "r_regionkey", "r_name"), ("calculated column", "part", "p_partkey", "p_name"), ("role", "customer", "c_custkey", "c_mktsegment"),
          ("object permission", "supplier", "s_suppkey", "s_name"), ("perspective", "events", "event_id", "event_type"), ("variation", "conversations", "conv_id", "role"), ("kpi", "benchmark", "item_id", "item_id"), ("calculation group", "labels", "doc_id", "quality"), ("load step", "pages", "page_id", "url"), ("gap", "orders", "o_orderkey", "o_orderstatus"))


@query("c_requirements", " UNION ALL ".join(
    f"SELECT sha256('{k}' || chr(31) || {i}) AS requirement, '{requirements.RULES[k][0]}' AS kind, '{requirements.RULES[k][1]}' AS category, replace('{requirements.RULES[k][2]}', '%s', {n}::VARCHAR) AS statement, '{requirements.RULES[k][3]}' AS confidence FROM {t}" for k, t, i, n in _KINDS))
def c_requirements(spark, d):
    objects = graph.union([table(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).cast("string").alias("id"), F.col(n).cast("string").alias("name")) for k, t, i, n in _KINDS])
    return requirements.derive(objects).drop("evidence")


def _and(x: str) -> str:
    return f"CASE WHEN len({x}) < 2 THEN array_to_string({x}, '') ELSE array_to_string({x}[:len({x}) - 1], ', ') || ' and ' || {x}[len({x})] END"


def _hash(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 16)"


def _definitions(spark, d):
    """Definition tables: documents as measures that read columns, nations as levels of regions, segments as row filters of nations, orders as relationships."""
    docs, nation = table(spark, d, "documents"), table(spark, d, "nation")
    nth = F.col("doc_id")
    none = F.array().cast("array<string>")
    places = docs.select(F.col("source").alias("model"), F.col("lang").alias("table"), "doc_id")
    columns = places.filter("doc_id % 5 < 3").select("model", "table", F.concat(F.lit("c"), nth % 5).alias("name")).distinct()
    calculated = F.col("name") == "c1"
    roles = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("role"), F.col("c_mktsegment").alias("table")).distinct()
    ways = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    tables = places.select("model", F.col("table").alias("name"), F.lit(False).alias("system")).distinct().unionByName(spark.createDataFrame([("sales", "status F", True)], "model string, name string, system boolean"))
    levels = nation.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("hierarchy"), F.col("n_nationkey").cast("int").alias("ordinal"), F.col("n_name").alias("level"), F.lit("n_name").alias("column"))
    empty = table(spark, d, "region").select(F.concat(F.lit("no "), "r_name").alias("hierarchy"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("column"))
    return {
        "measures": docs.select(
            F.col("source").alias("model"), F.col("lang").alias("table"), F.concat(F.lit("m"), nth).alias("name"), F.when(nth % 7 == 0, " ").otherwise(F.substring("text", 1, 40)).alias("expression"), fingerprint(F.col("text")).alias("fingerprint"),
            F.when(nth % 3 == 0, F.array(F.concat("lang", F.lit(".c"), nth % 5))).otherwise(none).alias("columns"), F.when(nth % 4 == 0, F.array(F.lit("m2"), F.lit("m1"))).otherwise(none).alias("measures"), (nth % 6 == 0).alias("implicit"),
        ),
        "columns": columns.select("*", F.when(F.col("table") == "de", "").otherwise("a + b").alias("expression"), calculated.alias("calculated"), fingerprint(F.col("table"), F.col("name")).alias("fingerprint")),
        "tables": tables.select("*", F.lit(False).alias("measure_only"), (F.col("name") == "fr").alias("parameter"), fingerprint(F.col("name")).alias("fingerprint")),
        "relationships": ways.select(
            F.lit("sales").alias("model"), F.lit("orders").alias("from_table"), F.col("o_orderpriority").alias("from_column"), F.concat(F.lit("status "), "o_orderstatus").alias("to_table"), F.lit("k").alias("to_column"), F.lit("many to one").alias("cardinality"),
            F.col("o_orderpriority").startswith("1").alias("active"), F.col("o_orderpriority").startswith("2").alias("integrity"), F.lit(None).cast("string").alias("direction"), fingerprint(F.col("o_orderpriority")).alias("fingerprint"),
        ),
        "levels": levels.unionByName(empty).select(F.lit("geo").alias("model"), F.lit("region").alias("table"), "*", fingerprint(F.col("hierarchy")).alias("fingerprint")),
        "filters": roles.select(F.lit("sales").alias("model"), "role", F.lit("read").alias("access"), "table", F.when(F.col("table") == "BUILDING", "").otherwise("[a] = 1").alias("expression"), fingerprint(F.col("role"), F.col("table")).alias("fingerprint")),
        "gaps": places.groupBy("model", "table").agg(F.count("*").alias("n")).select("model", F.concat("table", F.lit(" texts")).alias("feature"), "n", F.lit("no rule").alias("reason")),
    }


RULES_SQL = f"""WITH d AS (SELECT source AS model, lang AS "table", 'm' || doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE left(text, 40) END AS expression, sha256(text) AS fp, CASE WHEN doc_id % 3 = 0 THEN [lang || '.c' || doc_id % 5] ELSE [] END AS cols, CASE WHEN doc_id % 4 = 0 THEN ['m1', 'm2'] ELSE [] END AS ms, doc_id % 6 = 0 AS implicit FROM documents),
c AS (SELECT DISTINCT source AS model, lang AS "table", 'c' || doc_id % 5 AS name FROM documents WHERE doc_id % 5 < 3),
m AS (SELECT d.*, 'measure:' || "table" || '.' || name AS node, fp AS bound FROM d WHERE NOT implicit UNION ALL SELECT d.*, 'column:' || cols[1], sha256(c."table" || chr(31) || c.name) FROM d JOIN c ON c.model = d.model AND c."table" || '.' || c.name = d.cols[1] WHERE implicit),
mx AS (SELECT *, {_hash("'measure'", "model", '"table"', "name")} AS h, node || '|' || bound || '|' || trim(expression) AS ev FROM m),
r AS (SELECT DISTINCT o_orderpriority AS p, 'status ' || o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'),
rx AS (SELECT *, {_hash("'relationship'", "'sales'", "'orders.' || p", "s || '.k'")} AS h, 'table:orders -> table:' || s || '|' || sha256(p) || '|orders.' || p || ' -> ' || s || '.k' AS ev, starts_with(p, '1') AS active FROM r),
l AS (SELECT r_name AS h, list(n_name ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'no ' || r_name, [] FROM region),
lx AS (SELECT *, {_hash("'hierarchy'", "'geo'", "'region'", "h")} AS id, 'hierarchy:region.' || h || '|' || sha256(h) || '|' || array_to_string(names, ' > ') AS ev FROM l),
f AS (SELECT DISTINCT n_name AS role, c_mktsegment AS t, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '[a] = 1' END AS x FROM customer JOIN nation ON c_nationkey = n_nationkey),
fx AS (SELECT *, 'role:' || role || '|' || sha256(role || chr(31) || t) || '|' || t || ': ' || x AS ev FROM f),
g AS (SELECT role, list_sort(list(t)) AS ts, list_sort(list(ev)) AS evs FROM fx GROUP BY 1),
t AS (SELECT model, list_sort(list("table")) AS names FROM (SELECT DISTINCT source AS model, lang AS "table" FROM documents WHERE lang <> 'fr') GROUP BY 1)
SELECT model, 'F-' || h AS requirement, 'functional' AS kind, 'incomplete definitions' AS category, 'What ' || "table" || '.' || name || ' computes is not stated and has to be supplied.' AS statement, 'low' AS confidence, ev AS evidence FROM mx WHERE trim(expression) = ''
UNION ALL SELECT model, 'B-' || h, 'business', 'metrics', 'The solution reports ' || name || '.' || CASE WHEN len(cols) > 0 THEN ' It reads ' || {_and("cols")} || '.' WHEN len(ms) > 0 THEN ' It is made of ' || {_and("ms")} || '.' ELSE '' END || CASE WHEN implicit THEN ' The report makes this figure, no measure does.' ELSE '' END, 'high', ev FROM mx WHERE trim(expression) <> ''
UNION ALL SELECT model, 'F-' || h, 'functional', 'measure definitions', "table" || '.' || name || ' is computed as its expression in the evidence says.' || CASE WHEN len(ms) > 0 THEN ' Before it, ' || {_and("ms")} || ' must be known.' ELSE '' END, 'high', ev FROM mx WHERE trim(expression) <> ''
UNION ALL SELECT model, 'F-' || {_hash("'column'", "model", '"table"', "name")}, 'functional', CASE WHEN "table" = 'de' THEN 'incomplete definitions' ELSE 'derived columns' END, "table" || '.' || name || CASE WHEN "table" = 'de' THEN ' is calculated, but by what is not stated.' ELSE ' is calculated by its expression in the evidence, and not loaded.' END, CASE WHEN "table" = 'de' THEN 'low' ELSE 'high' END, 'column:' || "table" || '.' || name || '|' || sha256("table" || chr(31) || name) || '|' || CASE WHEN "table" = 'de' THEN '' ELSE 'a + b' END FROM c WHERE name = 'c1'
UNION ALL SELECT 'sales', 'B-' || h, 'business', 'analysis by dimension', CASE WHEN active THEN 'Users can split orders by what ' || s || ' says of it.' ELSE 'Calculations that ask for it can take another way from orders to ' || s || '.' END, CASE WHEN active THEN 'medium' ELSE 'low' END, ev FROM rx
UNION ALL SELECT 'sales', 'F-' || h, 'functional', 'relationships', 'An ' || CASE WHEN active THEN 'active' ELSE 'inactive' END || ' relationship (many to one) joins orders.' || p || ' to ' || s || '.k, filters one way and ' || CASE WHEN starts_with(p, '2') THEN 'drops no row, since each key is known to exist' ELSE 'keeps rows without a partner' END || '.', 'high', ev FROM rx
UNION ALL SELECT 'geo', 'F-' || id, 'functional', 'incomplete definitions', h || ' of region has no levels; its way down has to be stated.', 'low', ev FROM lx WHERE len(names) = 0
UNION ALL SELECT 'geo', 'B-' || id, 'business', 'drilling', 'Users can drill through ' || h || ' of region: ' || array_to_string(names, ' > ') || '.', 'high', ev FROM lx WHERE len(names) > 0
UNION ALL SELECT 'geo', 'F-' || id, 'functional', 'hierarchies', h || ' of region has ' || len(names) || ' levels, in this order: ' || array_to_string(list_transform(names, lambda n: n || ' (n_name)'), ', ') || '.', 'high', ev FROM lx WHERE len(names) > 0
UNION ALL SELECT 'sales', 'B-' || {_hash("'role'", "'sales'", "role")}, 'business', 'who sees what', 'Members of ' || role || ' see only the rows of ' || {_and("ts")} || ' that its filters let through.', 'high', array_to_string(evs, ';') FROM g
UNION ALL SELECT 'sales', 'F-' || {_hash("'role'", "'sales'", "role", "t")}, 'functional', 'row filters', 'For ' || role || ', rows of ' || t || ' are filtered by the expression in the evidence.', 'high', 'role:' || role || '|' || sha256(role || chr(31) || t) || '|' || x FROM fx WHERE x <> ''
UNION ALL SELECT model, 'B-' || {_hash("'scope'", "model")}, 'business', 'scope', 'The solution covers ' || len(names) || CASE WHEN len(names) = 1 THEN ' subject: ' ELSE ' subjects: ' END || {_and("names")} || '.', 'high', array_to_string(list_transform(names, lambda n: 'table:' || n || '|' || sha256(n) || '|table ' || n), ';') FROM t
UNION ALL SELECT model, 'F-' || {_hash("'gap'", "model", "feature")}, 'functional', 'gaps', 'The ' || n || ' ' || feature || ' of this model are not covered (no rule) and have to be specified elsewhere.', 'low', '' FROM (SELECT source AS model, lang || ' texts' AS feature, count(*) AS n FROM documents GROUP BY 1, 2)"""


@query("c_requirement_rules", RULES_SQL)
def c_requirement_rules(spark, d):
    found = rules.derive(_definitions(spark, d))
    rests = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["node"], e["fingerprint"], e["detail"])), ";")
    return found.withColumn("evidence", rests)


@query("d_status_of_models", """WITH RECURSIVE d AS (SELECT (doc_id // 16)::VARCHAR AS model, doc_id AS i, 'm' || doc_id AS name, CASE doc_id % 8 WHEN 0 THEN lang WHEN 6 THEN 'nowhere' END AS base, CASE doc_id % 8 WHEN 1 THEN [i - 1] WHEN 2 THEN [i - 1, i - 2] WHEN 3 THEN [i + 1] WHEN 4 THEN [i - 1] WHEN 7 THEN [i + 1] ELSE [] END AS ins FROM (SELECT *, doc_id AS i FROM documents)),
e AS (SELECT model, name AS src, 'm' || unnest(ins) AS dst FROM d), r AS (SELECT model, name AS start, name AS at FROM d UNION SELECT r.model, r.start, e.dst FROM r JOIN e ON e.model = r.model AND e.src = r.at),
l AS (SELECT DISTINCT r.model, r.start AS name FROM r JOIN e ON e.model = r.model AND e.src = r.at AND e.dst = r.start),
f AS (SELECT r.model, r.start, bool_or(l.name IS NOT NULL) AS cycle, bool_or(d.name IS NULL) AS no_measure, bool_or(d.base = 'nowhere') AS no_table, bool_or(d.base IS NULL AND len(d.ins) = 0) AS constant FROM r LEFT JOIN d ON d.model = r.model AND d.name = r.at LEFT JOIN l ON l.model = r.model AND l.name = r.at GROUP BY 1, 2),
c AS (SELECT model, start AS measure, CASE WHEN cycle THEN 'cycle' WHEN no_measure THEN 'measure' WHEN coalesce(no_table, false) THEN 'table' WHEN coalesce(constant, false) THEN 'constant' END AS construct FROM f)
SELECT model, measure, CASE WHEN construct IS NULL THEN 'EXACT' WHEN construct = 'constant' THEN 'UNSUPPORTED' ELSE 'BLOCKED' END AS status, construct FROM c""")
def d_status_of_models(spark, d):
    """Documents as measures of many small models, made of their neighbours; some in cycles, some of what isn't there."""
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    model = F.floor(i / 16).cast("string").alias("model")
    k, at = i % 8, lambda n: F.concat(F.lit("m"), i + n)
    inputs = F.when(k.isin(1, 4), F.array(at(-1))).when(k == 2, F.array(at(-1), at(-2))).when(k.isin(3, 7), F.array(at(1))).otherwise(F.array().cast("array<string>"))
    measures = docs.select(model, at(0).alias("name"), F.when(k == 0, F.col("lang")).when(k == 6, "nowhere").alias("base"), inputs.alias("inputs"))
    return evaluable.statuses(measures, docs.select(model, F.col("lang").alias("name")))


@query("d_grains_of_models", """WITH m AS (SELECT DISTINCT source AS model, lang FROM documents), x AS (SELECT n_nationkey AS k, n_name AS t, n_regionkey AS r FROM nation),
c AS (SELECT model, lang || ':' || t AS tab, t || '_name' AS name FROM m, x UNION ALL SELECT model, lang || ':' || r_name, r_name || '_text' FROM m, region)
SELECT m.model, lang || ':' || x.t AS base, c.tab AS "table", c.name AS "column" FROM m, x JOIN region ON x.r = r_regionkey JOIN c ON c.tab IN (lang || ':' || x.t, lang || ':' || r_name) WHERE c.model = m.model""")
def d_grains_of_models(spark, d):
    """Models with a fact for each nation, which leads to its region; names are options, keys, ids and amounts are not."""
    models = table(spark, d, "documents").select(F.col("source").alias("model"), "lang").distinct()
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    own = models.join(F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")), F.lit(True))  # 25 rows
    one, many = F.concat_ws(":", "lang", "r_name"), F.concat_ws(":", "lang", "n_name")
    column = lambda tab, name, kind: own.select("model", tab.alias("table"), name.alias("name"), F.lit(kind).alias("data_type")).distinct()
    columns = graph.union([
        column(many, F.concat("n_name", F.lit("_name")), "string"), column(many, F.concat("n_name", F.lit("_id")), "string"), column(many, F.lit("region"), "string"), column(many, F.lit("amount"), "double"),
        column(one, F.concat("r_name", F.lit("_text")), "string"), column(one, F.lit("region"), "string"),
    ])
    ways = own.select("model", many.alias("from_table"), F.lit("region").alias("from_column"), one.alias("to_table"), F.lit("region").alias("to_column"), F.lit(True).alias("active"))
    return evaluable.grain_options(columns, ways, own.select("model", many.alias("base")))


@query("c_corroboration", """SELECT backing, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'shown' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'read' ELSE 'nothing' END AS backing FROM documents) GROUP BY 1""")
def c_corroboration(spark, d):
    marks = table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    rows = requirements.corroborated(table(spark, d, "documents").select(F.col("doc_id").alias("id")), marks.filter("quality = 1"), marks)
    return rows.groupBy("backing").agg(F.count("*").alias("n"))


@query("c_standing", """SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'open' WHEN d.lang = 'de' THEN 'stale' ELSE 'decided' END AS standing, l.quality AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)""")
def c_standing(spark, d):
    docs = table(spark, d, "documents")
    decided = table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("at"), F.col("quality").alias("verdict"), F.array(fingerprint(F.col("text"))).alias("fingerprints"))
    now = docs.select(F.col("doc_id").alias("id"), F.array(fingerprint(F.when(F.col("lang") == "de", F.concat("text", F.lit(" + 1"))).otherwise(F.col("text")))).alias("fingerprints"))
    return requirements.standing(now, decided)


@query("c_risks", f"""SELECT 'inactive relationship' AS risk, 1::BIGINT AS n UNION ALL SELECT 'both directions', 0 UNION ALL SELECT 'shared fingerprint', count(*)::BIGINT FROM (SELECT lang, text FROM documents GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'unused', count(*)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'undocumented', count(*)::BIGINT FROM documents WHERE length(text) < 60
UNION ALL SELECT 'unresolved', count(*)::BIGINT FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'gap', count(*)::BIGINT FROM events WHERE event_type NOT IN ('click', 'view')""")
def c_risks(spark, d):
    joins = spark.createDataFrame([(r.many, r.active, r.both_directions) for r in RELATIONSHIPS], "many string, active boolean, both boolean")
    docs, marks = table(spark, d, "documents"), table(spark, d, "labels")
    return listing.risks({
        "inactive relationship": joins.filter("NOT active"),
        "both directions": joins.filter("both"),
        "shared fingerprint": listing.same_fingerprint(before(spark, d)),
        "unused": docs.join(marks, "doc_id", "left_anti"),
        "undocumented": docs.filter("length(text) < 60"),
        "unresolved": table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
        "gap": table(spark, d, "events").filter("event_type NOT IN ('click', 'view')"),
    })


@query("c_glossary", "SELECT lang AS kind, source || ' ' || doc_id AS name, text AS description FROM documents WHERE trim(text) <> ''")
def c_glossary(spark, d):
    return listing.glossary(before(spark, d), F.col("expression"))


@query("c_tiles", """WITH f AS (SELECT DISTINCT conv_id, role FROM conversations)
SELECT conv_id AS tile, count(*)::BIGINT AS n_fields, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_measures, count(*) FILTER (WHERE role = 'user')::BIGINT AS n_columns, count(*) FILTER (WHERE role NOT IN ('assistant', 'user'))::BIGINT AS n_unresolved,
  count(*) FILTER (WHERE role = 'assistant') > 0 AND conv_id % 2 = 0 AS is_kpi FROM f GROUP BY 1""")
def c_tiles(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("tile"), F.col("role").alias("field"), F.when(F.col("conv_id") % 2 == 0, "number").otherwise("table").alias("visual"))
    roles = t.select("field").distinct()
    return listing.tiles(t, roles.filter("field = 'assistant'"), roles.filter("field = 'user'"))


@query("c_verify", "SELECT doc_id AS id, true AS same_when_reformatted, true AS differs_when_mutated FROM documents")
def c_verify(spark, d):
    return listing.self_check(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_STEPS = tuple(listing.STEP_EFFECTS.items())
_STEP_LIST = lambda i: "[" + ", ".join("'" + step[i] + "'" for step in _STEPS) + "]"


@query("c_load_steps", f"""WITH p AS (SELECT *, (p_partkey % {len(_STEPS)} + 1)::INT AS k FROM part), s AS (SELECT *, {_STEP_LIST(0)}[k] AS f, {_STEP_LIST(1)}[k] AS e FROM p)
SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'csv' WHEN f = 'File.Contents' THEN 'file' WHEN f = 'Csv.Document' THEN 'csv' WHEN f = 'Json.Document' THEN 'json' WHEN f = 'Xml.Tables' THEN 'xml' WHEN f = 'Excel.Workbook' THEN 'excel' ELSE NULL END AS connector, p_name AS first_literal,
  CASE WHEN p_size > 25 THEN 4 ELSE 2 END AS calls, CASE WHEN p_size > 25 THEN 3 ELSE 1 END AS steps, CASE WHEN p_size > 25 THEN 'reads delimited text, reads a file, ' ELSE '' END || e AS effects, 'Own.Function' AS "unknown",
  f IN ('Table.SelectRows', 'Table.Distinct', 'Table.FirstN', 'Table.Skip', 'Table.Range', 'Table.RemoveLastN', 'Table.Group', 'Table.Combine', 'Table.Join', 'Table.NestedJoin', 'Table.ExpandTableColumn', 'Table.Pivot', 'Table.Unpivot', 'Table.UnpivotOtherColumns') AS changes_rows FROM s""")
def c_load_steps(spark, d):
    p = table(spark, d, "part")
    step = F.get(F.array(*[F.lit(f) for f, _ in _STEPS]), (F.col("p_partkey") % len(_STEPS)).cast("int"))
    source = F.when(F.col("p_size") > 25, F.concat(F.lit('Csv.Document(File.Contents("'), "p_name", F.lit('")), '))).otherwise(F.concat(F.lit('"'), "p_name", F.lit('", ')))
    return listing.load_steps(p.select(F.col("p_partkey").alias("id"), F.concat(source, step, F.lit("(x), Own.Function (y)")).alias("script")))


@query("c_sql_refs", """SELECT p_partkey AS id, list_aggregate(list_sort(list_distinct(['Plant Sites', CASE WHEN p_size > 25 THEN lower(p_type) ELSE 'wh.' || lower(p_type) END])), 'string_agg', ',') AS tables, CASE WHEN p_size > 25 THEN 'a,x,y' ELSE 'a,x' END AS columns, CASE WHEN p_size > 25 THEN 'AVG,SUM' ELSE 'COUNT' END AS aggregates FROM part""")
def c_sql_refs(spark, d):
    picked, schema = F.when(F.col("p_size") > 25, "sum(t.x) / avg(t.y)").otherwise("count(t.x)"), F.when(F.col("p_size") > 25, "").otherwise("WH.")
    body = F.concat(F.lit("WITH given AS (SELECT 1) SELECT "), picked, F.lit(" -- FROM nowhere\nFROM "), schema, "p_type", F.lit(" t JOIN \"Plant Sites\" s ON t.a = s.a JOIN given ON 'from text' <> ''"))
    return listing.sql_refs(table(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body")))


@query("c_data_as_of", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS as_of, count(*)::BIGINT AS tables, 'mixed' AS storage FROM events WHERE event_type <> 'error'")
def c_data_as_of(spark, d):
    found = listing.data_as_of(table(spark, d, "events").select(F.col("ts").alias("refreshed_at"), (F.col("event_type") == "error").alias("calculated"), F.when(F.col("user_id") % 2 == 0, "import").otherwise("direct").alias("mode")))
    return found.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"))


@query("c_gaps", "SELECT p_name AS kind, count(*)::BIGINT AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#7') GROUP BY 1")
def c_gaps(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_name", "kind")
    return listing.gaps(p, p.filter("p_brand = 'Brand#7'").select("kind").distinct())


@query("c_security", "SELECT DISTINCT c_mktsegment AS role, 'member' AS what, c_nationkey::VARCHAR AS value FROM customer UNION ALL SELECT DISTINCT c_mktsegment, 'filter', CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END FROM customer")
def c_security(spark, d):
    return listing.security(_grants(spark, d))


@query("c_security_counts", "SELECT c_mktsegment AS role, count(DISTINCT c_nationkey)::BIGINT AS members, count(DISTINCT c_acctbal < 0)::BIGINT AS filters, 0::BIGINT AS hidden FROM customer GROUP BY 1")
def c_security_counts(spark, d):
    return listing.security_counts(_grants(spark, d))


def _grants(spark, d):
    c = table(spark, d, "customer")
    grant = lambda what, value: c.select(F.col("c_mktsegment").alias("role"), F.lit(what).alias("what"), value.alias("value"))
    return grant("member", F.col("c_nationkey").cast("string")).unionByName(grant("filter", F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit")))


_REVIEW = "r AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'low' WHEN 'fr' THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN CASE WHEN source = 'src1' THEN 'stale' ELSE 'decided' END ELSE 'open' END AS standing FROM documents)"


def _review(spark, d):
    docs = table(spark, d, "documents")
    confidence = F.when(F.col("lang") == "de", "low").when(F.col("lang") == "fr", "medium").otherwise("high")
    standings = docs.join(table(spark, d, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src1", "stale").otherwise("decided").alias("standing"))
    return docs.select(F.col("doc_id").alias("requirement"), confidence.alias("confidence")), standings


@query("c_review_queue", f"WITH {_REVIEW} SELECT doc_id AS requirement, standing FROM r WHERE confidence = 'low' AND standing <> 'decided'")
def c_review_queue(spark, d):
    return requirements.review_queue(*_review(spark, d))


@query("c_review_counts", f"WITH {_REVIEW} SELECT confidence, standing, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def c_review_counts(spark, d):
    return requirements.review_counts(*_review(spark, d))


_EVENTS = (("region", 2, 0, 0), ("nation", 3, 0, 0), ("customer", 5, 0, 0), ("supplier", 4, 0, 0), ("part", 6, 0, 0), ("orders", 6, 1, 0), ("lineitem", 11, 12, 1))


@query("s_lineage_events", " UNION ALL ".join(f"SELECT '{t}' AS table_name, {n}::BIGINT AS n_fields, {r}::BIGINT AS n_inputs, {o}::BIGINT AS n_omitted, count(*)::BIGINT AS n_rows FROM {t}" for t, n, r, o in _EVENTS))
def s_lineage_events(spark, d):
    m = retail(spark, d).add(Measure("broken", inputs=("revenue", "no such measure"), fn=lambda a, b: a))
    reads, omitted = m.lineage()
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    events = listing.lineage_events(_model_columns(spark, m), frame(reads, "table_name string, measure string, column_name string"), frame(omitted, "table_name string, measure string, reason string"))
    size = lambda path: F.coalesce(F.size(F.from_json(F.get_json_object("event", path), "array<string>")), F.lit(0)).cast("long")
    counts = graph.union([df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in m.tables.items()])
    return events.join(counts, "table_name").select("table_name", size("$.fields").alias("n_fields"), size("$.lineage").alias("n_inputs"), size("$.omitted").alias("n_omitted"), "n_rows")

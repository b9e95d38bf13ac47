"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, formats, names, patterns, text
from ._base import query, table

P = "l_extendedprice"


@query("f_math", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({P}, 1) AS r, abs(l_quantity - 25) AS a, ceil({P})::BIGINT AS c, floor({P})::BIGINT AS f, round(sqrt({P}), 4) AS s, round(pow(l_quantity, 2), 4) AS p,
  round(exp(l_discount), 6) AS e, round(ln({P}), 6) AS l, round(log10({P}), 6) AS l10 FROM lineitem""")
def f_math(spark, d):
    p, q = F.col(P), F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(p, 1).alias("r"), F.abs(q - 25).alias("a"), F.ceil(p).alias("c"), F.floor(p).alias("f"), F.round(F.sqrt(p), 4).alias("s"),
        F.round(F.pow(q, F.lit(2)), 4).alias("p"), F.round(F.exp("l_discount"), 6).alias("e"), F.round(F.ln(p), 6).alias("l"), F.round(F.log10(p), 6).alias("l10"),
    )


@query("f_concat", "SELECT c_custkey, c_name || ' / ' || c_mktsegment AS x FROM customer")
def f_concat(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" / "), "c_mktsegment").alias("x"))


@query("f_value", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS v, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def f_value(spark, d):
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("v"), F.col("event_type").try_cast("double").alias("none"))


@query("f_coalesce", "SELECT c_custkey, coalesce(o_orderstatus, 'none') AS s, coalesce(NULL, o_totalprice, 0) AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def f_coalesce(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("o_orderstatus", F.lit("none")).alias("s"), F.coalesce(F.lit(None).cast("double"), "o_totalprice", F.lit(0.0)).alias("p"))


@query("f_if", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS x FROM customer")
def f_if(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, "credit").otherwise("debit").alias("x"))


@query("f_switch", "SELECT c_nationkey, CASE WHEN avg(c_acctbal) > 5000 THEN 'high' WHEN avg(c_acctbal) > 4000 THEN 'middle' ELSE 'low' END AS x FROM customer GROUP BY 1")
def f_switch(spark, d):
    a = F.avg("c_acctbal")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.when(a > 5000, "high").when(a > 4000, "middle").otherwise("low").alias("x"))


_PARTS = ("year", "quarter", "month", "day", "hour", "minute", "second")


@query("f_datediff", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"date_diff('{p}', o_orderdate, l_shipdate)::BIGINT AS {p}s" for p in _PARTS) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f_datediff(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[dates.datediff(F.col("o_orderdate"), F.col("l_shipdate"), p).alias(f"{p}s") for p in _PARTS])


@query("f_today", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderdate < current_date)::BIGINT AS past FROM orders GROUP BY 1")
def f_today(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderdate") < dates.today()).alias("past"))


@query("f_date_trunc", "SELECT event_id, " + ", ".join(f"strftime(date_trunc('{p}', ts), '%Y-%m-%d %H:%M:%S') AS {p}_start" for p in ("year", "quarter", "month", "day", "hour")) + " FROM events")
def f_date_trunc(spark, d):
    return table(spark, d, "events").select("event_id", *[F.date_format(F.date_trunc(p, "ts"), "yyyy-MM-dd HH:mm:ss").alias(f"{p}_start") for p in ("year", "quarter", "month", "day", "hour")])


@query("f_years", "SELECT DISTINCT year(o_orderdate)::BIGINT AS y FROM orders")
def f_years(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y")).distinct()


@query("f_period_label", "SELECT event_id, strftime(ts, '%Y') AS y, 'Q' || quarter(ts) || ' ' || year(ts) AS q, strftime(ts, '%b %Y') AS m, strftime(ts, '%d %b %Y') AS d, strftime(ts, '%d %b %H:00') AS h FROM events")
def f_period_label(spark, d):
    return table(spark, d, "events").select("event_id", *[dates.period_label(F.col("ts"), p).alias(n) for n, p in (("y", "year"), ("q", "quarter"), ("m", "month"), ("d", "day"), ("h", "hour"))])


@query("f_blank_label", "SELECT c_custkey, CASE WHEN o_orderstatus IS NULL OR trim(o_orderstatus) = '' THEN '(Blank)' ELSE o_orderstatus END AS label FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def f_blank_label(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", names.label(F.col("o_orderstatus")).alias("label"))


@query("f_name_key", r"SELECT c_custkey, regexp_replace(replace(replace(lower(c_name || ' & % ' || c_mktsegment), '%', 'pct'), '&', 'and'), '[^\p{L}\p{N}]', '', 'g') AS k FROM customer")
def f_name_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", names.name_key(F.concat("c_name", F.lit(" & % "), "c_mktsegment")).alias("k"))


@query("f_id_like", "SELECT page_id, regexp_matches(lower(trim(url)), '(id|key|guid|code|url|image|pic|photo)$') OR contains(lower(url), '(clusters)') AS x FROM pages")
def f_id_like(spark, d):
    return table(spark, d, "pages").select("page_id", names.is_id_like(F.col("url")).alias("x"))


@query("f_unreadable", """SELECT 'page' AS what, page_id AS id, regexp_matches(lower(trim(url)), '^(http://|https://|data:|www\\.|/9j/)') OR length(lower(trim(url))) > 60 AS x FROM pages
UNION ALL SELECT 'document', doc_id, regexp_matches(lower(trim(text)), '^(http://|https://|data:|www\\.|/9j/)') OR length(lower(trim(text))) > 60 FROM documents""")
def f_unreadable(spark, d):
    pages = table(spark, d, "pages").select(F.lit("page").alias("what"), F.col("page_id").alias("id"), names.is_unreadable(F.col("url")).alias("x"))
    return pages.unionByName(table(spark, d, "documents").select(F.lit("document").alias("what"), F.col("doc_id").alias("id"), names.is_unreadable(F.col("text")).alias("x")))


@query("f_format", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || format('{:,.2f}', (-c_acctbal)::DECIMAL(18,2)) || ')' ELSE '$' || format('{:,.2f}', c_acctbal::DECIMAL(18,2)) END AS shown FROM customer""")
def f_format(spark, d):
    return table(spark, d, "customer").select("c_custkey", formats.render(F.col("c_acctbal"), r"\$#,0.00;(#,0.00)").alias("shown"))


@query("f_compact", """WITH v AS (SELECT c_custkey, sum(o_totalprice) AS x FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN x >= 1e9 THEN '$' || format('{:,.2f}', x / 1e9) || 'B' WHEN x >= 1e6 THEN '$' || format('{:,.2f}', x / 1e6) || 'M' ELSE '$' || format('{:,.0f}', round(x)) END AS shown FROM v""")
def f_compact(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(formats.exact_sum(F.col("o_totalprice")).alias("x"))
    return rows.select("c_custkey", formats.compact(F.col("x"), r"\$#,0").alias("shown"))


@query("f_brief", """SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN printf('%.1f', round(o_totalprice / 1e6, 1)) || 'M' WHEN o_totalprice >= 1e3 THEN printf('%.1f', round(o_totalprice / 1e3, 1)) || 'K' ELSE regexp_replace(printf('%.1f', round(o_totalprice, 1)), '\\.0$', '') END AS shown FROM orders""")
def f_brief(spark, d):
    return table(spark, d, "orders").select("o_orderkey", formats.brief(F.col("o_totalprice")).alias("shown"))


@query("f_no_numbers", """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN (o_orderkey % 50 + 1) * 1e20::DOUBLE WHEN 5 THEN -2.5::DOUBLE ELSE 1250.0::DOUBLE END AS x FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 4 THEN format('{:,.1f}', x) WHEN o_orderkey % 7 = 5 THEN '-2.5' WHEN o_orderkey % 7 = 6 THEN '1,250.0' END AS shown,
CASE WHEN o_orderkey % 7 = 4 THEN printf('%.1f', round(x / 1e9, 1)) || 'B' WHEN o_orderkey % 7 = 5 THEN '-2.5' WHEN o_orderkey % 7 = 6 THEN '1.3K' END AS small FROM v""")
def f_no_numbers(spark, d):
    """Figures that are no numbers, infinite, missing or beyond a decimal's reach: a text or nothing."""
    k = F.col("o_orderkey") % 7
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 4, (F.col("o_orderkey") % 50 + 1) * 1e20).when(k == 5, -2.5).when(k == 6, 1250.0)
    return table(spark, d, "orders").select("o_orderkey", formats.render(x, "#,0.0").alias("shown"), formats.brief(x).alias("small"))


@query("f_canonical", r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '("(?:[^"]|"")*"|''(?:[^'']|'''')*''|\[[^\]]*\]|//[^\n]*|--[^\n]*|/\*[\s\S]*?\*/|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[\p{L}_][\p{L}\p{N}_.]*|<>|<=|>=|&&|\|\||\S)', 1) AS w FROM documents),
k AS (SELECT doc_id, list_filter(w, lambda x: NOT regexp_full_match(x, '//[^\n]*|--[^\n]*|/\*[\s\S]*?\*/')) AS w FROM t)
SELECT doc_id, sha256(array_to_string(list_transform(w, lambda x: CASE WHEN starts_with(x, '"') THEN x WHEN regexp_full_match(x, '[0-9]+(\.[0-9]+)?')
  THEN regexp_replace(regexp_replace(regexp_replace(x, '^0+([0-9])', '\1'), '(\.[0-9]*?)0+$', '\1'), '\.$', '') ELSE lower(x) END), ' ')) AS fingerprint FROM k""")
def f_canonical(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fingerprint(text.canonical(F.coalesce("text", F.lit("")))).alias("fingerprint"))


@query("f_fingerprint", "SELECT doc_id, sha256(lang || chr(31) || source || chr(31) || text) AS fingerprint FROM documents")
def f_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"))


@query("f_functions", r"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '([\p{L}_][\p{L}\p{N}_.]*)\s*\(', 1), lambda x: upper(x)))), ',') AS called FROM pages")
def f_functions(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(text.functions_called(F.col("html")), ",").alias("called"))


@query("f_references", r"SELECT part.p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(p_type || '[' || p_brand || '] + [' || p_name || ']', '((?:[\p{L}_][\p{L}\p{N}_]*)?\[[^\]]+\])', 1))), ',') AS refs FROM part")
def f_references(spark, d):
    formula = F.concat(F.lit("'"), "p_type", F.lit("'["), "p_brand", F.lit("] + ["), "p_name", F.lit("]"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.references(formula), ",").alias("refs"))


_CASES = "['SUMX', 'COUNTROWS', 'Average', 'COUNT_DISTINCT', 'MODE']"


@query("f_agg_concept", f"SELECT p_partkey, CASE ({_CASES})[p_size % 5 + 1] WHEN 'SUMX' THEN 'SUM' WHEN 'COUNTROWS' THEN 'COUNT' WHEN 'Average' THEN 'AVG' WHEN 'COUNT_DISTINCT' THEN 'COUNT_DISTINCT' END AS concept FROM part")
def f_agg_concept(spark, d):
    spelt = F.get(F.array(*[F.lit(x) for x in ("SUMX", "COUNTROWS", "Average", "COUNT_DISTINCT", "MODE")]), F.col("p_size") % 5)
    return table(spark, d, "part").select("p_partkey", patterns.concept(spelt).alias("concept"))


@query("f_pattern", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ratio' WHEN 1 THEN 'time_intelligence' WHEN 2 THEN 'row_iteration' ELSE NULL END AS behaviour, CASE p_size % 4 WHEN 0 THEN 'SUM' WHEN 2 THEN 'SUMX' END AS aggregation FROM part""")
def f_pattern(spark, d):
    formulas = [F.lit(x) for x in ("DIVIDE(SUM(a), IF(b, 1))", "DATEADD(c) + SUM(a) + MAX(b)", "SUMX(t, IF(x, 1))", "a + b")]
    called = text.functions_called(F.get(F.array(*formulas), F.col("p_size") % 4))
    return table(spark, d, "part").select("p_partkey", patterns.behaviour(called).alias("behaviour"), patterns.single_aggregation(called).alias("aggregation"))


@query("f_names_period", r"SELECT p_partkey, p_type = 'ECONOMY' OR contains(p_name, 'x') AS x FROM part")
def f_names_period(spark, d):
    name = F.when((F.col("p_type") == "ECONOMY") | F.col("p_name").contains("x"), F.concat("p_type", F.lit(" FiscalYear"))).otherwise(F.concat("p_type", F.lit("Yearbook")))
    return table(spark, d, "part").select("p_partkey", names.names_period(name).alias("x"))

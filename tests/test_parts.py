"""Sources, formats, names and load steps on small fixtures."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from grainwise.functions import dates, formats, names, text
from grainwise.operators import filters, security, shape, steps
from grainwise.plans import dashboard
from grainwise.plans.catalog import drift, graph, reconcile, requirements
from grainwise.queries import QUERIES
from grainwise.sources import stores, tables


def one(spark, column, **values):
    kinds = {k: ("double" if isinstance(v, float) else "long" if isinstance(v, int) else "string") for k, v in values.items()}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, picture, shown",
    [(0.4229, "0.0%;-0.0%;0.0%", "42.3%"), (1234.5678, r"\$#,0.###############", "$1,234.5678"), (-1234.5, "#,0;(#,0)", "(1,235)"), (0.0, "0.0;0.0;\"none\" 0", "none 0"), (12.0, "0.00", "12.00"), (7.5, '"USD "#,0.0#', "USD 7.5"), (3.0, "0.##", "3"), (1.0, "General Date", None), (1.0, "0.00;;", None), (5.0, "0,", None)],
)
def test_render(spark, value, picture, shown):
    assert one(spark, formats.render(F.col("v"), picture), v=value) == shown


@pytest.mark.parametrize("value, shown", [(1.25e6, "$1.25M"), (2.5e9, "$2.50B"), (999.0, "$999"), (-2e6, "$-2,000,000")])
def test_compact(spark, value, shown):
    assert one(spark, formats.compact(F.col("v"), r"\$#,0"), v=value) == shown


def test_exact_sum(spark):
    """A sum that ends in a half is rounded up in whatever order its figures come; sums of no numbers stay so."""
    orders = list(permutations([343828.36, 218758.4, 49553.65, 245439.09]))
    rows = [(k, v) for k, some in enumerate(orders) for v in some] + [(98, float("nan")), (98, 1.0), (99, None), (97, 1e300), (97, None)]
    summed = spark.createDataFrame(rows, "k int, v double").coalesce(1).groupBy("k").agg(formats.exact_sum(F.col("v")).alias("x"), F.sum("v").alias("plain"))
    got = {r.k: (r.x, r.shown, r.plain) for r in summed.withColumn("shown", formats.compact(F.col("x"), r"\$#,0")).collect()}
    assert {got[k][:2] for k in range(len(orders))} == {(857579.5, "$857,580")}
    assert {got[k][2] for k in range(len(orders))} > {857579.5}
    assert got[98][0] != got[98][0] and got[99][0] is None and got[97][0] == 1e300


@pytest.mark.parametrize("value, shown", [(0.0, "0"), (1.5e9, "1.5B"), (2.25e6, "2.3M"), (1500.0, "1.5K"), (12.34, "12.3"), (7.0, "7"), (0.01234, "0.012")])
def test_brief(spark, value, shown):
    assert one(spark, formats.brief(F.col("v")), v=value) == shown


def test_names(spark):
    assert one(spark, names.name_key(F.col("v")), v="Yield % & Loss") == "yieldpctandloss"
    assert [one(spark, names.is_id_like(F.col("v")), v=x) for x in ("CategoryID", "Category", "Name (clusters)", "key")] == [True, False, True, True]
    assert [one(spark, names.names_period(F.col("v")), v=x) for x in ("FiscalYear", "Yearbook", "order date")] == [True, False, True]
    assert one(spark, names.numeric_order(F.col("v")), v="Item 9") < one(spark, names.numeric_order(F.col("v")), v="Item 10")


def test_canonical(spark):
    f = lambda v: one(spark, text.canonical(F.col("v")), v=v)
    assert f("SUM( Sales[Net] ) // all\n + 1.50") == f("sum(sales[net])+1.5")
    assert f('IF(a = "Yes", 1)') != f('IF(a = "yes", 1)')
    assert one(spark, F.array_join(text.references(F.col("v")), ","), v="SUM('Big Sales'[Net]) + [Rate]") == "Big Sales[Net],[Rate]"


def test_datediff_counts_boundaries(spark):
    days = spark.sql("SELECT timestamp'2024-01-31' AS a, timestamp'2024-02-01' AS b")
    assert days.select(*[dates.datediff(F.col("a"), F.col("b"), p) for p in ("year", "month", "day", "hour")]).first()[:] == (0, 1, 1, 24)


def test_snapshot_and_decisions(spark, tmp_path):
    rows = spark.createDataFrame([("a", "measure", "x", "f")], "id string, kind string, name string, fingerprint string")
    stores.save_snapshot(rows, str(tmp_path / "s"), "v1")
    assert stores.load_snapshot(spark, str(tmp_path / "s"), "v1").collect() == rows.collect()
    rows.withColumns({"schema_version": F.lit(9), "label": F.lit("v2")}).write.mode("append").partitionBy("label").parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError):
        stores.load_snapshot(spark, str(tmp_path / "s"), "v2")
    log = spark.sql("SELECT 'r1' AS id, timestamp'2024-01-01' AS at, 'accepted' AS verdict, 'me' AS by, array('f') AS fingerprints")
    stores.append_decisions(log, str(tmp_path / "d"))
    stores.append_decisions(log.withColumn("verdict", F.lit("unheard of")), str(tmp_path / "d"))
    (tmp_path / "d" / "part-x.json").write_text("not json\n")
    assert stores.read_decisions(spark, str(tmp_path / "d")).count() == 1
    assert stores.jdbc_options("redshift", "t", host="h", database="db")["url"] == "jdbc:redshift://h/db"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), "id long, name string").collect()] == [(1, "x"), (2, None)]


def test_filter_rules(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert filters.admissible(F.col("x") > 1, df) and not filters.admissible(F.sum("x") > 1, df) and not filters.admissible(F.col("z") > 1, df)
    with pytest.raises(ValueError):
        filters.one_of("x", [])


def test_places(spark):
    spots = spark.createDataFrame([("a", 10.0, 20.0), ("b", 91.0, 0.0), ("c", float("nan"), 1.0), ("d", None, 1.0), ("e", -10.0, 30.0)], "label string, latitude double, longitude double")
    values = spark.createDataFrame([(x, v) for x, v in zip("abcde", (1.0, 2.0, 3.0, 4.0, -5.0))], "label string, value double")
    found = dashboard.places(values, spots).collect()
    assert [r["label"] for r in found] == ["e", "a"] and found[0]["south"] == -10.0 and found[0]["east"] == 30.0


def test_renames_need_a_single_pair(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, kind string, fingerprint string")
    changes = drift.diff(make([("a", "m", "1"), ("b", "m", "2"), ("c", "m", "2"), ("d", "m", "3")]), make([("x", "m", "1"), ("y", "m", "2"), ("d", "m", "4")]))
    assert [tuple(r) for r in drift.renames(changes).collect()] == [("a", "x", "m")]
    assert {r["id"]: r["event"] for r in drift.events(changes).collect()} == {"a": "renamed", "b": "removed", "c": "removed", "y": "added", "d": "changed"}


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    found = graph.closure(edges, spark.createDataFrame([("a",)], "id string"))
    assert {r["id"]: r["depth"] for r in found.collect()} == {"b": 1, "c": 2}


def test_verdicts_and_likeness(spark):
    rows = [("bi", "OOS Rate", ["test"], ["r"], ["SUM"]), ("wh", "oos_rate", ["test", "batch"], ["r"], ["SUM"]), ("bi", "Yield %", ["batch"], ["y"], ["SUM"]), ("wh", "yield_pct", ["batch"], ["y"], ["AVG"]), ("bi", "Tests", ["t"], ["x"], ["COUNT"]), ("wh", "tests", ["T"], ["X"], ["count"]), ("wh", "only", [], [], [])]
    found = reconcile.verdicts(spark.createDataFrame(rows, "platform string, name string, tables array<string>, columns array<string>, aggregations array<string>"))
    assert {r["key"]: r["verdict"] for r in found.collect()} == {"oosrate": "divergent", "yieldpct": "review", "tests": "consistent", "only": "unique"}
    assert abs(one(spark, reconcile.likeness(F.col("a"), F.col("b")), a="released", b="rejected") - 0.625) < 1e-9


def test_standing(spark):
    now = spark.createDataFrame([("a", ["1"]), ("b", ["2", "3"]), ("c", ["4"])], "id string, fingerprints array<string>")
    said = spark.createDataFrame([("b", 1, "rejected", ["9"]), ("b", 2, "accepted", ["3", "2"]), ("c", 1, "accepted", ["5"])], "id string, at int, verdict string, fingerprints array<string>")
    assert {r["id"]: r["standing"] for r in requirements.standing(now, said).collect()} == {"a": "open", "b": "decided", "c": "stale"}


def test_steps(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "a int, b int").repartition(4)
    assert [r["a"] for r in steps.row_range(df, ["a"], 5, 10, 6).orderBy("a").collect()] == list(range(5, 14))
    assert sorted(r["index"] for r in steps.add_index(df, [F.desc("a")]).collect()) == list(range(20))
    assert one(spark, security.kpi_status(F.col("v"), F.lit(10)), v=9.5) == 0


def test_the_rest_stands_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['grainwise.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_closure_goes_to_the_end(spark):
    """A chain deeper than what is walked step by step; with a bound it stops there."""
    n = 4 * graph.STEP_ROUNDS + 3
    edges = spark.createDataFrame([(str(i), str(i + 1), "x") for i in range(n)], "src string, dst string, kind string").coalesce(1)
    starts = spark.createDataFrame([("0",)], "id string")
    assert sorted((r["depth"], r["id"]) for r in graph.closure(edges, starts).collect()) == [(i, str(i)) for i in range(1, n + 1)]
    assert graph.closure(edges, starts, most=2).count() == 2
    assert graph.closure(edges, starts, most=n - 2).count() == n - 2


def plain_closure(edges, starts, most=None):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    found = []
    for s in set(starts):
        depth, todo = {s: 0}, [s]
        while todo:
            at = todo.pop(0)
            for b in ahead.get(at, ()):
                if b not in depth:
                    depth[b] = depth[at] + 1
                    todo.append(b)
        found += [(s, x, d) for x, d in depth.items() if d and (most is None or d <= most)]
    return sorted(found)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("most", [None, 9])
def test_closure_of_chains_and_cycles(spark, seed, most):
    """Random edges between long chains and cycles, some that nothing leads to: contracted from the first round on, as by hand."""
    rng = random.Random(seed)
    edges, n = [], 0
    for _ in range(12):
        size = rng.randint(1, 25)
        edges += [(i, i + 1) for i in range(n, n + size)]
        if rng.random() < 0.4:
            edges.append((n + size, n))
        n += size + 1
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(10)]
    starts = [rng.randrange(n) for _ in range(5)]
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    ids = spark.createDataFrame([(str(s),) for s in starts], "id string")
    for backwards in (False, True):
        want = plain_closure([(b, a) if backwards else (a, b) for a, b in edges], starts, most)
        got = sorted((int(r["start"]), int(r["id"]), r["depth"]) for r in graph.closure(frame, ids, backwards, most, step_rounds=1).collect())
        assert got == want


def test_closure_of_a_very_deep_chain(spark, monkeypatch):
    """10,000 steps, and a cycle at their end, in under 20 written rounds."""
    edges = spark.range(10_000).selectExpr("CAST(id AS STRING) AS src", "CAST(id + 1 AS STRING) AS dst").unionByName(spark.createDataFrame([("10000", "9000")], "src string, dst string"))
    rounds, write = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: rounds.append(name) or write(df, name))
    found = graph.closure(edges, spark.createDataFrame([("0",)], "id string"))
    assert found.agg(F.count("*"), F.max("depth")).first() == (10_000, 10_000)
    assert rounds.count("frontier") + rounds.count("chains") < 20



def test_gate_refuses_two_models(spark):
    happened = spark.createDataFrame([("a", "changed", True)], "id string, event string, is_semantic boolean")
    touched = spark.createDataFrame([("r", "revalidate")], "requirement string, action string")
    with pytest.raises(ValueError, match="different models"):
        drift.gate(happened, touched, models=("one", "two"))
    assert drift.gate(happened, touched, "any", ("one", "two"), allow_different=True).first()["fails"]
    assert not drift.gate(happened, touched, "none").first()["fails"]


def test_medians(spark):
    """Against the built-in one: even and odd numbers, ties, nulls, one row, and a group of nulls alone."""
    rows = spark.range(9001).selectExpr("CASE WHEN id % 5 = 4 THEN NULL ELSE id % 5 END AS g", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 5 = 1 THEN 7.0D ELSE pmod(id * 7919, 1000) / 8 END AS v")
    rows = rows.union(spark.createDataFrame([(10, 1.5), (11, None), (12, 1.0), (12, 4.0)], "g long, v double"))
    found = {r["g"]: r["median"] for r in shape.medians(rows, ["g"], "v").collect()}
    assert found == {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect()} and len(found) == 8


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_no_numbers(spark, value):
    for picture in ("0%", "#,0.00", r"\$#,0;(#,0);zero", "0.0##"):
        assert one(spark, formats.render(F.col("v"), picture), v=value) is None and one(spark, formats.compact(F.col("v"), picture), v=value) is None
    assert one(spark, formats.brief(F.col("v")), v=value) is None


@pytest.mark.parametrize("value", [1e20, -1e30, 1.7e308, 5e-324, -1e-310, 99999999999999990000.0, 1e37])
def test_extreme_numbers(spark, value):
    for picture in ("0%", "#,0.00", "0.0##", "0"):
        shown = one(spark, formats.render(F.col("v"), picture), v=value)
        assert float(shown.replace(",", "").replace("%", "")) == pytest.approx(value * (100 if "%" in picture else 1), abs=0.01) or value > 1e306
    assert one(spark, formats.brief(F.col("v")), v=value)


@pytest.mark.parametrize("down", [True, False])
def test_fill_over_ranges(spark, down):
    """One group over many ranges, long stretches without values, groups of one row, a group of nulls, and none at all."""
    rng = random.Random(2)
    rows = [(g, i, (None if rng.random() < 0.9 or i in range(100, 400) else f"{g}:{i}")) for g, n in (("a", 600), ("b", 1), (None, 40), ("c", 30)) for i in range(n)]
    rows = [(g, i, None if g == "c" else v) for g, i, v in rows]
    frame = spark.createDataFrame(rows, "g string, i int, v string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = steps.ranged(frame, ["g", "i"]).filter("g = 'a'").select("_part").distinct().count()
        got = {(r["g"], r["i"]): r["v"] for r in steps.fill(frame, "v", ["g"], ["i"], down).collect()}
        alone = {r["i"]: r["v"] for r in steps.fill(frame.filter("g = 'a'"), "v", [], ["i"], down).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1], reverse=not down):
        last[g] = v if v is not None else last.get(g)
        want[g, i] = last[g]
    assert parts > 8 and got == want and alone == {i: v for (g, i), v in want.items() if g == "a"}


def test_indexes_within_groups(spark):
    rows = [(g, i * 37 % 101) for g, n in (("a", 80), (None, 5), ("b", 1)) for i in range(n)]
    got = steps.add_index_within(spark.createDataFrame(rows, "g string, x int"), ["g"], [F.desc("x")], "nth", start=1).collect()
    want = {(g, x): sorted((y for h, y in rows if h == g), reverse=True).index(x) + 1 for g, x in rows}
    assert {(r["g"], r["x"]): r["nth"] for r in got} == want


def test_profile_of_few_values(spark):
    """Counts up to the bound are exact, nulls aside; beyond it they are above it."""
    df = spark.range(20_000).selectExpr("id % 30 AS a", "id % 31 AS b", "id % 45 AS c", "id AS d", "IF(id % 3 = 0, NULL, id % 5) AS e", "concat('x', id % 30) AS f", "CAST(NULL AS STRING) AS g", "id % 2 = 0 AS h", "IF(id % 7 = 0, NULL, id % 30) AS i")
    found = {r["column_name"]: r["n_distinct"] for r in tables.profile(df, df.columns, 30).collect()}
    assert {c: n for c, n in found.items() if n <= 30} == {"a": 30, "e": 5, "f": 30, "g": 0, "h": 2, "i": 30} and found["b"] >= 31 and found["d"] > 18_000


def test_medians_of_few_groups(spark):
    """Rows of a few large groups are not dealt by group: no join sorts them, so a task's memory doesn't grow with a group."""
    rows = spark.range(0, 1001, 1, 4).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    found = shape.medians(rows, ["g"], "v")
    assert {tuple(r) for r in found.collect()} == {("0", 500.0), ("1", 500.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "percentile_approx" not in plan


def test_graph_is_dealt_evenly(spark):
    """Nodes and edges are told apart in as many tasks as the session says, whatever their size, and exported in order."""
    edges = spark.range(2000).select((F.col("id") % 1000).cast("string").alias("src"), (F.col("id") % 500).cast("string").alias("dst"), F.lit("reads").alias("kind"))
    nodes, found = graph.build([edges.select(F.col("src").alias("id"), "kind")], [edges])
    assert nodes.count() == 1000 and found.count() == 1000
    assert found.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = QUERIES["s_graph_export"](spark, "/root/testdata/sf0.001").collect()
    assert rows == sorted(rows)


def test_neighbourhood_of_repeated_rows(spark):
    """Edges and nodes that repeat, also in a kind that is reached a step further, count once."""
    nodes = spark.createDataFrame([(x, k) for x, k in (("a", "node"), ("b", "node"), ("c", "node"), ("d", "source"), ("e", "node"), ("f", "source")) for _ in range(3)], "id string, kind string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "c"), ("c", "e"), ("f", "e"), ("a", "b"), ("d", "c"), ("b", "gone")], "src string, dst string")
    found = graph.neighbourhood(edges, nodes, "a", per_column=1)
    assert sorted(map(tuple, found.collect())) == [("b", "node", 1, 0), ("c", "node", 2, 0), ("d", "source", 3, 0)]


def test_edges_of_a_closure_are_dealt_once(spark, monkeypatch):
    """Repeated edges count once, none are left on disk, and a join of a frontier deals and sorts it alone, however large."""
    kept = []
    monkeypatch.setattr(graph, "dealt", lambda step, deal=graph.dealt: kept.append(deal(step)) or kept[-1])
    edges = spark.range(2000).selectExpr("concat('a', id % 100) AS src", "concat('a', id % 100 + 1) AS dst", "'k' AS kind")
    got = graph.closure(edges, spark.createDataFrame([("a97",)], "id string"))
    assert sorted((r["id"], r["depth"]) for r in got.collect()) == [("a100", 3), ("a98", 1), ("a99", 2)]
    assert len(kept) == 1 and not kept[0].is_cached
    step = graph.dealt(edges.selectExpr("src AS _from", "dst AS _to"))
    plan = edges.select("dst").hint("merge").join(step, F.col("dst") == F.col("_from"))._jdf.queryExecution().executedPlan().toString()
    outside = plan.split("InMemoryRelation")[0]
    assert step.count() == 100 and outside.count("Exchange ") == 1 and outside.count("Sort [") == 1
    step.unpersist()


def test_joined_rows_are_dealt_before_distinct_counts(spark, sf_dir):
    """A task that joins doesn't gather values to count: they are dealt to a stated number of tasks first, which adaptive execution doesn't merge."""
    found = QUERIES["a_additive"](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["measure"]: r["additive"] for r in found.collect()} == {"quantity": True, "parts": False}

"""The stored index against a scan of all texts."""

import time

import pytest

from grainwise.plans.catalog import search

KINDS = ("table", "measure")
ROWS = [
    ("1", "measure", "Net Sales", "SUM(sales[net])"), ("2", "table", "sales", None), ("3", "measure", "sales per day", "divide([Net Sales], [days])"), ("4", "measure", None, "sales sales SALES"),
    ("5", "table", "a", "b"), ("6", "table", "ab", "ab"), ("7", "measure", "", ""), ("8", "table", "Ünïque sàles", "x" * 5000 + "needle"), ("9", "measure", "x\x00y", "tail"),
]
ASKED = ["sales", "Sales", "net sales", "a", "AB", "b", "le", "needle", "days]", "nothing here", "sàles", "x" * 50, "il", "l", "y", "[", "sales sales"]


@pytest.fixture(scope="module")
def objects(spark):
    more = [(f"m{i}", KINDS[i % 2], f"order {i}", f"count of orders {i % 7}") for i in range(60)]
    return spark.createDataFrame(ROWS + more, "id string, kind string, name string, expression string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, objects, tmp_path_factory):
    return search.write_index(objects, str(tmp_path_factory.mktemp("index") / "own"))


def tier(asked, name, expression):
    a, n, e = asked.lower(), (name or "").lower(), (expression or "").lower()
    return 0 if n == a else 1 if n.startswith(a) else 2 if a in n else 3 if a in e else None


def test_many_questions(spark, objects, index):
    asked = [*ASKED, "order", "ord", "7"]
    got = search.search_many(index, objects, spark.createDataFrame([(a,) for a in [*asked, "", None]], "asked string"), KINDS).collect()
    rows = [tuple(r) for r in objects.collect()]
    want = []
    for a in asked:
        hits = sorted((t, KINDS.index(k), n is not None, n or "", i) for i, k, n, e in rows if (t := tier(a, n, e)) is not None)
        want += [(a, KINDS[k], n if has else None, t, len(hits) > 40) for t, k, has, n, _ in hits[:40]]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["asked"], r["kind"], r["name"], r["tier"], r["truncated"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["asked"] for r in got if r["truncated"]} >= {"order", "ord"}


def test_as_one_question(spark, objects, index):
    """Each question as `search` answers it."""
    got = search.search_many(index, objects, spark.createDataFrame([("sales",), ("le",)], "asked string"), KINDS)
    for a in ("sales", "le"):
        one = search.search(objects.select("kind", "name", "expression"), a, KINDS)
        assert sorted(map(str, got.filter(got.asked == a).drop("asked").collect())) == sorted(map(str, one.collect()))


def test_find_many(spark, objects, index):
    got = search.find_many(index, objects, spark.createDataFrame([(a,) for a in ASKED], "asked string"))
    want = {}
    for a in ASKED:
        for _, k, _, e in ROWS + [(f"m{i}", KINDS[i % 2], f"order {i}", f"count of orders {i % 7}") for i in range(60)]:
            if n := (e or "").lower().count(a.lower()):
                objects_, found = want.get((a, k), (0, 0))
                want[a, k] = (objects_ + 1, found + n)
    assert {(r["asked"], r["kind"]): (r["n_objects"], r["n_found"]) for r in got.collect()} == want


def test_candidates_are_few(spark, objects, index):
    """Postings are intersected: no object without the question's rarest grams is a candidate; nothing of an empty index."""
    asked = spark.createDataFrame([("needle",), ("net sales",)], "asked string")
    assert {(r["asked"], r["field"], r["id"]) for r in search.candidates(index, asked).collect()} == {("needle", "expression", "8"), ("net sales", "name", "1"), ("net sales", "expression", "3")}
    empty = search.write_index(objects.limit(0), index + "-empty")
    assert search.search_many(empty, objects, asked, KINDS).count() == 0


def test_long_text(spark, tmp_path):
    """The work for a text grows with its length: a million characters are indexed in seconds, where a search for each place from the text's start took minutes."""
    text = "abcdefghij" * 100_000 + "needle é😀"
    objects = spark.createDataFrame([("1", "table", "long", text)], "id string, kind string, name string, expression string")
    began = time.perf_counter()
    found = search.find_many(search.write_index(objects, str(tmp_path / "long")), objects, spark.createDataFrame([("NEEDLE",), ("j",), ("é😀",), ("ééé",)], "asked string"))
    assert sorted(map(tuple, found.collect())) == [("NEEDLE", "table", 1, 1), ("j", "table", 1, 100_000), ("é😀", "table", 1, 1)]
    assert time.perf_counter() - began < 60

import pytest

#: Null and empty texts and ids, repeated rows, ties, one word, shouting, a long text, a text that repeats itself.
LONG = " ".join(f"w{i % 997} then{i % 13}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over a lazy dog and then it runs far away into the deep dark wood where no one lives but an old owl who knows all of the songs that were ever sung there"
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", None), (None, "no id here", "en", "b"), (None, None, None, None),
    (4, "one", "en", "b"), (5, f"Start. {PASSAGE} end", "en", "b"), (6, f"Other words first {PASSAGE}", "en", "é"), (7, f"Start. {PASSAGE} end", "en", "a"),
    (8, "same row", "en", "a"), (8, "same row", "en", "a"), (8, "same id, other text", "en", "c"), (9, LONG, "en", "c"), (10, "ha " * 100, "en", "c"),
    (11, "Ünïcödé wörds ünd mehr  Wörter 日本語 text", "de", "é"), (12, f"{PASSAGE} {PASSAGE}", "en", "a"),
    (13, "call +49 30 1234-5678 or +1 (2, mail a.b@c.de_x@y.zz from 10.0.0.255 or 999.1.1.1, card 4111 1111 1111 1111 5 4111-1111-1111-1111", "en", "a"),
    (14, "1" * 30_000 + "." + "2" * 3000 + " @" + "a" * 3000 + "@", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS k", "2 AS fp", "3 AS size", "4 AS n", "5 AS h", "6 AS slot", "7 AS score", "8 AS root", "9 AS shard", "10 AS g", "11 AS u", "12 AS copies", "13 AS start", "14 AS kept").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def both(odd, docs):
    """The odd rows and all given documents."""
    return odd.select("doc_id", "text", "lang", "source").union(docs.selectExpr("doc_id + 1000", "text", "lang", "source")).repartition(4).cache()

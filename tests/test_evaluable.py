"""Statuses and grain options of small definition tables."""

from grainwise.plans.catalog import evaluable

MEASURES = "model string, name string, base string, inputs array<string>"


def test_statuses(spark):
    rows = [
        ("m", "sales", "orders", []), ("m", "rate", None, ["sales", "cost"]), ("m", "cost", " orders ", None), ("m", "a", None, ["b"]), ("m", "b", None, ["c", "gone"]), ("m", "c", None, ["a"]), ("m", "self", "orders", ["self"]),
        ("m", "over self", None, ["self", "sales"]), ("m", "lost", "nowhere", []), ("m", "over lost", None, ["sales", "lost"]), ("m", "one", "", []), ("m", "half one", None, ["one", "sales"]), ("m", "bad", None, ["missing", "lost"]), ("n", "sales", "orders", []), ("n", "own", None, ["rate"]),
    ]
    measures, tables = spark.createDataFrame(rows, MEASURES), spark.createDataFrame([("m", "orders"), ("n", "lines")], "model string, name string")
    found = {(r["model"], r["measure"]): (r["status"], r["construct"]) for r in evaluable.statuses(measures.unionByName(measures.limit(3)), tables).collect()}
    blocked = lambda what: ("BLOCKED", what)
    assert found == {
        ("m", "sales"): ("EXACT", None), ("m", "rate"): ("EXACT", None), ("m", "cost"): ("EXACT", None), ("m", "a"): blocked("cycle"), ("m", "b"): blocked("cycle"), ("m", "c"): blocked("cycle"), ("m", "self"): blocked("cycle"), ("m", "over self"): blocked("cycle"),
        ("m", "lost"): blocked("table"), ("m", "over lost"): blocked("table"), ("m", "one"): ("UNSUPPORTED", "constant"), ("m", "half one"): ("UNSUPPORTED", "constant"), ("m", "bad"): blocked("measure"), ("n", "sales"): blocked("table"), ("n", "own"): blocked("measure"),
    }
    assert evaluable.statuses(measures.limit(0), tables).count() == 0


def test_grain_options(spark):
    columns = spark.createDataFrame(
        [("m", "facts", "note", "string"), ("m", "facts", "amount", "double"), ("m", "facts", "shop", "int"), ("m", "shops", "shop", "int"), ("m", "shops", "town", "string"), ("m", "shops", "town_id", "string"), ("m", "lands", "land", "string"), ("m", "other", "x", "string"), ("n", "shops", "name", "string")],
        "model string, table string, name string, data_type string",
    )
    ways = spark.createDataFrame([("m", "facts", "shop", "shops", "shop", True), ("m", "shops", "k", "lands", "k", True), ("m", "facts", "o", "other", "o", False), ("m", "other", "q", "facts", "q", True)], "model string, from_table string, from_column string, to_table string, to_column string, active boolean")
    found = evaluable.grain_options(columns, ways, spark.createDataFrame([("m", "facts"), ("n", "shops")], "model string, base string"))
    assert sorted(map(tuple, found.collect())) == [("m", "facts", "facts", "note"), ("m", "facts", "lands", "land"), ("m", "facts", "shops", "town"), ("n", "shops", "shops", "name")]

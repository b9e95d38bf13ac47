"""Requirements of small definition tables: each rule's conditions, evidence and confidence."""

import pytest

from grainwise.plans.catalog import rules

TABLES = [("m", "sales", False, False, False, "t1"), ("m", "dates", False, False, False, "t2"), ("m", "Local_1", True, False, False, "t3"), ("m", "Measures", False, True, False, "t4"), ("m", "What if", False, False, True, "t5"), ("n", "one", False, False, False, "t6")]
DEFINITIONS = {
    "tables": (TABLES, "model string, name string, system boolean, measure_only boolean, parameter boolean, fingerprint string"),
    "gaps": ([("m", "visuals", 3, "nothing reads them"), ("m", "macros", 1, None)], "model string, feature string, n int, reason string"),
    "columns": ([("m", "sales", "net", None, False, "c1"), ("m", "sales", "band", " IF(a) ", True, "c2"), ("m", "sales", "lost", "  ", True, "c3"), ("m", "Local_1", "day", "x", True, "c4")], "model string, table string, name string, expression string, calculated boolean, fingerprint string"),
    "measures": (
        [
            ("m", "sales", "Net", " SUM(net) ", "f1", ["sales.net", "sales.band"], [], False), ("m", "sales", "Rate", "DIVIDE", "f2", [], ["Tax", "Net", "Cost"], False), ("m", "sales", "Empty", " ", "f3", [], [], False), ("m", "sales", "Null", None, "f4", [], [], False),
            ("m", "sales", "Sum of net", "SUM(net)", "f5", ["sales.net"], [], True), ("m", "sales", "Sum of gone", "SUM(gone)", "f6", ["sales.gone"], [], True), ("m", "sales", "Bound to none", "1", "f7", [], [], True), ("n", "sales", "Net", "SUM(other)", "f8", [], [], False),
        ],
        "model string, table string, name string, expression string, fingerprint string, columns array<string>, measures array<string>, implicit boolean",
    ),
    "relationships": (
        [("m", "sales", "day", "dates", "day", "many to one", True, True, "one way", "r1"), ("m", "sales", "shipped", "dates", "day", "many to one", False, False, "both ways", "r2"), ("m", "sales", "day", "Local_1", "day", "many to one", True, False, None, "r3"), ("m", "sales", "k", "dates", "k", "one to one", None, None, None, "r4")],
        "model string, from_table string, from_column string, to_table string, to_column string, cardinality string, active boolean, integrity boolean, direction string, fingerprint string",
    ),
    "levels": ([("m", "dates", "Calendar", 2, "Month", "month", "h1"), ("m", "dates", "Calendar", 1, "Year", "year", "h1"), ("m", "dates", "Bare", None, None, None, "h2")], "model string, table string, hierarchy string, ordinal int, level string, column string, fingerprint string"),
    "filters": ([("m", "North", "read", "sales", "[r] = 1", "p1"), ("m", "North", "read", "dates", "", "p2"), ("m", "All", "read", None, None, "p3")], "model string, role string, access string, table string, expression string, fingerprint string"),
    "kpis": ([("m", "sales", "Net", "100", "last year", "IF(x)", None, "k1"), ("m", "sales", "Rate", "1", " ", "", "up", "k2")], "model string, table string, measure string, target string, target_text string, status string, trend string, fingerprint string"),
    "permissions": ([("m", "North", "sales.cost", True), ("m", "North", "sales.bonus", True), ("m", "North", "sales.net", False), ("m", "South", "sales.net", False)], "model string, role string, target string, hides boolean"),
    "variations": ([("m", "sales", "day", "v", "'Local_1'[Date Hierarchy]"), ("m", "sales", "day", "w", "dates.Calendar"), ("m", "sales", "day", "u", None)], "model string, table string, column string, name string, target string"),
    "members": ([("m", "Board", "measure", "sales", "Net"), ("m", "Board", "column", "dates", "day"), ("m", "Nothing", None, None, None)], "model string, perspective string, member_kind string, table string, name string"),
    "items": ([("m", "Time", "YTD", 2, "CALCULATE", "i1"), ("m", "Time", "Now", 1, "", "i2"), ("m", "Hollow", None, None, None, "i3")], "model string, table string, item string, ordinal int, expression string, fingerprint string"),
    "steps": ([("m", "sales", 2, "Filtered", "keeps some rows", True, "let", "q1"), ("m", "sales", 1, "Typed", "sets types", False, "let", "q1"), ("m", "sales", 3, "Odd", None, None, "let", "q1"), ("m", "dates", None, None, None, None, " one ", "q2")], "model string, table string, nth int, step string, effect string, changes_rows boolean, query string, fingerprint string"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = rules.derive({n: spark.createDataFrame(r, s) for n, (r, s) in DEFINITIONS.items()}).collect()
    assert len({(r["model"], r["requirement"]) for r in rows}) == len(rows)
    return rows


def of(found, category, model="m"):
    return sorted((r["kind"], r["statement"], r["confidence"], [tuple(e) for e in r["evidence"]]) for r in found if r["category"] == category and r["model"] == model)


def test_measures(found):
    business = [r for r in of(found, "metrics") if "reports" in r[1]]
    assert [r[1] for r in business] == ["The solution reports Net. It reads sales.band and sales.net.", "The solution reports Rate. It is made of Cost, Net and Tax.", "The solution reports Sum of net. It reads sales.net. The report makes this figure, no measure does."]
    assert business[0][3] == [("measure:sales.Net", "f1", "SUM(net)")] and business[2][3] == [("column:sales.net", "c1", "SUM(net)")]
    functional = of(found, "measure definitions")
    assert len(functional) == 3 and any(r[1].endswith("Before it, Cost, Net and Tax must be known.") for r in functional)
    assert [r[1] for r in of(found, "metrics", "n")] == ["The solution reports Net."]


def test_incomplete_definitions(found):
    rows = of(found, "incomplete definitions")
    assert {r[2] for r in rows} == {"low"} and {r[0] for r in rows} == {"functional"}
    assert sorted(r[1].split(" ")[0 if "band" not in r[1] else 0] for r in rows) == ["Bare", "What", "What", "sales.lost"]
    assert [r[1] for r in of(found, "derived columns")] == ["sales.band is calculated by its expression in the evidence, and not loaded."]


def test_relationships(found):
    purpose = {r[3][0][1]: (r[1], r[2]) for r in of(found, "analysis by dimension")}
    assert {k: v[1] for k, v in purpose.items()} == {"r1": "medium", "r2": "low", "r4": "low"} and "another way" in purpose["r2"][0]
    built = {r[3][0][1]: r[1] for r in of(found, "relationships")}
    assert set(built) == {"r1", "r2", "r4"} and "drops no row" in built["r1"] and "inactive" in built["r2"] and "both ways" in built["r2"] and "keeps rows" in built["r4"]


def test_drilling(found):
    assert [r[1] for r in of(found, "hierarchies")] == ["Calendar of dates has 2 levels, in this order: Year (year), Month (month)."]
    said = [r[1] for r in of(found, "drilling")]
    assert said == ["Drilling sales.day goes through dates.Calendar, not through its own values.", "Users can drill sales.day by an automatic calendar.", "Users can drill sales.day by an automatic calendar.", "Users can drill through Calendar of dates: Year > Month."]


def test_who_sees_what(found):
    rows = {r[1]: r[3] for r in of(found, "who sees what")}
    assert set(rows) == {
        "Members of North see only the rows of dates and sales that its filters let through.", "Members of All have read access and see all rows.", "To members of North, sales.bonus and sales.cost don't exist.", "The view Board shows dates and sales, with Net.",
    }
    assert rows["Members of All have read access and see all rows."] == [("role:All", "p3", "access: read")]
    assert len(rows["Members of North see only the rows of dates and sales that its filters let through."]) == 2
    assert [r[3] for r in of(found, "row filters")] == [[("role:North", "p1", "[r] = 1")]]


def test_kpis_and_groups(found):
    judged = [r for r in of(found, "metrics") if "judged" in r[1]]
    assert [r[1] for r in judged] == ["Net is judged against last year.", "Rate is judged against the target in the evidence."]
    assert judged[0][3] == [("kpi:sales.Net", "k1", "target: 100; status: IF(x)")] and judged[1][3][0][2] == "target: 1; trend: up"
    assert len(of(found, "kpi thresholds")) == 1
    assert [r[1] for r in of(found, "metrics") if "seen through" in r[1]] == ["Any metric can be seen through Time, which offers Now and YTD."]
    assert [r[3][0][0] for r in of(found, "calculation groups")] == ["item:Time.YTD"]


def test_loads_scope_and_gaps(found):
    loads = [r[1] for r in of(found, "data acquisition")]
    assert loads[0] == "dates is loaded by the one expression in the evidence."
    assert loads[1] == "sales is loaded by the 3 steps in the evidence, which sets types (Typed) and keeps some rows (Filtered). 1 of them are not described. Since Filtered may change the number of rows, its figures need not equal those of its source."
    assert [r[1] for r in of(found, "scope")] == ["The solution covers 2 subjects: dates and sales."] and [r[1] for r in of(found, "scope", "n")] == ["The solution covers 1 subject: one."]
    gaps = of(found, "gaps")
    assert {r[2] for r in gaps} == {"low"} and all(r[3] == [] for r in gaps) and gaps[1][1] == "The 3 visuals of this model are not covered (nothing reads them) and have to be specified elsewhere."


def test_no_definitions(spark):
    empty = {n: spark.createDataFrame([], s) for n, (_, s) in DEFINITIONS.items()}
    assert rules.derive(empty).count() == 0

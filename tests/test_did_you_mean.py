"""The names that did_you_mean gives against difflib over all names."""

import re
from difflib import SequenceMatcher, get_close_matches

import pytest

from grainwise.plans.catalog import reconcile
from grainwise.queries import QUERIES


def by_force(asked, names):
    return sorted((a, n) for a in asked for n in get_close_matches(a, sorted(names), 5, 0.5))


@pytest.mark.parametrize("block", [2, 10_000])
def test_all_names(spark, monkeypatch, block):
    monkeypatch.setattr(reconcile, "ASKED_BLOCK", block)
    names = {"cold bolt", "cold gear", "net revenue", "total net revenue", "revenue", "gross", "order count", "count of orders", "old bolt", "a", "bold colt"}
    asked = {"culd bult", "culd gier", "nwt revenue", "rvenue", "zzz", "cuont orders"}
    frame = lambda x: spark.createDataFrame([(n,) for n in [*sorted(x), None]], "name string")
    found = reconcile.did_you_mean(frame(asked), frame(names)).collect()
    assert sorted((r["asked"], r["name"]) for r in found) == by_force(asked, names)
    assert {a for a, _ in by_force(asked, names)} == asked - {"zzz"}


def test_query(spark, sf_dir):
    names = {r["p_name"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    asked = {n.translate(str.maketrans("aeiou", "eioua")) for n in names}
    found = QUERIES["c_did_you_mean"](spark, sf_dir).collect()
    assert sorted((r["asked"], r["name"]) for r in found) == by_force(asked, names)


def pairs_by_force(left, right):
    """(left, right, basis, contradicted) of all pairs of unmatched metrics (name, columns, tables)."""
    name_key = lambda n: re.sub(r"[^a-z0-9]", "", n.lower())
    bare = lambda x: {c.lower().rpartition(".")[2] for c in x}
    keys = [{name_key(m[0]) for m in side} for side in (left, right)]
    out = []
    for a, ac, at in left:
        for b, bc, bt in right:
            if name_key(a) in keys[1] or name_key(b) in keys[0]:
                continue
            both = bare(ac) & bare(bc)
            built = bool(ac and bc) and len(both) / min(len(bare(ac)), len(bare(bc))) >= 0.6
            named = SequenceMatcher(None, name_key(a), name_key(b)).ratio() >= 0.8
            if built or named:
                out.append((a, b, "both" if built and named else "structure" if built else "name", named and not built and not both and not bare(at) & bare(bt)))
    return sorted(out)


@pytest.mark.parametrize("block", [2, 10_000])
def test_pairings(spark, monkeypatch, block):
    monkeypatch.setattr(reconcile, "ASKED_BLOCK", block)
    left = [("oosrate", ["a"], []), ("NetRevenue", ["x"], ["T"]), ("Batches Released", ["r"], ["lots"]), ("matched", ["m"], []), ("quality failure ratio", ["oos", "s.Tested"], []), ("evenue", [], [])]
    right = [("oos_rate_", ["b"], []), ("TotalNetRevenue", ["y"], ["t"]), ("batches_rejected", ["q"], ["bins"]), ("Matched", ["m"], []), ("oosx", ["OOS", "tested", "more"], []), ("revenues", [], []), ("matche", ["m"], [])]
    frame = lambda rows: spark.createDataFrame(rows, "name string, columns array<string>, tables array<string>")
    found = reconcile.pairings(frame(left), frame(right)).collect()
    want = pairs_by_force(left, right)
    assert sorted((r["left"], r["right"], r["basis"], r["contradicted"]) for r in found) == want and len(want) >= 4


def test_pairings_query(spark, sf_dir):
    assert QUERIES["c_pairings"](spark, sf_dir).count() == reconcile.MOST_PAIRS

"""The pipeline's near-duplicate stage against brute force over whole shingle sets, with planted near copies."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_operators import FOLD, words

from grainwise.llm import near_copies


def shingles(text):
    w = words((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def like(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_by_force(rows):
    """The ids that are left of rows (id, text), ids being distinct."""
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            if like(a, sets[j][1]):
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    return [sets[i][0] for i in range(len(sets)) if root[i] == i]


def planted():
    """Texts of 60 to 400 words with copies in which some words are changed: similarities around 0.7 to 0.98."""
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append(" ".join(w))
        for share in (0.004, 0.012, 0.022, 0.035):
            c = list(w)
            for i in rng.sample(range(len(c)), max(1, int(share * len(c)))):
                c[i] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(c))
    return list(enumerate(rows))


def test_planted(spark, sf_dir):
    rows = planted()
    bands = {b: 0 for b in (0.8, 0.85, 0.9)}
    sets = [shingles(t) for _, t in rows]
    for i in range(0, len(rows), 5):
        for j in range(i + 1, i + 5):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            for b in bands:
                bands[b] += b <= s < b + 0.05
    assert min(bands.values()) >= 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = corpus_pipeline.near_duplicates(spark, df, sf_dir)
    assert found.columns == df.columns and sorted(r["doc_id"] for r in found.collect()) == kept_by_force(rows)


@pytest.mark.parametrize("size", [3, 2048])
def test_chunks(spark, size, monkeypatch):
    monkeypatch.setattr(near_copies, "MEETING", size)
    monkeypatch.setattr(near_copies, "GROUP", size)
    rows = planted()[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == kept_by_force(rows)


def family(n, seed, shared=0.0, changes=(1, 2, 3, 6)):
    """n near copies of one text of 300 words; a share of its words is that of every family."""
    rng, common = random.Random(seed), random.Random(0)
    w = [f"c{common.randrange(5000)}" if i < shared * 300 else f"f{rng.randrange(5000)}" for i in range(300)]
    out = []
    for _ in range(n):
        c = list(w)
        for i in rng.sample(range(300), rng.choice(changes)):
            c[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(c))
    return out


def test_families_in_slices(spark, monkeypatch):
    """Families that meet each other, above a slice's size: the same as by brute force, whatever lies outside the largest."""
    monkeypatch.setattr(near_copies, "MEETING", 16)
    monkeypatch.setattr(near_copies, "GROUP", 8)
    texts = family(60, 1, 0.8) + family(25, 2, 0.8) + family(3, 3, 0.8) + family(20, 4)
    random.Random(9).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == kept_by_force(rows)


def test_family_costs_its_rows(spark, monkeypatch):
    """Of one large family, each text goes out about once, not once for each chunk of the others."""
    sent = []
    compared = near_copies._compared

    def counted(dealt, content, run):
        if run is near_copies._similar:
            sent.append(dealt.count())
        return compared(dealt, content, run)

    monkeypatch.setattr(near_copies, "_compared", counted)
    monkeypatch.setattr(near_copies, "GROUP", 32)
    df = spark.createDataFrame(list(enumerate(family(1200, 1, changes=(1, 2, 3)))), "doc_id long, text string")
    assert near_copies.keep_one(df).count() == 1
    assert 1200 * 0.9 < sum(sent) < 1200 * 1.2


def test_odd_rows(odd, none):
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    found = [(r["doc_id"], r["text"]) for r in near_copies.keep_one(odd).collect()]
    sets = [shingles(t) for _, t in found]
    assert set(found) <= rows and len(found) == len(set(found))
    assert not any(like(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :])
    assert all(any(like(shingles(t), s) or shingles(t) == s for s in sets) for _, t in rows)
    assert near_copies.keep_one(none).count() == 0


def test_given(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 20000").dropDuplicates(["doc_id"]).limit(600)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == kept_by_force(rows)


def test_spanning():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, 25)) for _ in range(40)]
    parts = {i: {i} for i in range(40)}
    for a, b in near_copies.similar(sets):
        both = parts[a] | parts[b]
        assert like(set(sets[a].tolist()), set(sets[b].tolist())) and not parts[a] & parts[b]
        for x in both:
            parts[x] = both
    assert all(parts[i] == parts[j] for i in range(40) for j in range(i) if like(set(sets[i].tolist()), set(sets[j].tolist())))

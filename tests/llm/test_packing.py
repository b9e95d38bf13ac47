"""Packing, spelling variants and resampling against brute force, on odd rows and on the given documents."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from grainwise.llm import packing, registry, resampling, spelling
from compare import same, views

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", ["op12_spelling", "op13_resample"])
def test_sql(spark, sf_dir, con, name):
    same(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name])


# --- packing --------------------------------------------------------------------------------------------------------


@functools.cache
def tokenizer():
    return Tokenizer.from_file(packing.byte_bpe_path())


def plain_places(lengths, capacity):
    """Sum-of-squares packing by trying each place: rooms of the open sequences, and the sequences' contents."""
    rooms, out = Counter(), []
    open_ = defaultdict(list)
    for n in sorted(lengths, reverse=True):
        best = None
        for room in [*sorted(r for r in rooms if r >= n and rooms[r]), capacity]:
            after = rooms.copy()
            if room < capacity:
                after[room] -= 1
            if room > n:
                after[room - n] += 1
            cost = sum(v * v for v in after.values())
            if best is None or cost < best[0]:
                best = (cost, room, after)
        _, room, rooms = best
        held = open_[room].pop() if room < capacity else []
        held.append(n)
        (open_[room - n] if room > n else out).append(held)
    return sorted(map(sorted, out + [h for left in open_.values() for h in left]))


def check_packed(rows, texts, capacity):
    """Pieces of each document are its ids; sequences are gapless and no longer than the capacity."""
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        at = [0, *range(first, len(ids), capacity)]
        for i, a in enumerate(at):
            part = ids[a : at[i + 1] if i + 1 < len(at) else len(ids)]
            want[doc_id, i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(both, none, capacity):
    rows = packing.pack_documents(both, capacity=capacity).collect()
    sequences = check_packed(rows, [(r["doc_id"], r["text"]) for r in both.collect()], capacity)
    short = [r["length"] for r in rows if r["length"] < capacity]
    full = sum(r["length"] == capacity for r in rows)
    assert len(sequences) - full <= len(short)
    assert sorted(sorted(n for _, n in s) for s in sequences.values() if [n for _, n in s] != [capacity]) == plain_places(short, capacity)
    assert packing.pack_documents(none).count() == 0


def test_few_sequences(docs):
    """In parts or in one: within 2% of the tokens' own number of sequences, or one a part."""
    for part_pieces in (packing.PART_PIECES, 100):
        rows = packing.pack_documents(docs, part_pieces=part_pieces).collect()
        parts = -(-sum(r["length"] < 2048 for r in rows) // part_pieces)
        assert len({r["sequence_id"] for r in rows}) <= sum(r["length"] for r in rows) / 2048 * 1.02 + 4 * parts


def test_packing_many_equal_rows(spark):
    """One text under one id, 3,000 times: all are packed, and parts are dealt by place."""
    rows = packing.pack_documents(spark.sql("SELECT 1L AS doc_id, 'the same few words' AS text FROM range(3000)"), part_pieces=500).collect()
    n = rows[0]["length"]
    assert len(rows) == 3000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    per_part = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(per_part) == 6 and max(per_part.values()) < 650
    assert len({r["sequence_id"] for r in rows}) <= 3000 * n / 2048 + 6


def test_whole_sequences(both):
    packed = packing.pack_documents(both, keep_ids=True)
    rows = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(r["length"] for r in packed.collect())
    for r in rows:
        assert len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= 2048
        assert [p["offset"] for p in r["pieces"]] == [sum(p["length"] for p in r["pieces"][:i]) for i in range(len(r["pieces"]))]


# --- spelling -------------------------------------------------------------------------------------------------------


def plain_words(rows, damaged=97, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def plain_near(n):
    """Near words by the words' gaps."""
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for same_ in gaps.values():
        for w in same_:
            near[w] |= same_ - {w}
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            if v in n:
                near[w].add(v)
                near[v].add(w)
    return near


def plain_variants(rows, damaged=97, least=3):
    n = plain_words(rows, damaged, least)
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], form[w] and n[form[w]], root(w)) for w in n)


@pytest.mark.parametrize("damaged", [97, 3])
def test_spelling(both, none, damaged):
    got = sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_variants(both, damaged=damaged, least=2).collect())
    want = plain_variants([(r["doc_id"], r["text"]) for r in both.collect()], damaged, least=2)
    assert got == want and sum(w[3] is not None for w in want) > 50
    assert spelling.spelling_variants(none).count() == 0


@pytest.mark.parametrize("most", [64, 3])
def test_near_pairs(spark, most):
    """Words of few letters, whose signatures crowd; both ways give each pair once."""
    rng = np.random.default_rng(5)
    found = {"".join(rng.choice(list("abcdé"), rng.integers(5, 9))) for _ in range(1500)}
    rows = spelling.near_pairs(spark.createDataFrame([(w, 3) for w in found], "word string, n long"), most_in_one=most).collect()
    near = plain_near(dict.fromkeys(found, 3))
    assert sorted((r["a"], r["b"]) for r in rows) == sorted((a, b) for a in near for b in near[a] if a < b)
    assert len(rows) > 500


def test_signatures_hold_two_changes():
    """Whatever is replaced, inserted or deleted, one signature stays."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        w = "".join(rng.choice(list("abcdefgàé"), rng.integers(5, 12)))
        i, c = rng.integers(0, len(w)), rng.choice(list("abcxyzñ"))
        others = [w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]]
        found = [set(row.tolist()) for row in spelling.signatures([w, *others])]
        assert all(found[0] & f for f in found[1:])


def test_long_chain_of_forms(spark):
    """Counts that double: the root of each is the last."""
    chain = [("a" * 5 + "b" * i, 3 * 2**i) for i in range(12)]
    linked = spark.createDataFrame([(w, chain[i + 1][0] if i + 1 < len(chain) else None) for i, (w, _) in enumerate(chain)], "word string, form string")
    assert {(r["word"], r["root"]) for r in spelling.roots(linked).collect()} == {(w, chain[-1][0]) for w, _ in chain[:-1]}


# --- resampling -----------------------------------------------------------------------------------------------------


def grams(text, runs):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, runs=1, buckets=10_000, percent=10):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(zlib.crc32(g.encode()) % buckets for g in grams(text, runs)[1])
    for text in target:
        t.update(zlib.crc32(g.encode()) % buckets for g in grams(text, runs)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        n_words, found = grams(text, runs)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), n_words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    able = able[: percent * len(able) // 100]
    return out, able


def by(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("runs,buckets,percent,sketch", [(1, 10_000, 10, 10_000), (2, 512, 40, 10), (3, 64, 100, 10_000), (1, 64, 1, 2)])
def test_resample(spark, sf_dir, both, runs, buckets, percent, sketch):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    want, drawn = plain_resample(rows, [r["text"] for r in target.collect()], runs, buckets, percent)
    got = resampling.resample(both, target, percent, runs=runs, buckets=buckets, sketch=sketch).collect()
    assert sorted((tuple(r)[:5] for r in got), key=by) == sorted(want, key=by)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == [(r[4], r[0]) for r in drawn]


def test_resample_ties(spark, both, none):
    """Equal rows with one id, or none, are drawn one by one; nothing is drawn of nothing."""
    long = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, long)] * 50 + [(None, long)] * 50, "doc_id long, text string")
    for percent in (10, 50, 75, 100):
        got = [r["rank"] for r in resampling.resample(rows, both.limit(0), percent).collect() if r["rank"] is not None]
        assert sorted(got) == list(range(1, percent + 1))
    assert resampling.resample(none, both.limit(0)).count() == 0


def test_crc32_spans():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4500, 400)
    ends = starts + rng.integers(0, 90, 400)
    assert resampling.crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    assert resampling.crc32_spans(data, starts[:0], ends[:0]).tolist() == []

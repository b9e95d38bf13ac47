"""Each operator against a brute-force version, on odd rows and on the given documents."""

import bisect
import functools
import hashlib
import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from grainwise.llm import decontamination, lm_scoring, mixing, pii, quality_classifier, quality_rules, registry, sharding, simhash, substring_dedup, token_output

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_names():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_substring_dedup(both, none):
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    places = Counter()
    for _, text in rows:
        w = words(text)
        places.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for doc_id, text in rows:
        w = words(text)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if places[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        want.append((doc_id, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(both).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.remove_repeats(none).count() == 0
    r = {r["doc_id"]: r for r in substring_dedup.remove_repeats(both.filter("doc_id IN (5, 7)")).collect()}
    assert (r[5]["repeat_start"], r[5]["repeat_end"]) == ([0], [r[5]["n_words"]])


def test_lm_scoring(both, none):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    texts = [(r["doc_id"], r["text"]) for r in both.collect()]
    toks = lambda t: [*words((t or "").translate(FOLD)), None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for i, t in texts:
        if not out(i):
            count.update(toks(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i, out(i), len(toks(t)), sum(count[x] > 0 for x in toks(t)), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in toks(t)), 4)) for i, t in texts), key=key)
    rows = lm_scoring.score_texts(both, held).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows), key=key)
    assert got == want
    assert all(r["score"] < 0 for r in rows)
    mean = lambda c, h: sum(r[c] for r in rows if r["held_out"] == h) / sum(r["n_tokens"] for r in rows if r["held_out"] == h)
    assert mean("score", False) > mean("base_score", False) and mean("score", True) > mean("base_score", True)
    assert lm_scoring.score_texts(none, held).count() == 0


@functools.cache
def quantised(n):
    """(lower, upper) end of a count: 1 to 8, then four values a doubling."""
    values = [*range(1, 8), *((4 + i) << e for e in range(1, 40) for i in range(4))]
    k = bisect.bisect_right(values, n)
    return (values[k - 1] if k else 0), (values[k] - 1 if k else 0)


def plain_scores(texts, out, prior):
    """log10 probabilities by exact counts that are quantised as the filter does, and the words' shares."""
    toks = lambda t: [*words((t or "").translate(FOLD)), None]
    word, pair, n = Counter(), Counter(), 0
    for i, t in texts:
        if not out(i):
            n += 1
            w = toks(t)
            word.update(w)
            pair.update(zip(["", *w], w))
    total = sum(quantised(c)[0] for c in word.values()) + len(word) + 1
    share = lambda w: (quantised(word[w])[0] + 1) / total

    def p(v, w):
        own = n if v == "" else quantised(word[v])[1]
        return (quantised(pair[v, w])[0] + prior * share(w)) / (own + prior)

    return [sum(math.log10(p(v, w)) for v, w in zip(["", *toks(t)], toks(t))) for _, t in texts], word, share, p


@pytest.mark.parametrize("broadcast", [1 << 28, 0])
def test_lm_scores(both, broadcast):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = sorted(((r["doc_id"], r["text"]) for r in both.collect()), key=key)
    want, vocabulary, share, p = plain_scores(texts, out, lm_scoring.PRIOR)
    # With bits to spare there are next to no false positives.
    rows = lm_scoring.score_texts(both, held, broadcast_bytes=broadcast, bits_per_entry=2000).collect()
    got = sorted((key((r["doc_id"],)), r["n_tokens"], r["score"]) for r in rows)
    want = sorted((key((i,)), len(words(t)) + 1, s) for (i, t), s in zip(texts, want))
    off = [abs(a[2] - b[2]) / a[1] for a, b in zip(got, want, strict=True)]
    assert [x[:2] for x in got] == [x[:2] for x in want] and sum(x > 1e-5 for x in off) <= 2 and max(off) < 0.1
    rough = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in lm_scoring.score_texts(both, held, broadcast_bytes=broadcast).collect()}
    exact = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in rows}
    assert sum(abs(rough[k] - exact[k]) for k in exact) < 0.02 * sum(k[1] for k in exact)
    # Shares of the vocabulary and one unknown word add up to 1; the pairs of a context to no more.
    assert sum(map(share, vocabulary)) + share("never seen") == pytest.approx(1)
    for v in ["", *sorted(filter(None, vocabulary))[::3000]]:
        assert sum(p(v, w) for w in vocabulary) <= 1 + 1e-9


def test_lm_scores_without_training(both):
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm_scoring.score_texts(both, F.lit(True)).collect()} == {(0, 0, 0.0, 0.0)}


def test_every_pair_is_in_the_filter(spark):
    """Texts of pairs that occur once: each known pair scores above the words' shares, whatever the number of segments."""
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 2000))) for i in range(60)]
    trained = lm_scoring.train(spark.createDataFrame(texts, "doc_id long, text string").select("text"))
    f = trained.shared().filter()
    for _, t in texts[:5]:
        data, offsets = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])
        _, token, pair = lm_scoring.tokens(data, offsets)
        assert (f.levels(pair) >= 1).all() and (f.levels(token) >= 1).all()


def test_bloom_levels():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2**63, 50000).astype(np.uint64) * np.uint64(2) | np.uint64(1))
    counts = (2 ** rng.uniform(0, 14, len(grams))).astype(np.int64)
    segment = lm_scoring.segment_of(grams, 4)
    rows = []
    for s in range(16):
        own = segment == s
        half = counts[own] // 2
        for n in (half, counts[own] - half):  # two steps that hold each n-gram
            rows.append((s, grams[own][n > 0].tobytes(), n[n > 0].astype(np.uint32).tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["segment", "h", "n"])
    built = list(lm_scoring._build(4, lm_scoring.BITS_PER_ENTRY)(iter([batch])))
    f = lm_scoring.Filter.of(4, [b.column(0)[0].as_py() for b in built], [b.column(1)[0].as_py() for b in built])
    want, level = lm_scoring.level_of(counts), f.levels(grams)
    assert (level >= want).all() and (level > want).mean() < 0.03
    assert (f.levels(rng.integers(0, 2**63, 50000).astype(np.uint64) * np.uint64(2)) > 0).mean() < 0.03
    assert sum(b.column(2)[0].as_py() for b in built) == counts.sum()


def test_questions_follow_stretches_not_texts():
    """2,000 texts of the same words ask each part once a stretch, and are answered as the whole filter would."""
    text = " ".join(f"w{i}" for i in range(40))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([text] * 2000)], ["at", "text"])
    asked = pa.Table.from_batches(lm_scoring._ask(8, 9)(iter([batch])))
    grams = np.unique(np.concatenate(lm_scoring.tokens(*text_of(text))[1:]))
    assert set(asked["at"].to_pylist()) == {0, 512, 1024, 1536} and asked.num_rows <= 4 * 16
    assert np.frombuffer(b"".join(asked.slice(0, asked.num_rows // 4)["raw"].to_pylist()), np.uint64).tolist() == grams.tolist()
    counts = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([grams.tobytes()]), pa.array([np.full(len(grams), 9, np.uint32).tobytes()])], ["part", "h", "n"])
    built = list(lm_scoring._build(8, lm_scoring.BITS_PER_ENTRY)(iter([counts])))  # segments that went together come out one by one
    assert [b.column(0)[0].as_py() for b in built] == sorted(set(lm_scoring.segment_of(grams, 8).tolist()))
    kept = pa.table({"part": pa.array([b.column(0)[0].as_py() >> 4 for b in built], pa.int32()), "kind": pa.array([0] * len(built), pa.int32()), "at": [b.column(0)[0].as_py() for b in built], "raw": pa.array([b.column(1)[0].as_py() for b in built], pa.binary())})
    rows = pa.concat_tables([kept, asked]).sort_by([("part", "ascending"), ("kind", "ascending"), ("at", "ascending")])
    got = pa.Table.from_batches(lm_scoring._answer(8, 9)(iter(rows.combine_chunks().to_batches(max_chunksize=7)))).sort_by([("at", "ascending"), ("part", "ascending")])
    whole = lm_scoring.Filter.of(8, [b.column(0)[0].as_py() for b in built], [b.column(1)[0].as_py() for b in built])
    assert b"".join(got["levels"].to_pylist()) == whole.levels(grams).astype(np.uint8).tobytes() * 4


def text_of(text):
    return np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])


@pytest.mark.parametrize("step", [1, 20_000])
def test_lm_scores_by_stretches(spark, both, monkeypatch, step):
    """A filter that isn't broadcast gives the same scores, however texts are cut into stretches and batches."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = lambda limit: sorted(map(tuple, lm_scoring.score_texts(both, held, broadcast_bytes=limit).collect()), key=key)
    want = rows(1 << 28)
    monkeypatch.setattr(lm_scoring, "STEP", step)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = rows(0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_distinct():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 9, 1000), rng.integers(0, 2**62, 1000), [5], [5, 5], [7, 6, 7, 6, 5]):
        x = np.array(x, np.uint64)
        want, at = np.unique(x, return_inverse=True)
        got, of = lm_scoring.distinct(x)
        assert got.tolist() == want.tolist() and of.tolist() == at.tolist()


def fingerprint(text):
    w = words((text or "").translate(FOLD))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(both, none):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in both.collect()]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i, f, least.get(root[f])) for i, f in rows), key=key)
    found = simhash.near_duplicates(both)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()), key=key) == want
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(both).count() == len({root[f] for f in fps})


def test_bit_sliced_pairs():
    rng = np.random.default_rng(3)
    for n, groups in ((1, 1), (2, 1), (300, 1), (1000, 40), (200, 3)):
        base = rng.integers(0, 2**63, n).astype(np.uint64) if n < 500 else np.repeat(rng.integers(0, 2**63, groups).astype(np.uint64), n // groups)
        near = base[rng.integers(0, len(base), len(base))] ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64))
        fps = np.where(rng.random(len(base)) < 0.5, base, near)
        group = np.sort(rng.integers(0, groups, len(fps)))
        end = np.searchsorted(group, group, "right")
        for radius in (0, 1, 2, 3):
            i, j = simhash.pairs_within(fps, end, radius)
            want = {(a, b) for a in range(len(fps)) for b in range(a + 1, end[a]) if int(fps[a] ^ fps[b]).bit_count() <= radius}
            assert set(zip(i.tolist(), j.tolist())) == want


def test_components_of_a_chain(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 600), (600, 500)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 500: 500, 600: 500}


def test_token_output(both, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.byte_bpe_path())
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    ids = {(i, x): np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in rows}
    want = sorted(((i, len(ids[i, x]), zlib.crc32(ids[i, x].tobytes())) for i, x in rows), key=key)
    got = token_output.token_output(both).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_output.token_output(none).count() == 0


def test_codec():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 3, 4, 5, 0, 17, 1000])
    ranks = (2 ** rng.uniform(0, 32, counts.sum())).astype(np.uint32)
    control, data = token_output.encode_ranks(ranks, counts)
    out, at, k = token_output.decode_ranks(b"".join(control), b"".join(data)), 0, 0
    for n in counts:
        assert (out[at : at + n] == ranks[k : k + n]).all()
        at, k = at + -(-n // 4) * 4, k + n


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding(both, none, shards):
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in both.collect())
    rows = sharding.shard_documents(both, shards).collect()
    assert len(rows) == len(texts)
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len(t.encode()) + 8, zlib.crc32(t.encode())) for _, _, t in texts)
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard_documents(none, shards).count() == 0


def test_packing_balances_three_dimensions():
    rng = np.random.default_rng(2)
    vectors = rng.pareto(2, (3000, 3)) + 0.1
    placed = sharding.pack(vectors, 24)
    load = np.array([np.bincount(placed, vectors[:, d], 24) for d in range(3)])
    assert (load.max(1) / load.mean(1) < 1.1).all()


def test_a_hot_group_is_split(spark):
    """A group of a third of all rows needs several of 24 shards, and a group of null ids likewise; all others stay whole."""
    for doc_id in ("id", "CASE WHEN id % 3 > 0 THEN id END"):
        df = spark.range(6000).selectExpr(f"{doc_id} AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' WHEN id % 3 = 1 THEN concat('text ', id % 900) ELSE concat('text ', id) END AS text")
        rows = sharding.shard_documents(df, 24).collect()
        sizes, where = Counter(r["shard"] for r in rows), {}
        for r in rows:
            where.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert max(sizes.values()) - min(sizes.values()) < 60
        one, most = sorted(map(len, where.values()))[-2:]
        assert one == 1 and 8 <= most <= 11  # it holds 3 / 7 of the tokens


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_shards_of_documents(spark, sf):
    """No group of equal texts is above a shard's capacity here, so each lies in one shard; bytes, tokens and rows are near equal."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = sharding.op5_shards(spark, f"/root/testdata/sf{sf}").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    shard_of, load = {}, np.zeros((24, 3))
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "bytes", None)
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"], len(words(text)), 1
    assert len(rows) == len(texts) and len(shard_of) < len(texts)
    assert (load.max(0) / load.mean(0) < (1.15 if sf == "0.01" else 1.02)).all()
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_mixing(odd, both, none):
    import duckdb
    from compare import rows as plain

    documents = both.toPandas()  # noqa: F841
    want = duckdb.sql(mixing.SQL)
    got = mixing.mix_sources(both)
    got = got.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(want.columns, want.fetchall())
    assert mixing.mix_sources(none).count() == 0 and mixing.take_mix(none).count() == 0
    taken = mixing.take_mix(odd)
    assert taken.columns == odd.columns
    assert taken.count() == mixing.mix_sources(odd).selectExpr("sum(copies)").first()[0]


def test_mix_comes_near_its_targets(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 1 + int(id % 37)) AS text", "concat('s', id % 7) AS source")
    # Null and repeated ids, and wholly equal rows, each have a draw of their own.
    for rows in (df, df.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "source"), df.selectExpr("doc_id % 5 AS doc_id", "'one text of five words' AS text", "source")):
        for r in mixing.mix_sources(rows).groupBy("source").agg({"target": "max", "*": "count"}).join(mixing.mix_sources(rows).selectExpr("source AS s", "size * copies AS t").groupBy("s").agg({"t": "sum"}), F.col("source").eqNullSafe(F.col("s"))).collect():
            assert abs(r["sum(t)"] - r["max(target)"]) <= 0.01 * r["max(target)"] + 37


def test_order_by_odds_is_not_the_order_of_the_draw(spark):
    """Documents of one source and class of size: what is taken is a fixed number, those of least q, and not those of least u."""
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3 + i % 60, 64)), "ab"[i % 2]) for i in range(1200)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = mixing.staged(mixing.sized(df, "doc_id", "text", "source"), "test")
    rows = mixing.drawn(mixing._single(mixing._joined(rows, mixing._plan(rows, (3, 1, 2), 1.5, 2), ["source"])), 2, 6)
    whole = mixing._copies(rows, mixing.cuts(rows, 16)).withColumn("u", mixing.uniform(F.col("doc_id"), F.col("text_md5"), F.col("occurrence"), 6)).collect()
    some = [r for r in whole if r["source"] == "b" and r["odds"] > 0 and r["class"] == 24]
    n = round(sum(r["odds"] for r in some) / mixing.ODDS)
    q = lambda r: r["u"] / (1 - r["u"]) / (r["odds"] / mixing.ODDS / (1 - r["odds"] / mixing.ODDS))
    lowest = {r["doc_id"] for r in sorted(some, key=q)[:n]}
    whole_copies = {r["doc_id"]: r["whole"] for r in mixing.drawn(rows.drop("copies", "odds", "class", "place"), 2, 6).withColumnRenamed("copies", "whole").collect()}
    taken = {r["doc_id"] for r in some if r["copies"] > whole_copies[r["doc_id"]]}
    assert taken == lowest and 50 < n < len(some) - 50
    assert taken != {r["doc_id"] for r in sorted(some, key=lambda r: r["u"])[:n]}
    assert len({r["odds"] for r in some}) > 20


def test_clashing_columns_of_a_mix(spark):
    df = spark.createDataFrame([(i, f"some text {i}", "s", i, "x") for i in range(50)] * 2, "doc_id long, text string, source string, `a.b` long, _mix_p string").withColumn("copies", F.lit(7)).withColumn("row", F.lit(8))
    found = mixing.take_mix(df)
    assert found.columns == df.columns and {(r["a.b"] - r["doc_id"], r["copies"], r["row"], r["_mix_p"]) for r in found.collect()} == {(0, 7, 8, "x")}
    assert found.count() == mixing.mix_sources(df).agg(F.sum("copies")).first()[0]


def test_quality_rules(both, none):
    import duckdb
    from compare import rows as plain

    documents = both.toPandas()  # noqa: F841
    want = duckdb.sql(quality_rules.SQL)
    got = quality_rules.quality_rules(both).select(*want.columns)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(want.columns, want.fetchall())
    assert quality_rules.quality_rules(none).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii(both, none):
    short = both.filter("doc_id IS NULL OR doc_id != 14")  # the brute-force patterns are quadratic in its run of digits
    texts = sorted(((r["doc_id"], r["text"]) for r in short.collect()), key=key)
    rows = pii.find_pii(short).collect()
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["base"]]) for r in rows), key=key)
    assert got == sorted(((i, base(t or "")) for i, t in texts), key=key)
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in rows)
    assert pii.find_pii(none).count() == 0
    assert pii.find_pii(both).count() == both.count()


@pytest.mark.parametrize("text", ["a@b.co_x@y.zz", "x@y.com@z.org", "1.2.3.4.5.6.7.8.9", "999.1.2.3 0001.2.3.255", "+49 (30) 1234-5678. +1 2", "4111 1111-1111 1111 5", "@@a@b", "a@b.c..d@e.f-", "+1+49 123 456 789", "a@b-.c d@.e"])
def test_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base(text)


def labelled_docs(n):
    """Texts that name a phone number with its country code and again without; decoys of as many digits stand in others."""
    rng, docs, want = np.random.default_rng(8), [], {}
    filler = "soon later there with about again from where nobody cares".split()
    for i in range(n):
        number, decoy = f"{5000000 + i * 7919 % 4000000}", f"{1000000 + i * 104729 % 4000000}"
        w = lambda k: " ".join(rng.choice(filler, k))
        text = f"{w(5)} call +4930{number} {w(8)} {number} {w(3)} {decoy} {w(4)} {decoy} {w(2)}"
        docs.append((i, text))
        at = text.index(f" {number} ") + 1
        want[i] = [("phone", at, at + 7)]
    return docs, want


def test_field_makes_labels_agree(spark):
    """The query's own fit and thresholds: what a pattern finds once is found where it repeats, and elsewhere nothing is."""
    docs, want = labelled_docs(400)
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s not in r["base"]] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    added = [(i, s) for i, spans in found.items() for s in spans]
    right = sum(s in want[i] for i, s in added)
    assert right >= 0.9 * len(docs) and right >= 0.97 * len(added)


def test_added_spans_of_documents(spark):
    """On the given documents the field finds the secrets, which no pattern of the base names, and next to nothing else."""
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op8_pii(spark, sf_dir).collect()
    added = [(r["doc_id"], *x.split(":")) for r in rows for x in r["spans"].split(",") if x and x.split(":")[0] == "secret"]
    secrets = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)}
    right = {(i, int(a), int(b)) for i, _, a, b in added} & secrets
    assert len(right) >= 0.9 * len(secrets) > 0 and len(right) >= 0.95 * sum(r["n_added"] for r in rows)
    assert all(r["n_spans"] == r["n_added"] + r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows)


def test_marginals_of_small_graphs():
    """Messages against sums over all labellings: exact on trees, near on a loop."""
    from itertools import product

    rng = np.random.default_rng(6)
    labels = len(pii.LABELS) + 1
    for links, near in (([(0, 1), (1, 2), (1, 3)], 1e-3), ([(0, 1), (1, 2), (0, 2)], 0.05), ([(0, 1)], 1e-3), ([], 1e-9)):
        w = pii.Weights()
        w.node[:] = rng.normal(size=w.node.shape)
        w.chain[:], skip = rng.normal(size=w.chain.shape) * 0.5, rng.normal(size=w.skip.shape) * 0.5
        w.skip[:] = (skip + skip.T) / 2
        f = pii.Field([])
        n = 4
        f.forms = [[int(x)] for x in rng.integers(0, pii.N_FEATURES, n)]
        f.label, f.seen = np.array([0, 0, 3, 0]), np.array([False, False, True, False])
        f.chain, f.skip = np.array(links[:1], int).reshape(-1, 2), np.array(links[1:], int).reshape(-1, 2)
        total = np.zeros((n, labels))
        unary = pii.dense(f.forms) @ w.node
        for y in product(range(labels), repeat=n):
            if y[2] != 3:
                continue
            z = sum(unary[i, y[i]] for i in (0, 1, 3)) + sum(w.chain[y[a], y[b]] for a, b in f.chain) + sum(w.skip[y[a], y[b]] for a, b in f.skip)
            total[range(n), y] += np.exp(z)
        assert np.abs(pii.marginals(f, w, 100) - total / total.sum(1, keepdims=True)).max() < near


def test_long_texts_without_blanks():
    """Time that grows with the length alone."""
    for text in ("x" * 1_000_000 + " a1", "x" * 500_000 + "1" + "y" * 500_000 + " 12", "1x" * 300_000, "@" * 300_000, "+1" * 300_000, "1.2." * 200_000):
        began = time.perf_counter()
        field = pii.Field([(0, text, pii.base_spans(text))])
        assert time.perf_counter() - began < 5
        assert [(a, b) for a, b in pii.node_words(text)] == [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m[0])]
        assert len(field.label) <= 2


def test_quality_classifier(spark, both, none, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.95
    rows = quality_classifier.classify(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.classify(none, labels).count() == 0
    assert all(r["score"] == pytest.approx(1.0) for r in quality_classifier.classify(both, labels.filter("quality = 1")).collect())


def test_classifier_keeps_clashing_columns(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clashing = odd.selectExpr("*", "21 AS label", "22 AS quality", "23 AS _id", "24 AS at", "25 AS _text", "26 AS _quality", "27 AS `a.b`", "28 AS quality_score")
    found = quality_classifier.keep_quality(clashing, labels)
    assert found.columns == clashing.columns
    assert {tuple(r)[-8:] for r in found.collect()} <= {tuple(range(21, 29))}
    assert len(quality_classifier.classify(clashing, labels).collect()) == odd.count()


def test_the_fit_takes_just_its_rows(spark):
    """One labelled id that repeats, so that all its rows tie: the sample stays as large as it may be."""
    docs = spark.range(2000).selectExpr("1 AS doc_id", "'one text of many words' AS text")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = quality_classifier.training_rows(docs, labels).unionByName(spark.range(300).selectExpr("concat('other ', id) AS text", "0 AS label", "id AS at"))
    sample = quality_classifier.fit_sample(rows, {1: 2000, 0: 300}, 100)
    assert Counter(r["label"] for r in sample.collect()) == {0: 50, 1: 50}


def test_class_counts_and_scores_by_force(spark):
    """Counts of every n-gram and shape by sets of strings, ratios, margins and the curve from them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality_classifier.training_rows(docs, labels).collect()
    shape = lambda w: re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub(r"[a-z\u0080-\U0010ffff]", "a", w))))
    counts = [Counter(), Counter()]
    for r in rows:
        w = words(r["text"])
        low, shapes = [x.translate(FOLD) for x in w], [shape(x) for x in w]
        counts[r["label"]].update({("w", x) for x in low} | {("s", x) for x in shapes} | {("ww", *x) for x in zip(low, low[1:])} | {("ss", *x) for x in zip(shapes, shapes[1:])})
    frame = spark.createDataFrame(rows, "text string, label int, at long").select("text", "label")
    found = {r["f"]: (r["n0"], r["n1"]) for r in frame.mapInArrow(quality_classifier._class_counts, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    # Buckets that one n-gram has to itself hold its count; there are few others.
    want = Counter((counts[0][x], counts[1][x]) for x in set(counts[0]) | set(counts[1]))
    got = Counter(found.values())
    assert sum((got & want).values()) > 0.8 * sum(want.values())
    model = quality_classifier.fit(quality_classifier.training_rows(docs, labels))
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, labels).collect()}
    for r in docs.limit(40).collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        _, f = quality_classifier.features(data, np.array([0, len(data)]))
        margin = sum(float(model.weights[x]) for x in set(f.tolist())) / math.sqrt(max(1, len(f))) + model.bias
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.a * margin + model.b)))), abs=1e-6)


def test_dual_descent_is_the_optimum():
    """The weights against projected gradient steps on the dual's dense matrix."""
    rng = np.random.default_rng(7)
    x = [(np.sort(rng.choice(12, 5, replace=False)), rng.normal(size=5)) for _ in range(60)]
    y, cost = np.where(rng.random(60) < 0.5, 1.0, -1.0), rng.uniform(0.2, 1.0, 60)
    rows = np.zeros((60, 12))
    for i, (f, v) in enumerate(x):
        rows[i, f] = v
    q = (y[:, None] * rows) @ (y[:, None] * rows).T
    alpha = np.zeros(60)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    w = quality_classifier.dual_descent(x, y, cost, 12, rounds=3000)
    assert np.abs(w - (alpha * y) @ rows).max() < 1e-2


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    x = [(np.array([0, 1, 2]), np.array([a, b, 1.0])) for a, b in rng.normal(size=(400, 2))]
    y = np.array([1.0 if v[0] + 2 * v[1] > 0.3 else -1.0 for _, v in x])
    w = quality_classifier.dual_descent(x, y, np.full(400, 10.0), 3, rounds=60)
    assert np.mean([np.sign(w @ v) == t for (_, v), t in zip(x, y)]) > 0.97


def plain_overlaps(text, item):
    """The longest stretch of any diagonal with at least four agreements for each disagreement, ends agreeing."""
    w = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").translate(FOLD))
    a, b = w(text), w(item)
    best = 0
    if len(b) < 13:
        same = [sum(x == y for x, y in zip(a[i:], b)) for i in range(len(a) - len(b) + 1)]
        return len(b) if b and max(same, default=0) >= 4 * (len(b) - max(same, default=0)) else 0
    for shift in range(-len(b), len(a)):
        same = [a[i + shift] == b[i] for i in range(len(b)) if 0 <= i + shift < len(a)]
        for i in range(len(same)):
            for j in range(len(same), i + best, -1):
                part = same[i:j]
                if part[0] and part[-1] and sum(part) >= 4 * (len(part) - sum(part)):
                    best = j - i
                    break
    return best if best >= 13 else 0


def test_decontamination(spark, odd, none):
    items = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, None), (4, ""), (5, "two words"), (1, "same id as the first but other words that come again and again here")]
    texts = [
        (1, "Start a b c d e f g h i j k l m n o p end"), (2, "a b c d e F, G. h i XX k l m n o p q r"), (3, "a b c XX YY f g h ZZ j k l"), (4, "Alpha, beta; gamma delta epsilon zeta eta theta iota!"),
        (5, None), (6, ""), (7, "m n o p q r s t u v w"), (8, "same id as the first but other words that come again and again here a b c d e f g h i j k l m n"), (None, "x a b c d e f g h i j k l m y"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, k, n) for i, t in texts for k, x in items if (n := plain_overlaps(t, x))), key=key)
    got = sorted(((r["doc_id"], r["item_id"], r["n_words"]) for r in decontamination.overlaps(df, bench).collect()), key=key)
    assert got == want and len(got) >= 6
    assert decontamination.clean(df, bench).count() == len({t for t in texts} - {(i, t) for i, t in texts if any(plain_overlaps(t, x) for _, x in items)})
    assert decontamination.clean(odd, bench).count() == odd.count()
    assert decontamination.overlaps(none, bench).count() == 0 and decontamination.clean(df, bench.limit(0)).count() == len(texts)


@pytest.mark.parametrize("length", [1, 4, 5, 6, 7, 9, 12, 13, 14, 20])
def test_items_of_any_length(spark, length):
    """Items with up to a fifth of their words substituted, at any places, are found in a text."""
    rng = np.random.default_rng(length)
    item = [f"i{x}" for x in range(length)]
    texts = [(0, " ".join(["x", *item, "y"])), (1, " ".join(item)), (2, " ".join(item[:-1]))]
    for i in range(3, 40):
        w = list(item)
        for at in rng.choice(length, min(length, int(rng.integers(0, length // 5 + 2))), replace=False):
            w[at] = "other"
        texts.append((i, " ".join(["before", "it", *w, "after"])))
    bench = spark.createDataFrame([(1, " ".join(item).upper())], "item_id long, text string")
    want = sorted((i, n) for i, t in texts if (n := plain_overlaps(t, " ".join(item))))
    found = decontamination.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in found) == want and len(want) > 2


def test_longest_overlap():
    rng = np.random.default_rng(4)
    for _ in range(400):
        agree = rng.random(rng.integers(0, 40)) < rng.choice([0.5, 0.8, 0.95])
        best = (0, 0)
        for i in range(len(agree)):
            for j in range(i + 1, len(agree) + 1):
                n = int(agree[i:j].sum())
                if agree[i] and agree[j - 1] and n >= 4 * (j - i - n) and j - i > best[1] - best[0]:
                    best = (i, j)
        assert decontamination.longest_overlap(agree) == best


@pytest.mark.parametrize("bits", [2, 24])
def test_decontamination_with_a_full_bitmap(spark, bits):
    """Passages that many items and many texts share, words that repeat, and a bitmap that rules nothing out."""
    common = " ".join(f"c{i}" for i in range(20))
    items = [(i, f"{common} only{i} " + " ".join(f"w{i}x{j}" for j in range(15))) for i in range(12)] + [(99, "ha " * 30), (98, common), (98, common)]
    texts = [(i, f"t{i} {common} u{i} " + " ".join(f"w{i}x{j}" for j in range(14))) for i in range(30)] + [(50, "so ha " + "ha " * 40), (51, "ha " * 12), (52, f"t0 {common}"), (53, f"t0 {common}")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    want = sorted((i, k, n) for i, t in texts for k, x in items if (n := plain_overlaps(t, x)))
    key = lambda df: decontamination._texts(df, "text")
    found = decontamination.text_overlaps(key(frame(texts, "doc_id")), key(frame(items, "item_id")).withColumnRenamed("k", "item"), bits)
    assert found.count() == len({(t, x) for _, t in texts for _, x in items if plain_overlaps(t, x)})
    got = decontamination.overlaps(frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_words"]) for r in got) == want


def test_digest(spark, sf_dir):
    r = {r["doc_id"]: r for r in substring_dedup.op1_substring_dedup(spark, sf_dir).collect()}
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    clean = next(i for i, x in r.items() if x["n_removed"] == 0)
    assert r[clean]["kept_sha256"] == hashlib.sha256(" ".join(words(d[clean])).encode()).hexdigest()


def test_crowded_meetings(spark, monkeypatch):
    """Fingerprints that meet in large numbers, near and far from each other, against all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = np.random.default_rng(9)
    low = rng.integers(0, 2**31, 150)
    fps = sorted({int(x) for x in low} | {int(x) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for x in low[:60] for a, b, c in [rng.integers(0, 64, 3)]})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    found = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    groups = lambda of: {frozenset(f for f in of if of[f] == r) for r in of.values()} - {frozenset([f]) for f in fps}
    assert groups(found) == groups(root) and len(groups(root)) > 40


def test_repeats_across_blocks(spark, both, monkeypatch):
    """Texts longer than a block of words, and copies of one text, whose spans are listed once."""
    whole = sorted(map(str, substring_dedup.remove_repeats(both).collect()))
    copies = spark.createDataFrame([(1, " ".join(f"a{i % 400}" for i in range(900)))] * 40 + [(2, None)] * 3, "doc_id long, text string")
    rows = substring_dedup.keyed(copies, "doc_id", "text")
    found = substring_dedup.repeats(rows).groupBy("k").agg(F.collect_set(F.struct("start", "n")).alias("found")).collect()
    assert len(found) == 1 and len(found[0]["found"]) < 900
    assert {(r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(copies).collect()} == {(900, 900), (0, 0)}
    data = np.frombuffer(" ".join(f"b{i % 700}" for i in range(3000)).encode(), np.uint8)
    windows = lambda: {w for _, at, n, _, _ in zip(*(x.tolist() for x in substring_dedup.spans(data, np.array([0, len(data)]), 35, 12))) for w in range(at, at + n)}
    one = windows()
    monkeypatch.setattr(substring_dedup, "BLOCK", 500)
    assert windows() == one == set(range(3000 - 34))
    assert sorted(map(str, substring_dedup.remove_repeats(both).collect())) == whole


def test_hot_ids_of_token_files(spark):
    """Null ids and one id that many rows have: starts follow each other, whatever the order among them."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "concat('text number ', id % 500) AS text").repartition(7)
    rows = sorted(token_output.token_output(df).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]


def doubled(times):
    """Two words of 2 ** times bytes by the rule x, y -> xy, yx: sums over bytes modulo a power of two can't tell them apart."""
    a, b = "a", "b"
    for _ in range(times):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("times", [5, 8, 10, 11])
def test_words_made_by_doubling(spark, times):
    """Documents that differ in one such word share no window; each piece has its own ids."""
    from tokenizers import Tokenizer

    p, q = doubled(times)
    around = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([*around[:17], p, *around[17:]])), (2, " ".join([*around[:17], q, *around[17:]]))], "doc_id long, text string")
    assert [(r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()] == [(35, 0), (35, 0)]
    text = f"x {p} {q} {q} {p}"
    ids = [*Tokenizer.from_file(token_output.byte_bpe_path()).encode(text, add_special_tokens=False).ids, 2]
    got = token_output.token_output(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_tokens"], got["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_pieces_that_share_a_hash(monkeypatch):
    """Were all hashes equal, the pieces' bytes would still keep them apart."""
    monkeypatch.setattr(token_output, "hash_words", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    e = token_output.Encoder(token_output.byte_bpe_path())
    texts = ["one two three two one", "two two", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, counts = e.encode(data, np.cumsum([0, *map(len, texts)]))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def test_a_word_is_one_piece_whatever_follows(monkeypatch):
    """A word is looked up once for all signs and line feeds around it, and what is cut has the ids of the whole text."""
    e = token_output.Encoder(token_output.byte_bpe_path())
    asked = []
    monkeypatch.setattr(e, "_ids", lambda new, plain, ids=e._ids: asked.extend(new) or ids(new, plain))
    text = " cité cité, cité. cité; cité\ncité (cité)"
    e.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert sorted(x.decode() for x in asked) == sorted([" cité", ",", ".", ";", "\n", "cité", " (", ")"])


def test_cut_texts_have_the_ids_of_whole_ones():
    """Every letter of two bytes before and after signs, contractions, white space of all kinds, added tokens, and random mixtures."""
    e = token_output.Encoder(token_output.byte_bpe_path())
    some = np.random.default_rng(5)
    kinds = ["a", "it", "Zoë", "é", "Ж", "δ", "ß", "ա", "中", "ก", "e\u0301", "’", "'", "'s", "'ll", "'S", "-", ".", ",", "_", "(", "\"", "1", "23", "²", "×", "÷", "ª", "ʰ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\0", "<|endoftext|>", "<|", "endoftext", "|>", "🙂"]
    texts = [" ".join(f"{c}.{c}'s-{c}\n{c}" for c in map(chr, range(128 + k, 0x800, 16))) for k in range(16)]
    texts += ["".join(kinds[i] for i in some.integers(0, len(kinds), n)) for n in some.integers(0, 40, 4000)]
    data = [t.encode() for t in texts]
    ids, counts = e.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_hash_words():
    from grainwise.llm._common import hash_words, same_words

    for n in (1, 5, 8, 9, 16, 255, 256, 257, 700):
        x = np.frombuffer(b"q" * n + b"q" * (n - 1) + b"Z" + b"Q" * n + b"q" * n, np.uint8)
        starts = np.arange(4) * n
        h, folded, other = (hash_words(x, starts, starts + n, **k) for k in ({}, {"fold": True}, {"seed": 1}))
        assert h[0] == h[3] and len(set(h.tolist())) == 3 and folded[0] == folded[2] == folded[3] != folded[1] and not set(h.tolist()) & set(other.tolist())
        assert same_words(x, starts, starts + n, np.zeros(4, int)).tolist() == [True, False, False, True]


def test_windows_that_fit(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="windows"):
        substring_dedup.remove_repeats(docs, length=267).collect()
    assert substring_dedup.remove_repeats(docs, length=266).count() == 1


@pytest.mark.parametrize("ids", [1, 3, None])
def test_shards_of_repeated_rows(spark, ids):
    """All rows equal, under one id or none: shards of about equal sizes, slots without gaps."""
    doc_id = "CAST(NULL AS LONG)" if ids is None else f"id % {ids}"
    rows = sharding.shard_documents(spark.range(2400).selectExpr(f"{doc_id} AS doc_id", "'the same text' AS text").repartition(5)).collect()
    n = Counter(r["shard"] for r in rows)
    assert len(n) == 24 and max(n.values()) <= 105 and min(n.values()) >= 95
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k)) for s, k in n.items())


def test_shards_of_which_half_is_one_text(spark):
    docs = spark.range(4800).selectExpr("IF(id % 2 = 0, id % 6, id) AS doc_id", "IF(id % 2 = 0, 'the same old text', concat('text ', lpad(id, 9, '0'))) AS text")
    rows = sharding.shard_documents(docs).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 24
    assert len(size) == 24 and all(abs(v / mean - 1) <= 0.05 for v in size.values())
    assert len({r["shard"] for r in rows if r["doc_id"] in (0, 2, 4)}) <= 17  # it holds two thirds of the tokens


def test_workers_give_free_memory_back():
    """What a task has freed, below something that its worker keeps, doesn't stay with the worker."""
    from grainwise.llm._common import lean

    kept = []

    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def run(batches):
        held = [bytes([1]) * 2000 for _ in range(60_000)]
        kept.append(bytes([1]) * 2000)
        yield resident()
        del held
        yield from batches

    most = next(found := lean(run)(iter(())))
    assert list(found) == []
    assert resident() < most - 80


def test_ranks_need_no_other_workers(spark, tmp_path, monkeypatch):
    """Tables made by the driver go to Spark by Arrow; lists would start a second set of Python workers, which stay."""
    from pyspark import SparkContext

    from grainwise.llm.token_output import byte_bpe_path, write_tokens

    monkeypatch.setattr(SparkContext, "parallelize", lambda *_: pytest.fail("a list went to Python workers"))
    docs = spark.sql("SELECT 1L AS doc_id, 'a b a' AS text UNION ALL SELECT 2L, NULL")
    path = write_tokens(docs, str(tmp_path / "ids"), byte_bpe_path())
    ranks = spark.read.parquet(f"{path}/ranks")
    assert ranks.dtypes == [("id", "bigint"), ("rank", "bigint")] and ranks.count() == 4

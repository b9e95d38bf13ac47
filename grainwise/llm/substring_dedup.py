"""Substring dedup: seed and extend over winnowed anchors.

Seeds. Of the hashes of a document's runs of ANCHOR words, the rightmost least one in each stretch of consecutive runs is
its anchor (winnowing). The stretch is as long as a window of `length` words has room for, so each window has exactly one
anchor, named by its content alone: equal windows have equal anchors at equal offsets, and joining on anchors misses no
repeat. Consecutive windows of one anchor are a span, some 14 of them.

Extension. Anchors found once end here. Where all spans of an anchor have the same words, they match in full, to both
sides. Where not, spans of the same words are pre-aggregated, one of each goes on, and is extended against the others:
the windows of a span are all its extensions to the left and right that reach the threshold, and those that two spans
share are found by grouping on (anchor, window), which costs a row for each extension and not one for each pair of spans.
Repeats that overlap are merged into maximal ones.

Defined cases: null and empty texts have no words; repeated rows repeat each other, and their spans are listed once; a document may repeat itself; anchors
and windows have 64 bits each, of word hashes with different seeds, so 128 in all; an empty table gives an empty result; extra columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import KEY, first_words, hash_runs, hash_words, keyed, mix, staged, text_steps, word_spans

LENGTH = 35
ANCHOR = 12
#: Windows are hashed from other word hashes than anchors are.
WINDOW_SEED = 1
#: Bits of the position in a block of words; the hash keeps the rest for choosing anchors.
AT_BITS = 24
BLOCK = (1 << AT_BITS) - 1024


def spans(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, span hash) of each span."""
    starts, ends, rows = word_spans(data, offsets)
    first = first_words(rows, len(offsets) - 1)
    words, others = hash_words(data, starts, ends), hash_words(data, starts, ends, seed=WINDOW_SEED)
    # In blocks that overlap, so that positions fit into AT_BITS; a span that a block's end cuts is two spans.
    found = [_block(words[lo : lo + BLOCK + length - 1], others[lo : lo + BLOCK + length - 1], rows[lo : lo + BLOCK + length - 1], lo, length, anchor) for lo in range(0, max(1, len(words) - length + 1), BLOCK)]
    row, at, n, gram, whole = (np.concatenate(x) for x in zip(*found))
    return row, at - first[row], n, gram, whole


def _block(words: np.ndarray, others: np.ndarray, rows: np.ndarray, offset: int, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    n = len(words) - length + 1
    none = np.zeros(0, np.int64)
    inside = np.flatnonzero(rows[: max(n, 0)] == rows[length - 1 : length - 1 + max(n, 0)])
    if not len(inside):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    windows, grams = hash_runs(others, length), hash_runs(words, anchor)
    at_mask = np.uint64((1 << AT_BITS) - 1)
    packed = grams & ~at_mask | (at_mask - np.arange(len(grams), dtype=np.uint64))
    width, reach = length - anchor + 1, 1
    least = packed
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (at_mask - (least & at_mask)).astype(np.int64)[:n]
    new = np.flatnonzero(np.concatenate([[True], (at[inside][1:] != at[inside][:-1]) | (inside[1:] != inside[:-1] + 1)]))
    lo = inside[new]
    hi = inside[np.concatenate([new[1:], [len(inside)]]) - 1]
    # A span is shorter than a window, so its first and its last window together have all its words.
    whole = mix(windows[lo] * np.uint64(0x9E3779B97F4A7C15) + windows[hi] + (hi - lo).astype(np.uint64))
    return rows[lo], lo + offset, hi - lo + 1, grams[at[lo]], whole


def _seed(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                row, start, n, gram, whole = spans(data, offsets, length, anchor)
                k = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([k, pa.array(start << 8 | n), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))], ["k", "at", "anchor", "span"])

    return run


def _extend(length: int):
    """Windows of spans: columns k, text, at (array of start << 8 | windows), anchor (array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                starts, ends, rows = word_spans(data, offsets)
                windows = hash_runs(hash_words(data, starts, ends, seed=WINDOW_SEED), length)
                first = first_words(rows, hi - lo)
                at, anchors = (batch.column(c).slice(lo, hi - lo) for c in (2, 3))
                counts = np.diff(at.offsets.to_numpy())
                packed, anchor = at.flatten().to_numpy(), anchors.flatten().to_numpy()
                row = np.repeat(np.arange(hi - lo), counts)
                n = packed & 255
                nth = np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n)
                start = np.repeat(packed >> 8, n) + nth
                row = np.repeat(row, n)
                found = windows[first[row] + start]
                k = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([k, pa.array(start), pa.array(np.repeat(anchor, n)), pa.array(found.view(np.int64))], ["k", "start", "anchor", "window"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(k, start, n): windows start .. start + n - 1 of the row with key k repeat; docs has (k, text)."""
    if not 0 < length - anchor + 1 < 256:
        raise ValueError(f"a length of {length} has room for {length - anchor + 1} windows of an anchor of {anchor}; 1 to 255 are kept")
    rows = docs.select("k", "text")
    seeds = rows.mapInArrow(_seed(length, anchor), f"k {KEY}, at long, anchor long, span long")
    met = seeds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).filter("n > 1")
    # Written, like `shared` below, so that the join has an exchange on either side and Spark can split what very many documents share.
    met = staged(met.select("anchor", (F.col("low") == F.col("high")).alias("alike")), "repeat-anchors")
    found = staged(seeds.join(met, "anchor").select("k", "at", "anchor", "span", "alike"), "repeat-seeds")
    full = found.filter("alike").select("k", "at")
    other = found.filter("not alike")
    kinds = staged(other.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("one")), "repeat-spans")
    full = full.unionByName(other.join(kinds.filter("n > 1").select("anchor", "span"), ["anchor", "span"]).select("k", "at"))
    # One span of each kind is extended against those of the same anchor.
    lists = kinds.select("one.k", "one.at", "anchor").groupBy("k").agg(F.collect_list(F.struct("at", "anchor")).alias("spans"))
    windows = rows.join(lists, "k").select("k", "text", F.col("spans.at").alias("at"), F.col("spans.anchor").alias("anchor")).dropDuplicates(["k"])
    windows = staged(windows.mapInArrow(_extend(length), f"k {KEY}, start long, anchor long, window long"), "repeat-windows")
    shared = staged(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window"), "repeat-shared")
    partial = windows.join(shared, ["anchor", "window"]).select("k", "start", F.lit(1).cast("long").alias("n"))
    return full.select("k", F.shiftright("at", 8).alias("start"), F.col("at").bitwiseAND(F.lit(255)).alias("n")).unionByName(partial)


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                found = found.values
                merged: list[tuple[int, int]] = []
                if found is not None and len(found):
                    packed = np.sort(found.to_numpy())
                    start = packed >> 32
                    end = start + (packed & 0xFFFFFFFF) + length - 1
                    upto = np.maximum.accumulate(end)
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > upto[:-1]]))
                    merged = list(zip(start[new].tolist(), upto[np.concatenate([new[1:], [len(start)]]) - 1].tolist()))
                kept, last = [], 0
                for a, b in merged:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(b" ".join(kept).decode())
                out[3].append([a for a, _ in merged])
                out[4].append([b for _, b in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_removed", "kept", "repeat_start", "repeat_end"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeat_start, repeat_end): kept words, and the maximal repeats as word ranges."""
    rows = keyed(docs, id_col, text_col)
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("n"))
    found = repeats(rows, length, anchor).groupBy("k").agg(F.collect_set(packed).alias("found"))  # copies share a key and have the same spans
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept string, repeat_start array<long>, repeat_end array<long>"
    return rows.join(found, "k", "left").select("doc_id", "text", "found").mapInArrow(_remove(length), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


#: The rule itself, as windows over words; for small tables.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
hit AS (SELECT DISTINCT k, i + unnest(range(0, 35)) AS p FROM rep),
word AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT word.k, string_agg(x, ' ' ORDER BY word.p) AS text, count(*) AS n FROM word LEFT JOIN hit ON word.k = hit.k AND word.p = hit.p WHERE hit.p IS NULL GROUP BY word.k)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (k)
"""

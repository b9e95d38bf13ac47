"""Benchmark decontamination by spaced-seed hashing.

A word is a run of letters and digits, A-Z counted as a-z. Fixed masks over windows of words ignore the positions that
hold a 0, so a substituted word spoils only the masks that look at it. Hashes of the benchmark's masked windows are
joined with those of the documents; each hit names a diagonal of a text and an item, and on it the longest stretch that
begins and ends with agreeing words and in which at least four words of five agree is the overlap. A text is contaminated
by an item if the overlap has MIN_WORDS words or more, or if it holds a shorter item whole with four words of five
agreeing, wherever the others are. The masks find every such pattern: five serve overlaps of seven words or more, items
of five or six words have a mask for each word that may differ, and shorter ones are hashed whole.

Equal texts are searched once, and equal items are one. A bitmap of the benchmark's hashes, at most 2**BITMAP_LOG2 bits
whatever the benchmark's size, spares the join those of the documents' hashes that surely have no partner; it is one pass
over the documents. Both sides of the join are written before it, so that Spark can split a frequent hash. Candidates meet
their texts in one sorted stream for each partition, and each is verified word by word.

Defined cases: null or empty texts match nothing, on either side; items without words match nothing; repeated documents
and items each give their rows; of equal overlaps the first in the text counts; an empty table gives an empty result;
extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import KEY, first_words, fresh, hash_words, lean, mix, named, row_key, staged, text_steps, word_spans

#: 1: the position counts; 0: it is ignored.
MASKS = ("1101011", "1011101", "11001011", "10110011", "111011")
MIN_WORDS = 13
#: An overlap has at least so many words that agree for each that does not.
AGREE = 4
BITMAP_LOG2 = 24

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def short_masks(length: int) -> list[str]:
    """Masks of the whole of an item that is too short for MASKS: one for each word that may differ."""
    if length <= AGREE:
        return ["1" * length]
    return ["1" * i + "0" + "1" * (length - 1 - i) for i in range(length)]


def masks_of(length: int) -> list[str]:
    return list(MASKS) if length >= 7 else short_masks(length)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word."""
    starts, ends, rows = word_spans(data, offsets, _BETWEEN)
    return hash_words(data, starts, ends, fold=True), rows, starts, ends


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of each window of the mask's length, of its 1 positions."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int("1" + mask, 2), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(total)


def places(hashes: np.ndarray, bits_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a bitmap."""
    shift = np.uint64(64 - bits_log2)
    return (hashes >> shift).astype(np.int64), (mix(hashes) >> shift).astype(np.int64)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, words, h, at, mask): columns item (its key), text to the item's words and, as arrays, its seeds."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for lo, hi, data, offsets in text_steps(batch.column(1)):
            hashes, rows, _, _ = words_of(data, offsets)
            first = first_words(rows, hi - lo)
            for r in range(hi - lo):
                words = hashes[first[r] : first[r + 1]]
                masks = masks_of(len(words)) if len(words) else []
                found = [masked(words, m) for m in masks]
                out[0].append(lo + r)
                out[1].append(words.tobytes())
                out[2].append(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
                out[3].append(np.concatenate([np.arange(len(h)) for h in found]) if found else np.zeros(0, np.int64))
                out[4].append([m for m in masks if m not in MASKS])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.binary()), pa.array(out[2], longs), pa.array(out[3], longs), pa.array(out[4], pa.list_(pa.string()))], ["item", "words", "h", "at", "masks"])


def _hits(known, masks: list[str], bits_log2: int):
    """Rows (k, h, at) of the documents' masked windows that the bitmap doesn't rule out: columns text, k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.value
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(0)):
                words, rows, _, _ = words_of(data, offsets)
                first = first_words(rows, hi - lo)
                for m in masks:
                    h = masked(words, m)
                    one, two = places(h, bits_log2)
                    near = np.flatnonzero(bitmap[one >> 3] >> (one & 7).astype(np.uint8) & 1)
                    near = near[(bitmap[two[near] >> 3] >> (two[near] & 7).astype(np.uint8) & 1).astype(bool)]
                    near = near[rows[near] == rows[near + len(m) - 1]]
                    if len(near):
                        row = rows[near]
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(lo + row)), pa.array(h[near].view(np.int64)), pa.array(near - first[row])], ["k", "h", "at"])

    return run


def longest_overlap(agree: np.ndarray) -> tuple[int, int]:
    """(start, end) of the longest stretch with at least AGREE agreements for each disagreement whose ends agree, the first of equals."""
    at = np.flatnonzero(agree)
    if not len(at):
        return 0, 0
    sums = np.concatenate([[0], np.where(agree, 1, -AGREE).cumsum()])
    # From each agreeing word, the last agreeing word up to which the sum doesn't fall below where it begins.
    ends = at + 1
    highest_after = np.maximum.accumulate(sums[ends][::-1])[::-1]
    lowest = np.minimum.accumulate(sums[at])
    best = (0, 0)
    for i in at[sums[at] <= lowest].tolist():
        j = int(ends[int(np.searchsorted(-highest_after, -sums[i], "right")) - 1])
        if j - i > best[1] - best[0]:
            best = (i, j)
    return best


def overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(start, end) in the item of what contaminates on the diagonal at + shift; (0, 0) if nothing does."""
    i = max(0, -shift)
    n = min(len(item), len(text) - shift) - i
    if n <= 0:
        return 0, 0
    agree = item[i : i + n] == text[i + shift : i + shift + n]
    if len(item) < MIN_WORDS:
        same = int(agree.sum())
        return (0, n) if n == len(item) and same >= AGREE * (n - same) else (0, 0)
    a, b = longest_overlap(agree)
    return (i + a, i + b) if b - a >= MIN_WORDS else (0, 0)


_FOUND = f"k {KEY}, item {KEY}, n_words long, n_agree long, item_word long, doc_word long, start_byte long, end_byte long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps from rows sorted by (k, kind, item, shift): a text (kind 0), then its candidates (kind 1) with their items' words."""
    text, spans, now, best = None, None, None, None

    def row(key: dict, item: dict) -> tuple:
        n, same, a, at = best
        starts, ends = spans
        return key, item, n, same, a, at, int(starts[at]), int(ends[at + n - 1])

    names = ["k", "item", "n_words", "n_agree", "item_word", "doc_word", "start_byte", "end_byte"]
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in ("k", "kind", "item", "shift", "raw")}
        out: list[tuple] = []
        for key, kind, item, shift, raw in zip(*columns.values()):
            if best is not None and (kind == 0 or (key, item) != now):
                out.append(row(*now))
                best = None
            if kind == 0:
                text, _, *spans = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                continue
            now = (key, item)
            words = np.frombuffer(raw, np.uint64)
            a, b = overlap(text, words, shift)
            if b > a and (best is None or (b - a, -(a + shift)) > (best[0], -best[3])):
                best = (b - a, int((words[a:b] == text[a + shift : b + shift]).sum()), a, a + shift)
        if out:
            yield _rows(out, names, batch.schema)
    if best is not None:
        yield _rows([row(*now)], names, batch.schema)


def _rows(out: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    types = [schema.field("k").type, schema.field("item").type, *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)


def text_overlaps(texts: DataFrame, items: DataFrame, bitmap_log2: int = BITMAP_LOG2) -> DataFrame:
    """One row for each distinct text (k, text) and item (item, text) with an overlap, by their keys."""
    spark = texts.sparkSession
    prepared = staged(items.select("item", "text").dropDuplicates(["item"]).mapInArrow(lean(_seeds), f"item {KEY}, words binary, h array<long>, at array<long>, masks array<string>"), "leak-items")
    seeds = staged(prepared.select("item", F.explode(F.arrays_zip("h", "at")).alias("s")).select("item", F.col("s.h").alias("h"), F.col("s.at").alias("item_at")), "leak-seeds")
    masks = [*MASKS, *sorted(r[0] for r in prepared.select(F.explode("masks")).distinct().collect())]  # at most 17 more
    bits_log2 = min(bitmap_log2, max(16, int(seeds.count() * 64).bit_length()))
    of = lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(places(b.column(0).to_numpy().view(np.uint64), bits_log2))).astype(np.int32))], ["p"]) for b in batches)
    taken = seeds.select("h").mapInArrow(of, "p int").distinct().toArrow()["p"].to_numpy()  # at most 2**BITMAP_LOG2 ints
    bitmap = np.zeros(1 << bits_log2, bool)
    bitmap[taken] = True
    known = spark.sparkContext.broadcast(np.packbits(bitmap, bitorder="little"))
    hits = staged(texts.select("text", "k").mapInArrow(lean(_hits(known, masks, bits_log2)), f"k {KEY}, h long, at long"), "leak-hits")
    candidates = staged(hits.join(seeds, "h").select("k", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "leak-candidates")
    met = candidates.select("k").distinct()
    some = texts.join(met, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    nobody = F.lit(None).cast(KEY)
    rows = some.select("k", F.lit(0).alias("kind"), nobody.alias("item"), F.lit(0).cast("long").alias("shift"), F.col("text").cast("binary").alias("raw")).unionByName(
        candidates.join(prepared.select("item", F.col("words").alias("raw")), "item").select("k", F.lit(1).alias("kind"), "item", "shift", "raw")
    )
    return staged(rows.repartition("k").sortWithinPartitions("k", "kind", "item", "shift").mapInArrow(lean(_verify), _FOUND), "leak-found")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(named(text_col).alias("text")).filter("text IS NOT NULL").select("text", row_key(F.col("text")).alias("k"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item with an overlap: its words, how many agree, and where it lies (words, bytes)."""
    items = _texts(benchmark, item_text_col).select("text", F.col("k").alias("item"))
    found = text_overlaps(_texts(docs, text_col), items)
    item_ids = benchmark.select(named(item_col).alias("item_id"), row_key(named(item_text_col)).alias("item"))
    rows = docs.select(named(id_col).alias("doc_id"), row_key(named(text_col)).alias("k"))
    return rows.join(found, "k").join(item_ids, "item").select("doc_id", "item_id", "n_words", "n_agree", "item_word", "doc_word", "start_byte", "end_byte")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates."""
    found = text_overlaps(_texts(docs, text_col), _texts(benchmark, item_text_col).select("text", F.col("k").alias("item")))
    own, leaked = fresh(docs, "row_key", "leaked")
    return docs.withColumn(own, row_key(named(text_col))).join(found.select(F.col("k").alias(leaked)).distinct(), F.col(own) == F.col(leaked), "left_anti").drop(own)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_words", "n_agree", "item_word", "doc_word")

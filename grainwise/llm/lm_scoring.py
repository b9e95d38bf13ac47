"""LM scoring with a log-frequency Bloom filter.

Counts of words and of pairs of words run over all training texts: each step of a task sorts and counts its n-grams and
sends them, packed, to the segment of their hash; a segment's task adds the counts up. A count is quantised to the last of
the values 1 to 8, 10, 12, 14, 16, 20, ... (four a doubling) that it reaches; the filter gets an n-gram once for each
value up to its own, and probing value after value until one is missing gives the quantised count back. Every n-gram is in
the filter, those found once too. Segments follow the size of the texts, and a segment's bits what it holds, so false
positives are as rare in any corpus.

A filter of at most BROADCAST_BYTES is broadcast, as a file that each executor gets once and its workers map, and texts
probe it where they are. A larger one stays in its segments: texts are taken in stretches of some 4 MB, the distinct n-grams
of a stretch are sent to the segments, packed, and the levels back to where the stretch's texts are sent; the scores are the
same. What is sent follows the distinct n-grams of stretches, and no part of the filter gets a row for each text.

With q the lower and q' the upper end of a quantised count, m a weight, and n the training texts:
P(w | v) = (q(v, w) + m P(w)) / (q'(v) + m), at a text's start (q(start, w) + m P(w)) / (n + m), where
P(w) = (q(w) + 1) / (sum of q over the vocabulary, as probed, + distinct words + 1). So the shares of the vocabulary and of
one unknown word add up to 1, and the pairs of a context that occur to no more than its own count. A pair counts as no
more than either of its words.

The base score takes exact counts: words of at least a certain count, at most HEAVY_WORDS of them, are broadcast; the
other words of each text are joined with their counts.

Defined cases: a null or empty text has the end token alone, and its score is that of an end after a start; a null id
counts as an empty one in the caller's rule of what is held out; repeated rows score alike and each counts in training;
without training texts every word is unknown and P(w) is 1 (base score and score 0); an empty table gives an empty result;
extra columns are left alone.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, first_words, hash_words, lean, mix, staged, text_steps, word_spans

BROADCAST_BYTES = 1 << 28
BITS_PER_ENTRY = 12
PROBES = 5
#: Weight of the words' shares against a context's own count.
PRIOR = 50.0
#: Bytes of training text for each segment of the filter, and segments that meet their probes together if it isn't broadcast.
SEGMENT_TEXT = 1 << 20
GROUP_SEGMENTS_LOG2 = 4
#: Counts go to segments one by one up to so many; beyond, some of them go together, so that a step's n-grams make fewer rows.
COUNTED_APART_LOG2 = 10
HEAVY_WORDS = 1 << 20
STEP = 2 << 20
#: Parts in which the driver reads the filter, one after the other.
FILE_PARTS = 8

_rng = np.random.default_rng(20250103)
_MASKS_LOG2 = 14
#: Sets of PROBES bits of a word: an entry's bits share a word, so that one fetch finds them all.
_MASKS = np.bitwise_or.reduce(np.uint64(1) << np.argsort(_rng.random((1 << _MASKS_LOG2, 64)), axis=1)[:, :PROBES].astype(np.uint64), axis=1)

#: The values that counts are quantised to.
VALUES = np.array([*range(1, 8), *((4 + i) << e for e in range(1, 50) for i in range(4))], np.int64)
LOW = np.concatenate([[0], VALUES])
HIGH = np.concatenate([[0], VALUES[1:] - 1, [VALUES[-1]]])

_START, _END = np.uint64(0x5354415254), mix(np.array([0x454E44], np.uint64))[0] | np.uint64(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, pair with the token before) of all tokens, the end of each row among them; bit 0 tells words (1) from pairs (0)."""
    starts, ends, rows = word_spans(data, offsets)
    n_rows = len(offsets) - 1
    first = first_words(rows, n_rows)
    at = np.arange(len(rows)) + rows
    row = np.empty(len(rows) + n_rows, np.int64)
    token = np.empty(len(row), np.uint64)
    row[at], token[at] = rows, hash_words(data, starts, ends, fold=True) | np.uint64(1)
    last = first[1:] + np.arange(n_rows)
    row[last], token[last] = np.arange(n_rows), _END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1] + np.arange(n_rows)] = _START
    return row, token, mix(before * np.uint64(0x9E3779B97F4A7C15) + token) & ~np.uint64(1)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(VALUES, counts, "right")


def segment_of(grams: np.ndarray, segments_log2: int) -> np.ndarray:
    return (grams >> np.uint64(64 - segments_log2)).astype(np.int64)


class Filter:
    """Words of 64 bits of some segments, one after the other: `first` has where each of all segments begins, `size` its words (0: not here)."""

    def __init__(self, segments_log2: int, segments: np.ndarray, lengths: np.ndarray, words: np.ndarray):
        self.segments_log2, self.words = segments_log2, words
        self.first, self.size = np.zeros(1 << segments_log2, np.uint64), np.zeros(1 << segments_log2, np.uint64)
        self.first[segments], self.size[segments] = lengths.cumsum() - lengths, lengths

    @staticmethod
    def of(segments_log2: int, segments: list[int], raw: list[bytes]) -> Filter:
        return Filter(segments_log2, np.array(segments, np.int64), np.array([len(b) // 8 for b in raw], np.uint64), np.frombuffer(b"".join(raw), np.uint64))

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing one value after the other."""
        level = np.zeros(len(grams), np.int64)
        segment = segment_of(grams, self.segments_log2)
        first, size = self.first[segment], self.size[segment]
        live, j = np.flatnonzero(size), 0
        if len(live) < len(grams):
            grams, first, size = grams[live], first[live], size[live]
        while len(live):
            j += 1
            at, mask = place(grams, j, size)
            there = np.flatnonzero((self.words[first + at] & mask) == mask)
            live, grams, first, size = live[there], grams[there], first[there], size[there]
            level[live] = j
        return level


def place(grams: np.ndarray, level, size) -> tuple[np.ndarray, np.ndarray]:
    """Where (n-gram, level) lies in a segment of `size` words, and its bits there."""
    y = mix(grams + np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (y & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32), _MASKS[y >> np.uint64(64 - _MASKS_LOG2)]


def stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(first row, row after the last) of each run of rows whose keys are equal."""
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return list(pairwise([0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])])) if len(keys[0]) else []


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x in order, and where each of x is among them. Sorts values with their places in the low bits, much faster than places alone."""
    low = np.uint64((1 << max(1, len(x)).bit_length()) - 1)
    order = (np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    values = x[order]
    if (values[1:] < values[:-1]).any():  # some differ in the low bits only
        order = np.argsort(x)
        values = x[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])[: len(x)]
    of = np.empty(len(x), np.int64)
    of[order] = new.cumsum() - 1
    return values[new], of


def _binary(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary value for each stretch of raw between two edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _count(segments_log2: int):
    """Rows (part, h, n): the n-grams of a step that fall into a part of the segments, and their counts, as 64 and 32 bits each."""
    together = max(0, min(GROUP_SEGMENTS_LOG2, segments_log2 - COUNTED_APART_LOG2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0), STEP):
                _, token, pair = tokens(data, offsets)
                h, n = np.unique(np.concatenate([token, pair]), return_counts=True)
                part = segment_of(h, segments_log2) >> together
                new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                edges = np.append(new, len(h))
                yield pa.RecordBatch.from_arrays([pa.array(part[new], pa.int32()), _binary(h, edges), _binary(n.astype(np.uint32), edges)], ["part", "h", "n"])

    return run


_SEGMENT = "segment int, bits binary, tokens long, quantised long, words array<long>, counts array<long>"


def _build(segments_log2: int, bits_per_entry: int):
    """A row for each segment from rows of _count sorted by part: its bits, sums over its words, and the words' counts."""

    def part(grams: list[bytes], counts: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, n = np.frombuffer(b"".join(grams), np.uint64), np.frombuffer(b"".join(counts), np.uint32)
        order = np.argsort(h)
        h, n = h[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n = h[new], np.add.reduceat(n.astype(np.int64), new)
        of = segment_of(h, segments_log2)
        for lo, hi in stretches(of):
            yield segment(int(of[lo]), h[lo:hi], n[lo:hi])

    def segment(now: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        level = level_of(n)
        filled = np.zeros(-(-int(level.sum()) * bits_per_entry // 64), np.uint64)
        for lo in range(0, len(h), 1 << 18):  # a bounded number of entries at once
            some = level[lo : lo + (1 << 18)]
            each = np.repeat(h[lo : lo + (1 << 18)], some)
            at, mask = place(each, np.arange(len(each)) - np.repeat(some.cumsum() - some, some) + 1, np.uint64(len(filled)))
            np.bitwise_or.at(filled, at, mask)
        raw = filled.tobytes()
        word = (h & np.uint64(1)).astype(bool)
        probed = Filter.of(segments_log2, [now], [raw]).levels(h[word])
        row = [[now], [raw], [int(n[word].sum())], [int(LOW[probed].sum())], [h[word].view(np.int64)], [n[word]]]
        types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["segment", "bits", "tokens", "quantised", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, counts = -1, [], []
        for batch in batches:
            for p, h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if p != now:
                    if grams:
                        yield from part(grams, counts)
                    now, grams, counts = p, [], []
                grams.append(h)
                counts.append(n)
        if grams:
            yield from part(grams, counts)

    return run


class Model:
    """What scoring needs beside the filter: totals, and the exact counts of frequent words."""

    def __init__(self, total: int, quantised: int, distinct: int, n_docs: int, heavy: np.ndarray, heavy_n: np.ndarray, prior: float):
        self.total, self.quantised, self.distinct, self.n_docs, self.heavy, self.heavy_n, self.prior = total, quantised, distinct, n_docs, heavy, heavy_n, prior

    def share(self, level: np.ndarray) -> np.ndarray:
        """P(w) of words of these levels."""
        return (LOW[level] + 1) / (self.quantised + self.distinct + 1)

    def logs(self, row: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray) -> np.ndarray:
        """log10 of each token's probability."""
        start = np.concatenate([[True], row[1:] != row[:-1]])
        before = np.concatenate([[0], word_level[:-1]])
        most = np.where(start, word_level, np.minimum(word_level, before))
        own = np.where(start, self.n_docs, HIGH[before])
        return np.log10((LOW[np.minimum(pair_level, most)] + self.prior * self.share(word_level)) / (own + self.prior))

    def exact(self, token: np.ndarray) -> np.ndarray:
        """Exact count of each token, or -1 if it is not among the frequent ones."""
        if not len(self.heavy):
            return np.full(len(token), -1)
        at = np.minimum(np.searchsorted(self.heavy, token), len(self.heavy) - 1)
        return np.where(self.heavy[at] == token, self.heavy_n[at], -1)


class Trained:
    """The segments of the filter as a table, the model, the counts (h, c) of words that the model lacks, and the mean bytes of a text."""

    def __init__(self, table: DataFrame, segments_log2: int, model: Model, rare: DataFrame, size: int, text_bytes: float):
        self.table, self.segments_log2, self.model, self.rare, self.size, self.text_bytes = table, segments_log2, model, rare, size, text_bytes

    def shared(self) -> Shared:
        """The filter as a file that every executor gets once."""
        name = f"lm-filter-{uuid.uuid4().hex}"
        path = Path(tempfile.mkdtemp(prefix="spark-filter-")) / name  # on the driver, which serves it to the executors
        segments, lengths = [], []
        with path.open("wb") as out:
            for r in self.table.select("segment", "bits").coalesce(FILE_PARTS).toLocalIterator():
                segments.append(r["segment"])
                lengths.append(out.write(r["bits"]) // 8)
        self.table.sparkSession.sparkContext.addFile(str(path))
        return Shared(name, self.segments_log2, np.array(segments, np.int64), np.array(lengths, np.uint64))


class Shared:
    """Where the filter's segments are in its file."""

    def __init__(self, name: str, segments_log2: int, segments: np.ndarray, lengths: np.ndarray):
        self.name, self.segments_log2, self.segments, self.lengths = name, segments_log2, segments, lengths

    def filter(self) -> Filter:
        """The filter, mapped: the workers of an executor share its memory."""
        words = np.memmap(SparkFiles.get(self.name), np.uint64, "r") if len(self.lengths) else np.zeros(0, np.uint64)
        return Filter(self.segments_log2, self.segments, self.lengths, words)


def train(texts: DataFrame, prior: float = PRIOR, bits_per_entry: int = BITS_PER_ENTRY) -> Trained:
    """A model of texts (text)."""
    n_docs, n_bytes = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    segments_log2 = max(4, math.ceil(math.log2(max(1, n_bytes / SEGMENT_TEXT))))
    parts = texts.mapInArrow(_count(segments_log2), "part int, h binary, n binary").repartition("part").sortWithinPartitions("part")
    table = staged(parts.mapInArrow(_build(segments_log2, bits_per_entry), _SEGMENT), "lm-filter")
    total, quantised, size = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "quantised", F.octet_length("bits"))]).first()
    words = table.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("h"), F.col("w.counts").alias("c"))
    power = F.floor(F.log2("c") + 1e-9).cast("int")
    kinds = {r["p"]: r["k"] for r in words.groupBy(power.alias("p")).agg(F.count("*").alias("k")).collect()}  # a row for each power of two
    least, room = 64, HEAVY_WORDS
    for p in sorted(kinds, reverse=True):
        room -= kinds[p]
        if room < 0:
            break
        least = p
    heavy = words.filter(power >= least).toArrow()  # at most HEAVY_WORDS rows
    h, n = heavy["h"].to_numpy().view(np.uint64), heavy["c"].to_numpy()
    order = np.argsort(h)
    return Trained(table, segments_log2, Model(total, quantised, sum(kinds.values()), n_docs, h[order], n[order], prior), words.filter(power < least), size, n_bytes / max(1, n_docs))


def _ask(segments_log2: int, rows_log2: int):
    """Rows (part, kind 1, at: that of a stretch's first text, raw: the stretch's distinct n-grams that fall into the part) from rows (at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for first, last in stretches(at >> rows_log2):
                for lo, _, data, offsets in text_steps(batch.column(1).slice(first, last - first), 4 * STEP):
                    _, token, pair = tokens(data, offsets)
                    grams = np.sort(np.concatenate([token, pair]))  # np.unique would hash them, which takes many times as long
                    grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]
                    part = segment_of(grams, segments_log2) >> GROUP_SEGMENTS_LOG2
                    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    columns = [pa.array(part[new], pa.int32()), pa.array(np.ones(len(new)), pa.int32()), pa.array(np.full(len(new), at[first + lo])), _binary(grams, np.append(new, len(grams)))]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "kind", "at", "raw"])

    return run


def _answer(segments_log2: int, rows_log2: int):
    """Levels of the n-grams that were asked for, from rows sorted by (part, kind, at): first a part's segments (kind 0), then the questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segments, bits, known = None, [], [], None
        for batch in batches:
            part, kind, at = (batch.column(c).to_numpy() for c in range(3))
            for first, last in stretches(part, kind):
                raw = batch.column(3).slice(first, last - first)
                if part[first] != now:
                    now, segments, bits, known = part[first], [], [], None
                if kind[first] == 0:
                    segments += at[first:last].tolist()
                    bits += raw.to_pylist()
                    continue
                if known is None:
                    known = Filter.of(segments_log2, segments, bits)
                for lo, hi, data, offsets in text_steps(raw, 2 * STEP):  # many questions at once; frequent n-grams are in most of them
                    grams, of = distinct(data.view(np.uint64))
                    levels = known.levels(grams).astype(np.uint8)[of]
                    own = at[first + lo : first + hi]
                    yield pa.RecordBatch.from_arrays([pa.array(own >> rows_log2), pa.array(own), pa.array(part[first + lo : first + hi]), _binary(levels, offsets // 8)], ["step", "at", "part", "levels"])

    return run


#: Stands where an answer has its part, so that texts come after the answers to their stretch.
_TEXT = 2**31 - 1


def _with_answers(rows: DataFrame, trained: Trained) -> tuple[DataFrame, DataFrame]:
    """(doc_id, held_out, text, part, levels) of rows (doc_id, held_out, text, at): the answers to each stretch, then its texts; and the staged answers.

    A step is 2**rows_log2 row numbers, so 2 to 4 MB of text; a stretch is what a task reads of a step, or less where that is long.
    """
    s = trained.segments_log2
    rows_log2 = min(16, max(0, math.floor(math.log2(2 * STEP / max(1, trained.text_bytes)))))
    kept = trained.table.select(F.shiftright("segment", GROUP_SEGMENTS_LOG2).alias("part"), F.lit(0).alias("kind"), F.col("segment").cast("long").alias("at"), F.col("bits").alias("raw"))
    asked = rows.select("at", "text").mapInArrow(lean(_ask(s, rows_log2)), "part int, kind int, at long, raw binary")
    answers = kept.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "at").mapInArrow(lean(_answer(s, rows_log2)), "step long, at long, part int, levels binary")
    answers = staged(answers, "lm-answers")  # so that what was sent can go before texts are
    texts = rows.withColumns({"step": F.shiftright("at", rows_log2), "part": F.lit(_TEXT)})
    both = texts.unionByName(answers, allowMissingColumns=True).repartition("step").sortWithinPartitions("step", "at", "part")
    return both.select("doc_id", "held_out", "text", "part", "levels"), answers


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each stretch together, from rows of _with_answers: a stretch begins where an answer follows a text."""
    pieces, last = [], False
    for batch in batches:
        answer = batch.column(3).to_numpy() != _TEXT
        first = np.flatnonzero(answer & ~np.concatenate([[last], answer])[:-1])
        for k, (lo, hi) in enumerate(pairwise([0, *first.tolist(), len(answer)])):
            if k and pieces:
                yield pa.concat_batches(pieces)
                pieces = []
            if hi > lo:
                pieces.append(batch.slice(lo, hi - lo))
        last = bool(answer[-1]) if len(answer) else last
    if pieces:
        yield pa.concat_batches(pieces)


def _leveled(batches: Iterator[pa.RecordBatch], bloom: Filter | None) -> Iterator[tuple]:
    """(doc_id, held_out, row, distinct n-grams and their levels, and which of them each token and each pair is) of texts."""
    if bloom is not None:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(2)):
                row, token, pair = tokens(data, offsets)
                grams, of = distinct(np.concatenate([token, pair]))
                yield *(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), row, grams, bloom.levels(grams), of[: len(row)], of[len(row) :]
        return
    for batch in _answered(batches):
        n = int(np.searchsorted(batch.column(3).to_numpy() == _TEXT, True))
        levels = np.frombuffer(b"".join(batch.column(4).slice(0, n).to_pylist()), np.uint8).astype(np.int64)
        batch = batch.slice(n)
        for _, _, data, offsets in text_steps(batch.column(2), 1 << 62):  # all of them
            row, token, pair = tokens(data, offsets)
            grams, of = distinct(np.concatenate([token, pair]))
            if len(grams) != len(levels):
                raise ValueError(f"{len(levels)} answers to {len(grams)} n-grams")
            yield batch.column(0), batch.column(1), row, grams, levels, of[: len(row)], of[len(row) :]


_SCORED = ["doc_id", "held_out", "at", "n_tokens", "known", "base", "score", "rare", "rare_n"]


def _score(model, known: Shared | None):
    """A row for each text: sums over all tokens, the base as if words that are not among the frequent ones had count 0, and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        bloom = known.filter() if known else None
        floor = math.log10(m.total + m.distinct + 1)
        at = TaskContext.get().partitionId() << 40
        for doc_id, held_out, row, grams, levels, token_at, pair_at in _leveled(batches, bloom):
            n_rows, token = len(doc_id), grams[token_at]
            score = np.bincount(row, m.logs(row, levels[token_at], levels[pair_at]), n_rows)
            word = np.flatnonzero(grams & np.uint64(1))
            exact = np.full(len(grams), -1)
            exact[word] = m.exact(grams[word])
            c = exact[token_at]
            base = np.bincount(row, np.log10(np.maximum(c, 0) + 1.0) - floor, n_rows)
            rare = np.flatnonzero(c < 0)
            order = rare[np.lexsort((token[rare], row[rare]))]
            new = np.flatnonzero(np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (token[order][1:] != token[order][:-1])])) if len(order) else order
            n = np.diff(np.append(new, len(order)))
            edges = pa.array(np.searchsorted(row[order][new], np.arange(n_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id,
                    held_out,
                    pa.array(at + np.arange(n_rows)),
                    pa.array(np.bincount(row, minlength=n_rows), pa.int64()),
                    pa.array(np.bincount(row[c > 0], minlength=n_rows), pa.int64()),
                    pa.array(base),
                    pa.array(score),
                    pa.ListArray.from_arrays(edges, pa.array(token[order][new].view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array(n, pa.int64())),
                ],
                _SCORED,
            )
            at += n_rows

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, prior: float = PRIOR, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, with a model of those not held out."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    trained = train(rows.filter(~F.col("held_out")).select("text"), prior, bits_per_entry)
    model, told, asked, done = trained.model, None, rows, []
    if trained.size <= broadcast_bytes:
        told = trained.shared()
    else:
        # Row numbers that are written, so that whatever reads them finds the same.
        numbered = staged(rows.withColumn("at", F.monotonically_increasing_id()), "lm-rows")
        asked, answers = _with_answers(numbered, trained)
        done = [numbered, answers]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, at long, n_tokens long, known long, base double, score double, rare array<long>, rare_n array<long>"
    scored = staged(asked.mapInArrow(_score(context.broadcast(model), told), schema), "lm-scored")
    discard(*done)
    more = (
        scored.select("at", F.explode(F.arrays_zip("rare", "rare_n")).alias("w"))
        .select("at", F.col("w.rare").alias("h"), F.col("w.rare_n").alias("n"))
        .join(trained.rare, "h")
        .groupBy("at")
        .agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"))
    )
    return scored.join(more, "at", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)

"""Importance resampling towards a target distribution.

Features are hashed into buckets. A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus,
in thousandths; a document's weight is the mean gain of its features, read from an array. With Gumbel noise added, the
documents of highest score are a draw without replacement by weight (Gumbel top-k).

The cut is bracketed by a quantile sketch: exact counts above and within the bracket validate it or widen it, and only the
bracket's rows are sorted to locate the last drawn one. Ranks then number the drawn rows by ranges.

Counts hold all documents; what is collected is two numbers a bucket, whose number is a parameter.

Defined cases: null and empty texts have no features, weight 0, and are never drawn if min_words > 0; a null id counts as the
empty text in the noise and comes after others of its score; equal ids of one score go in order of their places, so repeated
rows are drawn one by one; an empty table, or target, gives an empty result, or gains by the corpus alone; very long texts
are counted whole; extra columns are left alone.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import add_index
from ._common import CRC_TABLE, crc_sql, first_words, named, staged, text_steps, word_spans

BUCKETS = 10_000
#: Values a quantile sketch keeps: its ranks are off by at most 1 / SKETCH of all rows.
SKETCH = 10_000
#: Longer spans of bytes are hashed one by one.
SHORT = 64

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: Bytes between words, once A-Z are lower-case: all of ASCII but digits and letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[0:0x30] = _BETWEEN[0x3A:0x61] = _BETWEEN[0x7B:0x80] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of data[start:end] for each span: byte by byte over all spans at once, those that are over left behind."""
    short = np.minimum(ends - starts, SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    at, falling = starts[order], -short[order].astype(np.int64)
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(falling, -SHORT))
    upto = np.searchsorted(falling, -np.arange(SHORT))  # how many are longer
    for j, hi in enumerate(upto.tolist()):
        if hi <= n_long:
            break
        live = crc[n_long:hi]
        crc[n_long:hi] = _CRC[(live ^ data[at[n_long:hi] + j]) & np.uint32(0xFF)] ^ (live >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(n_long):
        crc[i] = zlib.crc32(data[at[i] : ends[order[i]]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, runs: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and bucket of each run of 1 to `runs` words, words of each row)."""
    data = _FOLDED[data]
    starts, ends, rows = word_spans(data, offsets, _BETWEEN)
    n_words = np.diff(first_words(rows, len(offsets) - 1))
    if runs > 1 and len(starts):
        # Words one space apart, so that a run is a stretch of bytes.
        length = ends - starts
        begin = (length + 1).cumsum() - (length + 1)
        packed = np.full(int(begin[-1] + length[-1] + 1), 32, np.uint8)
        packed[np.arange(int(length.sum())) + np.repeat(begin - (length.cumsum() - length), length)] = data[np.arange(int(length.sum())) + np.repeat(starts - (length.cumsum() - length), length)]
        data, starts, ends = packed, begin, begin + length
    found = []
    for n in range(1, runs + 1):
        inside = np.flatnonzero(rows[: max(len(rows) - n + 1, 0)] == rows[n - 1 :])
        found.append((rows[inside], crc32_spans(data, starts[inside], ends[inside + n - 1]) % np.uint32(buckets)))
    return np.concatenate([r for r, _ in found]), np.concatenate([b for _, b in found]).astype(np.int64), n_words


def _count(runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0)):
                total += np.bincount(features(data, offsets, runs, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket: added up in each task, then over the tasks."""
    rows = texts.select(named(text_col).alias("text")).mapInArrow(_count(runs, buckets), "bucket long, n long")
    found = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    size, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log(float(t + 1) * (all_s + size) / (float(s + 1) * (all_t + size)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _weigh(runs: int, gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                rows, bucket, n_words = features(data, offsets, runs, len(gain))
                n = np.bincount(rows, minlength=hi - lo)
                # Of whole numbers, which doubles hold exactly at these sizes.
                total = np.bincount(rows, gain[bucket], minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_features", "n_words", "weight"],
                )

    return run


def noise(seed: int, id_col: str = "doc_id") -> Column:
    """Thousandths of a Gumbel variable that seed and id decide, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]


def last_drawn(rows: DataFrame, percent: int, sketch: int = SKETCH):
    """The row (score, doc_id, place) of the last of the floor(percent * N / 100) highest scores; None if none is drawn."""
    share, slack = percent / 100, 2 / sketch
    points = [max(0.0, 1 - share - slack), min(1.0, 1 - share + slack)]
    first = rows.agg(F.count("*").alias("n"), F.percentile_approx("score", points, sketch).alias("ends")).first()
    k = percent * first["n"] // 100
    if not k:
        return None
    low, high = first["ends"]
    while True:
        counts = rows.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("upto")).first()
        if counts["above"] < k <= counts["upto"]:
            break
        reach = max(1, high - low)
        low, high = (low - reach if counts["upto"] < k else low), (high + reach if counts["above"] >= k else high)
    bracket = rows.filter(F.col("score").between(low, high)).select("score", "doc_id", "place")
    return add_index(bracket, _order(), "nth").filter(F.col("nth") == k - counts["above"] - 1).first()


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, runs: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank): rank is 1, 2, 3, ... over the drawn documents, null for the others."""
    texts = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    gain = gains(bucket_counts(texts, "text", runs, buckets), bucket_counts(target, text_col, runs, buckets))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    weighed = texts.mapInArrow(_weigh(runs, gain), f"doc_id {id_type}, n_features long, n_words long, weight long")
    rows = staged(weighed.select("*", (F.col("weight") + noise(seed)).alias("score"), F.monotonically_increasing_id().alias("place")), "weighed")
    able = F.col("n_words") >= min_words
    last = last_drawn(rows.filter(able), percent, sketch)
    drawn = F.lit(False)
    if last is not None:
        same_id = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]))
        before = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") < F.lit(last["doc_id"]), F.lit(False))
        tie = before | (same_id & (F.col("place") <= last["place"]))
        drawn = able & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tie))
    ranked = add_index(rows.filter(drawn), _order(), "rank", start=1)
    others = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(others.select(*names))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
f AS (SELECT k, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
g AS (SELECT unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
bucket AS (SELECT w, {crc_sql("w")} % {BUCKETS} AS b FROM (SELECT w FROM f UNION SELECT w FROM g), tab),
s AS (SELECT b, count(*) AS s FROM f JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN bucket USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
each AS (SELECT k, count(*) AS n, sum(gain) AS total FROM f JOIN bucket USING (w) JOIN gain USING (b) GROUP BY k),
weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM d LEFT JOIN each USING (k)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= able * 10 // 100 THEN nth END AS rank FROM ranked
"""

"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams of a whole text: words, pairs of words, shapes of words (letter case,
punctuation) and pairs of shapes, and how often a word or shape repeats its forerunner, in steps. Class counts of every
feature run over all labelled training rows, on Spark; their smoothed log-count ratios scale the indicators. On those, a
linear hinge-loss model is fitted by dual coordinate descent. The fit takes at most FIT_ROWS labelled rows: those of least
hash, a bounded sample; at most 2**BITS weights go to the workers. A logistic curve over margins of rows that the fit
left out turns margins into scores.

Defined cases: a null or empty text has no features, and its score is that of the intercept; labels of null count as
none; ids that repeat among the labels or the documents are each a labelled row, and of tied rows the fit takes no more than
its bound; without labels of both classes every score is
the share of label 1, or 0.5 without any; repeated rows score alike; an empty table gives an empty result; extra columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import first_words, fresh, hash_words, lean, mix, named, staged, text_steps, word_spans

BITS = 18
FIT_ROWS = 12_000
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3

# Shape classes of bytes: lower, upper, digit, other ASCII by its own value, and bytes of longer characters as lower.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, in order of rows."""
    starts, ends, rows = word_spans(data, offsets)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = hash_words(data, starts, ends, fold=True)
    # A word's shape: its bytes' classes, runs of one class counted once.
    shaped = _SHAPE[data]
    new = np.concatenate([[True], shaped[1:] != shaped[:-1]])
    new[starts] = True
    kept = np.concatenate([[0], new.cumsum()])
    shapes = hash_words(shaped[new], kept[starts], kept[ends])
    same_row = rows[1:] == rows[:-1]
    of, kinds = [rows, rows], [mix(words ^ np.uint64(1)), mix(shapes ^ np.uint64(2))]
    of += [rows[1:][same_row]] * 2
    kinds += [mix(words[1:] * np.uint64(3) + words[:-1])[same_row], mix(shapes[1:] * np.uint64(5) + shapes[:-1])[same_row]]
    first = first_words(rows, n_rows)
    n = np.maximum(np.diff(first), 1)
    upper = (shaped[starts] == 65) & (shaped[ends - 1] != 97)
    for salt, hit, at in ((7, (words[1:] == words[:-1]) & same_row, rows[1:]), (11, (shapes[1:] == shapes[:-1]) & same_row, rows[1:]), (13, upper, rows)):
        share = np.bincount(at[hit], minlength=n_rows) * 10 // n
        for step in range(1, 10):
            who = np.flatnonzero(share >= step)
            of.append(who)
            kinds.append(mix(np.full(len(who), salt * 100 + step, np.uint64)))
    f = (np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique(np.concatenate(of).astype(np.int64) << BITS | f)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _rows_of_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, order, features) of labelled texts: columns text, label, order."""
    for batch in batches:
        for lo, hi, data, offsets in text_steps(batch.column(0)):
            rows, f = features(data, offsets)
            edges = np.searchsorted(rows, np.arange(hi - lo + 1))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(f, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), lists], ["label", "at", "f"])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in text_steps(batch.column(0)):
            rows, f = features(data, offsets)
            y = labels[lo + rows]
            for c in (0, 1):
                total[c] += np.bincount(f[y == c], minlength=1 << BITS)
    seen = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["f", "n0", "n1"])


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dims: int, rounds: int = 12, seed: int = 9) -> np.ndarray:
    """Weights of the hinge-loss model, by dual coordinate descent; x: (features, values) of each row; cost: upper bounds of the duals."""
    w, alpha = np.zeros(dims), np.zeros(len(x))
    square = np.array([v @ v for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            if square[i] == 0:
                continue
            f, v = x[i]
            gradient = y[i] * (w[f] @ v) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                w[f] += step * y[i] * v
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton steps with a small ridge; a is at least 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - y) * margins).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        r = p * (1 - p)
        h = np.array([[(r * margins * margins).sum() + 1e-2, (r * margins).sum()], [(r * margins).sum(), r.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class Model:
    """Weights of each feature (log-count ratio times fitted weight), and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, f = features(data, offsets)
        n_rows = len(offsets) - 1
        found = np.bincount(rows, minlength=n_rows)
        margin = np.bincount(rows, self.weights[f], n_rows) / np.sqrt(np.maximum(found, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def fit_sample(labelled: DataFrame, docs: dict[int, int], fit_rows: int) -> DataFrame:
    """At most fit_rows of labelled (text, label, at), those of least `at`; docs has the number of rows of each label.

    Both classes get half of the sample at most; a class of fewer rows leaves its place to the other. Rows that tie at the
    cut are equal, and as many of them are taken as there is room.
    """
    least, parts = min(docs.values()), []
    for c in (0, 1):
        most = fit_rows // 2 if least >= fit_rows // 2 else fit_rows - least if docs[c] == max(docs.values()) else docs[c]
        own = labelled.filter(F.col("label") == c)
        first = own.select("at").orderBy("at").limit(most).groupBy("at").agg(F.count("*").alias("n")).orderBy(F.desc("at")).first()
        parts += [own.filter(F.col("at") < first["at"]), own.filter(F.col("at") == first["at"]).limit(first["n"])]
    return reduce(DataFrame.unionByName, parts)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled (text, label, at): at orders the rows by hash, and the fit takes the first fit_rows."""
    labelled = labelled.filter("label in (0, 1)")
    none = np.zeros(1 << BITS)
    counts = labelled.select("text", "label").mapInArrow(lean(_class_counts), "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    seen = counts.toArrow()  # at most 2**BITS rows
    docs = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(docs) < 2:
        share = docs.get(1, 0) / max(1, sum(docs.values())) if docs else 0.5
        return Model(none, 0.0, 0.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    n = np.ones((2, 1 << BITS))
    for c, name in ((0, "n0"), (1, "n1")):
        n[c, seen["f"].to_numpy()] += seen[name].to_numpy()
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    sample = fit_sample(labelled, docs, fit_rows).mapInArrow(lean(_rows_of_features), "label int, at long, f array<int>").toArrow()
    order = np.lexsort((sample["label"].to_numpy(), sample["at"].to_numpy()))
    y = sample["label"].to_numpy()[order].astype(np.int64)
    lists = sample["f"].combine_chunks()
    edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    bias_at = 1 << BITS
    # All rows in two arrays, each row with the bias at its end: large pieces of memory go back when they are done with.
    sizes = np.diff(edges)[order] + 1
    ends = sizes.cumsum()
    f_all = np.full(int(ends[-1]), bias_at, np.int32)
    for i, end, size in zip(order.tolist(), ends.tolist(), sizes.tolist()):
        f_all[end - size : end - 1] = flat[edges[i] : edges[i + 1]]
    v_all = np.append(ratio, 1.0).astype(np.float32)[f_all]
    v_all /= np.repeat(np.sqrt(np.maximum(sizes - 1, 1)), sizes).astype(np.float32)
    v_all[ends - 1] = 1
    x = [(f_all[end - size : end], v_all[end - size : end]) for end, size in zip(ends.tolist(), sizes.tolist())]
    del sample, lists, flat, edges
    pa.default_memory_pool().release_unused()
    signs = 2.0 * y - 1
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    cost = 0.5 / share[y]
    kept = np.arange(len(y)) % 5 == 0  # left out of the first fit, for the curve
    w = dual_descent([x[i] for i in np.flatnonzero(~kept)], signs[~kept], cost[~kept], bias_at + 1)
    margins = np.array([w[x[i][0]] @ x[i][1] for i in np.flatnonzero(kept)])
    # The sample has other class shares than the corpus: the curve is fitted as the corpus has them.
    a, b = logistic(margins, y[kept].astype(float)) if len(set(y[kept].tolist())) == 2 else (1.0, 0.0)
    b += float(np.log(docs[1] / docs[0]) - np.log(max(share[1], 1e-9) / max(share[0], 1e-9)))
    w = dual_descent(x, signs, cost, bias_at + 1)
    return Model(w[:bias_at] * ratio, float(w[bias_at]), a, b)


def _score(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.scores(data, offsets) for _, _, data, offsets in text_steps(batch.column(at))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """docs and, in a new column of this name, the score of each text."""
    # Plain names on the way: mapInArrow doesn't take those with a dot.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    found = plain.mapInArrow(lean(_score(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col))), schema)
    return found.toDF(*docs.columns, name)


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, at) of the labelled documents whose remainder is not 0.

    Labels go to the texts, and not texts to the labels, while there are at most BROADCAST_LABELS of them (some 20 bytes
    each); beyond, the labelled texts are shuffled and written once.
    """
    marks = labels.select(named(id_col).alias("of"), named(label_col).cast("int").alias("label")).filter("of IS NOT NULL AND label IN (0, 1)")
    small = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    texts = docs.select(named(id_col).alias("doc"), named(text_col).alias("text")).filter(remainder(F.col("doc")) != 0)
    rows = texts.join(F.broadcast(marks) if small else marks, F.col("doc") == F.col("of"))
    rows = rows.select("text", "label", F.xxhash64("doc", "text", F.lit("fit")).alias("at"))
    return rows if small else staged(rows, "labelled")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a model learnt from the labelled rows that are not held out."""
    model = fit(training_rows(docs, labels))
    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "text")
    return score(rows, model, "text", "score").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    (name,) = fresh(docs, "quality_score")
    return score(docs, fit(training_rows(docs, labels)), "text", name).filter(F.col(name) >= threshold).drop(name)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

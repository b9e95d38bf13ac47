"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped by PartEnum signatures.

A word is the vector of its letters as a multiset (the first e, the second e, ...). One edit changes at most two of its
elements, so words one edit apart lie within Hamming distance two. The elements are divided into PARTS parts by a fixed
hash; whichever two elements differ, they lie in at most two parts, so for some choice of two parts to leave out, the rest
is equal. Each word has a signature for each choice, a hash of what the other parts hold; words that share one are joined
on it, and verified by their edit distance.

Common letters can make a signature that very many words share. Words of a signature above MOST_IN_ONE meet further on
what one edit leaves alone: with h half of the longer word's length, one edit apart means the same first or the same last h
code points. That loses no pair and is used at any size above the bound.

Each pair is kept once. A word's form is its near word of the largest count, if at least `times` its own; so forms only
rise, and roots are found by doubling the paths over words that have a form.

Defined cases: null and empty texts have no words; a null id counts as the empty text; repeated rows count again; very
long texts are searched whole; ties of counts take the smallest word in code-point order; an empty table gives an empty
result; extra columns are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CRC_TABLE, crc_sql, discard, mix, named, staged

RUN = "[A-Za-zÀ-ÿ]+"
DAMAGED = 97
PARTS = 7
MOST_IN_ONE = 64


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, damaged: int = DAMAGED) -> DataFrame:
    """(word), a row for each run of letters: A-Z lower-cased, and one run in `damaged` without one of its letters."""
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(named(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(named(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length).select(run.alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)


def counted(found: DataFrame, least: int = 3) -> DataFrame:
    """(word, n) of words found at least `least` times."""
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def signatures(found: list[str], parts: int = PARTS) -> np.ndarray:
    """Words x choices of two parts: a hash of the letters that lie in the other parts."""
    letters = np.array([ord(c) for w in found for c in w], np.int64)
    length = np.array([len(w) for w in found], np.int64)
    row = np.repeat(np.arange(len(found)), length)
    # The nth occurrence of a letter in its word is an element of its own.
    order = np.lexsort((letters, row))
    key = row[order] << 32 | letters[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    element = mix((letters[order] << 24 | (np.arange(len(key)) - begin)).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros((len(found), parts), np.uint64)
    np.add.at(sums, (row[order], (element >> np.uint64(33)) % np.uint64(parts)), mix(element))
    total = sums.sum(1)
    out = [mix(total - sums[:, a] - sums[:, b] + np.uint64((a * parts + b + 1) * 0xD6E8FEB86659FD93 % 2**64)) for a in range(parts) for b in range(a + 1, parts)]
    return np.stack(out, 1)


def _sign(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = signatures(batch.column(0).to_pylist(), parts).view(np.int64)
            at = np.repeat(np.arange(batch.num_rows), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["signature", "word", "n"])

    return run


def _left_alone(word: Column) -> Column:
    """Hashes of what one edit leaves alone: where the longer word has this length, or one more, the first and the last half of it."""
    size, ends = F.length(word), []
    for longest in (size, size + 1):
        half = F.floor((longest - 1) / 2).cast("int")
        ends += [F.xxhash64(longest, F.lit("first"), F.substring(word, F.lit(1), half)), F.xxhash64(longest, F.lit("last"), F.substring(word, size - half + 1, half))]
    return F.array(*ends)


def near_pairs(vocabulary: DataFrame, parts: int = PARTS, most_in_one: int = MOST_IN_ONE) -> DataFrame:
    """(a, n_a, b, n_b): words one edit apart, a < b, each pair once; vocabulary has (word, n)."""
    signed = staged(vocabulary.mapInArrow(_sign(parts), "signature long, word string, n long"), "spelling-signatures")
    sizes = staged(signed.groupBy("signature").agg(F.count("*").alias("size")).filter("size > 1"), "spelling-sizes")
    met = staged(signed.join(sizes, "signature"), "spelling-met")
    few = met.filter(F.col("size") <= most_in_one).select("signature", "word", "n")
    crowd = met.filter(F.col("size") > most_in_one).select(F.explode(_left_alone(F.col("word"))).alias("end"), "signature", "word", "n")
    found = _verified(few, "signature").union(_verified(crowd.select(F.xxhash64("signature", "end").alias("signature"), "word", "n"), "signature"))
    pairs = staged(found.dropDuplicates(["a", "b"]), "spelling-pairs")
    discard(signed, sizes, met)
    return pairs


def _verified(rows: DataFrame, key: str) -> DataFrame:
    a, b = (rows.select(F.col(key).alias(f"{key}_{x}"), F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, (F.col(f"{key}_a") == F.col(f"{key}_b")) & near).select("a", "n_a", "b", "n_b")


def forms(vocabulary: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """(word, n_near, form, form_n) of words that have near ones."""
    names = ("word", "n", "near", "m")
    either = F.array(*[F.struct(*[F.col(c).alias(name) for c, name in zip(side, names)]) for side in (("a", "n_a", "b", "n_b"), ("b", "n_b", "a", "n_a"))])
    sides = pairs.select(F.explode(either).alias("p"))
    best = sides.groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.m")).alias("m"), F.col("p.near").alias("near"))).alias("best"), F.first("p.n").alias("n"))
    taken = -F.col("best.m") >= times * F.col("n")
    return best.select("word", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """(word, root): where the forms of `linked` (word, form) end. Paths double each round, and forms can't return."""
    paths = staged(linked.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-paths")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = staged(paths.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-paths")
        moved = longer.filter("moved").limit(1).count()
        discard(paths)
        paths = longer.select("word", "root")
        if not moved:
            return paths


def spelling_variants(docs: DataFrame, least_length: int = 5, least: int = 3, times: int = 2, damaged: int = DAMAGED, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root), a row a word."""
    vocabulary = staged(counted(words(docs, id_col, text_col, least_length, damaged), least), "spelling-words")
    linked = staged(forms(vocabulary, near_pairs(vocabulary, parts), times), "spelling-forms")
    found = vocabulary.join(linked, "word", "left").join(roots(linked), "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Near words by what is left around each code point: the same around one of each, or the other word itself.
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '{RUN}')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
g AS (SELECT d, run, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, k, {crc_sql("d || ':' || run")} AS h FROM g, tab),
w AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
gap AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT gap.word AS a, v.word AS b FROM gap JOIN v ON gap.a || gap.b = v.word),
p AS (SELECT x.word AS a, y.word AS b FROM gap x JOIN gap y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
best AS (SELECT p.a AS word, count(*) AS n_near, min({{'m': -v.n, 'w': v.word}}) AS near FROM p JOIN v ON p.b = v.word GROUP BY p.a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -near.m >= 2 * n THEN near.w END AS form, CASE WHEN -near.m >= 2 * n THEN -near.m END AS form_n FROM v LEFT JOIN best USING (word)),
path AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.at WHERE f.form IS NOT NULL),
root AS (SELECT path.word, path.at FROM path JOIN f ON f.word = path.at WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(root.at, f.word) AS root FROM f LEFT JOIN root USING (word)
"""

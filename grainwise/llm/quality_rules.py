"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The measures are lengths, symbols, stop words and lines; a rule is (measure, lowest, highest), and a text is kept if
every rule holds. All measures are built-in expressions over the whole text; each is bound once, so the projection
computes words and lines a single time.

Defined cases: a null or empty text has no words, every measure 0, and fails the base rule (fewer than 50 words);
repeated rows are judged alike; rows are kept as they come (nothing is dropped: the verdict is a column); an empty
table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD

SYMBOLS = "#*$%&|<>"
# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for with on was as are be at by this from or an not "
    "le la les de des et en un une du que est pour dans qui sur au pas par il "
    "der die das und ist von mit den zu auf für im ein eine nicht als auch dem sich "
    "el los las y una por con para es se del no lo su"
).split()

#: (measure, lowest, highest); None: no bound. Ratios are per word or per line.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("repeat_ratio", None, 0.5),
    ("mean_word", 2.0, 12.0),
    ("symbol_ratio", None, 0.3),
    ("dup_line_ratio", None, 0.5),
    ("shout_ratio", None, 0.3),
    ("stop_ratio", 0.02, None),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more: windows are sorted by hash, and neighbours compared."""

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        hash_at = lambda i: F.get(sorted_windows, i)["h"]
        doubled = F.filter(
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.when((hash_at(i) == hash_at(i - 1)) | (hash_at(i) == hash_at(i + 1)), F.get(sorted_windows, i)["i"]),
            ),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(doubled, lambda i: F.array(i, i + 1, i + 2)))))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) >= 4, let(F.sort_array(windows), covered)).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""

    def of(t: Column, words: Column, lines: Column) -> Column:
        n = F.size(words).cast("long")
        per_word = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
        chars = F.length(F.array_join(words, "")).cast("long")
        symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
        dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        shouts = F.size(F.filter(words, lambda w: w.endswith("!!")))
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        base = F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"), _repeat_words(words).alias("n_repeat_words"),
            shouts.alias("shouts"), stops.alias("stops"), F.size(lines).alias("n_lines"),
        )
        return let(
            base,
            lambda b: F.struct(
                *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                per_word(b["n_repeat_words"]).alias("repeat_ratio"),
                per_word(b["word_chars"]).alias("mean_word"),
                per_word(b["n_symbols"]).alias("symbol_ratio"),
                F.coalesce(F.try_divide(b["n_dup_lines"], b["n_lines"]), F.lit(0.0)).alias("dup_line_ratio"),
                per_word(b["shouts"]).alias("shout_ratio"),
                per_word(b["stops"]).alias("stop_ratio"),
            ),
        )

    text = F.coalesce(text, F.lit(""))
    has_word = lambda line: line.rlike(WORD)
    return let(
        F.struct(text.alias("t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"), F.filter(F.split(text, "\n"), has_word).alias("l")),
        lambda x: of(x["t"], x["w"], x["l"]),
    )


def verdict(m: Column, rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> Column:
    """True if every rule holds."""
    held = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            held &= m[name] >= low
        if high is not None:
            held &= m[name] <= high
    return held


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """(doc_id, the five counts, the ratios, base_failed, kept)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    m = F.col("m")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return rows.select("doc_id", "m.*", failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS k
  FROM documents),
win AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM (
    SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS s FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM t))),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY k),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: ends_with(x, '!!'))) AS shouts, len(list_filter(w, lambda x: list_contains(__STOPS__, lower(x)))) AS stops
  FROM t LEFT JOIN rep USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.3
         AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AND shouts / n_words <= 0.3 AND stops / n_words >= 0.02 AS kept
FROM m
""".replace("__STOPS__", "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]")

"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target in words, and e = target / its words. A document's expected copies are
e + TILT * min(e, max_copies - e) * (r - R), r being the share of its words that are distinct and R that of its source's
words: of each source's documents, those that repeat themselves less are favoured, and the expected words are the target.

Whole expected copies are certain and allocated first; what is left, p, is the document's inclusion odds, and differs by
document. The documents of a source are dealt into classes of size (four a doubling); each class gets a fixed number of
further copies, its odds' sum rounded, and from the largest class to the smallest the words that rounding leaves over or
lacks are handed on. In each class the documents are ranked by random odds divided by inclusion odds,
q = (u / (1 - u)) / (p / (1 - p)), and that fixed number of lowest q is taken; u is a uniform number made from a hash of id,
text and occurrence. So a source's words differ from its target by what sizes differ within a class, and by half of its
smallest documents.

The cut is found without sorting a class: ranks are counted over slices of the logarithm of q, of which each holds some
a thousandth of documents of equal odds, and only the slice that holds the cut is ordered. Rows are never dropped or capped. The sources, a row each, are ordered in one task.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last; null and repeated ids are told
apart by their texts, and wholly equal rows by an occurrence number, so that each has a draw of its own; an empty table
gives an empty result; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, fresh, named, staged

#: Up to so many rows a table of sources or classes is broadcast (some 80 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
#: How far the share of distinct words moves a document's expected copies.
TILT = 0.5
#: Inclusion odds are multiples of 1 / ODDS, so that their sums are exact.
ODDS = 1 << 20
#: Slices for each unit of the logarithm of q.
SLICES = 250


def uniform(id_col: Column, text_md5: Column, occurrence: Column, seed: int) -> Column:
    """A number in (0, 1) of 52 bits, the same in every run."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), text_md5, occurrence.cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def pareto(u: Column, p: Column) -> Column:
    """The logarithm of the odds ratio q = (u / (1 - u)) / (p / (1 - p)); it orders like q."""
    return F.log(u) - F.log(1 - u) - F.log(p) + F.log(1 - p)


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """sizes (source, source_size, ...) with target: weights repeat over the sources in code point order."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_source) - 1) % len(weights)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fullest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(max_copies))
        .withColumn("wanted", F.sum("source_size").over(everything) * share)
        .withColumn("level", (F.col("wanted") - before) / left)
        # Above the level of the first source that is not full, every source gets its cap.
        .withColumn("level", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything))
        .select(*sizes.columns, F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))
    )


def measured(text: Column) -> tuple[Column, Column, Column]:
    """Words, distinct words and md5 of a text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.coalesce(F.size(words), F.lit(0)).cast("long"), F.coalesce(F.size(F.array_distinct(words)), F.lit(0)).cast("long"), F.md5(text.cast("binary"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, kinds, text_md5, times): equal rows once, with how many they are."""
    size, kinds, digest = measured(F.coalesce(named(text_col), F.lit("")))
    rows = docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), size.alias("size"), kinds.alias("kinds"), digest.alias("text_md5"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))


def _joined(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of side, null-safe on keys; side is broadcast if it has few rows."""
    renamed = side.select(*[F.col(k).alias(f"{k}_of") for k in keys], *[c for c in side.columns if c not in keys])
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return rows.join(renamed, same).drop(*[f"{k}_of" for k in keys])


def expected(size: Column, kinds: Column, max_copies: int, tilt: float = TILT) -> Column:
    """Expected copies of a document, from the columns of its source: source_size, source_kinds, target."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    e = ratio(F.col("target"), F.col("source_size"))
    moved = F.lit(tilt) * F.least(e, max_copies - e) * (ratio(kinds, size) - ratio(F.col("source_kinds"), F.col("source_size")))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), e + moved))


def drawn(rows: DataFrame, max_copies: int, seed: int) -> DataFrame:
    """rows (doc_id, size, kinds, text_md5, occurrence, and the columns of the source) with copies, odds, class and place."""
    return (
        rows.withColumn("expected", expected(F.col("size"), F.col("kinds"), max_copies))
        .withColumn("copies", F.floor("expected"))
        .withColumn("odds", F.floor((F.col("expected") - F.col("copies")) * ODDS))
        .withColumn("class", F.when(F.col("size") > 0, F.floor(4 * F.log2("size") + 1e-9)).otherwise(-1).cast("int"))
        .withColumn("place", F.when(F.col("odds") > 0, pareto(uniform(F.col("doc_id"), F.col("text_md5"), F.col("occurrence"), seed), F.col("odds") / float(ODDS))))
        .drop("expected")
    )


def fixed_numbers(classes: DataFrame) -> DataFrame:
    """(source, class, number) from (source, class, rows, odds, words): the fixed number of further copies of each class."""
    listed = classes.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("class", "rows", "odds", "words")))).alias("classes"))  # some 80 a source at most

    def step(state: Column, c: Column) -> Column:
        words, odds = c["words"] / float(ODDS), c["odds"] / float(ODDS)
        mean = words / odds
        wanted = F.when(mean > 0, (state["over"] + words) / mean).otherwise(odds)
        number = F.least(c["rows"], F.greatest(F.lit(0), F.floor(wanted + 0.5)))
        return F.struct((state["over"] + words - number * mean).alias("over"), F.concat(state["numbers"], F.array(F.struct(c["class"].alias("class"), number.alias("number")))).alias("numbers"))

    start = F.struct(F.lit(0.0).alias("over"), F.array().cast("array<struct<class: int, number: bigint>>").alias("numbers"))
    return listed.select("source", F.explode(F.aggregate("classes", start, step)["numbers"]).alias("n")).select("source", "n.class", "n.number")


def cuts(rows: DataFrame, slices: int) -> DataFrame:
    """(source, class, cut): rows of the class (from drawn()) whose place is at most cut are taken once more."""
    rows = rows.filter("odds > 0")
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    classes = rows.groupBy("source", "class").agg(F.count("*").alias("rows"), exact(F.col("odds")).alias("odds"), exact(F.col("odds") * F.col("size")).alias("words"))
    numbers = staged(fixed_numbers(classes), "mix-numbers")
    sliced = rows.withColumn("slice", F.floor(F.col("place") * slices))
    upto = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sliced.groupBy("source", "class", "slice").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    edge = _joined(counted, numbers, ["source", "class"]).filter("upto >= number and upto - n < number")
    edge = staged(edge.select("source", "class", F.col("slice").alias("edge"), (F.col("number") - F.col("upto") + F.col("n")).alias("nth")), "mix-edge")
    nth = F.row_number().over(Window.partitionBy("source", "class").orderBy("place"))
    found = _joined(sliced, edge, ["source", "class"]).filter("slice = edge").withColumn("at", nth).filter("at = nth")
    return staged(found.select("source", "class", F.col("place").alias("cut")), "mix-cuts")


def _plan(rows: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum(F.col("kinds") * F.col("times")).alias("source_kinds"))
    return staged(targets(sizes, weights, share, max_copies), "mix-plan")


def _single(rows: DataFrame) -> DataFrame:
    """A row for each of `times` equal ones, with its occurrence number."""
    return rows.withColumn("occurrence", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def _copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows of drawn() with copies that count what is taken at the cut."""
    side = cut.select(F.col("source").alias("source_of"), F.col("class").alias("class_of"), "cut")
    if cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    met = rows.join(side, F.col("source").eqNullSafe(F.col("source_of")) & (F.col("class") == F.col("class_of")), "left")
    return met.withColumn("copies", F.col("copies") + F.when(F.col("place") <= F.col("cut"), 1).otherwise(0)).drop("source_of", "class_of", "cut")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, seed: int = 6, slices: int = SLICES,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): one row a document, with how often the mix takes it."""
    rows = staged(sized(docs, id_col, text_col, source_col), "mix-rows")
    rows = drawn(_single(_joined(rows, _plan(rows, weights, share, max_copies), ["source"])), max_copies, seed)
    return _copies(rows, cuts(rows, slices)).select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def _numbered(docs: DataFrame, key: str, several: DataFrame, name: str) -> DataFrame:
    """docs with the occurrence of each row among those of its key, 1 unless the key is among several (key).

    Rows of a key are counted by partition, and numbered within it: no task gets a key whole.
    """
    if several.isEmpty():
        return docs.withColumn(name, F.lit(1).cast("long"))
    part, before = fresh(docs.withColumn(name, F.lit(1)), "part", "before")
    marked = docs.withColumn(part, F.spark_partition_id())
    some = marked.join(several, key, "left_semi")
    counted = some.groupBy(key, part).agg(F.count("*").alias("n"))
    offsets = counted.select(key, part, (F.sum("n").over(Window.partitionBy(key).orderBy(part)) - F.col("n")).alias(before))
    numbered = some.join(offsets, [key, part]).withColumn(name, F.col(before) + F.row_number().over(Window.partitionBy(key, part).orderBy(F.lit(1))))
    others = docs.join(several, key, "left_anti").withColumn(name, F.lit(1).cast("long"))
    return others.unionByName(numbered.select(*[named(c) for c in others.columns]))


def take_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, seed: int = 6, slices: int = SLICES,
) -> DataFrame:
    """The documents of the mix with the columns of docs, each as often as the mix takes it."""
    rows = staged(sized(docs, id_col, text_col, source_col), "mix-rows")
    plan = _plan(rows, weights, share, max_copies)
    cut = cuts(drawn(_single(_joined(rows, plan, ["source"])), max_copies, seed), slices)
    key = lambda i, s, m: F.md5(F.concat_ws("\x1f", F.coalesce(i.cast("string"), F.lit("\0")), F.coalesce(s.cast("string"), F.lit("\0")), m))
    several = rows.filter("times > 1").select(key(F.col("doc_id"), F.col("source"), F.col("text_md5")).alias("mix_key"))
    # The columns of docs travel as one, so that no name of theirs meets a name of ours.
    size, kinds, digest = measured(F.coalesce(named(text_col), F.lit("")))
    own = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"), named(id_col).alias("doc_id"), named(source_col).alias("source"), size.alias("size"), kinds.alias("kinds"), digest.alias("text_md5")
    )
    own = _numbered(own.withColumn("mix_key", key(F.col("doc_id"), F.col("source"), F.col("text_md5"))), "mix_key", several, "occurrence")
    taken = _copies(drawn(_joined(own, plan, ["source"]), max_copies, seed), cut)
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same rule in DuckDB: whole classes are ranked, and the numbers handed on class by class.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, source, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, md5(coalesce(text, '')) AS m FROM documents),
docs AS (
  SELECT doc_id, source, len(w)::BIGINT AS size, len(list_distinct(w))::BIGINT AS kinds,
         (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), m, (row_number() OVER (PARTITION BY doc_id, source, m))::VARCHAR, '6')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM texts),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, sum(kinds)::BIGINT AS source_kinds, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM docs GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(nth % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
top AS (SELECT max(level) FILTER (WHERE cap > level * weight) AS level FROM levels),
goals AS (SELECT w.nth, w.source, w.source_size, w.source_kinds, coalesce(least(w.cap, t.level * w.weight), w.cap) AS target FROM weighed w, top t),
wanted AS (
  SELECT d.*, g.nth, g.source_size, g.target, coalesce(g.target / nullif(g.source_size, 0), 0)::DOUBLE AS e,
         coalesce(d.kinds / nullif(d.size, 0), 0)::DOUBLE - coalesce(g.source_kinds / nullif(g.source_size, 0), 0)::DOUBLE AS off
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
split AS (SELECT *, greatest(0.0::DOUBLE, least(2.0::DOUBLE, e + 0.5::DOUBLE * least(e, 2.0::DOUBLE - e) * off)) AS expected FROM wanted),
odds AS (
  SELECT *, floor(expected)::BIGINT AS copies, floor((expected - floor(expected)) * 1048576.0::DOUBLE)::BIGINT AS odds,
         CASE WHEN size > 0 THEN floor(4 * log2(size) + 1e-9)::INT ELSE -1 END AS class FROM split),
placed AS (
  SELECT *, CASE WHEN odds > 0 THEN (u / (1 - u)) / ((odds / 1048576.0::DOUBLE) / (1 - odds / 1048576.0::DOUBLE)) END AS q FROM odds),
classes AS (
  SELECT nth, class, count(*) AS n, sum(odds)::DOUBLE / 1048576.0::DOUBLE AS o, sum(odds::HUGEINT * size)::DOUBLE / 1048576.0::DOUBLE AS words, row_number() OVER (PARTITION BY nth ORDER BY class DESC) AS at
  FROM placed WHERE odds > 0 GROUP BY nth, class),
given AS (
  SELECT nth, 0::BIGINT AS at, NULL::INT AS class, 0::BIGINT AS number, 0.0::DOUBLE AS over FROM goals
  UNION ALL
  SELECT c.nth, c.at, c.class, x.number, g.over + c.words - x.number * (c.words / c.o)
  FROM given g JOIN classes c ON c.nth = g.nth AND c.at = g.at + 1,
       LATERAL (SELECT least(c.n, greatest(0, floor(CASE WHEN c.words > 0 THEN (g.over + c.words) / (c.words / c.o) ELSE c.o END + 0.5)))::BIGINT AS number) x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY nth, class ORDER BY q) AS place FROM placed WHERE odds > 0),
more AS (SELECT r.doc_id, r.size, r.source_size, r.target, r.copies + CASE WHEN r.place <= g.number THEN 1 ELSE 0 END AS copies FROM ranked r JOIN given g ON r.nth = g.nth AND r.class = g.class
  UNION ALL SELECT doc_id, size, source_size, target, copies FROM placed WHERE odds = 0)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM more
"""

"""Search over names and definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...sources.staging import staged

LIMIT = 40


def search(objects: DataFrame, asked: str, kinds: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """(kind, name, tier, truncated) of objects (kind, name, expression): exact, prefix, within the name, within the definition."""
    asked = asked.strip().lower()
    name = F.lower("name")
    tier = F.when(name == asked, 0).when(name.startswith(asked), 1).when(name.contains(asked), 2).when(F.lower("expression").contains(asked), 3)
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    hits = objects.withColumn("tier", tier).filter("tier IS NOT NULL")
    found = hits.agg((F.count("*") > limit).alias("truncated"))
    return hits.orderBy("tier", rank, "name").limit(limit).crossJoin(found).select("kind", "name", "tier", "truncated")  # found is one row


def find_in_expressions(expressions: DataFrame, asked: str) -> DataFrame:
    """(kind, n_objects, n_found) of expressions (kind, expression): how many hold the text, whatever its case."""
    held = F.lower("expression").contains(asked.lower())
    times = F.when(held, (F.length("expression") - F.length(F.replace(F.lower("expression"), F.lit(asked.lower()), F.lit("")))) / len(asked))
    return expressions.groupBy("kind").agg(F.count_if(held).alias("n_objects"), F.coalesce(F.sum(times), F.lit(0)).cast("long").alias("n_found"))


# --- an index for many questions ------------------------------------------------------------------------------------

GRAM = 3
#: Rarest grams of a question whose postings are intersected; what they leave is verified.
MOST_GRAMS = 4


#: Bits of a character in a gram's code: Unicode ends below 2^21.
BITS = 21
#: Grams in one batch from Python, at least a text's.
BATCH = 1 << 20


def _codes(text: str, ended: bool) -> np.ndarray:
    """The distinct grams of a text as numbers; ended: those that run over its end too, so each shorter part begins one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
    if ended and len(points):
        points = np.concatenate([points, np.zeros(GRAM - 1, "int64")])
    n = max(len(points) - GRAM + 1, 0)
    return np.unique(reduce(lambda code, i: code << BITS | points[i : i + n], range(GRAM), np.zeros(n, "int64")))


def _grams(ended: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts (key, field, text) to (key, field, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, size, done = [], 0, 0
            for n, text in enumerate(batch.column("text"), 1):
                grams.append(_codes(text.as_py(), ended))
                size += len(grams[-1])
                if size >= BATCH or n == batch.num_rows:
                    own = batch.slice(done, n - done)
                    yield pa.RecordBatch.from_arrays([own.column("key"), own.column("field"), pa.array(grams, pa.list_(pa.int64()))], ["key", "field", "grams"])
                    grams, size, done = [], 0, n

    return run


_GRAMS = "key string, field string, grams array<long>"


def write_index(objects: DataFrame, path: str) -> str:
    """Store the postings of objects (id, kind, name, expression): (gram, field, id) in segments, and how many each gram has.

    A segment has the postings of its own objects, ordered by gram, so objects are shuffled and their far larger postings
    aren't; a scan for some grams reads only row groups that may have them. Null names and expressions have no postings;
    objects that share an id are one.
    """
    spark = objects.sparkSession
    segments = int(spark.conf.get("spark.sql.shuffle.partitions") or spark.sparkContext.defaultParallelism)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in ("name", "expression")])
    texts = objects.select("id", "name", "expression").repartition(segments, "id").select(F.col("id").alias("key"), F.inline(fields)).filter("text IS NOT NULL")
    postings = texts.mapInArrow(_grams(True), _GRAMS).select(F.explode("grams").alias("gram"), "field", F.col("key").alias("id"))
    postings.sortWithinPartitions("gram").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("field", "gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    return path


def candidates(path: str, questions: DataFrame) -> DataFrame:
    """(asked, field, id) of questions (asked): objects that hold the rarest grams of the lower-cased question. All that hold it are among them."""
    spark = questions.sparkSession
    postings, sizes = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes")
    asked = staged(questions.select("asked").filter("length(asked) > 0").distinct().withColumn("text", F.lower("asked")), "asked")
    longer = asked.select(F.col("asked").alias("key"), F.lit("asked").alias("field"), "text").filter(F.length("text") >= GRAM)
    grams = longer.mapInArrow(_grams(False), _GRAMS).select(F.col("key").alias("asked"), F.explode("grams").alias("gram"))
    # Both fields are asked; a gram that a field lacks leaves nothing of it.
    each = grams.crossJoin(spark.createDataFrame([("name",), ("expression",)], "field string")).join(sizes, ["field", "gram"], "left")  # two rows
    nth = F.row_number().over(Window.partitionBy("asked", "field").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    rarest = each.withColumn("_nth", nth).filter(F.col("_nth") <= MOST_GRAMS)
    wanted = rarest.groupBy("asked", "field").agg(F.count("*").alias("wanted"), F.count("n").alias("there"))
    # Written, so that its size is known before the postings would be shuffled.
    rarest = staged(rarest.join(wanted.filter("wanted = there"), ["asked", "field"]).select("asked", "field", "gram", "wanted"), "rarest")
    met = postings.join(rarest, ["field", "gram"]).groupBy("asked", "field", "id", "wanted").agg(F.count_distinct("gram").alias("n")).filter("n = wanted").select("asked", "field", "id")
    for size in range(1, GRAM):
        # The padded question is one gram; its first characters are the number's highest bits.
        start = F.shiftright("gram", BITS * (GRAM - size)).alias("start")
        padded = asked.filter(F.length("text") == size).select(F.col("asked").alias("key"), F.lit("asked").alias("field"), F.rpad("text", GRAM, "\x00").alias("text"))
        short = staged(padded.mapInArrow(_grams(False), _GRAMS).select(F.col("key").alias("asked"), F.explode("grams").alias("gram")).select("asked", start), "short")
        begun = postings.select("field", "id", start).join(short, "start").select("asked", "field", "id").distinct()
        met = met.unionByName(begun)
    return met


def search_many(path: str, objects: DataFrame, questions: DataFrame, kinds: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """(asked, kind, name, tier, truncated): for each question what `search` gives, from the stored index of the objects (id, kind, name, expression)."""
    lowered = objects.dropDuplicates(["id"]).withColumns({"_name": F.lower("name"), "_text": F.lower("expression")})
    met = candidates(path, questions).select("asked", "id").distinct().join(lowered, "id")
    name, asked = F.col("_name"), F.lower("asked")
    tier = F.when(name == asked, 0).when(name.startswith(asked), 1).when(name.contains(asked), 2).when(F.col("_text").contains(asked), 3)
    hits = staged(met.withColumn("tier", tier).filter("tier IS NOT NULL").select("asked", "id", "kind", "name", "tier"), "hits")
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    # Spark keeps the first `limit` of a question in each task before it sorts any of them together.
    first = hits.withColumn("_nth", F.row_number().over(Window.partitionBy("asked").orderBy("tier", rank, "name", "id"))).filter(F.col("_nth") <= limit)
    more = hits.groupBy("asked").agg((F.count("*") > limit).alias("truncated"))
    return first.join(more, "asked").select("asked", "kind", "name", "tier", "truncated")


def find_many(path: str, objects: DataFrame, questions: DataFrame) -> DataFrame:
    """(asked, kind, n_objects, n_found): for each question what find_in_expressions gives of the kinds that hold it."""
    met = candidates(path, questions).filter("field = 'expression'").select("asked", "id").join(objects.select("id", "kind", F.lower("expression").alias("_text")).dropDuplicates(["id"]), "id")
    text, asked = F.col("_text"), F.lower("asked")
    times = (F.length(text) - F.length(F.replace(text, asked, F.lit("")))) / F.length("asked")
    held = met.filter(text.contains(asked)).withColumn("times", times)
    return held.groupBy("asked", "kind").agg(F.count("*").alias("n_objects"), F.sum("times").cast("long").alias("n_found"))

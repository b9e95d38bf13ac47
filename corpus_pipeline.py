"""The corpus pipeline: documents are filtered, deduplicated, decontaminated, mixed and written as token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it works on all that the stage before kept.

Defined cases, in every stage: an empty table gives an empty result; extra columns, whatever their names, are kept as they
are by all stages but the last; nulls may stand in any column. What a stage makes of null, empty and very long texts, of
ties and of repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainwise.llm import decontamination, mixing, near_copies, quality_classifier, token_output
from grainwise.llm._common import staged
from grainwise.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among docs, accepts.

    A null or empty text has the score of the model's intercept; a score that ties with the threshold is accepted; equal
    texts share their fate; very long texts are scored whole; without labels of both classes all have one score.
    """
    return quality_classifier.keep_quality(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their five-word shingles: that of the smallest id.

    Null and wordless texts are one group; null ids come last, and of equal ids the smallest key; of wholly equal rows one is
    left; very long texts are compared whole.
    """
    ship(spark)
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Null and empty texts stay; equal texts share their fate, whatever their ids; very long texts are searched whole.
    """
    return decontamination.clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its draw and its source's target ask for.

    A null source is a source of its own; null and empty texts have no words, and are taken as often as their source asks of
    each; null and repeated ids, and wholly equal rows, have a draw each.
    """
    return mixing.take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix written as token ids, and what reading them back gives: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; null ids come first, and rows of one id in order of a hash of their bytes.
    """
    ship(spark)
    return token_output.token_output(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID output", token_ids),
]

#: SQL can express neither the classifier nor the stages that follow it; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, "pipeline")
    return docs

"""Snapshots of definitions compared: what was added, removed, changed or renamed, and what that touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...sources import stores


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, kind, status, old_fingerprint, new_fingerprint) of objects (id, kind, fingerprint)."""
    a = before.select("id", F.col("kind").alias("_ka"), F.col("fingerprint").alias("old_fingerprint"))
    b = after.select("id", F.col("kind").alias("_kb"), F.col("fingerprint").alias("new_fingerprint"))
    status = (
        F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "removed").when(F.col("old_fingerprint").eqNullSafe(F.col("new_fingerprint")), "unchanged").otherwise("changed")
    )
    return a.join(b, "id", "full").select("id", F.coalesce("_kb", "_ka").alias("kind"), status.alias("status"), "old_fingerprint", "new_fingerprint")


def changes_between(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """What `diff` says of two digested snapshots, without what is unchanged: only buckets whose digests differ are read."""
    return diff(*stores.digested_sides(spark, path, old, new)).filter("status <> 'unchanged'")


def renames(changes: DataFrame) -> DataFrame:
    """(old_id, new_id, kind): a removed and an added object of one kind and fingerprint, each the only one on its side."""

    def single(status: str, fingerprint: str) -> DataFrame:
        side = changes.filter(F.col("status") == status).select("id", "kind", F.col(fingerprint).alias("fp"))
        n = F.count("*").over(Window.partitionBy("kind", "fp"))
        return side.withColumn("_n", n).filter("_n = 1").drop("_n")

    gone, new = single("removed", "old_fingerprint"), single("added", "new_fingerprint")
    return gone.withColumnRenamed("id", "old_id").join(new.withColumnRenamed("id", "new_id"), ["kind", "fp"]).select("old_id", "new_id", "kind")


def events(changes: DataFrame) -> DataFrame:
    """(id, event, is_semantic): renames take the place of their two halves, and mean nothing."""
    pairs = renames(changes)
    halves = pairs.select(F.col("old_id").alias("id")).unionByName(pairs.select(F.col("new_id").alias("id")))
    others = changes.filter("status <> 'unchanged'").join(halves, "id", "left_anti").select("id", F.col("status").alias("event"), F.lit(True).alias("is_semantic"))
    return others.unionByName(pairs.select(F.col("old_id").alias("id"), F.lit("renamed").alias("event"), F.lit(False).alias("is_semantic")))


def affected(evidence: DataFrame, happened: DataFrame) -> DataFrame:
    """(requirement, n_events, action) of evidence (requirement, id): revalidate, or only update references."""
    hit = evidence.join(happened, "id")
    action = F.when(F.bool_or("is_semantic"), "revalidate").otherwise("reference update")
    return hit.groupBy("requirement").agg(F.count("*").alias("n_events"), action.alias("action"))


def change_rows(happened: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, event, position of its kind of event, requirement): for a document; a row for each requirement that rests on the object, one with none if there is none."""
    order = F.element_at(F.create_map(*[F.lit(x) for p in (("changed", 0), ("removed", 1), ("added", 2), ("renamed", 3)) for x in p]), F.col("event"))
    touched = evidence.select("requirement", "id").distinct()
    return happened.join(touched, "id", "left").select("id", "event", order.alias("event_order"), "requirement")


def gate(happened: DataFrame, touched: DataFrame, fail_on: str = "semantic", models: tuple[str, str] | None = None, allow_different: bool = False) -> DataFrame:
    """One row: counts, and whether the gate fails on any, semantic, revalidation or no changes.

    models are the names of the two that are compared: different ones are refused unless that is allowed.
    """
    if models and models[0] != models[1] and not allow_different:
        raise ValueError(f"{models[0]} and {models[1]} are different models: every object would be added or removed")
    a = happened.agg(F.count("*").alias("n_events"), F.count_if("is_semantic").alias("n_semantic"))
    b = touched.agg(F.count_if(F.col("action") == "revalidate").alias("n_revalidate"))
    fails = {"any": F.col("n_events"), "semantic": F.col("n_semantic"), "revalidation": F.col("n_revalidate"), "none": F.lit(0)}[fail_on] > 0
    return a.crossJoin(b).withColumn("fails", fails)  # one row each

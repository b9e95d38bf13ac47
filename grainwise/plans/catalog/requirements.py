"""Requirement rows derived from definitions, what backs them, and where their review stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.text import fingerprint

#: Kind of object: (kind of requirement, category, statement, confidence).
RULES = {
    "measure": ("functional", "metrics", "The system shall compute %s.", "high"),
    "relationship": ("functional", "integration", "The system shall relate %s.", "high"),
    "hierarchy": ("business", "navigation", "Users shall drill through %s.", "high"),
    "calculated column": ("functional", "derivation", "The system shall derive %s for each row.", "high"),
    "role": ("business", "security", "Members of %s shall see only their rows.", "high"),
    "object permission": ("business", "security", "%s shall be hidden where its role says so.", "high"),
    "perspective": ("business", "navigation", "%s shall be offered as a view of its own.", "medium"),
    "variation": ("functional", "navigation", "The system shall offer %s as a default way through dates.", "low"),
    "kpi": ("business", "metrics", "%s shall be judged against its target.", "high"),
    "calculation group": ("functional", "metrics", "The system shall apply %s to any measure.", "medium"),
    "load step": ("functional", "data", "The load of %s shall keep its steps.", "medium"),
    "gap": ("functional", "coverage", "%s shall be looked at by a person.", "low"),
}


def derive(objects: DataFrame) -> DataFrame:
    """(requirement, kind, category, statement, confidence, evidence) of objects (id, kind, name), in one pass; the id is a hash of what it is about."""
    rules = F.create_map(*[x for kind, rule in RULES.items() for x in (F.lit(kind), F.array(*[F.lit(r) for r in rule]))])
    rows = objects.withColumn("_rule", F.element_at(rules, F.col("kind"))).filter("_rule IS NOT NULL")
    what, category, statement, confidence = (F.col("_rule")[i] for i in range(4))
    return rows.select(
        fingerprint(F.col("kind"), F.col("id")).alias("requirement"),
        what.alias("kind"),
        category.alias("category"),
        F.replace(statement, F.lit("%s"), F.col("name")).alias("statement"),
        confidence.alias("confidence"),
        F.array("id").alias("evidence"),
    )


def evidence(requirements: DataFrame) -> DataFrame:
    """(requirement, id): what each requirement rests on, a row each."""
    return requirements.select("requirement", F.explode("evidence").alias("id"))


def corroborated(objects: DataFrame, shown: DataFrame, readers: DataFrame) -> DataFrame:
    """objects (id) with `backing`: shown on a report, read by a measure, or nothing."""
    s = shown.select("id", F.lit(True).alias("_shown")).distinct()
    r = readers.groupBy("id").agg(F.count("*").alias("_readers"))
    backing = F.when(F.col("_shown"), "shown").when(F.col("_readers") > 0, "read").otherwise("nothing")
    return objects.join(s, "id", "left").join(r, "id", "left").select("id", backing.alias("backing"))


def standing(current: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, standing, verdict) of current (id, fingerprints): the last decision (id, at, verdict, fingerprints) holds while it is bound to the same set."""
    last = decisions.groupBy("id").agg(F.max_by(F.struct("verdict", "fingerprints"), "at").alias("d")).select("id", "d.verdict", F.col("d.fingerprints").alias("_bound"))
    same = F.array_sort("fingerprints").eqNullSafe(F.array_sort("_bound"))
    state = F.when(F.col("verdict").isNull(), "open").when(same, "decided").otherwise("stale")
    return current.join(last, "id", "left").select("id", state.alias("standing"), "verdict")


def review_queue(requirements: DataFrame, standings: DataFrame) -> DataFrame:
    """(requirement, standing) of requirements (requirement, confidence) of low confidence that aren't decided, standings being (id, standing)."""
    low = requirements.filter("confidence = 'low'").join(standings.withColumnRenamed("id", "requirement"), "requirement", "left")
    return low.select("requirement", F.coalesce("standing", F.lit("open")).alias("standing")).filter("standing <> 'decided'")


def review_counts(requirements: DataFrame, standings: DataFrame) -> DataFrame:
    """(confidence, standing, n)."""
    rows = requirements.join(standings.withColumnRenamed("id", "requirement"), "requirement", "left")
    return rows.groupBy("confidence", F.coalesce("standing", F.lit("open")).alias("standing")).agg(F.count("*").alias("n"))

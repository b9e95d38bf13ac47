"""What can be computed, and by what it can be split, over the definitions of many models at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.names import is_id_like
from . import graph

#: Kinds of values that a split can show; all others are measures of something, or unreadable.
READABLE = ("string", "int", "bigint", "boolean", "date")


def _at(*parts: str) -> Column:
    return F.concat_ws("\x1f", *parts)


def statuses(measures: DataFrame, tables: DataFrame) -> DataFrame:
    """(model, measure, status, construct) of measures (model, name, base, inputs) and tables (model, name).

    A measure is EXACT if all it is made of, to the end, is there and ends in tables. It is BLOCKED by a cycle it is in or
    leads to, by a measure or a table that its model lacks, and UNSUPPORTED where it reads no table (a constant), or is made
    of one that does; the first of these in this order is given. A null or empty base is none.
    """
    own = measures.select("model", F.col("name").alias("measure"), F.nullif(F.trim("base"), F.lit("")).alias("base"), F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"), _at("model", "name").alias("id")).dropDuplicates(["id"])
    edges = own.select(F.col("id").alias("src"), F.explode("inputs").alias("dst"), "model").select("src", _at("model", "dst").alias("dst"))
    reach = graph.closure(edges, own.select("id")).select("start", "id").unionByName(own.select(F.col("id").alias("start"), "id"))
    known = tables.select(_at("model", "name").alias("_table")).distinct()
    parts = own.withColumn("_base", _at("model", "base")).join(known, F.col("_base") == F.col("_table"), "left").select(
        "id", (F.col("base").isNotNull() & F.col("_table").isNull()).alias("no_table"), (F.col("base").isNull() & (F.size("inputs") == 0)).alias("constant")
    )
    # In a cycle: something that it reaches, or itself, has it as an input.
    looped = reach.join(edges.withColumnRenamed("src", "id"), "id").filter("dst = start").select(F.col("start").alias("id"), F.lit(True).alias("cycle")).distinct()
    faults = reach.join(parts, "id", "left").join(looped, "id", "left").groupBy("start").agg(
        F.bool_or(F.coalesce("cycle", F.lit(False))).alias("cycle"), F.bool_or(F.col("no_table").isNull()).alias("no_measure"), F.bool_or(F.coalesce("no_table", F.lit(False))).alias("no_table"), F.bool_or(F.coalesce("constant", F.lit(False))).alias("constant")
    )
    construct = F.when(F.col("cycle"), "cycle").when(F.col("no_measure"), "measure").when(F.col("no_table"), "table").when(F.col("constant"), "constant")
    status = F.when(construct.isNull(), "EXACT").when(construct == "constant", "UNSUPPORTED").otherwise("BLOCKED")
    return own.join(faults, own["id"] == faults["start"]).select("model", "measure", status.alias("status"), construct.alias("construct"))


def grain_options(columns: DataFrame, relationships: DataFrame, bases: DataFrame) -> DataFrame:
    """(model, base, table, column) by which a base's measures can be split: readable columns of the base and of what it reaches over active relationships to one sides, no keys and nothing that is named like an id.

    columns is (model, table, name, data_type), relationships (model, from_table, from_column, to_table, to_column, active),
    bases (model, base).
    """
    active = relationships.filter("active")
    edges = active.select(_at("model", "from_table").alias("src"), _at("model", "to_table").alias("dst"))
    starts = bases.select(_at("model", "base").alias("id")).distinct()
    reach = graph.closure(edges, starts).select("start", "id").unionByName(starts.select(F.col("id").alias("start"), "id"))
    keys = relationships.select("model", F.col("from_table").alias("table"), F.col("from_column").alias("name")).unionByName(relationships.select("model", F.col("to_table").alias("table"), F.col("to_column").alias("name"))).distinct()
    fit = columns.filter(F.col("data_type").isin(*READABLE) & ~is_id_like(F.col("name"))).join(keys, ["model", "table", "name"], "left_anti").withColumn("id", _at("model", "table"))
    return reach.join(fit, "id").select("model", F.substring_index("start", "\x1f", -1).alias("base"), "table", F.col("name").alias("column")).distinct()

"""Metrics of several platforms compared: by name, by what they read, and by likeness of names."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.names import name_key
from ...sources.staging import staged

NAME_LIKENESS, COLUMN_OVERLAP, MOST_PAIRS = 0.80, 0.6, 20
#: Asked names in one broadcast.
ASKED_BLOCK = 10_000


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def likeness(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts."""
    return F.pandas_udf(_ratio, "double")(a, b)


def likeness_bound(a: Column, b: Column) -> Column:
    """No pair's likeness is above this."""
    return F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller set that is in both; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def verdicts(metrics: DataFrame) -> DataFrame:
    """(key, platforms, verdict) of metrics (platform, name, tables, columns, aggregations)."""
    sets = [F.count_distinct(F.array_sort(F.array_distinct(F.transform(c, F.lower)))).alias(c) for c in ("tables", "columns", "aggregations")]
    merged = metrics.groupBy(name_key(F.col("name")).alias("key")).agg(F.count_distinct("platform").alias("platforms"), *sets)
    verdict = (
        F.when(F.col("platforms") < 2, "unique").when((F.col("tables") > 1) | (F.col("columns") > 1), "divergent").when(F.col("aggregations") > 1, "review").otherwise("consistent")
    )
    return merged.select("key", "platforms", verdict.alias("verdict"))


def pairings(left: DataFrame, right: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Likely pairs of unmatched metrics (name, columns and, where known, tables) of two platforms; names that both have are matched and left out.

    A pair meets over a column that both read, or by likeness of names: there the left names are a set of queries, broadcast
    in blocks of about ASKED_BLOCK against all right names, with bounds on likeness before likeness itself. None is lost.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        bare = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(F.substring_index(x, ".", -1))))
        tables = bare(F.col("tables")) if "tables" in df.columns else F.array().cast("array<string>")
        return df.select(F.col("name").alias(name), name_key(F.col("name")).alias(f"{name}_key"), bare(F.col("columns")).alias(f"{name}_columns"), tables.alias(f"{name}_tables")).dropDuplicates([name])

    every = {"left": staged(side(left, "left"), "left-names"), "right": staged(side(right, "right"), "right-names")}
    own = {n: staged(every[n].join(every[o].select(F.col(f"{o}_key").alias(f"{n}_key")).distinct(), f"{n}_key", "left_anti"), "unmatched") for n, o in (("left", "right"), ("right", "left"))}
    by_column = {n: own[n].select(n, F.explode(f"{n}_columns").alias("column")) for n in own}
    met = by_column["left"].join(by_column["right"], "column").select("left", "right").distinct()
    keys = {n: own[n].select(n, f"{n}_key") for n in own}
    near = _alike(keys["left"], keys["right"], F.col("left_key"), F.col("right_key"), NAME_LIKENESS).select("left", "right")
    pairs = met.unionByName(near).distinct().join(own["left"], "left").join(own["right"], "right")
    weighed = pairs.withColumn("structure", overlap(F.col("left_columns"), F.col("right_columns"))).withColumn("ratio", likeness(F.col("left_key"), F.col("right_key")))
    named, built = F.col("ratio") >= NAME_LIKENESS, F.col("structure") >= COLUMN_OVERLAP
    basis = F.when(named & built, "both").when(built, "structure").otherwise("name")
    shared = F.arrays_overlap("left_columns", "right_columns") | F.arrays_overlap("left_tables", "right_tables")
    rank = F.when(F.col("basis") == "both", 0).when(F.col("basis") == "structure", 1).otherwise(2)
    found = weighed.filter(named | built).withColumn("basis", basis).withColumn("contradicted", (F.col("basis") == "name") & ~shared).withColumn("similarity", F.round("ratio", 3))
    return found.orderBy("contradicted", rank, F.desc("similarity"), "left", "right").limit(most).select("left", "right", "similarity", "basis", "contradicted")


def _close(least: float):
    def run(names: pd.Series, asked: pd.Series) -> pd.Series:
        matcher, last, found = SequenceMatcher(), None, []
        for x, word in zip(names, asked):
            if word != last:
                matcher.set_seq2(word)
                last = word
            matcher.set_seq1(x)
            # Both quick ratios are never below the ratio.
            close = matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (ratio := matcher.ratio()) >= least
            found.append(ratio if close else None)
        return pd.Series(found, dtype="float64")

    return F.pandas_udf(run, "double")


def _alike(asked: DataFrame, names: DataFrame, one: Column, two: Column, least: float) -> DataFrame:
    """Pairs of asked and names whose texts `one` and `two` have a likeness (ratio) of least or more: asked, a set of queries, is broadcast in blocks."""
    blocks = max(1, -(-asked.count() // ASKED_BLOCK))
    block = F.pmod(F.xxhash64(asked.columns[0]), F.lit(blocks))
    met = reduce(DataFrame.union, [names.join(F.broadcast(asked.filter(block == b)), likeness_bound(one, two) >= least) for b in range(blocks)])
    return met.withColumn("ratio", _close(least)(one, two)).filter(F.col("ratio") >= least)


def did_you_mean(asked: DataFrame, names: DataFrame, most: int = 5, least: float = 0.5) -> DataFrame:
    """(asked, name, similarity): for each asked name the most alike of all names, of equals the last by name.

    Every asked name meets every name: the asked ones are broadcast in blocks of about ASKED_BLOCK.
    """
    a = staged(asked.select(F.col("name").alias("asked")).filter("asked IS NOT NULL").distinct(), "asked")
    n = staged(names.select("name").filter("name IS NOT NULL").distinct(), "names")
    scored = _alike(a, n, F.lower("name"), F.lower("asked"), least).withColumnRenamed("ratio", "similarity")
    nth = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("similarity"), F.desc("name")))
    return scored.withColumn("_nth", nth).filter(F.col("_nth") <= most).select("asked", "name", "similarity")

"""Reading tables and describing them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Relationship


def load(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Parquet tables by name, in full, each also a temporary view."""
    found = {name: spark.read.parquet(path) for name, path in paths.items()}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, under a declared schema."""
    return spark.read.csv(path, header=True, schema=schema)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()])


def harvest(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(table_name, position, column_name, data_type, n_rows) of tables and views in the session's catalog."""
    wanted = {n.lower() for n in names}
    rows = [(t.name, i, c.name, c.dataType) for t in spark.catalog.listTables() if t.name.lower() in wanted for i, c in enumerate(spark.catalog.listColumns(t.name))]
    listed = spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
    return listed.join(counts({n: spark.table(n) for n in names}), "table_name")


def tolerant_json(rows: DataFrame, column: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """rows with the fields of a JSON text column; texts that can't be read, or lack a required field, are skipped."""
    read = rows.withColumn("_read", F.from_json(column, schema, {"mode": "PERMISSIVE"})).select(*rows.columns, "_read.*")
    return reduce(lambda df, c: df.filter(F.col(c).isNotNull()), required, read.filter(F.col(column).isNotNull()))


def profile(table: DataFrame, columns: Sequence[str], exact_upto: int | None = None) -> DataFrame:
    """(column_name, n_distinct, sample) of the columns; the sample is the least value.

    An exact count of distinct values sends every one of them through a shuffle. With exact_upto, one pass keeps an estimate
    and a sketch of the most frequent values for each column, both of bounded size: a column of so many values at most has
    all of them in the sketch and is counted exactly; others have the estimate, or one more than exact_upto, whichever is more.
    """
    if exact_upto is None:
        n = lambda c: F.count_distinct(c)
    else:
        kept = 1 << (2 * exact_upto).bit_length()  # the sketch is exact up to three quarters of this
        few = lambda c: F.size(F.filter(F.call_function("approx_top_k", F.col(c), F.lit(exact_upto + 2), F.lit(kept)), lambda x: x["item"].isNotNull()))
        rough = lambda c: F.approx_count_distinct(c, 0.02)
        # Estimates of so few values are within a few hundredths.
        n = lambda c: F.when(rough(c) <= exact_upto + exact_upto // 4, few(c)).otherwise(F.greatest(rough(c), F.lit(exact_upto + 1))).cast("long")
    aggs = [x for c in columns for x in (n(c).alias(f"n:{c}"), F.min(c).cast("string").alias(f"s:{c}"))]
    whole = table.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`n:{c}`").alias("n_distinct"), F.col(f"`s:{c}`").alias("sample")) for c in columns])
    return whole.select(F.inline(rows))


def manifest(rows: DataFrame, confident: Column, awaiting: Column, gap: Column, kind: str) -> DataFrame:
    """One row of counts over evidence."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(confident).alias("confident"), F.count_if(awaiting).alias("awaiting_review"), F.count_if(gap).alias("gaps"), F.count_distinct(kind).alias("kinds")
    )


def relationship_rows(spark: SparkSession, relationships: Sequence[Relationship]) -> DataFrame:
    rows = [(r.many, r.one, "many to one", r.active, r.both_directions, f"LEFT JOIN {r.one.split('.')[0]} ON {r.many} = {r.one}" if not r.integrity else f"JOIN {r.one.split('.')[0]} ON {r.many} = {r.one}") for r in relationships]
    return spark.createDataFrame(rows, "from_column string, to_column string, cardinality string, active boolean, both_directions boolean, sql_clause string")

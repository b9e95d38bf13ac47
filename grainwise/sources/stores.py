"""Snapshots, decisions and warehouses: what is written and read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
VERDICTS = ("accepted", "rejected", "deferred")
DECISION = "id string, at timestamp, verdict string, by string, fingerprints array<string>"

# JDBC drivers of the warehouses that can be read.
JDBC = {
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}"),
    "databricks": ("com.databricks.client.jdbc.Driver", "jdbc:databricks://{host}"),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}/{database}"),
    "athena": ("com.amazon.athena.jdbc.AthenaDriver", "jdbc:athena://{host}"),
    "derby": ("org.apache.derby.jdbc.EmbeddedDriver", "jdbc:derby:{database}"),
    "duckdb": ("org.duckdb.DuckDBDriver", "jdbc:duckdb:{database}"),
}


def save_snapshot(objects: DataFrame, path: str, label: str) -> None:
    """Objects (id, kind, name, fingerprint, ...) as the snapshot `label`, in a partition of its own."""
    objects.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "label": F.lit(label)}).write.mode("append").partitionBy("label").parquet(path)


def load_snapshot(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The objects of a snapshot; one of another schema version is refused."""
    rows = spark.read.parquet(path).filter(F.col("label") == label)
    other = rows.filter(F.col("schema_version") != SCHEMA_VERSION).select("schema_version").take(1)
    if other:
        raise ValueError(f"snapshot {label!r} has schema version {other[0][0]}; {SCHEMA_VERSION} can be read")
    return rows.drop("schema_version", "label")


def append_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions, without lines that can't be read and verdicts that aren't known."""
    rows = spark.read.text(path).select(F.from_json("value", DECISION, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")
    return rows.filter(F.col("id").isNotNull() & F.col("verdict").isin(*VERDICTS))


def jdbc_options(kind: str, table: str, host: str = "", database: str = "", **more: str) -> dict[str, str]:
    """Options of spark.read.format('jdbc') for a table or a query in brackets; Spark pushes filters and columns down."""
    driver, url = JDBC[kind]
    return {"driver": driver, "url": url.format(host=host, database=database), "dbtable": table, "fetchsize": "10000", **more}


def read_warehouse(spark: SparkSession, kind: str, table: str, key: str | None = None, rows_per_part: int = 1_000_000, **more: str) -> DataFrame:
    """A warehouse's table, or query in brackets with a name. With a key (a number, date or timestamp column) it is read in ranges of the key by as many tasks as its rows need.

    The ranges' ends and the number of rows are asked of the source, in one row. Rows without a key are in the first range; a
    key that all rows share, or an empty table, makes one range. Filters and columns that Spark can push go to the source in
    every range; `pushed` tells which.
    """
    options = jdbc_options(kind, table, **more)
    reader = spark.read.format("jdbc").options(**options)
    if key is None:
        return reader.load()
    ends = spark.read.format("jdbc").options(**{**options, "dbtable": f"(SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH, COUNT(*) AS N FROM {table}) ENDS"}).load().first()
    parts = -(-ends[2] // rows_per_part)
    if parts < 2 or ends[0] == ends[1]:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts)).load()


def pushed(rows: DataFrame) -> tuple[list[str], list[str]]:
    """(filters, columns) that the plan of a JDBC read leaves to the source."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    found = lambda name: re.search(rf"{name}: \[(.*?)\]|{name}: struct<(.*?)>", plan)
    filters, schema = found("PushedFilters"), found("ReadSchema")
    split = lambda m: [x.strip() for x in re.split(r",(?![^(]*\))", (m[1] or m[2] or "") if m else "") if x.strip()]
    return [f.lstrip("*") for f in split(filters)], [c.split(":")[0] for c in split(schema)]


# --- snapshots with digests -----------------------------------------------------------------------------------------

BUCKETS = 256


def save_digested(objects: DataFrame, path: str, label: str, buckets: int = BUCKETS) -> None:
    """Objects (id, kind, fingerprint, ...) as the snapshot `label`, by buckets of the id, with a digest of each bucket and kind beside them.

    A digest is a number of objects and 128 bits of their hashes combined, whatever their order. All snapshots of a path
    must have the same number of buckets.
    """
    rows = objects.withColumns({"label": F.lit(label), "bucket": F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")})
    rows.repartition("bucket").write.mode("append").partitionBy("label", "bucket").parquet(f"{path}/objects")
    each = objects.sparkSession.read.parquet(f"{path}/objects").filter(F.col("label") == label)
    what = ("id", "kind", "fingerprint")
    digests = each.groupBy("bucket", "kind").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*what)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *what)).alias("b"))
    digests.withColumns({"label": F.lit(label), "buckets": F.lit(buckets)}).coalesce(1).write.mode("append").partitionBy("label").parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, path: str, old: str, new: str) -> list[int]:
    """Buckets in which two snapshots differ, by their digests alone; at most all buckets."""
    rows = spark.read.parquet(f"{path}/digests").filter(F.col("label").isin(old, new))
    sizes = [r[0] for r in rows.select("buckets").distinct().collect()]
    if len(sizes) > 1:
        raise ValueError(f"the snapshots have {' and '.join(map(str, sorted(sizes)))} buckets")
    differs = rows.groupBy("bucket", "kind").agg(F.count("*").alias("_sides"), *[F.count_distinct(c).alias(c) for c in ("n", "a", "b")]).filter("_sides < 2 OR n > 1 OR a > 1 OR b > 1" if old != new else "false")
    return sorted(r[0] for r in differs.select("bucket").distinct().collect())


def digested_sides(spark: SparkSession, path: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The objects of two snapshots in the buckets in which they differ; no other files are read."""
    buckets = changed_buckets(spark, path, old, new)
    rows = spark.read.parquet(f"{path}/objects").filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return tuple(rows.filter(F.col("label") == label).drop("label", "bucket") for label in (old, new))

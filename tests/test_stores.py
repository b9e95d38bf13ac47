"""A warehouse read by ranges, against an embedded database; snapshots compared by digests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainwise.plans.catalog import drift
from grainwise.sources import stores

DATABASE = "memory:stores"


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(None if i % 50 == 0 else i * 3, f"r{i % 4}", i / 7, dt.date(2024, 1, 1) + dt.timedelta(days=i % 90)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "ID int, REGION string, PRICE double, DAY date")
    driver, url = stores.JDBC["derby"]
    frame.write.format("jdbc").options(driver=driver, url=url.format(database=f"{DATABASE};create=true"), dbtable="SALES", createTableColumnTypes="REGION VARCHAR(20)").mode("overwrite").save()
    frame.limit(0).write.format("jdbc").options(driver=driver, url=url.format(database=DATABASE), dbtable="NOTHING").mode("overwrite").save()
    return frame


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("column,parts", [("ID", 10), ("DAY", 10), (None, 1)])
def test_ranges(spark, sales, column, parts):
    """All rows once, those without a key too, by as many tasks as asked."""
    read = stores.read_warehouse(spark, "derby", "SALES", column, rows_per_part=100, database=DATABASE)
    assert read.rdd.getNumPartitions() == parts
    assert sorted(map(tuple, read.collect()), key=key) == sorted(map(tuple, sales.collect()), key=key)
    sizes = [r["n"] for r in read.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == parts and max(sizes) <= 1000 if parts == 1 else max(sizes) < 250


def test_pushed(spark, sales):
    """Filters and columns reach the source in each range."""
    read = stores.read_warehouse(spark, "derby", "SALES", "ID", rows_per_part=250, database=DATABASE)
    asked = read.filter((F.col("REGION") == "r1") & (F.col("PRICE") > 20)).select("PRICE")
    filters, columns = stores.pushed(asked)
    assert "EqualTo(REGION,r1)" in filters and "GreaterThan(PRICE,20.0)" in filters and columns == ["PRICE"]
    assert asked.count() == sales.filter("REGION = 'r1' AND PRICE > 20").count()
    query = stores.read_warehouse(spark, "derby", "(SELECT ID, PRICE FROM SALES WHERE REGION = 'r2') Q", "ID", rows_per_part=50, database=DATABASE)
    assert query.rdd.getNumPartitions() == 5 and query.count() == 250


def test_one_range(spark, sales):
    assert stores.read_warehouse(spark, "derby", "NOTHING", "ID", database=DATABASE).count() == 0
    one = stores.read_warehouse(spark, "derby", "(SELECT 5 AS K, PRICE FROM SALES) Q", "K", rows_per_part=10, database=DATABASE)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1000


@pytest.fixture(scope="module")
def snapshots(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("digests") / "own")
    before = spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "concat('k', id % 3) AS kind", "sha2(CAST(id AS STRING), 256) AS fingerprint")
    after = before.filter("id <> '17'").withColumn("fingerprint", F.when(F.col("id") == "99", "new").otherwise(F.col("fingerprint"))).withColumn("kind", F.when(F.col("id") == "5", "k9").otherwise(F.col("kind")))
    after = after.unionByName(spark.createDataFrame([("added", "k1", "x"), (None, "k1", "y")], "id string, kind string, fingerprint string"))
    for label, side in (("a", before), ("b", after), ("c", before.repartition(7))):
        stores.save_digested(side, path, label)
    return path, before, after


def test_digests(spark, snapshots):
    path, before, after = snapshots
    rows = lambda df: sorted(map(tuple, df.select("id", "kind", "status", "old_fingerprint", "new_fingerprint").collect()), key=key)
    want = rows(drift.diff(before, after).filter("status <> 'unchanged'"))
    assert rows(drift.changes_between(spark, path, "a", "b")) == want and len(want) == 4
    assert drift.changes_between(spark, path, "a", "c").count() == 0 and stores.changed_buckets(spark, path, "a", "a") == []
    assert all(s == "added" for _, _, s, *_ in rows(drift.changes_between(spark, path, "nothing", "a")))


def test_only_changed_buckets_are_read(spark, snapshots):
    path, *_ = snapshots
    buckets = stores.changed_buckets(spark, path, "a", "b")
    assert 1 <= len(buckets) <= 5
    one, two = stores.digested_sides(spark, path, "a", "b")
    files = {f for side in (one, two) for f in side.inputFiles() if "bucket=" in f}
    read = {r["f"] for r in one.unionByName(two).select(F.input_file_name().alias("f")).distinct().collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= set(buckets) and len(read) <= 2 * len(buckets) < len(files) + 1
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()


def test_other_buckets_are_refused(spark, snapshots):
    path, before, _ = snapshots
    stores.save_digested(before, path, "few", buckets=8)
    with pytest.raises(ValueError, match="8 and 256 buckets"):
        stores.changed_buckets(spark, path, "a", "few")

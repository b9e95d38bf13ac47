"""Streams give what the batch gives."""

import time

from pyspark.sql import functions as F

from grainwise.queries._base import table
from grainwise.queries.shaping import st_quota, st_quota_batch, st_tumbling
from grainwise.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_quota(spark, sf_dir):
    stream, batch = rows(st_quota(spark, sf_dir)), rows(st_quota_batch(spark, sf_dir))
    assert stream == batch and len(batch) == table(spark, sf_dir, "events").count()


def test_tumbling(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    batch = jobs.closed(jobs.tumbling(events), events)
    batch = batch.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    assert rows(st_tumbling(spark, sf_dir)) == rows(batch)


def test_quota_window_starts_at_the_first_request(spark):
    times = [0, 10, 20, 30, 3599, 3600, 3601, 9000]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "client long, request long, t long").withColumn("ts", F.timestamp_seconds("t"))
    found = {r["request"]: r["allowed"] for r in jobs.quota_batch(df, limit=3, seconds=3600).collect()}
    assert found == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}


def test_quota_state_goes_from_batch_to_batch(spark, tmp_path):
    df = spark.range(300).selectExpr("id % 7 AS client", "id AS request", "timestamp_seconds(id * 97) AS ts")
    for n in range(3):
        df.filter(f"request >= {n * 100} AND request < {n * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = jobs.quota_stream(stream, limit=2, seconds=7000)
    assert rows(found) == rows(jobs.quota_batch(df, limit=2, seconds=7000))
    assert {r["allowed"] for r in found.collect()} == {True, False}


def requests_in_batches(spark, tmp_path, *batches):
    """A stream of one batch for each list of (client, request, seconds)."""
    schema = "client long, request long, t long"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken in order of their times
    return spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("client", "request", "ts")


def test_quota_of_requests_out_of_order(spark, tmp_path):
    """Each batch brings requests before those of the batch before: answers change, and end as in one batch."""
    batches = [[(c, 1000 * c + 100 * n + i, 50_000 + (2 - n) * 1500 + i * 700 + c) for c in range(3) for i in range(6)] for n in range(3)]
    found = rows(jobs.quota_stream(requests_in_batches(spark, tmp_path, *batches), limit=3, seconds=3600))
    everything = spark.createDataFrame(sum(batches, []), "client long, request long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert found == rows(jobs.quota_batch(everything, limit=3, seconds=3600))
    first = spark.createDataFrame(batches[0], "client long, request long, t long").withColumn("ts", F.timestamp_seconds("t"))
    early = set(rows(jobs.quota_batch(first, limit=3, seconds=3600)))
    assert early - set(found)  # some answer did change


def test_quota_drops_what_is_too_late(spark, tmp_path):
    batches = [[(1, 1, 100_000)], [(1, 2, 103_000), (1, 3, 99_500)], [(1, 4, 101_000), (1, 5, 10_000)], [(1, 6, 200_000)]]
    found = {r["request"]: r["allowed"] for r in jobs.quota_stream(requests_in_batches(spark, tmp_path, *batches), limit=2, seconds=5000, late="1 hour").collect()}
    # 5 comes a day behind; the window begins at 3, which came after 1, then 1; 4 and 2 are beyond the limit.
    assert found == {1: True, 2: False, 3: True, 4: False, 6: True}


def test_quota_state_ends(spark, tmp_path):
    """State of clients that the watermark has left behind is gone; what they ask then is allowed anew."""
    batches = [[(c, 10 * c + i, 1000 + i) for c in range(20) for i in range(4)], [(100, 900, 50_000)], [(100, 901, 90_000)], [(c, 10 * c + 5, 90_500) for c in range(3)], [(100, 902, 91_000)]]
    path = str(tmp_path / "run")
    found = jobs.quota_stream(requests_in_batches(spark, tmp_path, *batches), limit=3, seconds=3600, late="10 minutes", path=path)
    answers = {r["request"]: r["allowed"] for r in found.collect()}
    assert len(answers) == 86 and not any(answers[10 * c + 3] for c in range(20)) and all(answers[10 * c + 5] for c in range(3))
    left = spark.read.format("statestore").option("stateVarName", "recent").load(f"{path}/state")
    assert {r[0] for r in left.select("key.client").collect()} <= {0, 1, 2, 100}

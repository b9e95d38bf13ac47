"""Streaming forms: figures over tumbling periods, standing of decisions, quotas of clients."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.staging import new_path


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over all that is there now, and read what was written."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of windows of a width; rows later than `late` are dropped in a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def closed(windows: DataFrame, events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Batch windows that a stream's append mode has given out: those that end by the last time less the lateness."""
    mark = events.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("_mark"))
    return windows.crossJoin(mark).filter(F.col("start") + F.expr(f"INTERVAL {width}") <= F.col("_mark")).drop("_mark")  # one row


def standing_stream(decisions: DataFrame, name: str = "standing") -> DataFrame:
    """(id, verdict): the last decision (id, at, verdict) of each id, kept up by update mode and foreachBatch."""
    spark = decisions.sparkSession
    path = new_path(spark, name)
    last = decisions.groupBy("id").agg(F.max(F.struct("at", "verdict")).alias("d")).select("id", "d.at", "d.verdict")
    last.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy("id").agg(F.max_by("verdict", "at").alias("verdict"))


_QUOTA = "client long, request long, allowed boolean"


def _admit(limit: int, micros: int):
    """Admissions from rows sorted by (client, ts, request).

    A client's window starts at the first request after the window before. One window and count are carried from batch to
    batch, whatever the number of a client's requests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, start, used, first = None, None, 0, True
        for batch in batches:
            allowed = []
            for whose, ts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if first or whose != client or ts >= start + micros:
                    client, start, used, first = whose, ts, 0, False
                used += 1
                allowed.append(used <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], ["client", "request", "allowed"])

    return run


def quota_batch(requests: DataFrame, limit: int = 3, seconds: int = 3600) -> DataFrame:
    """(client, request, allowed) of requests (client, request, ts); null times are dropped."""
    rows = requests.filter("ts IS NOT NULL").select("client", "request", F.unix_micros("ts").alias("ts"))
    return rows.repartition("client").sortWithinPartitions("client", "ts", "request").mapInArrow(_admit(limit, seconds * 1_000_000), _QUOTA)


#: A stream's first watermark is 1970, which would drop what is older; clocks here are a century ahead.
_CLOCK_DAYS = 36_525
_CLOCK_MS = _CLOCK_DAYS * 86_400_000


class QuotaProcessor(StatefulProcessor):
    """A client's quota in event time.

    State: `settled`, the window and count as of the watermark; `recent`, the requests after it, which late ones may still
    precede. New and recent requests are admitted anew in order of time, and those whose answer is new or has changed are
    given out. What the watermark has passed is settled. A timer at the end of the client's last window clears its state.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.micros = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "start long, used long")
        self.recent = handle.getListState("recent", "ts long, request long, allowed boolean")

    def _admit(self, ts: int, start: int | None, used: int) -> tuple[int, int]:
        return (ts, 1) if start is None or ts >= start + self.micros else (start, used + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = (timerValues.getCurrentWatermarkInMs() - _CLOCK_MS) * 1000
        known = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        new = [(int(t), int(r), None) for frame in rows for t, r in zip(frame["ts_micros"], frame["request"])]
        start, used = self.settled.get() if self.settled.exists() else (None, 0)
        settled, left, out = (start, used), [], []
        for ts, request, said in sorted(known + new, key=lambda r: r[:2]):
            start, used = self._admit(ts, start, used)
            allowed = used <= self.limit
            if allowed != said:
                out.append((request, allowed))
            if ts <= mark:
                settled = (start, used)
            else:
                left.append((ts, request, allowed))
        if settled[0] is not None:
            self.settled.update(settled)
        if left:
            self.recent.put(left)
        elif self.recent.exists():
            self.recent.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if start is not None:
            self.handle.registerTimer(-(-(start + self.micros) // 1000) + _CLOCK_MS)
        yield pd.DataFrame({"client": [key[0]] * len(out), "request": [r for r, _ in out], "allowed": [a for _, a in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is past the client's last window, so whatever it asks next begins a new one."""
        self.settled.clear()
        self.recent.clear()
        yield pd.DataFrame({"client": pd.Series([], dtype="int64"), "request": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool")})


_STORE = "spark.sql.streaming.stateStore.providerClass"


def quota_stream(requests: DataFrame, name: str = "quota", limit: int = 3, seconds: int = 3600, late: str = "1 day", path: str | None = None) -> DataFrame:
    """(client, request, allowed) of a stream of requests (client, request, ts), over all that is there now.

    Requests may come in any order, up to `late` behind the latest seen before their batch; later ones are dropped and have
    no answer. Answers are those of quota_batch over the requests that count: one that a late request has changed is given
    out again, and the last holds. State lives in RocksDB and the checkpoint under path; a batch that is run again overwrites
    its own answers. A null client is a client; null times are dropped.
    """
    spark = requests.sparkSession
    path = path or new_path(spark, name)
    clock = F.col("ts") + F.expr(f"INTERVAL '{_CLOCK_DAYS}' DAY")
    timed = requests.filter("ts IS NOT NULL").select("client", "request", F.unix_micros("ts").alias("ts_micros"), clock.alias("clock")).withWatermark("clock", late)
    answers = timed.groupBy("client").transformWithStateInPandas(QuotaProcessor(limit, seconds), "client long, request long, allowed boolean", "Update", "EventTime")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        answers.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    found = spark.read.schema("client long, request long, allowed boolean, batch long").parquet(f"{path}/out")
    return found.groupBy("client", "request").agg(F.max_by("allowed", "batch").alias("allowed"))

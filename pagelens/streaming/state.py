"""Streaming forms of the time-bounded operations. State is bounded by watermarks or time-outs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelens.operators.groups import folder


def progress_batches(items: DataFrame, key: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: what a receiver adds of overlapping batches."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def replayed(rows: DataFrame, every: str | None = None):
    """A stream's rows as a table in the cluster's folder: all that there are now, or with `every` (as "1500 milliseconds") the running query that adds them at that pace."""
    spark = rows.sparkSession
    place = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/rows")
    if every:
        return writer.trigger(processingTime=every).start()
    done = writer.trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


def request_pairs(requests: DataFrame, responses: DataFrame, key: str = "request_id", within: str = "60 seconds") -> DataFrame:
    """Requests joined with their responses within the time, a key once while the watermark remembers it; pending ones expire with the watermark."""
    a = requests.withWatermark("ts", within).alias("a")
    b = responses.withWatermark("ts", within).alias("b")
    on = F.expr(f"a.{key} = b.{key} AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {within}")
    return a.join(b, on).select(f"a.{key}", F.col("a.ts").alias("ts"), F.col("b.ts").alias("response_ts")).dropDuplicatesWithinWatermark([key])


def without_stopped(batches: DataFrame, stops: DataFrame, memory: str = "10 minutes") -> DataFrame:
    """Batches (scan_id, ts) that no earlier stop (scan_id, stopped_at) of their scan forbids."""
    a = batches.withWatermark("ts", memory).alias("a")
    b = stops.withWatermark("stopped_at", memory).alias("b")
    on = F.expr(f"a.scan_id = b.scan_id AND a.ts >= b.stopped_at AND a.ts <= b.stopped_at + INTERVAL {memory}")
    return a.join(b, on, "left_outer").where("b.scan_id is null").select("a.*")


def bursts(events: DataFrame, key: str, at: str = "ts", quiet: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last event time and number of events of each burst."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, quiet)).agg(F.max(at).alias("last_event"), F.count("*").alias("events"))


def ttl_cache(events: DataFrame, key: str, at: str = "ts", ttl_ms: int = 30 * 60 * 1000, late: str = "1 minute") -> DataFrame:
    """(key, last_touch, touches, live): a row for each update of a key, and one that isn't live when its time to live ends."""

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_touch": [pd.Timestamp(last, unit="ms")], "touches": [n], "live": [False]})
            return
        last, n = state.get if state.exists else (0, 0)
        for part in rows:
            times = part[at].astype("datetime64[ms]").astype("int64")
            last, n = max(last, int(times.max())), n + len(part)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "last_touch": [pd.Timestamp(last, unit="ms")], "touches": [n], "live": [True]})

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_touch timestamp, touches long, live boolean", "last long, touches long", "append", GroupStateTimeout.EventTimeTimeout)


def circuit_breaker(attempts: DataFrame, key: str, at: str = "ts", failures: int = 2, block_ms: int = 300_000, late: str = "1 minute") -> DataFrame:
    """(key, ts, blocked) of attempts (key, ts, failed): the rule of the batch form; state is dropped a block's length after the last attempt."""

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, 0)
        log = pd.concat(list(rows)).sort_values(at, kind="stable")
        times = log[at].astype("datetime64[ms]").astype("int64")
        out = []
        for t, bad in zip(times, log["failed"], strict=True):
            if until and until <= t:
                count, until = 0, 0
            out.append(bool(until))
            if not until:
                count = count + 1 if bad else 0
                until = t + block_ms if count >= failures else 0
        state.update((count, until))
        state.setTimeoutTimestamp(max(int(times.max()) + block_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(log), "ts": log[at].values, "blocked": out})

    kind = attempts.schema[key].dataType.simpleString()
    return attempts.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, blocked boolean", "failures int, until long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(stream: DataFrame, path: str, key: list[str], checkpoint: str):
    """Writes a keyed table: each micro-batch adds the rows whose key the table lacks (exactly once by batch number)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        if number and spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            seen = spark.read.parquet(path).where(F.col("batch") < number).select(*key)
            rows = rows.join(seen, key, "left_anti")
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

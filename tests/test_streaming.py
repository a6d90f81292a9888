from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagelens.operators import timed
from pagelens.streaming import state

T0 = datetime(2024, 1, 1)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"select * from {name}")


@pytest.fixture
def attempts(spark, tmp_path):
    rows = [("h", T0 + timedelta(seconds=s), f) for s, f in ((0, True), (1, True), (2, False), (400, False), (401, True))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, failed boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_breaker_agrees_with_batch(spark, attempts):
    batch, stream = attempts
    got = run(state.circuit_breaker(stream, "k"), "breaker").orderBy("ts").collect()
    log = batch.select("k", F.col("ts").cast("timestamp_ntz").alias("ts"), "failed").withColumn("i", F.lit(0))
    expected = timed.circuit_breaker(log, "k", "ts", "i", "failed").orderBy("ts").collect()
    assert [r.blocked for r in got] == [r.blocked for r in expected]


def test_ttl_cache_agrees_with_batch(spark, attempts):
    batch, stream = attempts
    got = run(state.ttl_cache(stream, "k"), "ttl").where("live").first()
    last = timed.live_entries(batch, ["k"], "ts", T0 + timedelta(seconds=500), 1800).first()
    assert (got.last_touch, got.touches) == (last.last_touch, last.touches)


def test_bursts_and_deduplication(spark, attempts):
    _, stream = attempts
    assert run(state.bursts(stream, "k", quiet="10 seconds"), "bursts", "append").collect()[0].events == 3
    assert run(state.progress_batches(stream, ["k"], "ts"), "once").count() == 1


def test_upsert_batches(spark, attempts, tmp_path):
    _, stream = attempts
    q = state.upsert_batches(stream, str(tmp_path / "table"), ["failed"], str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2

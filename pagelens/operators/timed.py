"""Time-bounded operations on logs, in batch form; the streaming forms give the same on a replayed log."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _seconds(n: float) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {n})")


def live_entries(log: DataFrame, key: list[str], at: str, now, ttl: float) -> DataFrame:
    """Keys with their last touch, if it is no older than the time to live (seconds) at `now`."""
    last = log.groupBy(*key).agg(F.max(at).alias("last_touch"), F.count("*").alias("touches"))
    return last.where(F.col("last_touch") >= F.lit(now) - _seconds(ttl))


def recent_values(log: DataFrame, key: str, value: str, at: str, tie: str, now, ttl: float, most: int) -> DataFrame:
    """The last value of each key, if young enough, for the `most` keys touched last."""
    last = log.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value), F.max(at).alias("last_touch"))
    return last.where(F.col("last_touch") >= F.lit(now) - _seconds(ttl)).orderBy(F.desc("last_touch"), key).limit(most)


def within_budget(entries: DataFrame, group: list[str], at: str, tie: str, size: Column, most_bytes: int, most_rows: int) -> DataFrame:
    """The youngest entries of each group that fit both budgets; the first that doesn't fit ends it."""
    w = Window.partitionBy(*group).orderBy(F.desc(at), F.desc(tie))
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("total_size", total).withColumn("rank", F.row_number().over(w)).where((F.col("total_size") <= most_bytes) & (F.col("rank") <= most_rows))


def debounced(log: DataFrame, key: str, at: str, tie: str, quiet: float, value: str) -> DataFrame:
    """The last event of each burst (gaps of `quiet` seconds end one), unless its value is the one sent before."""
    w = Window.partitionBy(key).orderBy(at, tie)
    last = log.withColumn("_next", F.lead(at).over(w)).where(F.col("_next").isNull() | (F.col("_next") >= F.col(at) + _seconds(quiet))).drop("_next")
    return last.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def request_pairs(requests: DataFrame, responses: DataFrame, key: list[str], seconds: float) -> DataFrame:
    """Requests with the response of the same key that follows within the time, at most once each.

    A later request replaces the one that waits, and a response takes it away; so
    a request's response is the event of its key next to it. `ts` orders both
    sides; a response at a request's time follows it.
    """
    kept = [c for c in responses.columns if c not in (*key, "ts")]
    a = requests.select(*key, "ts", F.lit(0).alias("side"), F.struct(*requests.columns).alias("request"))
    b = responses.select(*key, "ts", F.lit(1).alias("side"), F.struct(*kept, F.col("ts").alias("response_ts")).alias("response"))
    w = Window.partitionBy(*key).orderBy("ts", "side")
    paired = a.unionByName(b, allowMissingColumns=True).withColumn("request", F.lag("request").over(w)).where("side = 1 and request is not null")
    paired = paired.select("request.*", "response.*")
    return paired.where(F.col("response_ts") <= F.col("ts") + _seconds(seconds))


def _sequential(log: DataFrame, key: str, at: str, tie: str, step, schema: str) -> DataFrame:
    """step(rows of one key in order) for rules that depend on the whole past; a key's log fits in one task."""
    return log.groupBy(key).applyInPandas(lambda rows: step(rows.sort_values([at, tie], kind="stable")), schema)


def circuit_breaker(log: DataFrame, key: str, at: str, tie: str, failed: str, failures: int = 2, block: float = 300.0) -> DataFrame:
    """(key, tie, at, blocked): whether an attempt met a blocked key. So many failures block it for the time; a success or the end of it resets."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        count, until, out = 0, None, []
        for t, bad in zip(rows[at], rows[failed], strict=True):
            if until is not None and until <= t:
                count, until = 0, None
            blocked = until is not None and until > t
            out.append(blocked)
            if blocked:
                continue
            if bad:
                count += 1
                if count >= failures:
                    until = t + timedelta(seconds=block)
            else:
                count, until = 0, None
        return pd.DataFrame({key: rows[key], tie: rows[tie], at: rows[at], "blocked": out})

    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    return _sequential(log, key, at, tie, step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {at} {kinds[at]}, blocked boolean")


def throttled(log: DataFrame, key: str, at: str, tie: str, delay: float, ignore: float) -> DataFrame:
    """(key, tie, at, fires_at): events that start a timer; others while it runs, or for `ignore` seconds after it fires, are merged into it."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        free, keep, fires = None, [], []
        for i, t in zip(rows.index, rows[at], strict=True):
            if free is None or t >= free:
                fire = t + timedelta(seconds=delay)
                keep.append(i), fires.append(fire)
                free = fire + timedelta(seconds=ignore)
        kept = rows.loc[keep]
        return pd.DataFrame({key: kept[key], tie: kept[tie], at: kept[at], "fires_at": pd.to_datetime(pd.Series(fires, index=kept.index, dtype="datetime64[us]"))})

    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    return _sequential(log, key, at, tie, step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {at} {kinds[at]}, fires_at {kinds[at]}")


def by_distance(log: DataFrame, key: str, at: str, tie: str, position: str, distance: float, gap: float) -> DataFrame:
    """(key, tie, at, carried): events at which the distance scrolled reaches the threshold, with a least gap; the remainder is carried."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        last = run = None
        total, keep, carried = 0.0, [], []
        for i, t, y in zip(rows.index, rows[at], rows[position], strict=True):
            total += 0.0 if last is None else abs(y - last)
            last = y
            if total >= distance and (run is None or t - run >= timedelta(seconds=gap)):
                total, run = total % distance, t
                keep.append(i), carried.append(total)
        kept = rows.loc[keep]
        return pd.DataFrame({key: kept[key], tie: kept[tie], at: kept[at], "carried": carried})

    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    return _sequential(log, key, at, tie, step, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {at} {kinds[at]}, carried double")


def first_success(attempts: DataFrame, key: list[str], ok: str, at: str, response: str) -> DataFrame:
    """The response of the first attempt that succeeded; null where all failed."""
    return attempts.groupBy(*key).agg(F.min_by(F.when(F.col(ok), F.col(response)), F.when(F.col(ok), F.col(at))).alias(response), F.bool_or(ok).alias("succeeded"))


def retry_delays(attempt: Column, base: float = 0.5) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)

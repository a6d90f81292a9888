"""Duplicate groups: by equal hash, and transitive groups of confirmed pairs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_status(df: DataFrame, key: str, order: list) -> DataFrame:
    """Columns canonical_id and status: the first row of a hash (ids are unique) is NEW, all others DUP.

    The first is a minimum, which combines before the shuffle; a window would
    bring all rows of a frequent hash to one task.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min_by("id", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("canonical_id"))
    found = df.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return found.withColumn("status", F.when(F.col("id") == F.col("canonical_id"), "NEW").otherwise("DUP"))


def hash_groups(df: DataFrame, key: str, layer: str) -> DataFrame:
    """Groups of two or more ids with one hash: group_id, representative, members in order."""
    out = df.groupBy(key).agg(F.min("id").alias("representative_id"), F.array_sort(F.collect_set("id")).alias("member_ids"))
    return out.where(F.size("member_ids") > 1).select(F.concat(F.lit(f"{layer.lower()}:"), key).alias("group_id"), "representative_id", "member_ids")


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local folder only where none is set and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of pairs (a, b): the smallest node that pairs reach.

    Each round a node takes the smallest label among its neighbours and then its
    label's label; rounds are checkpointed in the cluster's folder.
    """
    folder(edges.sparkSession)
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct().checkpoint()
    label = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")).select(F.col("x").alias("node"), "l").checkpoint()
    for _ in range(most_rounds):
        near = both.join(label, both.y == label.node).groupBy("x").agg(F.min("l").alias("m"))
        hop = label.join(near, label.node == near.x).select("node", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = label.select(F.col("node").alias("n2"), F.col("l").alias("l2"))
        new = hop.join(jump, hop.l == jump.n2, "left").select("node", F.least("l", F.coalesce("l2", "l")).alias("l"), "was").checkpoint()
        label = new.select("node", "l")
        if not new.where("l <> was").limit(1).count():
            return label.select("node", F.col("l").alias("component"))
    raise RuntimeError("components did not settle")

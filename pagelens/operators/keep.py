"""Keyed deduplication: one row of each key stays, by declared orders (never by arrival)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; dropDuplicates() alone wouldn't say which."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def keep_best(df: DataFrame, key: list[str], quality: list[Column], position: Column, at_first: bool = True) -> DataFrame:
    """The greatest row by the quality columns, of equals the first. With at_first, column `position` is its key's first position, else the row's own."""
    best = F.struct(*(q.alias(f"q{i}") for i, q in enumerate(quality)), (-position).alias("p"))
    agg = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), best).alias("_row"), F.min(position).alias("_first"))
    own = agg.select("_row.*", "_first")
    return own.withColumn("position", F.col("_first") if at_first else position).drop("_first")


def keep_latest(df: DataFrame, key: list[str], at: Column, position: Column) -> DataFrame:
    """The row with the greatest time; of equals the first."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(at.alias("t"), (-position).alias("p"))).alias("_row")).select("_row.*")


def keep_preferred(df: DataFrame, key: list[str], score: Column, label: Column, position: Column) -> DataFrame:
    """The highest score, then the first label without case, then the first row."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct((-score).alias("s"), F.lower(label).alias("l"), position.alias("p"))).alias("_row")).select("_row.*")


def dedupe_key(kind: Column, source: Column, file_name: Column, content_hash: Column, source_id: Column, url: Column, raw_url: Column, dom_order: Column) -> Column:
    """The first of: source and file, content hash, source id, canvas name, URL, raw URL, file name, place."""

    def some(c: Column) -> Column:
        return c.isNotNull() & (c != "")

    drawn = kind.isin("canvas", "svg")
    return F.coalesce(
        F.when(~drawn & some(source) & some(file_name), F.concat(source, F.lit("::"), file_name)),
        F.when(some(content_hash), F.concat(F.lit("hash:"), content_hash)),
        F.when(some(source_id), F.concat(F.lit("id:"), source_id)),
        F.when((kind == "canvas") & some(file_name), F.concat(F.lit("canvas:"), file_name)),
        F.when(some(url), F.concat(F.lit("url:"), url)),
        F.when(some(raw_url), F.concat(F.lit("raw:"), raw_url)),
        F.when(some(file_name), F.concat(F.lit("name:"), file_name)),
        F.concat(F.lit("dom:"), dom_order.cast("string")),
    )


def append_unseen(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti"))


def persistent_union(current: DataFrame, before: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Current rows and those earlier ones whose kind outlives a scan."""
    return current.unionByName(before.where(F.col("kind").isin(*kinds)))


def without_keys(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key isn't among those to delete."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def only_valid(registry: DataFrame, valid: DataFrame, key: list[str]) -> DataFrame:
    """The registry without keys that are no longer valid."""
    return registry.join(valid.select(*key).distinct(), key, "left_semi")


def united(lists: list[DataFrame], column: str) -> DataFrame:
    """The distinct values, trimmed and without case, of several lists."""
    out = lists[0].select(column)
    for more in lists[1:]:
        out = out.unionByName(more.select(column))
    return out.select(F.lower(F.trim(column)).alias(column)).where(F.col(column) != "").distinct()

"""Captured assets: collectors and logs as sources, guards, registries and download jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelens.functions import urls

LEAST_BYTES, MOST_BYTES = 10, 10 << 20
_IMAGE_NAME = r"(?i)\.(png|jpe?g|gif|webp|svg|avif|bmp|ico|cur)($|\?)"


def wanted(kind: Column, kinds: list[str]) -> Column:
    """Whether a kind is among those asked for; none asked for means all."""
    return kind.isin(*kinds) if kinds else F.lit(True)


def is_image(content_type: Column, url: Column) -> Column:
    """By content type; without one by the URL's data type or file name."""
    none = F.coalesce(content_type, F.lit("")) == ""
    by_type = F.coalesce(content_type, F.lit("")).rlike(r"(?i)^image/|svg\+xml")
    return by_type | (none & F.coalesce(url.startswith("data:image/") | url.rlike(_IMAGE_NAME), F.lit(False)))


def fits(content: Column, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> Column:
    """Whether a content's size is within the guards; a null isn't."""
    return F.coalesce(F.octet_length(content).between(least, most), F.lit(False))


def embed_images(elements: DataFrame, hosts: tuple[str, ...], scanned: int = 200) -> DataFrame:
    """(page_id, url, width_hint) of a page's first elements (page_id, pos, url, width_hint) on the hosts: the largest hint of each URL."""
    w = Window.partitionBy("page_id").orderBy("pos")
    seen = elements.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= scanned)
    host = urls.host(F.col("url"))
    allowed = reduce(lambda a, b: a | b, (urls.matches_domain(host, h) for h in hosts))
    return seen.where(allowed).groupBy("page_id", "url").agg(F.max("width_hint").alias("width_hint"))


def canvas_names(canvases: DataFrame, group: str, content: str, position: str) -> DataFrame:
    """Column `name`: equal contents of a group share the number of their first place among its contents."""
    first = canvases.groupBy(group, content).agg(F.min(position).alias("first"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("first")).cast("string")
    named = first.select(F.col(group).alias("g"), F.col(content).alias("c"), F.concat(F.lit("Canvas_"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0"))).alias("name"))
    return canvases.join(named, F.col(group).eqNullSafe(F.col("g")) & F.col(content).eqNullSafe(F.col("c"))).drop("g", "c")


def swept(collectors: list[DataFrame], key: list[str], position: str) -> DataFrame:
    """The collectors' rows in their fixed order, the first of each key kept; column `collector` says whose it is."""
    every = reduce(DataFrame.unionByName, (c.withColumn("collector", F.lit(i)) for i, c in enumerate(collectors)))
    kept = every.groupBy(*key).agg(F.min_by(F.struct(*every.columns), F.struct("collector", position)).alias("row"))
    return kept.select("row.*")


def blob_registry(log: DataFrame) -> DataFrame:
    """(url, op, size, created_at, revoked) from (url, op, size, at, seq): what made a URL last, and whether it was revoked since."""
    at = F.struct("at", "seq")
    made = F.col("op") != "revoke"
    last = log.groupBy("url").agg(F.max_by(F.struct("op", "size", F.col("at").alias("created_at")), F.when(made, at)).alias("x"), F.max(F.when(made, at)).alias("m"), F.max(F.when(~made, at)).alias("r"))
    return last.where("m is not null").select("url", "x.*", F.coalesce(F.col("r") > F.col("m"), F.lit(False)).alias("revoked"))


def pruned(registry: DataFrame, now: Column, aggressive: bool = False, age: float = 300.0, revoked_age: float = 30.0, most_bytes: int = 50 << 20, most_rows: int = 600) -> DataFrame:
    """Registry entries (url, created_at, size, revoked) that stay: young ones, and of those the youngest that fit both budgets.

    The oldest go first, one by one, until the rest fits, so the first that doesn't fit ends it.
    """
    old = F.timestamp_diff("MICROSECOND", "created_at", now) / 1e6
    young = registry.where(~((old > age) | (F.col("revoked") & (old > revoked_age)) | (F.lit(aggressive) & (old > age * 0.5))))
    # a registry is one tab's and bounded by what a page makes in five minutes
    w = Window.orderBy(F.desc("created_at"), F.desc("url")).rowsBetween(Window.unboundedPreceding, 0)
    return young.withColumn("kept_bytes", F.sum("size").over(w)).withColumn("kept_rows", F.count("*").over(w)).where((F.col("kept_bytes") <= most_bytes) & (F.col("kept_rows") <= most_rows))


def finished_requests(log: DataFrame, key: list[str], at: str, tie: str, kind: str, status: str, seconds: float) -> DataFrame:
    """Each finish with the response that is its key's pending one: (key, response, finish) as the tie column's values, at most once.

    `kind` is response, finished or failed. A response replaces the pending one;
    a finish or a failure takes it away; it expires after the time. So a finish
    has a response only if that is the event before it: no range join, one sort.
    """
    w = Window.partitionBy(*key).orderBy(at, tie)
    before = F.lag(F.struct(kind, status, at, tie)).over(w)
    paired = log.withColumn("before", before).where((F.col(kind) == "finished") & (F.col(f"before.{kind}") == "response"))
    fresh = F.timestamp_diff("MICROSECOND", F.col(f"before.{at}"), F.col(at)) <= seconds * 1e6
    return paired.where(fresh & F.col(f"before.{status}").between(200, 399)).select(*key, F.col(f"before.{tie}").alias("response"), F.col(tie).alias("finish"))


def with_fallback(first: DataFrame, fallback: DataFrame, attached: DataFrame, tab: str, key: list[str], position: str) -> DataFrame:
    """The first path's captures, and the fallback's of tabs that the first isn't attached to; the first of each key."""
    return swept([first, fallback.join(attached.select(tab).distinct(), tab, "left_anti")], key, position)


def once_in_flight(requests: DataFrame, tab: str, url: Column, at: str, tie: str, seconds: float) -> DataFrame:
    """Requests that start work: an equal URL of the tab (as `url` normalises it) within the time of the last request before it waits for that."""
    named = requests.withColumn("in_flight", url)
    w = Window.partitionBy(tab, "in_flight").orderBy(at, tie)
    idle = F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) >= seconds * 1e6
    return named.withColumn("starts", F.coalesce(idle, F.lit(True))).where("starts").drop("starts")


def queue_order(jobs: DataFrame, queue: str, priority: str, sequence: str) -> DataFrame:
    """Column `place`: higher priorities first, first come first served inside one."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy(queue).orderBy(F.desc(priority), sequence)))


def job_outcomes(attempts: DataFrame, key: list[str], number: str, ok: str, most: int = 3, base: float = 0.35) -> DataFrame:
    """A task's outcome from its attempts (numbered from 1): attempts made, seconds waited between them (doubling), and whether one succeeded in time."""
    first_ok = F.min(F.when(F.col(ok), F.col(number)))
    made = attempts.groupBy(*key).agg(first_ok.alias("first_ok"), F.max(number).alias("last"))
    done = F.coalesce(F.col("first_ok") <= most, F.lit(False))
    tries = F.when(done, F.col("first_ok")).otherwise(F.least(F.col("last"), F.lit(most)))
    return made.select(*key, done.alias("done"), tries.cast("int").alias("tries"), F.round(F.lit(base) * (F.pow(F.lit(2.0), tries - 1) - 1), 6).alias("waited"))


def job_entries(items: DataFrame, job: str, position: str, name: Column, workers: int = 4) -> DataFrame:
    """Columns entry (a number of the job's width, then the name) and worker: entries keep their order whichever worker is first."""
    w = Window.partitionBy(job)
    n = F.row_number().over(w.orderBy(position))
    width = F.greatest(F.lit(3), F.length(F.count(F.lit(1)).over(w).cast("string")))
    return items.withColumn("entry", F.concat(F.lpad(n.cast("string"), width, F.lit("0")), F.lit("_"), name)).withColumn("worker", ((n - 1) % workers).cast("int"))


def episode_url(url: Column) -> Column:
    """Whether a URL's path or query is an episode's."""
    path = F.lower(urls.path(url))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return path.rlike(r"/(episode|viewer)/") | query.rlike(r"(^|&)(episode|content|cid)(=|&|$)") | (path.endswith(".json") & path.contains("episode"))


def or_else(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in candidates))


def chapters(rows: DataFrame, group: str, position: str) -> DataFrame:
    """(group, id, title, url) of chapter records with id, url, href, title and name, each by its first value that isn't empty; numbered where none is."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(position)).cast("string")
    ident = or_else(F.col("id"), F.col("url"), F.col("href"), F.concat(F.lit("chapter-"), n))
    link = or_else(F.col("url"), F.col("href"), ident)
    return rows.select(group, position, ident.alias("id"), or_else(F.col("title"), F.col("name"), F.concat(F.lit("Chapter "), n)).alias("title"), F.when(link.rlike("^https?://"), link).alias("url"))

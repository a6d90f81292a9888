"""Lookup joins: hosts to catalogue entries, aliases, keywords, hashes within a distance, validity in time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import imaging, urls
from pagelens.operators import groups

# Endings and beginnings of class names that overlays use.
OVERLAY_SUFFIXES = ("-overlay", "-wrapper", "-mask", "-cover", "-scrim", "-dimmer", "-veil", "-curtain", "-shield", "-guard", "-blocker", "-backdrop", "-pane", "-layer", "-modal", "-popup", "-banner", "-shade")
OVERLAY_PREFIXES = ("overlay-", "modal-", "popup-", "paywall-", "cookie-", "consent-", "backdrop-", "mask-", "cover-", "shield-", "blocker-", "cdk-overlay")

#: Ids with equal hashes or metadata that are compared as one, at most, and ids of which a block is held, about.
NODE, BLOCK = 1_000, 32_768
METADATA = ("intrinsic_width", "intrinsic_height", "byte_length", "rendered_width", "rendered_height")


def by_host(rows: DataFrame, host: Column, entries: DataFrame, first_only: bool = True) -> DataFrame:
    """Rows joined with the entries (entry_id, position, domain) whose domain is the host or a parent of it.

    Hosts are exploded into their suffixes, so this is an equi-join; a suffix
    predicate would compare all pairs. With first_only, the entry with the
    smallest position is kept, and rows without one stay with nulls.
    """
    hosts = rows.select(host.alias("host")).where("host <> ''").distinct()
    hits = hosts.select("host", F.explode(urls.suffixes(F.col("host"))).alias("domain")).join(entries, "domain").select("host", "entry_id", "position")
    if first_only:
        hits = hits.groupBy("host").agg(F.min_by("entry_id", "position").alias("entry_id"))
        return rows.withColumn("host", host).join(hits, "host", "left")
    return rows.withColumn("host", host).join(hits.select("host", "entry_id").distinct(), "host")


def with_alias(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Column `canonical`: the alias table's (alias, canonical) entry for the trimmed value, else that value."""
    value = F.trim(column)
    known = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return rows.join(known, F.lower(value) == F.col("_alias"), "left").withColumn("canonical", F.coalesce("_canonical", value)).drop("_alias", "_canonical")


def _ends(p: str):
    return lambda n: n.endswith(p)


def _begins(p: str):
    return lambda n: n.startswith(p)


def keyword_match(sample: Column, names: Column, keywords: list[str]) -> Column:
    """The first keyword in the sample (short ones as whole tokens), else the first overlay ending, else the first overlay beginning of a name."""
    text = F.lower(sample)
    tokens = F.split(text, "[^a-z0-9_-]+")
    hits = [F.when(F.array_contains(tokens, k) if len(k) <= 3 else F.contains(text, F.lit(k)), F.lit(k)) for k in keywords]
    lower = F.transform(names, F.lower)
    hits += [F.when(F.exists(lower, _ends(p)), F.lit(f"pattern:{p}")) for p in OVERLAY_SUFFIXES]
    hits += [F.when(F.exists(lower, _begins(p)), F.lit(f"pattern:{p}")) for p in OVERLAY_PREFIXES]
    return F.coalesce(*hits)


def near_hashes(left: DataFrame, right: DataFrame, most: int = imaging.MAX_DISTANCE) -> DataFrame:
    """Pairs (id_a, id_b, distance) of 64-bit hashes (id, h) within the distance, id_a < id_b.

    Both sides meet on equal bands; with 5 bands and at most 4 differing bits no
    pair is lost.
    """
    a = left.select(F.col("id").alias("id_a"), F.col("h").alias("h_a"), F.explode(imaging.bands(F.col("h"))).alias("key"))
    b = right.select(F.col("id").alias("id_b"), F.col("h").alias("h_b"), F.explode(imaging.bands(F.col("h"))).alias("key"))
    far = imaging.distance(F.col("h_a"), F.col("h_b"))
    return a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & (far <= most)).select("id_a", "id_b", far.alias("distance")).distinct()


def near_images(images: DataFrame, most: int = imaging.MAX_DISTANCE) -> DataFrame:
    """All pairs (id_a, id_b, distance) of images (id, hashes of their four turns, content) within the distance in any turns, id_a < id_b, each once.

    Rows with one id are one image with the hashes of all and the least content,
    so its distances are the least of any row's; rows with a null id or without
    hashes are in no pair.
    Ids with the same hashes are nodes of up to NODE ids, so copies are compared
    once. Nodes are stored in blocks of about BLOCK ids, and each pair of blocks
    is one row of a product, which reads the stored blocks: neither hashes by
    band nor candidates are shuffled, so disk is the nodes' own size, some times
    over. In a row numpy compares the hashes with an equal band, and only pairs
    within the distance leave it. Equal contents within the distance have
    distance 0.
    """
    spark = images.sparkSession
    groups.folder(spark)
    sets = images.where("id is not null").groupBy("id").agg(F.flatten(F.collect_list("hashes")).alias("hashes"), F.min("content").alias("content"))
    one = sets.withColumn("hashes", F.array_sort(F.array_distinct(F.array_compact("hashes")))).where("size(hashes) > 0")
    every = one.groupBy("hashes").agg(F.collect_list(F.struct("id", "content")).alias("every"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("every") - 1) / NODE).cast("int")), lambda i: F.slice("every", i * NODE + 1, NODE))
    nodes = every.select("hashes", F.explode(parts).alias("x")).select("hashes", F.col("x.id").alias("ids"), F.col("x.content").alias("contents")).checkpoint()
    blocks = -(-(nodes.agg(F.sum(F.size("ids"))).first()[0] or 1) // BLOCK)
    dealt = nodes.withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    held = dealt.groupBy("block").agg(F.collect_list(F.struct("hashes", "ids", "contents")).alias("nodes")).checkpoint()
    a, b = (held.select(F.col("block").alias(f"block_{s}"), F.col("nodes").alias(f"nodes_{s}")) for s in "ab")
    met = a.join(b.hint("shuffle_replicate_nl"), F.col("block_a") <= F.col("block_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, left, y, right in zip(*(batch.column(i) for i in range(4)), strict=True):
                yield from imaging.near_nodes(left.values, None if x == y else right.values, most)

    kind = images.schema["id"].dataType.simpleString()
    found = met.mapInArrow(run, f"id_a {kind}, id_b {kind}, distance int")
    twins = nodes.where(F.size("ids") > 1).select("ids", F.explode("ids").alias("id_a")).select("id_a", F.explode("ids").alias("id_b")).where("id_a < id_b")
    return found.unionByName(twins.withColumn("distance", F.lit(0)))


def denied(rows: DataFrame, host: Column, patterns: DataFrame) -> DataFrame:
    """Rows whose host no pattern `*://*.domain/*` (column pattern) denies; patterns may repeat."""
    domains = patterns.select(F.regexp_extract("pattern", r"^\*://(?:\*\.)?([^/]+)/\*$", 1).alias("domain")).where("domain <> ''").distinct()
    hosts = rows.select(host.alias("denied_host")).where("denied_host <> ''").distinct()
    hit = hosts.select("denied_host", F.explode(urls.suffixes(F.col("denied_host"))).alias("domain")).join(domains, "domain", "left_semi").select("denied_host").distinct()
    return rows.withColumn("own_host", host).join(hit, F.col("own_host") == F.col("denied_host"), "left_anti").drop("own_host")


def allowed_families(rows: DataFrame, family: str, flags: Column) -> DataFrame:
    """Rows whose family a map of flags doesn't switch off; one it doesn't name is on."""
    return rows.where(F.coalesce(F.try_element_at(flags, F.col(family)), F.lit(True)))


def with_confirmed(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) with the cached verdict (pair, verdict) of the same two ids in any order."""
    known = cache.groupBy("pair").agg(F.max("verdict").alias("verdict"))
    return pairs.withColumn("pair", pair_key(F.col("id_a"), F.col("id_b"))).join(known, "pair", "left")


def file_status(online: DataFrame, files: DataFrame, title: str) -> DataFrame:
    """Titles online, in files, or both (a full outer join by lower-cased title): available, offline or completed."""
    a = online.select(F.lower(F.trim(title)).alias("key"), F.lit(True).alias("online")).distinct()
    b = files.groupBy(F.lower(F.trim(title)).alias("key")).agg(F.count("*").alias("files"))
    status = F.when(F.col("online").isNotNull() & F.col("files").isNotNull(), "completed").when(F.col("online").isNotNull(), "available").otherwise("offline")
    return a.join(b, "key", "full_outer").select("key", F.coalesce("files", F.lit(0)).alias("files"), status.alias("status"))


def passes_metadata(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether intrinsic sizes and byte lengths are equal and rendered sizes within a pixel; a missing side passes."""

    def agree(name: str, within: int) -> Column:
        return a[name].isNull() | b[name].isNull() | (F.abs(a[name] - b[name]) <= within)

    return agree("intrinsic_width", 0) & agree("intrinsic_height", 0) & agree("byte_length", 0) & agree("rendered_width", 1) & agree("rendered_height", 1)


def metadata_pairs(images: DataFrame, group: str) -> DataFrame:
    """Pairs (id_a, id_b) of a group's images that pass passes_metadata(), id_a < id_b; images have id, group and the names in METADATA, ids are unique.

    Images with equal metadata are nodes of up to NODE ids. Nodes meet by their
    rendered width, and only the pairs of nodes that pass are spread out into
    ids, so the work grows with the pairs returned and not with a group's square.
    """
    cell = images.groupBy(F.col(group).alias("cell"), F.struct(*METADATA).alias("of")).agg(F.sort_array(F.collect_list("id")).alias("every")).where("cell is not null")
    nodes = cell.select("cell", "of", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("every") - 1) / NODE).cast("int")), lambda i: F.slice("every", i * NODE + 1, NODE))).alias("ids"))
    width = F.floor("of.rendered_width")
    a, b = (nodes.select("cell", F.col("of").alias(f"of_{s}"), F.col("ids").alias(f"ids_{s}"), width.alias(f"width_{s}")) for s in "ab")
    near = a.join(b.where("width_b is not null").withColumn("width_a", F.explode(F.array(*(F.col("width_b") + i for i in (-1, 0, 1))))), ["cell", "width_a"])
    missing = a.join(b, "cell").where("width_a is null or width_b is null")
    met = near.select("of_a", "ids_a", "of_b", "ids_b").unionByName(missing.select("of_a", "ids_a", "of_b", "ids_b"))
    met = met.where((F.col("ids_a")[0] <= F.col("ids_b")[0]) & passes_metadata(*({n: F.col(f"of_{s}.{n}") for n in METADATA} for s in "ab"))).select("ids_a", "ids_b")
    # a number of its own, as Spark would join the small inputs of large outputs into few tasks
    dealt = met.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = F.col("ids_a")[0] == F.col("ids_b")[0]
    every = dealt.select(one.alias("one"), "ids_b", F.explode("ids_a").alias("a")).select("one", "a", F.explode("ids_b").alias("b")).where("not one or a < b")
    return every.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def pair_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a.cast("string"), b.cast("string"))), "|")


def any_alias(rows: DataFrame, columns: list[str], known: DataFrame, keep: bool) -> DataFrame:
    """Rows of which one of the columns is a known value (keep), or none is."""
    marked = rows.withColumn("_id", F.struct(*columns))
    hits = marked.select("_id", F.explode(F.array(*columns)).alias("value")).where("value is not null").join(known.select(F.col(known.columns[0]).alias("value")), "value", "left_semi").select("_id").distinct()
    return marked.join(hits, marked._id.eqNullSafe(hits._id), "left_semi" if keep else "left_anti").drop("_id")


def latest_within(rows: DataFrame, facts: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Each row with the latest fact of its key at or before its time and no older than so many seconds: columns fact_at and fact.

    `facts` has (key, fact_at, fact); rows are unique by (key, at). Both sides
    are one sequence by key and time, so no range join is needed.
    """
    from pyspark.sql.window import Window

    both = rows.select(key, F.col(at).alias("_t"), F.lit(1).alias("_o"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(facts.schema["fact"].dataType).alias("fact"), F.lit(None).cast("timestamp_ntz").alias("fact_at")).unionByName(
        facts.select(key, F.col("fact_at").alias("_t"), F.lit(0).alias("_o"), "fact", F.col("fact_at").cast("timestamp_ntz").alias("fact_at")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_o") == 0, F.struct("fact_at", "fact")), ignorenulls=True).over(w)
    out = both.withColumn("_last", last).where("_o = 1").select("_row.*", "_last.fact_at", "_last.fact", "_t")
    fresh = F.col("fact_at") >= F.col("_t") - F.make_dt_interval(secs=F.lit(seconds))
    return out.withColumn("fact", F.when(fresh, F.col("fact"))).withColumn("fact_at", F.when(fresh, F.col("fact_at"))).drop("_t")

"""Roll-ups, detection rules, catalogue enrichment and layout arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How sure a family's markers make its detection.
FAMILY_CONFIDENCE = {"speedbinb": 0.95, "coreview": 0.85, "madara": 0.7, "mangastream": 0.6, "foolslide": 0.55}


def merged_counters(a: Column, b: Column) -> Column:
    """The greater of two snapshots of a counter, whole and not negative."""
    return F.greatest(F.coalesce(F.floor(a), F.lit(0)), F.coalesce(F.floor(b), F.lit(0)), F.lit(0))


def scan_counters(log: DataFrame, scan: str, layer: str, duplicate: str, failed: str, fetched: str) -> DataFrame:
    """A scan's counters: candidates, fetched, new and duplicate ones of each layer (1 to 3), errors."""
    layers = [F.count_if((F.col(layer) == n) & (F.col(duplicate) == d)).alias(f"l{n}_{'dup' if d else 'new'}") for n in (1, 2, 3) for d in (False, True)]
    return log.groupBy(scan).agg(F.count("*").alias("candidates"), F.count_if(fetched).alias("fetched"), *layers, F.count_if(failed).alias("errors"))


def discovery(rows: DataFrame, seen: Column, visible: Column, selected: Column) -> DataFrame:
    """One row: total, new, seen, visible and selected rows."""
    return rows.groupBy().agg(F.count("*").alias("total"), F.count_if(~seen).alias("fresh"), F.count_if(seen).alias("seen"), F.count_if(visible).alias("visible"), F.count_if(selected).alias("selected"))


def seen_registry(rows: DataFrame, key: str, scan: str, position: str) -> DataFrame:
    """(key, first_seen, last_seen, seen_count, discovery): seen_count counts the turns from one scan to another, in order of detection."""
    w = Window.partitionBy(key).orderBy(position)
    turn = rows.withColumn("turn", F.when(F.lag(scan).over(w).eqNullSafe(F.col(scan)), 0).otherwise(1))
    out = turn.groupBy(key).agg(F.min(position).alias("first_seen"), F.max(position).alias("last_seen"), F.sum("turn").alias("seen_count"))
    return out.withColumn("discovery", F.when(F.col("seen_count") == 1, "new").otherwise("seen"))


def monthly_milestones(rows: DataFrame, at: str, lifetime: int = 1500, monthly: int = 300) -> DataFrame:
    """(month, n, previous_n, prompt): prompt if the lifetime total, the month or the one before reaches its limit; a missing month counts 0."""
    each = rows.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    before = each.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM").alias("month"), F.col("n").alias("previous_n"))
    total = each.agg(F.sum("n").alias("lifetime"))  # one row
    previous = F.coalesce("previous_n", F.lit(0))
    return each.join(before, "month", "left").crossJoin(F.broadcast(total)).select("month", "n", previous.alias("previous_n"), ((F.col("lifetime") >= lifetime) | (F.col("n") >= monthly) | (previous >= monthly)).alias("prompt"))


def viewer_rollup(frames: DataFrame, viewer: str, ok: Column, detected: Column, pages: Column) -> DataFrame:
    return frames.groupBy(viewer).agg(F.bool_or(ok).alias("ok"), F.bool_or(detected).alias("detected"), F.max(pages).alias("pages"))


def archive_names(items: DataFrame, group: str, folder: str) -> DataFrame:
    """A group's archive is named after its only folder, else `chapters.zip`; without folders `zippedimages.zip`."""
    n = F.count_distinct(folder)
    return items.groupBy(group).agg(F.when(n == 1, F.concat(F.max(folder), F.lit(".zip"))).when(n > 1, "chapters.zip").otherwise("zippedimages.zip").alias("archive_name"), n.alias("folders"))


def telemetry(log: DataFrame, site: str, at: str, failed: Column, retries: Column, ident: str, most: int = 5) -> DataFrame:
    """Pages, failures, retries, seconds and the first failures of each site."""
    w = Window.partitionBy(site, F.when(failed, 1).otherwise(0)).orderBy(at, ident)
    rows = log.withColumn("_failed", failed).withColumn("_n", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("_failed") & (F.col("_n") <= most), F.col(ident))))
    return rows.groupBy(site).agg(F.count("*").alias("pages"), F.count_if("_failed").alias("failures"), F.sum(retries).alias("retries"), F.timestamp_diff("SECOND", F.min(at), F.max(at)).alias("seconds"), first.alias("first_failures"))


def with_names(rows: DataFrame, ids: str, names: DataFrame, key: list[str]) -> DataFrame:
    """Column names: the names (id, name, licensed) of an array of ids, in its order; rows whose ids are all licensed go."""
    each = rows.select(*key, F.posexplode(ids).alias("_pos", "id")).join(names, "id")
    got = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "name"))), lambda x: x["name"]).alias("names"), F.bool_and("licensed").alias("_all"))
    return rows.join(got, key, "left").where(~F.coalesce("_all", F.lit(False))).drop("_all")


def with_placeholder(bookmarks: DataFrame, connectors: DataFrame, key: str, label: str, missing: str = "unknown") -> DataFrame:
    return bookmarks.join(connectors.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.concat(F.lit(f"{missing}:"), F.col(key).cast("string"))))


def marked(chapters: DataFrame, marks: DataFrame) -> DataFrame:
    """Chapters (connector, manga, id, file, title) with column marked: a mark of their manga names their id, file or title."""
    own = ["connector", "manga", "id", "file", "title"]
    names = chapters.select(*own, F.explode(F.array_distinct(F.array("id", "file", "title"))).alias("chapter"))
    hits = names.join(marks.select("connector", "manga", "chapter"), ["connector", "manga", "chapter"], "left_semi").select(*(F.col(c).alias(f"_{c}") for c in own)).distinct()
    same = (F.col("connector") == F.col("_connector")) & (F.col("manga") == F.col("_manga"))
    for c in own[2:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return chapters.join(hits, same, "left").withColumn("marked", F.col("_connector").isNotNull()).drop(*(f"_{c}" for c in own))


def overlay_candidates(elements: DataFrame, min_coverage: float = 0.55, min_z: float = 999, scanned: int = 2200, most: int = 120) -> DataFrame:
    """Elements (page_id, pos, tag, role, aria_modal, position, width, height, view_width, view_height, z) that may cover the page, with their coverage."""
    part = F.least("width", "view_width") * F.least("height", "view_height") / F.greatest(F.lit(1.0), F.col("view_width") * F.col("view_height"))
    order = Window.partitionBy("page_id").orderBy("pos")
    seen = elements.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= scanned)
    essential = F.upper("tag").isin("IMG", "CANVAS", "SVG", "PICTURE", "VIDEO", "AUDIO", "IFRAME", "OBJECT", "MAIN", "NAV", "HEADER", "FOOTER") | F.coalesce(F.lower("role").isin("main", "navigation", "banner"), F.lit(False)) | F.coalesce("aria_modal", F.lit(False))
    some = seen.withColumn("coverage", part).where(~essential & F.col("position").isin("fixed", "absolute", "sticky") & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("coverage") >= min_coverage) & (F.coalesce("z", F.lit(0.0)) >= min_z))
    return some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def families(pages: DataFrame, markers: dict[str, str], html: str = "html") -> DataFrame:
    """(page_id, family, confidence, rank): families whose marker pattern the markup has, the surest first."""
    rules = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(FAMILY_CONFIDENCE.get(f, 0.5)).alias("confidence"), F.col(html).rlike(p).alias("hit")) for f, p in markers.items()))
    hits = F.filter(rules, lambda r: r["hit"])
    ordered = F.array_sort(F.transform(hits, lambda r: F.struct((-r["confidence"]).alias("c"), r["family"].alias("family"))))
    return pages.select("page_id", F.posexplode(ordered).alias("rank", "r")).select("page_id", F.col("r.family").alias("family"), (-F.col("r.c")).alias("confidence"), (F.col("rank") + 1).alias("rank"))


def tile_order(size: Column, seed: Column) -> Column:
    """The permutation of size * size tiles by the values of a 32-bit xorshift generator."""
    mask = F.lit(0xFFFFFFFF)

    def step(s: Column) -> Column:
        a = s.bitwiseXOR(F.shiftleft(s, 13).bitwiseAND(mask))
        b = a.bitwiseXOR(F.shiftrightunsigned(a, 17))
        return b.bitwiseXOR(F.shiftleft(b, 5).bitwiseAND(mask))

    start = F.when(seed.cast("bigint").bitwiseAND(mask) == 0, F.lit(1)).otherwise(seed.cast("bigint").bitwiseAND(mask)).cast("bigint")
    # one list grows by a value for each tile; grids are small
    keys = F.aggregate(F.sequence(F.lit(1), size * size), F.array(start), lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1)))))
    return F.transform(F.array_sort(F.transform(F.slice(keys, F.lit(2), size * size), lambda k, i: F.struct(k.alias("k"), i.alias("i")))), lambda x: x["i"])


def tile_geometry(width: Column, height: Column, div: Column, unit: int = 8) -> Column:
    """Tile and canvas sizes: tiles are whole units, or whole pixels where a unit doesn't fit."""

    def quantized(v: Column) -> Column:
        whole = F.floor(v / (div * unit)) * unit
        return F.greatest(F.lit(1), F.when(whole > 0, whole).when(F.floor(v / div) > 0, F.floor(v / div)).otherwise(v)).cast("int")

    w, h = quantized(width), quantized(height)
    return F.struct(w.alias("tile_width"), h.alias("tile_height"), (w * div).alias("canvas_width"), (h * div).alias("canvas_height"))


def ranges(size: Column, part: int) -> Column:
    """`first-last` of the parts of a file."""
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("bigint"), size.cast("bigint") - 1, F.lit(part).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.concat(s.cast("string"), F.lit("-"), F.least(s + (part - 1), size - 1).cast("string")))


def not_stopped(batches: DataFrame, stops: DataFrame, memory: float = 600.0) -> DataFrame:
    """Batches (scan_id, ts) unless their scan was stopped before them, within the time that stops are remembered.

    Only a scan's last stop before a batch matters, so both are one sequence by
    scan and time; a range join would pair all of a scan's stops and batches.
    """
    both = batches.select("scan_id", F.col("ts").alias("t"), F.lit(1).alias("o"), F.struct(*batches.columns).alias("row")).unionByName(
        stops.select("scan_id", F.col("stopped_at").alias("t"), F.lit(0).alias("o")), allowMissingColumns=True
    )
    w = Window.partitionBy("scan_id").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("o") == 0, F.col("t"))).over(w)
    open_ = last.isNull() | (F.timestamp_diff("MICROSECOND", last, F.col("t")) > memory * 1e6)
    return both.withColumn("open", open_).where("o = 1 and open").select("row.*")

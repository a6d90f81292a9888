"""The engine's queries by name. Each runs an operator over whole driver tables in the role of items, captures, catalogues or images."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelens.functions import imaging, text, urls
from pagelens.operators import curate, groups, keep, lookups, reports, timed
from pagelens.plans.sql import ORACLE_SQL
from pagelens.sources import archives, markup

__all__ = ["ORACLE_SQL", "QUERIES"]

NOW = datetime(2024, 1, 15)
#: A catalogue of (entry_id, position, domain).
CATALOGUE = (("net-all", 2, "example.net"), ("org-www", 0, "www.example.org"), ("org-all", 1, "example.org"), ("com-all", 3, "example.com"))
ALIASES = (("france", "FR"), ("germany", "DE"), ("japan", "JP"), ("united states", "US"))
KEYWORDS = ["ad", "overlay", "banner"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_l1_exact_dup(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return groups.hash_status(docs, "sha256", [F.col("id")]).select(F.col("id").alias("doc_id"), "sha256", "canonical_id", "status")


def q_hash_groups(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return groups.hash_groups(docs, "sha256", "L1").select("group_id", "representative_id", F.array_join("member_ids", ",").alias("members"))


def q_scan_stats(spark, d):
    docs = _t(spark, d, "documents").select("source", F.col("doc_id").alias("id"), "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    s = groups.hash_status(docs, "h", [F.col("id")])
    return s.groupBy("source").agg(F.count("*").alias("found"), F.count_if(F.col("status") == "NEW").alias("fresh"), F.count_if(F.col("status") == "DUP").alias("duplicates"), F.count_if(F.col("n_chars") < 100).alias("small"), F.sum("n_chars").alias("chars"))


def q_occurrence_groups(spark, d):
    """Seen registry: first, last and number of scans (a scan is a source) of each content, in order of detection."""
    docs = _t(spark, d, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("content"))
    return reports.seen_registry(docs, "content", "source", "doc_id")


def q_keep_best(spark, d):
    li = _t(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("size"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return keep.keep_best(li, ["l_partkey"], [F.col("area"), F.col("size")], F.col("pos")).select("l_partkey", "area", "size", F.col("pos").alias("own_pos"), "position")


def q_keep_latest(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return keep.keep_latest(o, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))


def q_keep_first(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return keep.keep_first(e, ["user_id", "event_type"], [F.col("event_id")])


def q_keep_preferred(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_name", "p_partkey", "p_size")
    return keep.keep_preferred(p, ["p_brand"], F.col("p_size"), F.col("p_name"), F.col("p_partkey"))


def q_dedupe_key(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url")
    src, name = urls.source_link(F.col("url")), urls.source_file(F.col("url"))
    key = keep.dedupe_key(F.lit("img"), src, name, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("url"), F.col("url"), F.col("page_id"))
    return p.select("page_id", key.alias("dedupe_key"))


def q_filter_sort(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return curate.matching(p, search="A", search_in=("p_name", "p_type"), minimum={"p_size": 10}).orderBy(F.desc("p_size"), "p_partkey")


def q_summary_counts(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy().agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 50).alias("visible"), F.count_if(F.col("event_type") == "click").alias("selected"), F.count_distinct("user_id").alias("users"))


def q_name_sort(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    return curate.top_per_group(p, ["p_brand"], [F.lower("p_name"), F.col("p_partkey")], 5)


def q_serial_rename(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_partkey")
    return curate.serial_names(p, ["p_brand"], [F.col("p_partkey")], F.lit("png"))


def q_collision_suffix(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("folder"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".png")).alias("name"))
    return curate.numbered_repeats(c, "folder", "name", [F.col("c_custkey")])


def q_collision_exact(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("folder"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".png")).alias("name"))
    return curate.unique_names(c, "folder", "name", "c_custkey")


def q_consecutive_collapse(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return curate.collapse_runs(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"], "ts")


def q_recent_tags(spark, d):
    last = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_id"))
    return curate.top_per_group(last, ["user_id"], [F.desc("last_id")], 3)


def q_topk_per_group(spark, d):
    return curate.top_per_group(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)


def q_detection_ordinal(spark, d):
    first = _t(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    # the users of a log fit in one task: this is the order in which a panel lists them
    return first.select("user_id", "first_id", F.row_number().over(Window.orderBy("first_id")).alias("ordinal"))


def q_union_persist(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "value", "ts")
    now = e.where(F.col("ts") >= F.lit(NOW))
    both = keep.persistent_union(now, e.where(F.col("ts") < F.lit(NOW)), ("purchase", "signup"))
    return keep.keep_best(both, ["user_id", "kind"], [F.col("value")], F.col("event_id")).select("user_id", "kind", "value", "position")


def q_append_unseen(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type")
    return keep.append_unseen(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"]).groupBy("user_id").agg(F.count("*").alias("kept"))


def q_set_diff(spark, d):
    """Customers without an urgent order."""
    urgent = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"))
    return keep.without_keys(_t(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), urgent, ["custkey"])


def q_set_intersect(spark, d):
    o = _t(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


def q_set_symdiff(spark, d):
    o = _t(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'F'").select("o_custkey").distinct(), o.where("o_orderstatus = 'O'").select("o_custkey").distinct()
    return a.join(b, "o_custkey", "left_anti").unionByName(b.join(a, "o_custkey", "left_anti"))


def q_links(spark, d):
    return markup.links(_t(spark, d, "pages"))


def q_chapter_links(spark, d):
    return markup.chapter_links(_t(spark, d, "pages"))


def q_elements(spark, d):
    el = markup.elements(_t(spark, d, "pages"), ("a", "div", "p", "li"))
    return el.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.count_if(F.col("attrs")["class"] == "ad").alias("ads"))


def q_url_parts(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.bare(u).alias("bare"), urls.file_name(u).alias("file_name"), urls.canonical(u, ("ref", "utm_source")).alias("canonical"), urls.source_link(u).alias("source_link"))


def q_host_suffix_join(spark, d):
    entries = spark.createDataFrame(CATALOGUE, "entry_id string, position int, domain string")
    return lookups.by_host(_t(spark, d, "pages").select("page_id", "url"), urls.host(F.col("url")), entries).select("page_id", "host", "entry_id")


def q_keyword_match(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), 1)).alias("cls"))
    hit = lookups.keyword_match(F.col("cls"), F.split("cls", r"\s+"), KEYWORDS)
    return p.select("page_id", hit.alias("keyword")).where("keyword is not null").groupBy("page_id", "keyword").agg(F.count("*").alias("n"))


def q_alias_join(spark, d):
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string")
    return lookups.with_alias(_t(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", aliases).select("n_nationkey", "n_name", "canonical")


def q_url_semi(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url", urls.bare(F.col("url")).alias("bare"))
    known = p.where("page_id % 3 = 0").select("bare")
    return lookups.any_alias(p, ["url", "bare"], known, keep=True).select("page_id")


def q_detection_rank(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id")
    stage = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(i)) for i, t in enumerate(("purchase", "signup", "click", "view", "error"))))
    first = keep.keep_first(e.withColumn("stage", stage), ["user_id", "event_type"], [F.col("event_id")])
    return curate.top_per_group(first, ["user_id"], [F.col("stage"), F.col("event_id")], 3).select("user_id", "event_type", "stage", "rank")


def q_monthly_milestone(spark, d):
    return reports.monthly_milestones(_t(spark, d, "orders"), "o_orderdate")


def q_ttl_cache(spark, d):
    return timed.live_entries(_t(spark, d, "events").where(F.col("ts") <= F.lit(NOW)), ["user_id", "event_type"], "ts", NOW, 86400.0)


def q_host_history(spark, d):
    return timed.recent_values(_t(spark, d, "events").where(F.col("ts") <= F.lit(NOW)).select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", "ts", "event_id", NOW, 43200.0, 200)


def q_budget_evict(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", F.floor("value").cast("bigint").alias("size"))
    return timed.within_budget(e, ["user_id"], "ts", "event_id", F.col("size"), 1000, 20).select("user_id", "event_id", "total_size", "rank")


def q_circuit_breaker(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return timed.circuit_breaker(e, "user_id", "ts", "event_id", "failed", 2, 86400.0)


def q_debounce(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return timed.debounced(e, "user_id", "ts", "event_id", 3600, "event_type").select("user_id", "event_id", "event_type")


def q_throttle(spark, d):
    return timed.throttled(_t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3600.0, 7200.0)


def q_scroll_distance(spark, d):
    return timed.by_distance(_t(spark, d, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id", "value", 200.0, 3600.0)


def q_req_resp_join(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    req = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "ts")
    res = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    return timed.request_pairs(req, res, ["user_id"], 3600).select("user_id", "view_id", "click_id")


def q_valid_fact(spark, d):
    """Each click with the user's last purchase at most a day before it."""
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "value")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    facts = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("fact_at")).agg(F.max("value").alias("fact"))
    return lookups.latest_within(clicks, facts, "user_id", "ts", 86400).select("user_id", "event_id", "fact")


def _grids(spark, d):
    # 64 values as an 8 x 9 grid of grey levels, the first ones twice
    grey = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x.cast("double") * 64 + 128))))
    return _t(spark, d, "embeddings").select("vec_id", "label", F.concat(F.slice(grey, 1, 64), F.slice(grey, 1, 8)).alias("grey"))


def _hashes(spark, d):
    """Hashes (id, h) of all images, and of a copy of every third with its 2 or 3 lowest bits inverted."""
    own = _grids(spark, d).select(F.col("vec_id").alias("id"), imaging.dhash(F.col("grey")).alias("h"))
    return own.unionByName(own.where("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("h").bitwiseXOR(F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.lit(7)).cast("bigint")).alias("h")))


def q_dhash(spark, d):
    return _grids(spark, d).select("vec_id", imaging.dhash(F.col("grey")).alias("dhash"))


def q_dhash_bands(spark, d):
    h = _hashes(spark, d)
    return lookups.near_hashes(h, h, 4)


def q_ssim_pairs(spark, d):
    h = _hashes(spark, d)
    pairs = lookups.near_hashes(h, h, 2)
    g = _grids(spark, d).select("vec_id", F.transform("grey", lambda x: x.cast("double")).alias("g"))
    changed = F.transform("g", lambda x, i: F.when(i % 9 == 0, F.greatest(F.lit(0.0), x - 8)).otherwise(x))
    every = g.unionByName(g.select((F.col("vec_id") + 1_000_000).alias("vec_id"), changed.alias("g")))
    a = every.select(F.col("vec_id").alias("id_a"), F.col("g").alias("ga"))
    b = every.select(F.col("vec_id").alias("id_b"), F.col("g").alias("gb"))
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", F.round(imaging.ssim(F.col("ga"), F.col("gb")), 6).alias("score"))


def q_dup_components(spark, d):
    h = _hashes(spark, d)
    pairs = lookups.near_hashes(h, h, 2)
    chain = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(h.where("id < 1000000 and id % 6 = 0").select(F.col("id").alias("a"), (F.col("id") + 3).alias("b")))
    return groups.connected(chain)


def q_full_outer_status(spark, d):
    online = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    files = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("files"))
    status = F.when(F.col("online").isNotNull() & F.col("files").isNotNull(), "completed").when(F.col("online").isNotNull(), "available").otherwise("offline")
    return online.withColumn("online", F.lit(True)).join(files, "key", "full_outer").select("key", F.coalesce("files", F.lit(0)).alias("files"), status.alias("status"))


def q_props_json(spark, d):
    e = _t(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.greatest(F.lit(0), F.least(F.lit(50), F.coalesce("p.k", F.lit(10)))).alias("k"))


def q_safe_names(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", text.safe_name(F.concat("p_name", F.lit(".JPG"))).alias("file_name"), text.human_size(F.col("p_retailprice") * 1000).alias("shown_size"), text.human_duration(F.col("p_retailprice") * 10).alias("shown_time"))


def q_text_hash(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.text_hash(F.col("p_name")).alias("h32"), text.text_hash(F.col("p_name"), True).alias("signed32"), F.sha1(F.substring(F.col("p_name").cast("binary"), 1, 8192)).alias("prefix_sha1"))


def q_crc(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


def q_zip_pack(spark, d):
    """The documents of a source as archives of about 50 files; larger sources get more archives."""
    docs = _t(spark, d, "documents").select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("pos"))
    return archives.packed(docs).select("archive", "n_files", "bytes", F.crc32("content").alias("crc32"))


def q_viewer_rollup(spark, d):
    e = _t(spark, d, "events")
    return reports.viewer_rollup(e, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", F.floor("value"))


def q_merged_counters(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a"), F.sum("l_discount").alias("b")).select("l_suppkey", reports.merged_counters(F.col("a") - 1000, F.round("b", 4)).alias("n"))


def q_archive_names(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("folder"))
    return reports.archive_names(o, "o_custkey", "folder")


def q_telemetry(spark, d):
    e = _t(spark, d, "events")
    out = reports.telemetry(e, "user_id", "ts", F.col("event_type") == "error", F.when(F.col("event_type") == "view", 1).otherwise(0), "event_id")
    return out.withColumn("first_failures", F.array_join(F.transform("first_failures", lambda x: x.cast("string")), ","))


def q_group_names(spark, d):
    """Customers' orders as ids of priorities with names; customers whose priorities are all licensed go."""
    names = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("licensed"))
    rows = _t(spark, d, "customer").groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 3).alias("bundle")).agg(F.array_sort(F.collect_set("c_nationkey")).alias("ids"))
    return reports.with_names(rows, "ids", names, ["c_mktsegment", "bundle"]).select("c_mktsegment", "bundle", F.array_join("names", ",").alias("names"))


def q_placeholder(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    c = _t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label"))
    return reports.with_placeholder(o, c, "key", "label")


def q_chapter_marks(spark, d):
    """Line items marked by their number, or by the part's name."""
    li = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("connector"), F.col("l_orderkey").alias("manga"), F.concat("l_linenumber", F.lit("")).alias("id"), F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("title"))
    marks = li.where("manga % 7 = 0").select("connector", "manga", F.lit("R").alias("chapter")).unionByName(li.where("manga % 11 = 0").select("connector", "manga", F.lit("1").alias("chapter")))
    return reports.marked(li, marks).groupBy("connector").agg(F.count_if("marked").alias("marked"), F.count("*").alias("chapters"))


def q_family_rank(spark, d):
    return reports.families(_t(spark, d, "pages"), {"madara": 'class="ad"', "speedbinb": "<table", "coreview": "<li>", "foolslide": "<h1>"})


def q_part_ranges(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(reports.ranges(F.col("n_chars"), 1024)).alias("part", "bytes"))


def q_tile_geometry(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", reports.tile_geometry(F.floor("p_retailprice"), F.col("p_size") * 10, F.lit(4)).alias("g")).select("p_partkey", "g.*")


def q_stopped_scans(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("user_id").alias("scan_id"), "event_type", "ts")
    stops = e.where("event_type = 'error'").select("scan_id", F.col("ts").alias("stopped_at"))
    return reports.not_stopped(e.where("event_type <> 'error'"), stops, 36000).select("event_id", "scan_id")


QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}

"""Further queries: sources, guards, registries, orders and field functions, each with its SQL beside it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import imaging, text, urls
from pagelens.operators import captures, curate, groups, keep, lookups, reports, timed
from pagelens.sources import markup, readers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 15)


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Markup ---------------------------------------------------------------------------------------------------------------

_SRCSET = "'a' || p_partkey || '.jpg ' || (p_size * 10) || 'w,  b.jpg 2x, c' || p_size || '.jpg , d.jpg 1.5x,' || p_brand || '.png ' || (p_size * 7) || 'w'"


@query(f"""
WITH e AS (SELECT p_partkey, unnest(string_split({_SRCSET}, ',')) AS e, unnest(range(0, 5)) AS pos FROM part),
w AS (SELECT p_partkey, pos, regexp_split_to_array(trim(e), '\\s+') AS w FROM e),
c AS (SELECT p_partkey, pos, w[1] AS url, CASE WHEN ends_with(w[2], 'w') THEN CAST(replace(w[2], 'w', '') AS DOUBLE) END AS width, CASE WHEN ends_with(w[2], 'x') THEN CAST(replace(w[2], 'x', '') AS DOUBLE) END AS density FROM w)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY coalesce(width, 0) DESC, coalesce(density, 0) DESC, pos) - 1 AS INTEGER) AS rank, url, width, density FROM c
""")
def q_srcset(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.expr(_SRCSET).alias("s"))
    return p.select("p_partkey", F.posexplode(markup.ranked(markup.srcset(F.col("s")))).alias("rank", "e")).select("p_partkey", "rank", "e.*")


_CSS = "'url(\"' || url || '\") no-repeat, image-set(''' || url || '&s=2'' 2x, url( ' || regexp_replace(url, '[?#].*$', '') || ' ) 1x)'"


@query(f"""
WITH c AS (SELECT page_id, {_CSS} AS css FROM pages),
u AS (SELECT page_id, list_concat(list_transform(regexp_extract_all(css, 'url\\(\\s*"?([^"\\s)]+)"?\\s*\\)', 1), lambda x: x), regexp_extract_all(css, '''([^'']*)''', 1)) AS u FROM c),
p AS (SELECT page_id, unnest(u) AS url, unnest(range(0, len(u))) AS i FROM u),
f AS (SELECT page_id, url, min(i) AS i FROM p GROUP BY page_id, url)
SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS rank FROM f
""")
def q_css_images(spark, d):
    el = _t(spark, d, "pages").select("page_id", F.lit(0).alias("pos"), F.create_map(F.lit("background"), F.expr(_CSS)).alias("style"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    return markup.background_items(el, per_page=500, min_area=50).select("page_id", "url", "rank")


_IMG = "'<p><img src=\"/i/' || page_id || '.png\" width=\"' || (page_id % 90) || '\" height=\"40\"><img data-src=\"v.mp4\" width=99 height=99><source srcset=\"x/s.jpg 1x, x/' || page_id || '.gif 2x\">'"


@query("""
WITH s AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) AS dir FROM pages)
SELECT page_id, site || '/i/' || page_id || '.png' AS item_url, 'img' AS kind, page_id || '.png' AS filename FROM s WHERE page_id % 90 >= 20
""")
def q_images(spark, d):
    """Images of at least 20 x 20 pixels; videos and images of no size don't count."""
    p = _t(spark, d, "pages").select("page_id", "url", F.expr(_IMG).alias("html"))
    return markup.image_items(p, min_width=20, min_height=20).select("page_id", "item_url", "kind", "filename")


@query("""
WITH s AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) AS dir FROM pages)
SELECT page_id, site || dir || 'x/' || page_id || '.gif' AS item_url, page_id || '.gif' AS filename FROM s
""")
def q_gifs(spark, d):
    return markup.gif_items(_t(spark, d, "pages").select("page_id", "url", F.expr(_IMG).alias("html"))).select("page_id", "item_url", "filename")


@query("""
WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages), h AS (SELECT page_id, url, unnest(l) AS h, unnest(range(0, len(l))) AS pos FROM l)
SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN pos % 2 = 0 THEN h ELSE '/a' || h END AS target FROM h WHERE regexp_matches(h, '^/[^/]')
""")
def q_resolved(spark, d):
    links = markup.links(_t(spark, d, "pages")).where("href rlike '^/[^/]'").join(_t(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^([a-z]+://[^/?#]*).*$", "$1/a/b/c?x#y").alias("base")), "page_id")
    link = F.when(F.col("pos") % 2 == 0, F.col("href")).otherwise(F.concat(F.lit(".././x/../../a"), F.col("href")))
    return links.select("page_id", "pos", markup.resolved(F.col("base"), link).alias("target"))


@query("""
WITH l AS (SELECT n_nationkey // 5 AS f, n_nationkey AS n, CASE n_nationkey % 5 WHEN 0 THEN '# ' || n_name WHEN 1 THEN n_name || ', x, two  words' WHEN 2 THEN '```' WHEN 3 THEN '# ' || n_name WHEN 4 THEN '| ' || n_name || ' | q |' END AS v FROM nation),
i AS (SELECT *, sum(CASE WHEN starts_with(trim(v), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY n) % 2 = 1 AS inside FROM l),
w AS (SELECT unnest(regexp_split_to_array(v, '[|,\\n]')) AS w FROM i WHERE NOT starts_with(trim(v), '```') AND (inside OR NOT starts_with(trim(v), '#'))),
k AS (SELECT lower(trim(regexp_replace(w, '^[\\s>*-]+|`', '', 'g'))) AS keyword FROM w)
SELECT DISTINCT keyword FROM k WHERE length(keyword) BETWEEN 2 AND 50
""")
def q_keyword_list(spark, d):
    n = F.col("n_nationkey")
    value = F.when(n % 5 == 0, F.concat(F.lit("# "), "n_name")).when(n % 5 == 1, F.concat("n_name", F.lit(", x, two  words"))).when(n % 5 == 2, "```").when(n % 5 == 3, F.concat(F.lit("# "), "n_name")).otherwise(F.concat(F.lit("| "), "n_name", F.lit(" | q |")))
    return markup.keyword_list(_t(spark, d, "nation").select(F.floor(n / 5).alias("file"), n.alias("n"), value.alias("value")))


@query("SELECT page_id, trim(replace(url, '&', '&')) || '&x=1' AS url FROM pages")
def q_attribute(spark, d):
    raw = F.concat(F.lit(' "'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.when(F.col("page_id") % 2 == 0, "&AMP;x=1").otherwise("&#38;x=1"), F.lit('" '))
    return _t(spark, d, "pages").select("page_id", urls.attribute(raw).alias("url"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(decode(from_base64(regexp_extract(u, ',(.*)$', 1))) AS VARCHAR) ELSE url_decode(regexp_extract(u, ',(.*)$', 1)) END AS content FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'data:text/plain;base64,' || to_base64(encode(substr(text, 1, 40))) ELSE 'data:text/plain,' || url_encode(substr(text, 1, 40)) END AS u FROM documents)")
def q_data_urls(spark, d):
    part = F.substring("text", 1, 40)
    plain = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), F.replace(F.base64(F.encode(part, "UTF-8")), F.lit("\r\n"), F.lit("")))).otherwise(F.concat(F.lit("data:text/plain,"), plain))
    return _t(spark, d, "documents").select("doc_id", F.decode(urls.decoded_data(url), "UTF-8").alias("content"))


# Collectors and captures ----------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id AS page_id, 'https://a' || (event_id % 7) || '.' || event_type || '.example/' || (event_id % 3) AS url, value AS width_hint, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT page_id, url, max(width_hint) AS width_hint FROM e WHERE n <= 200 AND event_type IN ('view', 'click') GROUP BY page_id, url
""")
def q_embeds(spark, d):
    e = _t(spark, d, "events")
    url = F.concat(F.lit("https://a"), (F.col("event_id") % 7).cast("string"), F.lit("."), "event_type", F.lit(".example/"), (F.col("event_id") % 3).cast("string"))
    return captures.embed_images(e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("pos"), url.alias("url"), F.col("value").alias("width_hint")), ("view.example", "click.example"))


@query("""
WITH f AS (SELECT source, sha1(text) AS content, min(doc_id) AS first FROM documents GROUP BY ALL), n AS (SELECT source, content, row_number() OVER (PARTITION BY source ORDER BY first) AS n FROM f)
SELECT d.doc_id, 'Canvas_' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS name FROM documents d JOIN n ON d.source = n.source AND sha1(d.text) = n.content
""")
def q_canvas_names(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("content"))
    return captures.canvas_names(docs, "source", "content", "doc_id").select("doc_id", "name")


@query("""
WITH c AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS collector, CAST(floor(value) AS BIGINT) AS url FROM events)
SELECT user_id, url, CAST(collector AS INTEGER) AS collector, event_id FROM c QUALIFY row_number() OVER (PARTITION BY user_id, url ORDER BY collector, event_id) = 1
""")
def q_sweep(spark, d):
    e = _t(spark, d, "events").select("user_id", F.floor("value").cast("bigint").alias("url"), "event_id", "event_type")
    parts = [e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), e.where("event_type not in ('purchase', 'signup')")]
    return captures.swept(parts, ["user_id", "url"], "event_id").select("user_id", "url", "collector", "event_id")


_OPS = "CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'canvasBlob' WHEN 'purchase' THEN 'fetchBlob' WHEN 'signup' THEN 'canvasDataURL' ELSE 'revoke' END"


@query(f"""
WITH l AS (SELECT user_id * 20 + event_id % 20 AS url, {_OPS} AS op, ts, event_id, CAST(floor(value) AS BIGINT) AS size FROM events),
m AS (SELECT url, arg_max(op, (ts, event_id)) AS op, arg_max(size, (ts, event_id)) AS size, max(ts) AS created_at, max((ts, event_id)) AS m FROM l WHERE op <> 'revoke' GROUP BY url),
r AS (SELECT url, max((ts, event_id)) AS r FROM l WHERE op = 'revoke' GROUP BY url)
SELECT m.url, op, size, created_at, coalesce(r > m, false) AS revoked FROM m LEFT JOIN r ON m.url = r.url
""")
def q_blob_registry(spark, d):
    return captures.blob_registry(_blobs(spark, d))


def _blobs(spark, d):
    return _t(spark, d, "events").select((F.col("user_id") * 20 + F.col("event_id") % 20).alias("url"), F.expr(_OPS).alias("op"), F.floor("value").cast("bigint").alias("size"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query(f"""
WITH l AS (SELECT user_id * 20 + event_id % 20 AS url, {_OPS} AS op, ts, event_id, CAST(floor(value) AS BIGINT) AS size FROM events),
m AS (SELECT url, arg_max(size, (ts, event_id)) AS size, max(ts) AS created_at, max((ts, event_id)) AS m FROM l WHERE op <> 'revoke' GROUP BY url),
r AS (SELECT url, max((ts, event_id)) AS r FROM l WHERE op = 'revoke' GROUP BY url),
y AS (SELECT m.url, size, created_at, date_diff('microsecond', created_at, TIMESTAMP '2024-02-01') / 1e6 AS age, coalesce(r > m, false) AS revoked FROM m LEFT JOIN r ON m.url = r.url),
k AS (SELECT url, sum(size) OVER w AS kept_bytes, count(*) OVER w AS kept_rows FROM y WHERE NOT (age > 2592000 OR (revoked AND age > 864000)) WINDOW w AS (ORDER BY created_at DESC, url DESC ROWS UNBOUNDED PRECEDING))
SELECT url, CAST(kept_bytes AS BIGINT) AS kept_bytes, kept_rows FROM k WHERE kept_bytes <= 9000 AND kept_rows <= 600
""")
def q_registry_evict(spark, d):
    out = captures.pruned(captures.blob_registry(_blobs(spark, d)), F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz"), age=2592000.0, revoked_age=864000.0, most_bytes=9000, most_rows=600)
    return out.select("url", "kept_bytes", "kept_rows")


_NET = "SELECT user_id % 40 AS tab, user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'response' WHEN 'click' THEN 'finished' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'response' ELSE 'finished' END AS kind, 200 + 40 * (event_id % 8) AS status FROM events"
_PAIRED = f"(SELECT tab, user_id, response, event_id AS finish FROM (SELECT *, lag(kind) OVER w AS k, lag(status) OVER w AS s, lag(ts) OVER w AS t, lag(event_id) OVER w AS response FROM ({_NET}) WINDOW w AS (PARTITION BY tab, user_id ORDER BY ts, event_id)) WHERE kind = 'finished' AND k = 'response' AND s BETWEEN 200 AND 399 AND date_diff('microsecond', t, ts) <= 36000000000)"


def _network(spark, d):
    kind = F.when(F.col("event_type").isin("view", "purchase"), "response").when(F.col("event_type") == "error", "failed").otherwise("finished")
    return _t(spark, d, "events").select((F.col("user_id") % 40).alias("tab"), "user_id", "event_id", "ts", kind.alias("kind"), (200 + 40 * (F.col("event_id") % 8)).alias("status"))


@query(f"SELECT user_id, response, finish FROM {_PAIRED}")
def q_finished_requests(spark, d):
    return captures.finished_requests(_network(spark, d), ["user_id"], "ts", "event_id", "kind", "status", 36000.0)


@query(f"""
WITH a AS (SELECT tab, user_id, min(finish) AS event_id, 0 AS collector FROM {_PAIRED} WHERE tab < 25 GROUP BY tab, user_id),
b AS (SELECT user_id % 40 AS tab, user_id, min(event_id) AS event_id, 1 AS collector FROM events WHERE event_type = 'signup' AND user_id % 40 NOT IN (SELECT tab FROM a) GROUP BY ALL)
SELECT tab, user_id, event_id, CAST(collector AS INTEGER) AS collector FROM a UNION ALL SELECT tab, user_id, event_id, CAST(collector AS INTEGER) FROM b
""")
def q_capture_paths(spark, d):
    """Path 1 for the tabs it is attached to, path 2 for the others."""
    first = captures.finished_requests(_network(spark, d).where("tab < 25"), ["tab", "user_id"], "ts", "event_id", "kind", "status", 36000.0).select("tab", "user_id", F.col("finish").alias("event_id"))
    second = _t(spark, d, "events").where("event_type = 'signup'").select((F.col("user_id") % 40).alias("tab"), "user_id", "event_id")
    return captures.with_fallback(first, second, first, "tab", ["tab", "user_id"], "event_id").select("tab", "user_id", "event_id", "collector")


@query("""
WITH u AS (SELECT event_id, user_id % 40 AS tab, event_type || '/' || (event_id % 3) AS in_flight, ts FROM events)
SELECT event_id, tab, in_flight FROM u QUALIFY coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY tab, in_flight ORDER BY ts, event_id), ts) >= 86400000000, true)
""")
def q_in_flight(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 40).alias("tab"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string"), F.lit("#"), "event_id").alias("url"))
    return captures.once_in_flight(e, "tab", urls.without_fragment(F.col("url")), "ts", "event_id", 86400.0).select("event_id", "tab", "in_flight")


@query("""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'dataUri' WHEN page_id % 4 = 1 THEN 'blob' ELSE 'img' END AS kind, page_id % 4 = 3 AND page_id % 8 = 3 AS video, page_id % 4 = 0 OR page_id % 4 = 2 AS image, octet_length(encode(html)) BETWEEN 10 AND 2500 AS fits, page_id % 4 IN (0, 2, 3) AS wanted,
  regexp_matches(host, '(^|\\.)example\\.(org|net)$') AS allowed FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
""")
def q_asset_guards(spark, d):
    n = F.col("page_id") % 4
    asset = F.when(n == 0, "data:image/png;base64,AA").when(n == 1, "blob:x").when(n == 2, F.concat(F.lit("https://h/"), F.col("page_id").cast("string"), F.lit(".PNG?x"))).otherwise(F.when(F.col("page_id") % 8 == 3, "https://h/v.mp4?x").otherwise("https://h/page"))
    host = urls.host(F.col("url"))
    p = _t(spark, d, "pages").withColumn("asset", asset)
    a, kind = F.col("asset"), urls.kind(F.col("asset"))
    return p.select("page_id", kind.alias("kind"), urls.is_video(a).alias("video"), captures.is_image(F.lit(None).cast("string"), a).alias("image"), captures.fits(F.col("html").cast("binary"), most=2500).alias("fits"), captures.wanted(kind, ["dataUri", "img"]).alias("wanted"), (urls.matches_domain(host, "example.org") | urls.matches_domain(host, "example.net")).alias("allowed"))


@query("""
WITH e AS (SELECT *, least(w, vw) * least(h, vh) / greatest(1.0, vw * vh) AS coverage FROM (SELECT p_size AS page_id, p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN 'img' ELSE 'div' END AS tag, CASE WHEN p_partkey % 5 = 0 THEN 'Main' END AS role, CASE p_partkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'fixed' ELSE 'sticky' END AS position, p_retailprice AS w, p_retailprice / 2 AS h, 1000.0 AS vw, 600.0 AS vh, CAST(p_partkey * 97 % 2000 AS DOUBLE) AS z FROM part)),
s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 2200)
SELECT page_id, pos, round(coverage, 6) AS coverage FROM s WHERE tag <> 'img' AND coalesce(lower(role), '') <> 'main' AND position IN ('fixed', 'sticky') AND coverage >= 0.55 AND z >= 999 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 120
""")
def q_overlays(spark, d):
    k = F.col("p_partkey")
    el = _t(spark, d, "part").select(
        F.col("p_size").alias("page_id"), k.alias("pos"), F.when(k % 4 == 0, "img").otherwise("div").alias("tag"), F.when(k % 5 == 0, "Main").alias("role"), F.lit(False).alias("aria_modal"), F.when(k % 3 == 0, "static").when(k % 3 == 1, "fixed").otherwise("sticky").alias("position"),
        F.col("p_retailprice").alias("width"), (F.col("p_retailprice") / 2).alias("height"), F.lit(1000.0).alias("view_width"), F.lit(600.0).alias("view_height"), (k * 97 % 2000).cast("double").alias("z"),
    )
    return reports.overlay_candidates(el).select("page_id", "pos", F.round("coverage", 6).alias("coverage"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS ok FROM lineitem), f AS (SELECT l_orderkey, min(l_linenumber) FILTER (ok) AS first_ok, max(l_linenumber) AS last FROM a GROUP BY l_orderkey),
t AS (SELECT l_orderkey, coalesce(first_ok <= 3, false) AS done, CASE WHEN coalesce(first_ok <= 3, false) THEN first_ok ELSE least(last, 3) END AS tries FROM f)
SELECT l_orderkey, done, CAST(tries AS INTEGER) AS tries, round(0.35 * (pow(2.0, tries - 1) - 1), 6) AS waited FROM t
""")
def q_job_outcomes(spark, d):
    a = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("ok"))
    return captures.job_outcomes(a, ["l_orderkey"], "l_linenumber", "ok")


@query("""
SELECT o_custkey, o_orderkey, lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(c AS VARCHAR))) AS INTEGER), '0') || '_' || o_orderstatus || '.png' AS entry, CAST((n - 1) % 4 AS INTEGER) AS worker
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
""")
def q_job_entries(spark, d):
    return captures.job_entries(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", F.concat("o_orderstatus", F.lit(".png"))).select("o_custkey", "o_orderkey", "entry", "worker")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber DESC, l_orderkey, l_partkey, l_extendedprice) AS INTEGER) AS place FROM lineitem WHERE l_linenumber > 5")
def q_queue_order(spark, d):
    li = _t(spark, d, "lineitem").where("l_linenumber > 5").withColumn("seq", F.struct("l_orderkey", "l_partkey", "l_extendedprice"))
    return captures.queue_order(li, "l_suppkey", "l_linenumber", "seq").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 AS episode FROM pages")
def q_episode_urls(spark, d):
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.concat(F.lit("https://h/Episode/"), n.cast("string"))).when(n % 5 == 0, F.concat(F.lit("https://h/x?a=1&cid="), n.cast("string"))).otherwise(F.concat(F.lit("https://h/episodes.html?incident="), n.cast("string")))
    return _t(spark, d, "pages").select("page_id", captures.episode_url(url).alias("episode"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'i' || o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'https://h/' || o_orderkey END AS url, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '' END AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, coalesce(nullif(id, ''), url, 'chapter-' || n) AS id, coalesce(nullif(name, ''), 'Chapter ' || n) AS title, url FROM r
""")
def q_chapter_records(spark, d):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("i"), k.cast("string"))).alias("id"), none.alias("url"), F.when(k % 3 == 0, F.concat(F.lit("https://h/"), k.cast("string"))).alias("href"), F.lit("").alias("title"), F.when(k % 5 == 0, F.col("o_orderpriority")).otherwise("").alias("name"))
    return captures.chapters(o, "o_custkey", "o_orderkey")


# Catalogues and stores ------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT o_custkey % 30 AS list, o_orderkey % 97 AS page, o_orderkey FROM orders WHERE o_orderkey % 11 <> 3 OR o_orderkey % 97 < 20),
p AS (SELECT list, page, row_number() OVER (PARTITION BY list ORDER BY page) - 1 AS n FROM (SELECT DISTINCT list, page FROM r))
SELECT r.list, r.page, o_orderkey FROM r JOIN p ON r.list = p.list AND r.page = p.page AND n = r.page
""")
def q_paged(spark, d):
    o = _t(spark, d, "orders").where("o_orderkey % 11 <> 3 or o_orderkey % 97 < 20").select((F.col("o_custkey") % 30).alias("list"), (F.col("o_orderkey") % 97).alias("page"), "o_orderkey")
    return readers.until_empty(o, "list", "page").select("list", "page", "o_orderkey")


@query("SELECT event_id AS id, CAST(0 AS INTEGER) AS pos, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events UNION ALL SELECT event_id, CAST(1 AS INTEGER), event_id, 'z' FROM events")
def q_json_records(spark, d):
    answer = F.concat(F.lit('{"data":{"list":{"nodes":[{"t":"'), "event_type", F.lit('",'), F.expr("substring(props, 2)"), F.lit(',{"k":'), F.col("event_id").cast("string"), F.lit(',"t":"z"}]}}}'))
    return readers.json_records(_t(spark, d, "events").select(F.col("event_id").alias("id"), answer.alias("answer")), "answer", "$.data.list.nodes", "k bigint, t string")


@query("""SELECT page_id AS id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS value FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<b>([^<]{0,30})', 1) AS l FROM pages))""")
def q_pattern_records(spark, d):
    return readers.pattern_records(_t(spark, d, "pages").select(F.col("page_id").alias("id"), "html"), "html", "<b>([^<]{0,30})")


@query("SELECT n_name AS connector, c_name AS title, 'https://h/' || c_custkey AS link, c_mktsegment AS read FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0")
def q_imported(spark, d):
    ids = _t(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("module"), F.col("n_name").alias("connector"))
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("module"), F.col("c_name").alias("title"), F.concat(F.lit("https://h/"), F.col("c_custkey").cast("string")).alias("link"), F.col("c_mktsegment").alias("read"))
    return readers.imported(c, ids)


@query("""
WITH s AS (SELECT 'p:' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS value, p_brand AS brand FROM part UNION ALL SELECT 'q:' || n_nationkey, n_name, NULL FROM nation)
SELECT key, value, brand FROM s WHERE starts_with(key, 'p:1') AND key NOT IN ('p:1', 'p:12') AND brand IN ('Brand#1', 'Brand#2', 'Brand#3')
""")
def q_store(spark, d):
    """A keyed store: put, remove, list by prefix, get by a secondary index."""
    p = _t(spark, d, "part")
    old = p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"), F.col("p_brand").alias("brand"))
    new = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), F.lit("new").alias("value"), F.lit(None).cast("string").alias("brand"))
    new = new.unionByName(_t(spark, d, "nation").select(F.concat(F.lit("q:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"), F.lit(None).cast("string").alias("brand")))
    listed = readers.with_prefix(readers.removed(readers.upserted(old, new, ["key"]), ["p:1", "p:12"]), "p:1")
    return readers.by_index(listed, "brand", spark.createDataFrame([(f"Brand#{i}",) for i in (1, 2, 3)], "brand string")).select("key", "value", "brand")


@query("""
WITH e AS (SELECT doc_id, unnest(range(0, 2)) AS pos, lang, source FROM documents)
SELECT doc_id AS feed_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'Über ' || source ELSE lang END AS title, CASE pos WHEN 0 THEN '/a/' || doc_id ELSE '/b' END AS link, pos = 0 AND doc_id % 2 = 0 AS locked FROM e WHERE lang IS NOT NULL AND source IS NOT NULL
""")
def q_feed(spark, d):
    i = F.col("doc_id").cast("string")
    xml = F.concat(F.lit("<feed><title>f</title><entry><id>1</id><title type='text'><![CDATA[Über "), "source", F.lit("]]></title><link rel=\"x\" href=\"/a/"), i, F.lit("\"/><g:locked>"), (F.col("doc_id") % 2 == 0).cast("string"), F.lit("</g:locked></entry>\n<entry a=\"b\"><title> "), "lang", F.lit(" </title><link href=\"/b\"/></entry></feed>"))
    return readers.atom_entries(_t(spark, d, "documents").where("lang is not null and source is not null").select(F.col("doc_id").alias("feed_id"), xml.alias("xml")))


@query("SELECT p_partkey AS id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN '/s/' || p_size ELSE '/h' END AS url FROM (SELECT *, unnest([0, 2]) AS pos FROM part)")
def q_page_list(spark, d):
    body = F.concat(F.lit('{"r":{"pages":[{"type":"main","src":"","url":"/s/'), F.col("p_size").cast("string"), F.lit('"},{"type":"link"},{"src":"/h","url":"/n"}]}}'))
    return readers.page_list(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body")), "body", "$.r.pages", ("src", "url"))


@query("""
SELECT page_id, CASE WHEN contains(url, '.example.org/') THEN 'org' WHEN regexp_matches(url, '^https://') THEN 'secure' END AS module, CASE WHEN contains(url, '.example.org/') THEN len(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) ELSE -1 END AS links FROM pages
""")
def q_modules(spark, d):
    """Site modules: each page goes to the first that takes its URL, and its method is called by name."""
    m = readers.Modules()

    def count(rows):
        return rows.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)).alias("links"))

    def none(rows):
        return rows.select("page_id", F.lit(-1).alias("links"))

    m.register("org", r"\.example\.org/", list_chapters=count, list_pages=none)
    m.register("secure", "^https://", list_chapters=none, list_pages=none)
    found = m.detect(_t(spark, d, "pages"))
    rest = none(found.where("module is null"))
    every = m.call("org", "list_chapters", found.where("module = 'org'")).unionByName(m.call("secure", "list_chapters", found.where("module = 'secure'"))).unionByName(rest)
    return found.select("page_id", "module").join(every, "page_id")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '(^|\\.)(example\\.net|www\\..*\\.example\\.com)$') OR lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) LIKE 'www.%'")
def q_denied(spark, d):
    patterns = spark.createDataFrame([("*://*.example.net/*",), ("*://*.example.net/*",), ("*://*/*",), ("nonsense",)], "pattern string").where("pattern <> '*://*/*'")
    p = _t(spark, d, "pages")
    secure = p.where(~urls.host(F.col("url")).startswith("www."))
    return lookups.denied(secure, urls.host(F.col("url")), patterns).select("page_id").unionByName(p.where(urls.host(F.col("url")).startswith("www.")).select("page_id"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'error')")
def q_family_flags(spark, d):
    flags = F.create_map(F.lit("view"), F.lit(False), F.lit("click"), F.lit(True), F.lit("error"), F.lit(False))
    return lookups.allowed_families(_t(spark, d, "events").select("event_id", "event_type"), "event_type", flags)


@query("""
SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus = 'F' END) IS TRUE OR (o_orderkey % 5) = 0 OR o_orderdate <= TIMESTAMP '1995-01-01' OR (CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END) > TIMESTAMP '1998-01-01'
""")
def q_access(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    freed = F.when(F.col("o_orderdate") <= F.lit(datetime(1995, 1, 1)), F.lit(datetime(1990, 1, 1))).cast("timestamp_ntz")
    until = F.when((k % 3 == 0) & (F.col("o_orderdate") > F.lit(datetime(1998, 1, 1))), F.lit(datetime(2030, 1, 1))).cast("timestamp_ntz")
    return o.where(curate.access_open(F.when(k % 7 != 0, F.col("o_orderstatus") == "F"), k % 5, freed, until, NOW)).select("o_orderkey")


@query("""
WITH p AS (SELECT p_partkey AS id, p_brand AS b, CASE WHEN p_partkey % 4 > 0 THEN p_size % 3 END AS w, CASE WHEN p_partkey % 5 > 0 THEN p_size % 2 END AS n, p_size AS r FROM part)
SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.b = b.b AND a.id < b.id WHERE coalesce(a.w = b.w, true) AND coalesce(a.n = b.n, true) AND abs(a.r - b.r) <= 1
""")
def q_metadata_prefilter(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    w, n = F.when(k % 4 > 0, size % 3), F.when(k % 5 > 0, size % 2)
    p = _t(spark, d, "part").where("p_size is not null").select("p_brand", k.alias("id"), *(x.alias(name) for name, x in zip(lookups.METADATA, (w, w, n, size, size), strict=True)))
    return lookups.metadata_pairs(p, "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 1")
def q_first_match(spark, d):
    return curate.first_match(_t(spark, d, "part").select("p_partkey", "p_name"), "RING", ("p_name",), "p_partkey")


@query("WITH f AS (SELECT lower(trim(o_orderpriority)) || (o_custkey % 40) AS key, count(*) AS files FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1), a AS (SELECT DISTINCT lower(trim(o_orderpriority)) || (o_custkey % 40) AS key FROM orders WHERE o_custkey % 2 = 0) SELECT coalesce(a.key, f.key) AS key, coalesce(files, 0) AS files, CASE WHEN a.key IS NULL THEN 'offline' WHEN f.key IS NULL THEN 'available' ELSE 'completed' END AS status FROM a FULL JOIN f ON a.key = f.key")
def q_file_status(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", F.concat(F.lit(" "), "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("title"))
    return lookups.file_status(o.where("o_custkey % 2 = 0"), o.where("o_custkey % 3 = 0"), "title")


@query("""
WITH c AS (SELECT DISTINCT c_nationkey AS a, (c_custkey % 25) AS b FROM customer WHERE c_nationkey <> c_custkey % 25), k AS (SELECT s_nationkey AS a, CAST(s_suppkey % 25 AS INTEGER) AS b, s_acctbal > 0 AS v FROM supplier),
n AS (SELECT least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS pair, max(v) AS verdict FROM k GROUP BY 1)
SELECT c.a AS id_a, CAST(c.b AS BIGINT) AS id_b, n.pair, n.verdict FROM c JOIN n ON least(CAST(c.a AS VARCHAR), CAST(c.b AS VARCHAR)) || '|' || greatest(CAST(c.a AS VARCHAR), CAST(c.b AS VARCHAR)) = n.pair
""")
def q_pair_cache(spark, d):
    pairs = _t(spark, d, "customer").select(F.col("c_nationkey").alias("id_a"), (F.col("c_custkey") % 25).alias("id_b")).where("id_a <> id_b").distinct()
    cache = _t(spark, d, "supplier").select(lookups.pair_key(F.col("s_suppkey") % 25, F.col("s_nationkey")).alias("pair"), (F.col("s_acctbal") > 0).alias("verdict"))
    return lookups.with_confirmed(pairs, cache).where("verdict is not null").select("id_a", "id_b", "pair", "verdict")


# Images: embeddings as 9 x 9 grids of grey, and of every third a turned copy with one changed value --------------------

_TURN = "list_transform(range(0, 81), lambda i: {0}[(8 - i % 9) * 9 + i // 9 + 1])"
_GRIDS = f"""
g AS (SELECT vec_id AS id, list_transform(range(0, 81), lambda i: CAST(floor(greatest(0.0, least(255.0, CAST(embedding[CAST(i % 64 AS INTEGER) + 1] AS DOUBLE) * 64 + 128))) AS BIGINT)) AS grid FROM embeddings),
t1 AS (SELECT id, grid, {_TURN.format("grid")} AS t FROM g), t2 AS (SELECT id, grid, t, {_TURN.format("t")} AS u FROM t1),
c AS (SELECT id + 1000000 AS id, CASE id % 2 WHEN 0 THEN t ELSE u END AS grid FROM t2 WHERE id % 3 = 0),
im AS (SELECT id, grid FROM g UNION ALL SELECT id, list_transform(range(0, 81), lambda i: CASE WHEN i = 40 AND (id - 1000000) % 5 <> 0 THEN 255 - grid[i + 1] ELSE grid[i + 1] END) FROM c),
r1 AS (SELECT id, grid, {_TURN.format("grid")} AS a FROM im), r2 AS (SELECT *, {_TURN.format("a")} AS b FROM r1), r3 AS (SELECT *, {_TURN.format("b")} AS c FROM r2),
f AS (SELECT id, unnest([0, 1, 2, 3]) AS turn, unnest([grid, a, b, c]) AS grid FROM r3),
hu AS (SELECT id, turn, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(0, 64), lambda i: CASE WHEN grid[(i // 8) * 9 + i % 8 + 1] > grid[(i // 8) * 9 + i % 8 + 2] THEN CAST(1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)), lambda x, y: x * 2 + y) AS h FROM f),
h AS (SELECT id, turn, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS h FROM hu)
"""


def _images(spark, d):
    grid = F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.get("embedding", i % 64).cast("double") * 64 + 128))).cast("smallint"))
    groups.folder(spark)
    own = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), grid.alias("grid")).checkpoint()  # stored columns, as images' grids are
    shown = F.when(F.col("id") % 2 == 0, imaging.turned(F.col("grid"), 9)).otherwise(imaging.turned(F.col("grid"), 9, 2))
    changed = F.transform(shown, lambda x, i: F.when((i == 40) & (F.col("id") % 5 != 0), 255 - x).otherwise(x))
    first, copy = F.struct("id", "grid"), F.struct((F.col("id") + 1_000_000).alias("id"), changed.alias("grid"))
    every = own.select(F.explode(F.when(F.col("id") % 3 == 0, F.array(first, copy)).otherwise(F.array(first))).alias("x")).select("x.*")
    return every.select("id", "grid", imaging.turn_hashes(F.col("grid")).alias("hashes"), F.col("id").alias("content"))


@query(f"WITH {_GRIDS} SELECT id, turn, h AS dhash FROM h")
def q_turn_hashes(spark, d):
    return _images(spark, d).select("id", F.posexplode("hashes").alias("turn", "dhash"))


@query(f"WITH {_GRIDS} SELECT a.id AS id_a, b.id AS id_b, CAST(min(bit_count(xor(a.h, b.h))) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id GROUP BY ALL HAVING min(bit_count(xor(a.h, b.h))) <= 4")
def q_near_images(spark, d):
    return lookups.near_images(_images(spark, d))


@query(f"WITH {_GRIDS} SELECT a.id AS id_a, b.id AS id_b, CAST(min(CASE WHEN a.id % 1000000 = b.id % 1000000 THEN 0 ELSE bit_count(xor(a.h, b.h)) END) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id GROUP BY ALL HAVING min(bit_count(xor(a.h, b.h))) <= 4")
def q_hash_shortcut(spark, d):
    """Equal contents (a copy keeps its original's number) have distance 0 without a comparison."""
    return lookups.near_images(_images(spark, d).withColumn("content", F.col("id") % 1_000_000))


@query("SELECT p_partkey, CAST(p_partkey % 10 AS INTEGER) * CAST(p_partkey % 10 BETWEEN 1 AND 8 AS INTEGER) + CAST(p_partkey % 10 NOT BETWEEN 1 AND 8 AS INTEGER) AS orientation FROM part")
def q_exif(spark, d):
    """Orientations of JPEG headers in both byte orders, after another segment; unknown ones are 1."""
    v = F.col("p_partkey") % 10
    little = F.concat(F.lit("49492A0008000000" "0200" "0F01020001000000" "00000000" "12010300" "01000000"), F.lpad(F.hex(v), 2, "0"), F.lit("000000"))
    big = F.concat(F.lit("4D4D002A00000008" "0001" "01120003" "00000001" "00"), F.lpad(F.hex(v), 2, "0"), F.lit("0000"))
    body = F.concat(F.lit("457869660000"), F.when(F.col("p_partkey") % 2 == 0, little).otherwise(big))
    size = F.lpad(F.hex(F.length(body) / 2 + 2), 4, "0")
    jpeg = F.unhex(F.concat(F.lit("FFD8" "FFE0000400FF" "FFE1"), size, body, F.lit("FFDA0000")))
    return _t(spark, d, "part").select("p_partkey", imaging.orientation(jpeg).alias("orientation"))


# Orders ---------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, node, CAST(i AS INTEGER) AS dom_order FROM (SELECT page_id, unnest(l) AS node, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1) AS l FROM pages)) WHERE i <= 20")
def q_dom_order(spark, d):
    return curate.stamped(_t(spark, d, "pages"), F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), 1), 20)


@query("""
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) % 5 END NULLS LAST, CASE WHEN event_id % 3 > 0 THEN event_id % 4 END NULLS LAST, CAST(event_id AS VARCHAR)) AS INTEGER) AS rank FROM events QUALIFY rank <= 4
""")
def q_dom_sort(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.floor("value") % 5).alias("dom_order"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 4).alias("seq"), F.col("event_id").cast("string").alias("name"))
    return curate.top_per_group(e, ["user_id"], curate.dom_order("dom_order", "seq", "name"), 4).select("user_id", "event_id", "rank")


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE lower(p_name) END, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 6")
def q_collated_names(spark, d):
    """Names with other cases and accents sort as without."""
    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.translate("p_name", "aei", "áêï"))
    p = _t(spark, d, "part").select("p_brand", "p_partkey", shown.alias("name"))
    return curate.top_per_group(p, ["p_brand"], curate.name_order("name", "p_partkey"), 6).select("p_brand", "p_partkey", "rank")


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_size DESC, p_type, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 6")
def q_title_order(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_partkey", F.initcap("p_name").alias("title"), "p_size", "p_type")
    return curate.top_per_group(p, ["p_brand"], curate.title_order("title", "p_size", "p_type", "p_partkey"), 6).select("p_brand", "p_partkey", "rank")


@query("SELECT path FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'x/cover.json' || chr(CAST(97 + p_partkey % 26 AS INTEGER)) ELSE 'data/' || (p_partkey * 7 % 1000) || '/' || p_partkey || '.json' END AS path, p_partkey FROM part) ORDER BY TRY_CAST(nullif(regexp_extract(path, '(\\d+)', 1), '') AS INTEGER) NULLS LAST, path LIMIT 700")
def q_natural(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("x/cover.json"), F.char(97 + k % 26))).otherwise(F.concat(F.lit("data/"), (k * 7 % 1000).cast("string"), F.lit("/"), k.cast("string"), F.lit(".json")))
    return curate.natural(_t(spark, d, "part").select(path.alias("path")), "path").limit(700)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 44 OFFSET 88")
def q_row_window(spark, d):
    return curate.page_of_rows(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], scroll=2000, row_height=20, visible=20)


@query("""
WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM a)
SELECT user_id, run, event_type, max(ts) AS run_end, count(*) AS run_rows FROM b GROUP BY user_id, run, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run DESC) <= 5
""")
def q_notices(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return curate.last_runs(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"], "ts").select("user_id", "run", "event_type", "run_end", "run_rows")


@query("""
WITH RECURSIVE x AS (SELECT p_partkey, 0 AS i, CAST(p_partkey + 1 AS BIGINT) AS s FROM part UNION ALL SELECT p_partkey, i + 1, xor(xor(a, a >> 17), (xor(a, a >> 17) << 5) & 4294967295) FROM (SELECT p_partkey, i, xor(s, (s << 13) & 4294967295) AS a FROM x WHERE i < 9))
SELECT p_partkey, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY s, i) AS tiles FROM x WHERE i > 0 GROUP BY p_partkey
""")
def q_tile_order(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.transform(reports.tile_order(F.lit(3), F.col("p_partkey") + 1), lambda x: x.cast("string")), ",").alias("tiles"))


# Sets -----------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT lower(trim(k)) AS k FROM (SELECT p_type AS k FROM part UNION ALL SELECT ' ' || upper(p_name) FROM part UNION ALL SELECT n_name FROM nation) WHERE trim(k) <> ''")
def q_keyword_union(spark, d):
    p = _t(spark, d, "part")
    return keep.united([p.select(F.col("p_type").alias("k")), p.select(F.concat(F.lit(" "), F.upper("p_name")).alias("k")), _t(spark, d, "nation").select(F.col("n_name").alias("k"))], "k")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def q_delete_keys(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    left = keep.without_keys(li, _t(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])
    return keep.only_valid(left, _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


# Field functions ------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'svg' WHEN 1 THEN 'jpg' WHEN 2 THEN 'ico' WHEN 3 THEN 'xcfx' ELSE '' END AS ext, CASE WHEN p_partkey % 3 = 0 THEN 'webp' WHEN p_partkey % 3 = 1 THEN 'jpg' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'tmp' ELSE 'data' END END AS format FROM part
""")
def q_formats(spark, d):
    k = F.col("p_partkey")
    mime = F.when(k % 5 == 0, "image/SVG+xml").when(k % 5 == 1, " image/jpeg; q=1").when(k % 5 == 2, "image/x-icon").when(k % 5 == 3, "image/xcf-x").otherwise("text/html")
    a = F.when(k % 3 == 0, "WEBP").when(k % 3 == 1, "bin")
    return _t(spark, d, "part").select("p_partkey", text.mime_extension(mime).alias("ext"), text.first_known_format(F.lit(""), a, F.when(k % 3 == 1, "JPEG").when((k % 3 == 2) & (k % 2 == 0), "tmp")).alias("format"))


_HEADS = ("89504E470D0A1A0A", "FFD8FFE000", "474946383961", "52494646000000005745425056", "00000100", "424D0000", "49492A00", "4D4D002A", "000000186674797061766966", "3C3F786D6C2076657273696F6E3D22312E30223F3E0A3C212D2D2061206C6F6E6720636F6D6D656E74202D2D3E3C73766720", "524946460000000057415645")
_MIMES = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/x-icon", "image/bmp", "image/tiff", "image/tiff", "image/avif", "image/svg+xml", "")


@query(f"SELECT p_partkey, {list(_MIMES)}[CAST(p_partkey % 11 AS INTEGER) + 1] AS mime FROM part")
def q_sniffed(spark, d):
    heads = F.array(*(F.lit(h) for h in _HEADS))
    return _t(spark, d, "part").select("p_partkey", text.sniffed_mime(F.unhex(F.get(heads, (F.col("p_partkey") % 11).cast("int")))).alias("mime"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Vol. ' || p_size || ' Chapter ' || p_partkey || '.5 ' || p_name WHEN 1 THEN 'volume' || p_size || ' ' || p_name ELSE p_name || ' ch.' || p_size END AS t, CAST(p_size AS VARCHAR) AS s, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad(s, 3, '0') || '/' || CASE WHEN length(k) >= 4 THEN k ELSE lpad(k, 4, '0') END || '.5' WHEN 1 THEN lpad(s, 3, '0') || '/' ELSE '/' || lpad(s, 4, '0') END || ' [' || t || ']' AS title FROM t
""")
def q_titles(spark, d):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    n = F.col("p_partkey") % 3
    title = F.when(n == 0, F.concat(F.lit("Vol. "), size, F.lit(" Chapter "), k, F.lit(".5 "), "p_name")).when(n == 1, F.concat(F.lit("volume"), size, F.lit(" "), "p_name")).otherwise(F.concat("p_name", F.lit(" ch."), size))
    return _t(spark, d, "part").select("p_partkey", text.chapter_title(title, "%VOL%/%CH% [%O%]", F.lit("m"), F.lit("c")).alias("title"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'blocked' WHEN 2 THEN 'timeout' WHEN 3 THEN 'auth' END AS class FROM events")
def q_error_class(spark, d):
    n = F.col("event_id") % 5
    message = F.when(n == 0, "HTTP 403").when(n == 1, "TypeError: Fetch failed").when(n == 2, "Request TIMED OUT").when(n == 3, "network: login needed").otherwise("no such file")
    return _t(spark, d, "events").select("event_id", text.error_class(message).alias("class"))


@query("""
WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'MANGA' ELSE 'other' END AS mode, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS enabled, CAST(value AS BIGINT) AS workers FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'manga' ELSE 'image' END AS mode, coalesce(enabled, true) AS enabled, 'auto' AS loader, greatest(2, least(40, CAST(json_extract(props, '$.k') AS BIGINT))) AS workers FROM s JOIN events USING (event_id)
""")
def q_settings(spark, d):
    """Settings merged leaf by leaf with defaults; names are checked, numbers clamped."""
    n = F.col("event_id")
    given = F.concat(F.lit('{"mode":"'), F.when(n % 2 == 0, "MANGA").otherwise("other"), F.lit('","manga":{'), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit('"enabled":'), (n % 3 == 1).cast("string"))), F.lit('},"more":1}'))
    schema = "mode string, manga struct<enabled:boolean,loader:string>"
    e = _t(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"), F.from_json(given, schema).alias("given"), F.from_json(F.lit('{"mode":"image","manga":{"enabled":true,"loader":"auto"}}'), schema).alias("defaults"))
    merged = text.merged_settings(F.col("defaults"), F.col("given"), {"mode": "string", "manga": {"enabled": "boolean", "loader": "string"}})
    e = e.withColumn("s", merged)
    return e.select("event_id", text.safeguarded(F.col("s.mode"), ("image", "manga"), "image").alias("mode"), F.col("s.manga.enabled").alias("enabled"), text.safeguarded(F.col("s.manga.loader"), ("runner", "manager", "auto"), "auto").alias("loader"), text.clamped(F.col("p.k"), 2, 40).alias("workers"))


@query("SELECT p_partkey, 'i' || p_partkey AS id, p_size AS x, -p_size AS y, CAST(p_size * 2 AS INTEGER) AS w, 10 AS h, CAST(p_partkey % 7 AS INTEGER) AS dx, -3 AS dy FROM part WHERE p_partkey % 4 > 0")
def q_coords(spark, d):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    raw = F.concat(F.lit("i"), k, F.when(F.col("p_partkey") % 4 == 0, ";").otherwise(":"), s.cast("string"), F.lit(","), (-s).cast("string"), F.lit("+"), (s * 2).cast("string"), F.lit(",10>"), (F.col("p_partkey") % 7).cast("string"), F.lit(",-3"))
    return _t(spark, d, "part").select("p_partkey", text.coords(raw).alias("c")).where("c is not null").select("p_partkey", "c.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN CAST(floor(p_retailprice + 0.5) AS BIGINT) ELSE 0 END AS n FROM part")
def q_positive_ints(spark, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, "12px").when(k == 1, F.col("p_retailprice").cast("string")).otherwise(F.concat(F.lit("-"), F.col("p_retailprice").cast("string")))
    return _t(spark, d, "part").select("p_partkey", text.positive_int(raw).alias("n"))


@query("SELECT page_id, u AS url, regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)), '^.*\\.(example\\.[a-z]+)$', '\\1') = 'example.org' AS ours FROM (SELECT page_id, url AS u FROM pages)")
def q_domain_match(spark, d):
    host = urls.host(F.col("url"))
    return _t(spark, d, "pages").select("page_id", "url", urls.matches_domain(host, "example.org").alias("ours"))


# Logs and roll-ups ----------------------------------------------------------------------------------------------------


@query("SELECT user_id AS scan, count(*) AS candidates, count(*) FILTER (value >= 10) AS fetched, " + ", ".join(f"count(*) FILTER (event_id % 3 + 1 = {n} AND (event_type = 'view') = {b}) AS l{n}_{k}" for n in (1, 2, 3) for k, b in (("new", "false"), ("dup", "true"))) + ", count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def q_scan_counters(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("scan"), (F.col("event_id") % 3 + 1).alias("layer"), (F.col("event_type") == "view").alias("dup"), (F.col("event_type") == "error").alias("failed"), (F.col("value") >= 10).alias("fetched"))
    return reports.scan_counters(e, "scan", "layer", "dup", "failed", "fetched")


@query("SELECT count(*) AS total, count(*) FILTER (NOT seen) AS fresh, count(*) FILTER (seen) AS seen, count(*) FILTER (n_chars >= 500) AS visible, count(*) FILTER (lang = 'en') AS selected FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS seen FROM documents)")
def q_discovery(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    s = groups.hash_status(docs, "h", [F.col("id")])
    return reports.discovery(s, F.col("status") == "DUP", F.col("n_chars") >= 500, F.col("lang") == "en")


@query("""
WITH a AS (SELECT user_id, event_type, event_id, ts, event_type <> 'error' AS ok FROM events)
SELECT user_id, event_type, bool_or(ok) AS succeeded, arg_min(event_id, (ts, event_id)) FILTER (ok) AS response FROM a GROUP BY user_id, event_type
""")
def q_first_success(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("response"))
    return timed.first_success(e, ["user_id", "event_type"], "ok", "at", "response").select("user_id", "event_type", "succeeded", "response")


@query("SELECT p_partkey, round(0.5 * pow(2.0, p_size % 6), 6) AS delay FROM part")
def q_retry_delays(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(timed.retry_delays(F.col("p_size") % 6), 6).alias("delay"))


# A stream over the table, run until its input ends --------------------------------------------------------------------


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def q_progress_stream(spark, d):
    """Each key once, whatever overlapping batches bring; written every time the trigger fires."""
    from pagelens.streaming import state

    e = spark.readStream.schema(_t(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = state.progress_batches(e.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", late="10000 days")
    return state.replayed(rows).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))

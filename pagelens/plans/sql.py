"""SQL of the same meaning for the queries of plans.catalog, as DuckDB runs it. q_crc and q_zip_pack have none: it has no CRC-32 and no archives."""

from __future__ import annotations

_GREY = "list_transform(embedding, lambda x: CAST(floor(greatest(0.0, least(255.0, CAST(x AS DOUBLE) * 64 + 128))) AS BIGINT))"
_GRID = f"SELECT vec_id, list_concat(g[1:64], g[1:8]) AS grey FROM (SELECT vec_id, {_GREY} AS g FROM embeddings)"
_WIDE = f"SELECT vec_id, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(0, 64), lambda i: CASE WHEN grey[(i // 8) * 9 + i % 8 + 1] > grey[(i // 8) * 9 + i % 8 + 2] THEN CAST(1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)), lambda h, b: h * 2 + b) AS u FROM ({_GRID})"
_HASH = f"SELECT vec_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS h FROM ({_WIDE})"
_HASHES = f"SELECT vec_id AS id, h FROM ({_HASH}) UNION ALL SELECT vec_id + 1000000, xor(h, CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 7 END) FROM ({_HASH}) WHERE vec_id % 3 = 0"
_SHOWN = f"SELECT vec_id, list_transform(grey, lambda x: CAST(x AS DOUBLE)) AS g FROM ({_GRID}) UNION ALL SELECT vec_id + 1000000, list_transform(range(0, 72), lambda i: CASE WHEN i % 9 = 0 THEN greatest(0.0, CAST(grey[i + 1] AS DOUBLE) - 8) ELSE CAST(grey[i + 1] AS DOUBLE) END) FROM ({_GRID})"


def _near(most: int) -> str:
    return f"SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM ({_HASHES}) a JOIN ({_HASHES}) b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= {most}"


_STEPS = "SELECT user_id, event_id, ts, value, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_BARE = "regexp_replace(url, '[?#].*$', '')"
_FOLDER = f"regexp_replace(lower(regexp_extract({_BARE}, '^(.*)/[^/]*$', 1)), '/+$', '')"
_NAME = f"regexp_extract({_BARE}, '/([^/]+)$', 1)"
_SOURCE = f"CASE WHEN regexp_matches(url, '^(http|https|file):') AND {_NAME} <> '' AND contains({_FOLDER}, '://') THEN {_FOLDER} END"
_LATE = "ts <= TIMESTAMP '2024-01-15'"

ORACLE_SQL = {
    "q_l1_exact_dup": "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER w AS canonical_id, CASE WHEN row_number() OVER (w ORDER BY doc_id) = 1 THEN 'NEW' ELSE 'DUP' END AS status FROM documents WINDOW w AS (PARTITION BY sha256(text))",
    "q_hash_groups": "SELECT 'l1:' || sha256(text) AS group_id, min(doc_id) AS representative_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents GROUP BY sha256(text) HAVING count(*) > 1",
    "q_scan_stats": "SELECT source, count(*) AS found, count(*) FILTER (n = 1) AS fresh, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (n_chars < 100) AS small, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) GROUP BY source",
    "q_occurrence_groups": "WITH t AS (SELECT doc_id, sha1(text) AS content, source, CASE WHEN lag(source) OVER (PARTITION BY text ORDER BY doc_id) = source THEN 0 ELSE 1 END AS turn FROM documents) SELECT content, min(doc_id) AS first_seen, max(doc_id) AS last_seen, CAST(sum(turn) AS BIGINT) AS seen_count, CASE WHEN sum(turn) = 1 THEN 'new' ELSE 'seen' END AS discovery FROM t GROUP BY content",
    "q_keep_best": "WITH t AS (SELECT l_partkey, l_quantity AS area, l_extendedprice AS size, l_orderkey * 10 + l_linenumber AS pos FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY area DESC, size DESC, pos) AS n, min(pos) OVER (PARTITION BY l_partkey) AS position FROM t) SELECT l_partkey, area, size, pos AS own_pos, position FROM r WHERE n = 1",
    "q_keep_latest": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
    "q_keep_first": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1",
    "q_keep_preferred": "SELECT p_brand, p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, lower(p_name), p_partkey) AS n FROM part) WHERE n = 1",
    "q_dedupe_key": f"SELECT page_id, coalesce(({_SOURCE}) || '::' || lower(trim({_NAME})), 'url:' || url) AS dedupe_key FROM pages",
    "q_filter_sort": "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE contains(lower(p_name || ' ' || p_type), 'a') AND p_size >= 10 ORDER BY p_size DESC, p_partkey",
    "q_summary_counts": "SELECT count(*) AS total, count(*) FILTER (value >= 50) AS visible, count(*) FILTER (event_type = 'click') AS selected, count(DISTINCT user_id) AS users FROM events",
    "q_name_sort": "SELECT * FROM (SELECT p_brand, p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 5",
    "q_serial_rename": "SELECT p_brand, p_partkey, lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(c AS VARCHAR))) AS INTEGER), '0') || '.png' AS serial_name FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS c FROM part)",
    "q_collision_suffix": "SELECT c_custkey, folder, name, CASE WHEN n = 0 THEN name ELSE replace(name, '.png', '') || ' (' || n || ').png' END AS unique_name FROM (SELECT c_custkey, c_mktsegment AS folder, 'n' || c_nationkey || '.png' AS name, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)",
    "q_collision_exact": "SELECT c_custkey, folder, name, CASE WHEN n = 0 THEN name ELSE replace(name, '.png', '') || ' (' || n || ').png' END AS unique_name FROM (SELECT c_custkey, c_mktsegment AS folder, 'n' || c_nationkey || '.png' AS name, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)",
    "q_consecutive_collapse": "WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM a) SELECT user_id, run, event_type, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_rows FROM b GROUP BY user_id, run, event_type",
    "q_recent_tags": "SELECT * FROM (SELECT user_id, event_type, max(event_id) AS last_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS INTEGER) AS rank FROM events GROUP BY user_id, event_type) WHERE rank <= 3",
    "q_topk_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 2",
    "q_detection_ordinal": "SELECT user_id, min(event_id) AS first_id, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS ordinal FROM events GROUP BY user_id",
    "q_union_persist": "WITH t AS (SELECT user_id, event_type AS kind, value, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' OR event_type IN ('purchase', 'signup')) SELECT user_id, kind, max(value) AS value, min(event_id) AS position FROM t GROUP BY user_id, kind",
    "q_append_unseen": "WITH a AS (SELECT * FROM events WHERE event_id % 2 = 0), b AS (SELECT * FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = e.user_id AND a.event_type = e.event_type)) SELECT user_id, count(*) AS kept FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY user_id",
    "q_set_diff": "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "q_set_intersect": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "q_set_symdiff": "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "q_links": "SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages))",
    "q_chapter_links": "SELECT page_id, target, CAST(min(i) - 1 AS INTEGER) AS pos FROM (SELECT page_id, i, regexp_replace(l[i], '#.*$', '') AS target FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages))) GROUP BY page_id, target",
    "q_url_parts": f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, {_BARE} AS bare, regexp_extract({_BARE}, '([^/]*)$', 1) AS file_name, CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN url ELSE {_BARE} || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || regexp_extract(url, '(#.*)$', 1) END AS canonical, {_SOURCE} AS source_link FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: split_part(p, '=', 1) NOT IN ('ref', 'utm_source')), '&') AS kept FROM pages)",
    "q_host_suffix_join": f"WITH c(entry_id, position, domain) AS (VALUES ('net-all', 2, 'example.net'), ('org-www', 0, 'www.example.org'), ('org-all', 1, 'example.org'), ('com-all', 3, 'example.com')), p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, arg_min(entry_id, position) AS entry_id FROM p LEFT JOIN c ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id, host",
    "q_keyword_match": "WITH c AS (SELECT page_id, lower(unnest(regexp_extract_all(html, 'class=\"([^\"]*)\"', 1))) AS cls FROM pages), k AS (SELECT page_id, CASE WHEN list_contains(regexp_split_to_array(cls, '[^a-z0-9_-]+'), 'ad') THEN 'ad' WHEN contains(cls, 'overlay') THEN 'overlay' WHEN contains(cls, 'banner') THEN 'banner' END AS keyword FROM c) SELECT page_id, keyword, count(*) AS n FROM k WHERE keyword IS NOT NULL GROUP BY page_id, keyword",
    "q_alias_join": "SELECT n_nationkey, n_name, CASE lower(trim(n_name)) WHEN 'france' THEN 'FR' WHEN 'germany' THEN 'DE' WHEN 'japan' THEN 'JP' WHEN 'united states' THEN 'US' ELSE trim(n_name) END AS canonical FROM nation",
    "q_url_semi": f"WITH k AS (SELECT {_BARE} AS bare FROM pages WHERE page_id % 3 = 0) SELECT page_id FROM pages WHERE url IN (SELECT bare FROM k) OR {_BARE} IN (SELECT bare FROM k)",
    "q_detection_rank": "WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS stage FROM events GROUP BY user_id, event_type) SELECT * FROM (SELECT user_id, event_type, CAST(stage AS INTEGER) AS stage, CAST(row_number() OVER (PARTITION BY user_id ORDER BY stage, event_id) AS INTEGER) AS rank FROM f) WHERE rank <= 3",
    "q_monthly_milestone": "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS lifetime FROM m) SELECT m.month, m.n, coalesce(b.n, 0) AS previous_n, (lifetime >= 1500 OR m.n >= 300 OR coalesce(b.n, 0) >= 300) AS prompt FROM m LEFT JOIN m b ON b.month = strftime(CAST(m.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m'), t",
    "q_ttl_cache": f"SELECT user_id, event_type, max(ts) AS last_touch, count(*) AS touches FROM events WHERE {_LATE} GROUP BY user_id, event_type HAVING max(ts) >= TIMESTAMP '2024-01-14'",
    "q_host_history": f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS last_touch FROM events WHERE {_LATE} GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-14 12:00:00' ORDER BY last_touch DESC, user_id LIMIT 200",
    "q_budget_evict": "SELECT * FROM (SELECT user_id, event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS total_size, CAST(row_number() OVER w AS INTEGER) AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE total_size <= 1000 AND rank <= 20",
    "q_debounce": "WITH a AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bef FROM a WHERE nxt IS NULL OR nxt >= ts + INTERVAL 3600 SECOND) SELECT user_id, event_id, event_type FROM b WHERE bef IS NULL OR bef <> event_type",
    "q_req_resp_join": "SELECT user_id, view_id, event_id AS click_id FROM (SELECT *, lag(event_type) OVER w AS k, lag(ts) OVER w AS t, lag(event_id) OVER w AS view_id FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type DESC)) WHERE event_type = 'click' AND k = 'view' AND ts <= t + INTERVAL 3600 SECOND",
    "q_circuit_breaker": f"WITH RECURSIVE e AS ({_STEPS}), s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, 0 AS c, CAST(NULL AS TIMESTAMP) AS until, false AS blocked FROM events UNION ALL SELECT e.user_id, e.n, e.event_id, e.ts, CASE WHEN s.until > e.ts THEN s.c WHEN NOT e.failed THEN 0 WHEN s.until <= e.ts THEN 1 ELSE s.c + 1 END, CASE WHEN s.until > e.ts THEN s.until WHEN e.failed AND CASE WHEN s.until <= e.ts THEN 1 ELSE s.c + 1 END >= 2 THEN e.ts + INTERVAL 86400 SECOND END, coalesce(s.until > e.ts, false) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) SELECT user_id, event_id, ts, blocked FROM s WHERE n > 0",
    "q_throttle": f"WITH RECURSIVE e AS ({_STEPS}), s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS TIMESTAMP) AS free, false AS keep FROM events UNION ALL SELECT e.user_id, e.n, e.event_id, e.ts, CASE WHEN e.ts < s.free THEN s.free ELSE e.ts + INTERVAL 10800 SECOND END, NOT coalesce(e.ts < s.free, false) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) SELECT user_id, event_id, ts, ts + INTERVAL 3600 SECOND AS fires_at FROM s WHERE keep",
    "q_scroll_distance": f"WITH RECURSIVE e AS ({_STEPS}), s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS total, CAST(NULL AS TIMESTAMP) AS run, false AS keep FROM events UNION ALL SELECT user_id, n, event_id, ts, value, CASE WHEN fire THEN moved % 200 ELSE moved END, CASE WHEN fire THEN ts ELSE run END, fire FROM (SELECT *, moved >= 200 AND (run IS NULL OR ts >= run + INTERVAL 3600 SECOND) AS fire FROM (SELECT e.user_id, e.n, e.event_id, e.ts, e.value, s.run, s.total + coalesce(abs(e.value - s.y), 0) AS moved FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))) SELECT user_id, event_id, ts, total AS carried FROM s WHERE keep",
    "q_elements": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:a|div|p|li)(?: [^>]*)?>')) AS t FROM pages) SELECT page_id, regexp_extract(t, '^<([a-z]+)', 1) AS tag, count(*) AS n, count(*) FILTER (contains(t, 'class=\"ad\"')) AS ads FROM t GROUP BY ALL",
    "q_safe_names": "SELECT p_partkey, p_name || '.jpg' AS file_name, CASE WHEN n < 1048576 THEN CAST(CAST(floor(n / 1024 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' ELSE CAST(round(CAST(n / 1048576 AS DECIMAL(18, 9)), 1) AS DECIMAL(9, 1)) || ' MB' END AS shown_size, CAST(round(CAST(ms / 1000 AS DECIMAL(18, 9)), 1) AS DECIMAL(9, 1)) || ' s' AS shown_time FROM (SELECT p_partkey, p_name, p_retailprice * 1000 AS n, p_retailprice * 10 AS ms FROM part)",
    "q_valid_fact": "WITH c AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2), f AS (SELECT user_id, ts AS fact_at, max(value) AS fact FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT c.user_id, c.event_id, CASE WHEN f.fact_at >= c.ts - INTERVAL 1 DAY THEN f.fact END AS fact FROM c ASOF LEFT JOIN f ON c.user_id = f.user_id AND c.ts >= f.fact_at",
    "q_dhash": f"SELECT vec_id, h AS dhash FROM ({_HASH})",
    "q_dhash_bands": _near(4),
    "q_ssim_pairs": f"WITH p AS ({_near(2)}), g AS ({_SHOWN}), u AS (SELECT id_a, id_b, unnest(a.g) AS x, unnest(b.g) AS y FROM p JOIN g a ON a.vec_id = id_a JOIN g b ON b.vec_id = id_b) SELECT id_a, id_b, round((2 * avg(x) * avg(y) + 6.5025) * (2 * covar_pop(x, y) + 58.5225) / ((avg(x) * avg(x) + avg(y) * avg(y) + 6.5025) * (var_pop(x) + var_pop(y) + 58.5225)), 6) AS score FROM u GROUP BY id_a, id_b",
    "q_dup_components": f"WITH RECURSIVE p AS ({_near(2)}), q AS (SELECT id_a, id_b FROM p UNION ALL SELECT vec_id, vec_id + 3 FROM embeddings WHERE vec_id % 6 = 0), e AS (SELECT id_a AS x, id_b AS y FROM q UNION SELECT id_b, id_a FROM q), r AS (SELECT x AS node, x AS reach FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x) SELECT node, min(reach) AS component FROM r GROUP BY node",
    "q_full_outer_status": "SELECT coalesce(c.c_custkey, o.key) AS key, coalesce(o.files, 0) AS files, CASE WHEN c.c_custkey IS NOT NULL AND o.files IS NOT NULL THEN 'completed' WHEN c.c_custkey IS NOT NULL THEN 'available' ELSE 'offline' END AS status FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c FULL OUTER JOIN (SELECT o_custkey AS key, count(*) AS files FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.key",
    "q_props_json": "SELECT event_id, greatest(0, least(50, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 10))) AS k FROM events",
    "q_text_hash": "WITH t AS (SELECT p_partkey, p_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part) SELECT p_partkey, h AS h32, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS signed32, sha1(p_name) AS prefix_sha1 FROM t",
    "q_viewer_rollup": "SELECT user_id, bool_or(event_type = 'purchase') AS ok, bool_or(event_type = 'error') AS detected, CAST(max(floor(value)) AS BIGINT) AS pages FROM events GROUP BY user_id",
    "q_merged_counters": "SELECT l_suppkey, CAST(greatest(floor(sum(l_quantity) - 1000), floor(round(sum(l_discount), 4)), 0) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey",
    "q_archive_names": "SELECT o_custkey, CASE WHEN count(DISTINCT f) = 1 THEN max(f) || '.zip' WHEN count(DISTINCT f) > 1 THEN 'chapters.zip' ELSE 'zippedimages.zip' END AS archive_name, count(DISTINCT f) AS folders FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS f FROM orders) GROUP BY o_custkey",
    "q_telemetry": "WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS n FROM events) SELECT user_id, count(*) AS pages, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'view') AS retries, CAST(floor(epoch(max(ts) - min(ts))) AS BIGINT) AS seconds, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (event_type = 'error' AND n <= 5), '') AS first_failures FROM f GROUP BY user_id",
    "q_group_names": "WITH b AS (SELECT c_mktsegment, c_custkey // 3 AS bundle, c_nationkey FROM customer GROUP BY ALL) SELECT c_mktsegment, bundle, string_agg(n_name, ',' ORDER BY c_nationkey) AS names FROM b JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, bundle HAVING NOT bool_and(n_regionkey = 0)",
    "q_placeholder": "SELECT o_custkey AS key, o_orderkey, coalesce(c_name, 'unknown:' || o_custkey) AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey",
    "q_chapter_marks": "SELECT l_suppkey AS connector, count(*) FILTER ((l_orderkey % 7 = 0 AND l_returnflag = 'R') OR (l_orderkey % 11 = 0 AND l_linenumber = 1)) AS marked, count(*) AS chapters FROM lineitem GROUP BY l_suppkey",
    "q_family_rank": "WITH m(family, confidence, p) AS (VALUES ('madara', 0.7, 'class=\"ad\"'), ('speedbinb', 0.95, '<table'), ('coreview', 0.85, '<li>'), ('foolslide', 0.55, '<h1>')) SELECT page_id, family, CAST(confidence AS DOUBLE) AS confidence, CAST(row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, family) AS INTEGER) AS rank FROM pages, m WHERE contains(html, p)",
    "q_part_ranges": "SELECT doc_id, CAST(i AS INTEGER) AS part, (i * 1024) || '-' || least(i * 1024 + 1023, n_chars - 1) AS bytes FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(ceil(n_chars / 1024.0) AS BIGINT))) AS i FROM documents)",
    "q_tile_geometry": "WITH q AS (SELECT p_partkey, floor(p_retailprice) AS w, p_size * 10 AS h FROM part), z AS (SELECT p_partkey, CAST(greatest(1, CASE WHEN floor(w / 32) > 0 THEN floor(w / 32) * 8 WHEN floor(w / 4) > 0 THEN floor(w / 4) ELSE w END) AS INTEGER) AS tile_width, CAST(greatest(1, CASE WHEN floor(h / 32) > 0 THEN floor(h / 32) * 8 WHEN floor(h / 4) > 0 THEN floor(h / 4) ELSE h END) AS INTEGER) AS tile_height FROM q) SELECT p_partkey, tile_width, tile_height, tile_width * 4 AS canvas_width, tile_height * 4 AS canvas_height FROM z",
    "q_stopped_scans": "SELECT event_id, user_id AS scan_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.user_id = e.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 36000 SECOND)",
}

"""The contract queries of the corpus operators, by name; SQL where it can express them."""

from __future__ import annotations

from pagelens.llm.decontamination import op5_decontamination
from pagelens.llm.language_id import op7_language_id
from pagelens.llm.lm_scoring import op8_lm_scoring
from pagelens.llm.ngram_join import op3_ngram_jaccard
from pagelens.llm.packing import op1_packing
from pagelens.llm.passages import op6_substring_dedup
from pagelens.llm.quality_rules import op4_quality_rules
from pagelens.llm.suffix_dedup import op10_suffix_array
from pagelens.llm.toxicity import op2_toxicity
from pagelens.llm.url_filters import op9_url_filters

QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_url_filters": op9_url_filters,
    "op10_suffix_array": op10_suffix_array,
}

_WORDS = r"SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents"

ORACLE_SQL = {
    "op3_ngram_jaccard": f"""
WITH RECURSIVE d AS ({_WORDS}),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [chr(10) || array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM g),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, l.y FROM r JOIN l ON r.reach = l.x)
SELECT g.doc_id, len(g.g) AS n_shingles, c.component_id FROM g JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON g.doc_id = c.node
""",
    "op8_lm_scoring": f"""
WITH d AS ({_WORDS}),
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
n AS (SELECT count(*) AS n FROM t),
b AS (SELECT doc_id, i, w, coalesce(lag(w) OVER p, ' ') AS v, CASE WHEN i > 1 THEN coalesce(lag(w, 2) OVER p, ' ') END AS u FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w UNION ALL SELECT ' ', count(*) FROM t WHERE i = 1),
c2 AS (SELECT v, w, count(*) AS c FROM b GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM b WHERE i > 1 GROUP BY u, v, w),
x AS (SELECT b.doc_id, count(*) AS n_tokens, sum(CASE WHEN c3.c >= 2 THEN ln(c3.c) - ln(uv.c) WHEN c2.c >= 2 THEN ln(c2.c) - ln(cv.c) + CASE WHEN b.i > 1 THEN ln(0.4) ELSE 0 END ELSE ln(cw.c) - ln((SELECT n FROM n)) + CASE WHEN b.i > 1 THEN 2 ELSE 1 END * ln(0.4) END) AS total FROM b JOIN c2 ON b.v = c2.v AND b.w = c2.w JOIN c1 cv ON b.v = cv.w JOIN c1 cw ON b.w = cw.w LEFT JOIN c3 ON b.u = c3.u AND b.v = c3.v AND b.w = c3.w LEFT JOIN c2 uv ON b.u = uv.v AND b.v = uv.w GROUP BY b.doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(total, 4) AS log_prob, round(exp(-total / n_tokens), 3) AS perplexity FROM d LEFT JOIN x ON d.doc_id = x.doc_id
""",
}

"""URL filters: listed rules first, then association rules mined from labelled URLs.

A listed rule (verdict, host, path) fits its host and all subdomains if the
URL's path starts with the rule's path; the longest fitting rule wins.

URLs that no listed rule fits are judged by mined rules. A URL's tokens are its
scheme, host labels and suffixes, path segments (digits as #) and query names.
FP-growth finds token combinations that occur with a label, "block" or "allow",
in a share of at least `min_support` of the labelled URLs. A combination is a
rule if its confidence is high enough and significant: were labels drawn by
their rate, the chance of so many of that label among the URLs with it, times
the number of combinations tried, is at most CHANCE. No rule is left out beyond
that. Rules lie in an inverted index under their rarest token: a URL's tokens
look up the rules there, and a rule matches if the URL has all its tokens. The
most confident match gives the verdict (of equal ones "block", then the last by
tokens); with none it is "allow".

A row of `labels` belongs to the page with that id, and asks to block if the
text is toxic or of low quality; of several rows one is enough. A null URL or
one without `://` has an empty host and path. A very long URL is one
transaction with all its tokens. Equal rows are judged alike, rows of one
page_id each by its URL. With no labels or an empty table, nothing is mined.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common as C

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT, MIN_CONFIDENCE, CHANCE = 0.02, 0.6, 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK, _ALLOW = "label=block", "label=allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed(rules) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict for columns host and path; nulls without one."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL with columns host and path."""
    labels = F.split("host", r"\.")
    at = F.sequence(F.lit(1), F.size(labels))
    kinds = F.concat(
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        F.transform(at, lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), "."))),
        F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "#"))),
        F.transform(F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"([^&=]+)(?:=[^&]*)?"), 1), lambda s: F.concat(F.lit("query="), s)),
    )
    return F.coalesce(F.array_distinct(kinds), F.array().cast("array<string>"))


def mined(pages: DataFrame, labels: DataFrame, min_support: float) -> DataFrame:
    """Rules (tokens, verdict, confidence, pivot); a share of support bounds their number at any size of the tables."""
    block = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("block"))
    label = F.when(F.col("block") == 1, _BLOCK).otherwise(_ALLOW)
    marked = C.checkpointed(pages.select("page_id", "tokens").join(block, "page_id").select(F.concat("tokens", F.array(label)).alias("items")))
    spark, schema = pages.sparkSession, "tokens array<string>, verdict string, confidence double, pivot string"
    total, blocked = marked.agg(F.count("*"), F.count_if(F.array_contains("items", _BLOCK))).first()
    if not total:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=MIN_CONFIDENCE).fit(marked)
    single = {r["items"][0]: r["freq"] for r in model.freqItemsets.where(F.size("items") == 1).collect()}
    tried = model.freqItemsets.where(~F.array_contains("items", _BLOCK) & ~F.array_contains("items", _ALLOW)).count()
    found = model.associationRules.where(F.col("consequent")[0].isin(_BLOCK, _ALLOW) & (F.col("lift") > 1))
    rules = []
    for r in found.select("antecedent", F.col("consequent")[0].alias("label"), "confidence", "support").collect():
        both = round(r["support"] * total)
        rate = (blocked if r["label"] == _BLOCK else total - blocked) / total
        if C.chance_of(round(both / r["confidence"]), both, rate) * tried <= CHANCE:
            rules.append((sorted(r["antecedent"]), r["label"].removeprefix("label="), r["confidence"], min(r["antecedent"], key=lambda t: (single[t], t))))
    return spark.createDataFrame(rules, schema)


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_tokens (the mined rule that decided) of each row of `pages` (page_id, url)."""
    host, path = parts(F.col("url"))
    name, verdict = listed(rules)
    df = pages.select(F.col("page_id"), "url", host.alias("host"), path.alias("path")).withColumn("rule", name).withColumn("listed", verdict).withColumn("tokens", tokens(F.col("url")))
    found = mined(df, labels, min_support)
    urls = df.where("rule is null and url is not null").select("url", "tokens").distinct()
    hits = urls.select("url", "tokens", F.explode("tokens").alias("pivot")).join(found.withColumnRenamed("tokens", "needs"), "pivot").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", "verdict", "needs")).alias("best")).select("url", F.col("best.verdict").alias("mined"), F.col("best.needs").alias("mined_tokens"))
    out = df.join(best, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("listed")).otherwise(F.coalesce("mined", F.lit("allow"))).alias("verdict"), "mined_tokens")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(C.table(spark, sf_dir, "pages").select("page_id", "url"), C.table(spark, sf_dir, "labels"))

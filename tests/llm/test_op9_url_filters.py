import re

from pagelens.llm import url_filters as U
from pagelens.llm.queries import QUERIES


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
    fits = [(h + p, kind) for kind, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


URLS = [None, "", "nothing", "http://", "https://EXAMPLE.org/es/1", "http://a.b.example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/?a#b", "http://notcom/fr/", "http://x.com?/fr/", "http://x.com#/de/", "http://u@x.com/de/", "ftp://É.ORG/É", "a://b.org://c/", "http://org/", "http://x.org"]


def check(got, urls):
    for r in got:
        host, path, rule = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), urls[r.page_id]
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = U.judged(pages, labels).collect()
    check(got, URLS)
    assert len(got) == len(URLS) and all(r.verdict == "allow" for r in got if not r.rule)
    assert U.judged(pages.where("false"), labels).count() == 0


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op9_url_filters"](spark, d).collect()
    assert len(got) == len(urls)
    check(got, urls)


def test_mined_rules_decide_what_is_not_listed(spark):
    rows = [(i, f"https://{'ads' if i % 3 == 0 else 'news'}.site{i % 7}.net/{'track' if i % 3 == 0 else 'story'}/{i}?u={i}") for i in range(600)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(400)] + [(None, 0, 1), (1, 1, None), (1, 1, 0)]
    pages = spark.createDataFrame(rows + [rows[0], (None, rows[3][1])], "page_id long, url string")
    got = U.judged(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 602
    for r in got:
        assert r.rule is None and r.verdict == ("block" if "ads" in r.host else "allow")
        assert r.mined_tokens

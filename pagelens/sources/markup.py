"""Items from page markup: images, srcset candidates, CSS images, links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls


def srcset(value: Column) -> Column:
    """Candidates (url, width, density) in order; commas split always, also inside data URLs."""

    def entry(part: Column) -> Column:
        words = F.split(F.trim(part), r"\s+")
        d = F.try_element_at(words, F.lit(2))

        def number(unit: str) -> Column:
            return F.when(d.endswith(unit), F.regexp_extract(d, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"))

        return F.struct(words[0].alias("url"), number("w").alias("width"), number("x").alias("density"))

    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), entry), lambda e: e["url"] != "")


def ranked(candidates: Column) -> Column:
    """Widest first, then densest, nulls as 0; equals stay in order."""
    keyed = F.transform(candidates, lambda e, i: F.struct((-F.coalesce(e["width"], F.lit(0.0))).alias("w"), (-F.coalesce(e["density"], F.lit(0.0))).alias("d"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


# CSS syntax: strings with escapes, and blocks in parentheses (three levels deep, as in a gradient of colours).
_STRING = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
_FLAT = rf"(?:[^()\"']|{_STRING})*"
_INNER = rf"(?:[^()\"']|{_STRING}|\({_FLAT}\))*"
_BLOCK = rf"(?:[^()\"']|{_STRING}|\({_INNER}\))*"
_URL = rf"(?is)(?<![\w-])url\(\s*({_STRING}|{_INNER}?)\s*(?:\)|$)"
_IMAGE_SET = rf"(?is)image-set\(({_BLOCK})(?:\)|$)"
_ARGUMENT = rf"(?is)({_STRING})|[\w-]+\({_INNER}\)"  # a function's own strings belong to it


def css_image_urls(css: Column) -> Column:
    """The images a CSS value names, each once: its url() values in order, then the strings that image-set() lists itself.

    Strings lose their quotes and keep their escapes. A function's arguments, as
    in type("image/avif"), are no images. A block that the text's end leaves
    open is closed there. Null is empty.
    """

    def bare(x: Column) -> Column:
        return F.when(x.rlike(r"(?s)^(?:\".*\"|'.*')$") & (F.length(x) > 1), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)

    css = F.coalesce(css, F.lit(""))
    sets = F.transform(F.regexp_extract_all(css, F.lit(_IMAGE_SET), 1), lambda body: F.regexp_extract_all(body, F.lit(_ARGUMENT), 1))
    found = F.transform(F.concat(F.regexp_extract_all(css, F.lit(_URL), 1), F.flatten(sets)), lambda x: bare(F.trim(x)))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def resolved(base: Column, link: Column) -> Column:
    """The link as an absolute URL by the usual rules; null if the base has no host and the link isn't absolute."""
    link = F.trim(link)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    kept = F.when(link.rlike(r"^[/?#]") | (link == ""), F.lit("")).otherwise(F.regexp_extract(urls.path(base), r"^(.*/)[^/]*$", 1))
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    own = F.concat(F.when(kept != "", kept).otherwise(F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/"))), path)
    # a dot is its own folder; two take away the one before
    last = F.element_at(F.split(own, "/"), -1)
    steps = F.aggregate(F.split(own, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    joined = F.concat(F.array_join(steps, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    here = F.regexp_replace(base, F.when(link.startswith("?"), F.lit(r"[?#].*$")).otherwise(F.lit(r"#.*$")), F.lit(""))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(urls.scheme(link), F.regexp_replace(link, r"^[A-Za-z0-9+.-]+", ""))).when(site == "", F.lit(None).cast("string")).when(link.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), link))
        .when((link == "") | link.rlike(r"^[?#]"), F.concat(here, link)).otherwise(F.concat(site, joined, tail))
    )


class _Tags(HTMLParser):
    def __init__(self, wanted: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.found = wanted, []

    def handle_starttag(self, tag, attrs):
        if tag in self.wanted:
            self.found.append((tag, {k: v or "" for k, v in attrs}))


def elements(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(page_id, url, pos, tag, attrs) of the wanted tags of pages (page_id, url, html), parsed page by page."""
    wanted = frozenset(tags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                parser = _Tags(wanted)
                parser.feed(html or "")
                parser.close()
                out += [(page, url, i, tag, attrs) for i, (tag, attrs) in enumerate(parser.found)]
            yield pd.DataFrame(out, columns=["page_id", "url", "pos", "tag", "attrs"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, pos int, tag string, attrs map<string,string>")


def image_items(pages: DataFrame, min_width: int = 0, min_height: int = 0) -> DataFrame:
    """Image items of <img>, srcset and <source> elements, without video files; sizes are the attributes'."""
    el = elements(pages, ("img", "source"))
    width, height = (F.coalesce(F.col("attrs")[k].try_cast("int"), F.lit(0)) for k in ("width", "height"))
    best = ranked(srcset(F.coalesce(F.col("attrs")["srcset"], F.col("attrs")["data-srcset"])))
    raw = F.coalesce(F.nullif(F.col("attrs")["src"], F.lit("")), F.nullif(F.col("attrs")["data-src"], F.lit("")), F.try_element_at(best, F.lit(1))["url"])
    items = el.select("page_id", "pos", "tag", urls.attribute(raw).alias("raw_url"), F.col("url").alias("page_url"), width.alias("width"), height.alias("height"), best.alias("candidates"))
    items = items.where("raw_url is not null").withColumn("item_url", F.when(urls.kind(F.col("raw_url")) == "img", resolved(F.col("page_url"), F.col("raw_url"))).otherwise(F.col("raw_url")))
    items = items.where(~urls.is_video(F.col("item_url")) & (F.col("width") >= min_width) & (F.col("height") >= min_height))
    return items.withColumn("kind", urls.kind(F.col("item_url"))).withColumn("filename", urls.file_name(F.col("item_url")))


def gif_items(pages: DataFrame) -> DataFrame:
    return image_items(pages).where(F.lower(F.col("item_url")).rlike(r"\.gif(?:[?#]|$)"))


def background_items(elements_: DataFrame, per_page: int = 500, min_area: float = 0.0) -> DataFrame:
    """Images of the styles of supplied elements (page_id, pos, style map, width, height), at most so many a page, in order."""
    from pyspark.sql.window import Window

    props = ("background-image", "background", "mask-image", "border-image-source", "list-style-image", "content")
    css = F.concat_ws(" ", *(F.col("style")[p] for p in props))
    found = elements_.where(F.col("width") * F.col("height") >= min_area).select("page_id", "pos", F.posexplode(css_image_urls(css)).alias("k", "url"))
    w = Window.partitionBy("page_id").orderBy("pos", "k")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_page)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of anchors, by pattern: stays in the JVM, for markup without quirks."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def chapter_links(pages: DataFrame) -> DataFrame:
    """Anchors without fragments, the first of equal targets of a page, in order."""
    first = links(pages).withColumn("target", urls.without_fragment(urls.attribute(F.col("href")))).groupBy("page_id", "target").agg(F.min("pos").alias("pos"))
    return first.select("page_id", "pos", "target")


def keyword_list(lines: DataFrame) -> DataFrame:
    """Keywords of 2 to 50 characters from markdown lines (file, n, value): in code fences, table cells and plain lines; not headings."""
    from pyspark.sql.window import Window

    fence = F.trim("value").startswith("```")
    inside = F.sum(F.when(fence, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    words = lines.select("n", "value", fence.alias("fence"), inside.alias("inside")).where("not fence and (inside or not trim(value) rlike '^#')").select(F.explode(F.split("value", r"[|,\n]")).alias("w"))
    key = F.lower(F.trim(F.regexp_replace("w", r"^[\s>*-]+|`", "")))
    return words.select(key.alias("keyword")).where("length(keyword) between 2 and 50 and not keyword rlike '^[:-]+$'").distinct()

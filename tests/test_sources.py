import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelens.sources import archives, markup, readers


def test_srcset(spark):
    df = spark.createDataFrame([("a 100w, b 2x , c, d 300w,",), ("",), (None,), ("data:x,y 5w",)], "s string")
    got = [[(e.url, e.width, e.density) for e in r.c] for r in df.select(markup.srcset(F.col("s")).alias("c")).collect()]
    assert got == [[("a", 100.0, None), ("b", None, 2.0), ("c", None, None), ("d", 300.0, None)], [], [], [("data:x", None, None), ("y", 5.0, None)]]
    best = df.limit(1).select(markup.ranked(markup.srcset(F.col("s"))).alias("c")).first().c
    assert [e.url for e in best] == ["d", "a", "b", "c"]


def test_css_image_urls(spark):
    cases = {
        "url(a.png), URL('b(1).png') url(\"c\\\"d\")": ["a.png", "b(1).png", 'c\\"d'],
        "image-set(url(a) 1x, 'b' 2x)": ["a", "b"],
        "-webkit-image-set(url(a) 1x)": ["a"],
        'image-set("x.avif" type("image/avif"), "y(2).png" type("image/png") 2x)': ["x.avif", "y(2).png"],
        "image-set(linear-gradient(rgba(0, 0, 0, .5), red) 1x, 'z' 2x), url( q.png )": ["q.png", "z"],
        "url(open.png": ["open.png"],
        "my-url(a) none": [],
        "url()": [],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "css string")
    got = {r.css: r.u for r in df.select("css", markup.css_image_urls(F.col("css")).alias("u")).collect()}
    assert got == cases | {None: []}


def test_image_items(spark):
    html = '<img src="/x.png" width=20 height=10><img data-src="v.mp4"><img srcset="a.jpg 1x, b.jpg 2x"><source src="m.gif"><img src="data:image/png;base64,AA"><img>'
    pages = spark.createDataFrame([(1, "https://h.org/p/q", html), (2, "https://h.org/", None)], "page_id long, url string, html string")
    got = [(r.item_url, r.kind, r.filename) for r in markup.image_items(pages).orderBy("pos").collect()]
    assert [g[:2] for g in got] == [("https://h.org/x.png", "img"), ("https://h.org/p/b.jpg", "img"), ("https://h.org/p/m.gif", "img"), ("data:image/png;base64,AA", "dataUri")]
    assert markup.image_items(pages, min_width=15).count() == 1
    assert [r.item_url for r in markup.gif_items(pages).collect()] == ["https://h.org/p/m.gif"]


def test_backgrounds_and_links(spark):
    el = spark.createDataFrame([(1, 0, {"background": "url(a) url(a)", "content": "url(b)"}, 5.0, 5.0), (1, 1, {"background": "url(c)"}, 1.0, 1.0)], "page_id int, pos int, style map<string,string>, width double, height double")
    assert [r.url for r in markup.background_items(el).orderBy("rank").collect()] == ["a", "b", "c"]
    assert markup.background_items(el, per_page=1).count() == 1 and markup.background_items(el, min_area=4).count() == 2
    pages = spark.createDataFrame([(1, '<a href="x#1">1</a><a class=q href="y">2</a><a href="x#2">3</a>')], "page_id int, html string")
    assert [(r.pos, r.target) for r in markup.chapter_links(pages).orderBy("pos").collect()] == [(0, "x"), (1, "y")]


def test_keyword_list(spark):
    lines = ["# Title", "plain, two words", "```", "# fenced", "```", "| cell | x |", "|---|---|"]
    df = spark.createDataFrame([(0, *x) for x in enumerate(lines)], "file int, n int, value string")
    assert sorted(r.keyword for r in markup.keyword_list(df).collect()) == ["# fenced", "cell", "plain", "two words"]


def test_archives(spark):
    df = spark.createDataFrame([("z", "b.txt", bytearray(b"2"), 2), ("z", "a.txt", bytearray(b"1"), 1), ("e", "p<1>", bytearray(b"x"), 1)], "archive string, name string, content binary, pos int")
    got = {r.archive: r for r in archives.packed(df).collect()}
    with zipfile.ZipFile(io.BytesIO(bytes(got["z"].content))) as z:
        assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt") == b"2" and z.testzip() is None
    book = archives.packed(df.where("archive = 'e'"), kind="epub").first()
    with zipfile.ZipFile(io.BytesIO(bytes(book.content))) as z:
        assert z.namelist()[0] == "mimetype" and "OEBPS/p<1>" in z.namelist()
    assert "<Series>A&amp;B</Series>" in archives.comic_info("A&B", "t", 3)


def test_paged_source(spark):
    spark.dataSource.register(readers.paged_source("pages_of_ids", "id int", lambda page: [(page * 2,), (page * 2 + 1,)] if page < 3 else [], 10, 2))
    assert sorted(r.id for r in spark.read.format("pages_of_ids").load().collect()) == list(range(6))


def test_feeds_lists_and_tables(spark):
    xml = "<feed><entry><title>A</title><link rel='x' href=\"u1\"/></entry><entry><title><![CDATA[B]]></title><link href=\"u2\"/><x:locked>true</x:locked></entry></feed>"
    got = readers.atom_entries(spark.createDataFrame([(1, xml)], "feed_id int, xml string"))
    assert [(r.title, r.link, r.locked) for r in got.orderBy("pos").collect()] == [("A", "u1", False), ("B", "u2", True)]
    doc = spark.createDataFrame([(1, '{"p":{"pages":[{"src":"a"},{"src":"","url":"b"},{}]}}')], "id int, js string")
    assert [(r.pos, r.url) for r in readers.page_list(doc, "js", "$.p.pages", ("src", "url")).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, None)], "k string, n int, s string")
    assert sorted(tuple(r) for r in readers.upserted(old, new, ["k"]).collect()) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, None)]
    series = spark.createDataFrame([("1", "b", 1), ("2", "A", 2), ("1", "c", 3)], "id string, title string, pos int")
    assert [r.title for r in readers.series_list(series).collect()] == ["A", "b"]


def test_modules(spark):
    m = readers.Modules()
    m.register("org", r"\.org/", list_chapters=lambda df: df, list_pages=lambda df: df.limit(1))
    m.register("any", "^https?:", list_chapters=lambda df: df, list_pages=lambda df: df)
    with pytest.raises(TypeError):
        m.register("half", "x", list_pages=lambda df: df)
    with pytest.raises(ValueError):
        m.register("org", "x", list_chapters=lambda df: df, list_pages=lambda df: df)
    df = spark.createDataFrame([("http://a.org/",), ("http://b/",), ("x",)], "url string")
    assert [r.module for r in m.detect(df).collect()] == ["org", "any", None]
    assert m.call("org", "list_pages", df).count() == 1


def test_sqlite_rows(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "f.db")
    con.execute('create table favorites (module text, title text, link text, "read" integer)')
    con.executemany("insert into favorites values (?, ?, ?, ?)", [("m1", "T", "/t", 3), ("m2", None, "/u", None)])
    con.commit()
    con.close()
    rows = readers.sqlite_rows(spark, str(tmp_path / "f.db"), "favorites", ("module", "title", "link", "read"))
    assert sorted((tuple(r) for r in rows.collect()), key=str) == [("m1", "T", "/t", "3"), ("m2", None, "/u", None)]
    ids = spark.createDataFrame([("m1", "one")], "module string, connector string")
    assert [tuple(r) for r in readers.imported(rows, ids).collect()] == [("one", "T", "/t", "3")]


def test_resolved(spark):
    from urllib.parse import urljoin

    base = ["https://h.org/a/b/c?q=1#f", "http://h", "https://h.org/a/"]
    links = ["x", "./x", "../x", "../../../x", "/r/s", "//o.org/p", "?z=2", "#g", "", "mailto:a@b", "x/../y?../z", ".", "..", "a/./b/", "/a/../b"]
    df = spark.createDataFrame([(b, x) for b in base for x in links], "b string, x string")
    got = {(r.b, r.x): r.u for r in df.select("b", "x", markup.resolved(F.col("b"), F.col("x")).alias("u")).collect()}
    assert got == {(b, x): urljoin(b, x) if x else b.split("#")[0] for b in base for x in links}

import math

import numpy as np
from pyspark.sql import functions as F

from pagelens.functions import imaging, text, urls


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, f, kind="string"):
    return values(spark, [(value,)], f"x {kind}", f(F.col("x")))[0][0]


def test_url_parts(spark):
    u = "https://User@WWW.Example.org:8080/a/b%20c.PNG?x=1&ccb=2&y#top"
    got = values(spark, [(u,)], "u string", urls.scheme(F.col("u")), urls.host(F.col("u")), urls.path(F.col("u")), urls.canonical(F.col("u")), urls.source_file(F.col("u")), urls.extension(F.col("u")))[0]
    assert got == ("https", "www.example.org", "/a/b%20c.PNG", "https://User@WWW.Example.org:8080/a/b%20c.PNG?x=1&y#top", "b c.png", "png")
    assert one(spark, "http://h/a?oh=1#f", urls.canonical) == "http://h/a#f"
    assert one(spark, "http://h/a+b%2", urls.source_file) == "a+b%2"
    assert one(spark, "data:image/png;base64,AAAA", urls.source_link) is None
    assert one(spark, None, urls.canonical) is None


def test_attribute_and_data_urls(spark):
    assert one(spark, ' "a?x=1&amp;y&#38;z" ', urls.attribute) == "a?x=1&y&z"
    assert bytes(one(spark, "data:text/plain;base64,aGk=", urls.decoded_data)) == b"hi"
    assert bytes(one(spark, "data:,a%20b+c", urls.decoded_data)) == b"a b+c"
    assert one(spark, "http://x", urls.decoded_data) is None
    assert [one(spark, u, urls.kind) for u in ("data:,x", "blob:x", "http://x")] == ["dataUri", "blob", "img"]


def test_host_suffixes(spark):
    assert one(spark, "a.b.c", urls.suffixes) == ["a.b.c", "b.c", "c"]
    assert [one(spark, h, lambda c: urls.matches_domain(c, "b.c")) for h in ("b.c", "a.b.c", "xb.c")] == [True, True, False]


def test_safe_names(spark):
    cases = {"a/b<c>.JPeG": "b_c_.jpeg", "con.png": "_con.png", "": "image.png", "..x. ": "x.png", None: "image.png", "noext": "noext.png"}
    assert {k: one(spark, k, text.safe_name) for k in cases} == cases
    assert len(one(spark, "n" * 300 + ".png", text.safe_name)) == 124


def test_formats(spark):
    assert [one(spark, m, text.mime_extension) for m in ("image/jpeg; q=1", "image/svg+xml", "image/x-icon", "text/html", None)] == ["jpg", "svg", "ico", "", ""]
    assert values(spark, [("php", "JPEG"), ("php", ""), (None, None)], "a string, b string", text.first_known_format(F.col("a"), F.col("b"))) == [("jpg",), ("php",), ("data",)]
    heads = {b"\x89PNG\r\n": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF89a": "image/gif", b"RIFF0000WEBP": "image/webp", b"BM": "image/bmp", b" <svg xmlns": "image/svg+xml", b"": ""}
    assert {h: one(spark, bytearray(h), text.sniffed_mime, "binary") for h in heads} == heads


def test_numbers(spark):
    assert [one(spark, n, text.human_size, "double") for n in (0.0, 512.0, 1536.0, 20480.0, 5e6, None)] == ["", "512 B", "1.5 KB", "20 KB", "4.8 MB", ""]
    assert [one(spark, n, text.human_duration, "double") for n in (-1.0, 250.0, 1500.0, 12000.0, 61000.0)] == ["-", "250 ms", "1.50 s", "12.0 s", "1m 01s"]
    assert [one(spark, n, text.positive_int) for n in ("2.5", "-3", "x", None)] == [3, 0, 0, 0]


def test_text_hashes_use_utf16_units(spark):
    def expected(s):
        h = 0
        units = s.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) % 2**32
        return h

    for s in ("", "abc", "ÿé", "a😀b"):
        assert one(spark, s, text.text_hash) == expected(s)
    assert one(spark, "hello world, long", lambda c: text.text_hash(c, True)) == (lambda h: h - 2**32 if h >= 2**31 else h)(expected("hello world, long"))


def test_titles_and_messages(spark):
    got = values(spark, [("Vol. 2 Ch. 12.5 The End",)], "t string", text.chapter_title(F.col("t"), "%VOL%-%CH% %T%", F.lit("S"), F.lit("L")))[0][0]
    assert got == "002-0012.5 The End"
    assert [one(spark, m, text.error_class) for m in ("HTTP 403", "CORS error", "Timed out", "other", None)] == ["auth", "blocked", "timeout", None, None]
    assert tuple(one(spark, "i:1,2+3,4>5,6", text.coords)) == ("i", 1, 2, 3, 4, 5, 6)
    assert one(spark, "bad", text.coords) is None


def test_dhash_and_bands(spark):
    grid = [9 - i % 9 for i in range(72)]  # each value is greater than its right neighbour
    assert one(spark, grid, imaging.dhash, "array<int>") == -1
    assert one(spark, grid[::-1], imaging.dhash, "array<int>") == 0
    got = one(spark, -1, imaging.bands, "bigint")
    assert [(b.band, b.value) for b in got] == [(0, 8191), (1, 8191), (2, 8191), (3, 8191), (4, 4095)]
    assert values(spark, [(0, 0b1011)], "a bigint, b bigint", imaging.distance(F.col("a"), F.col("b"))) == [(3,)]


def test_similarity_and_transforms(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (8, 8))
    rows = [(a.reshape(-1).tolist(), np.rot90(a, 1).reshape(-1).tolist()), (a.reshape(-1).tolist(), a[:, ::-1].reshape(-1).tolist()), (a.reshape(-1).tolist(), rng.integers(0, 256, 64).tolist())]
    got = [r[0] for r in values(spark, rows, "a array<int>, b array<int>", imaging.confirmed(F.col("a"), F.col("b")))]
    assert [(round(g.score, 6), g.rotation, g.mirror) for g in got] == [(1.0, 90, False), (1.0, 0, True), (0.0, None, None)]
    x, y = [1.0, 2.0, 3.0], [2.0, 2.0, 5.0]
    s = values(spark, [(x, y)], "a array<double>, b array<double>", imaging.ssim(F.col("a"), F.col("b")))[0][0]
    assert math.isclose(s, imaging.similarity(np.array(x), np.array(y)), rel_tol=1e-9)


def test_rotation_hashes(spark):
    g = np.random.default_rng(2).integers(0, 256, (12, 12)).astype(np.uint8)
    turned = np.ascontiguousarray(np.rot90(g, -1))
    rows = [(bytearray(g.tobytes()), 12, 12), (bytearray(turned.tobytes()), 12, 12)]
    a, b = (r[0] for r in values(spark, rows, "p binary, w int, h int", imaging.rotation_hashes("p", "w", "h")))
    assert a[1] == b[0] and a[2] == b[1] and len(set(a)) == 4
    assert imaging.resized(np.array([[0, 10], [20, 30]]), 4, 2).tolist() == [[0, 5, 10, 10], [20, 25, 30, 30]]


def test_orientation_and_upright_pixels():
    import numpy as np

    def jpeg(value, little):
        o = "little" if little else "big"
        tiff = (b"II*\0" if little else b"MM\0*") + (8).to_bytes(4, o) + (1).to_bytes(2, o) + (0x0112).to_bytes(2, o) + (3).to_bytes(2, o) + (1).to_bytes(4, o) + value.to_bytes(2, o) + b"\0\0"
        body = b"Exif\0\0" + tiff
        return b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda\0\0\0\0"

    assert [imaging.exif_orientation(jpeg(v, k)) for v in range(1, 9) for k in (True, False)] == [v for v in range(1, 9) for _ in range(2)]
    assert [imaging.exif_orientation(x) for x in (jpeg(9, True), b"", b"\x89PNG", jpeg(6, True)[:20], b"\xff\xd8\xff\xe1\xff\xff")] == [1] * 5
    a = np.arange(6).reshape(2, 3, 1)
    shown = {o: imaging.upright(a, o)[..., 0].tolist() for o in range(1, 9)}
    assert shown[1] == [[0, 1, 2], [3, 4, 5]] and shown[2] == [[2, 1, 0], [5, 4, 3]] and shown[3] == [[5, 4, 3], [2, 1, 0]] and shown[4] == [[3, 4, 5], [0, 1, 2]]
    assert shown[6] == [[3, 0], [4, 1], [5, 2]] and shown[8] == [[2, 5], [1, 4], [0, 3]] and shown[5] == [[0, 3], [1, 4], [2, 5]] and shown[7] == [[5, 2], [4, 1], [3, 0]]


def test_pixel_hash_is_of_the_upright_image(spark):
    import numpy as np

    a = np.random.default_rng(1).integers(0, 256, (4, 6, 4)).astype(np.uint8)
    rows = [(1, a.tobytes(), 6, 4, 1), (2, np.rot90(a, 1).tobytes(), 4, 6, 6), (3, a[:, ::-1].tobytes(), 6, 4, 2), (4, a.tobytes(), 6, 4, 3), (5, None, 6, 4, 1)]
    df = spark.createDataFrame(rows, "id int, rgba binary, w int, h int, o int")
    got = {r.id: r.x for r in df.select("id", imaging.pixel_hash("rgba", "w", "h", "o").alias("x")).collect()}
    assert got[1] == got[2] == got[3] != got[4] and got[5] is None


def test_digests(spark):
    import hashlib

    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},)], "m map<string,string>")
    pairs = ",".join(f"{hashlib.sha256(k.encode()).hexdigest()}_{hashlib.sha512(v.encode()).hexdigest()}" for k, v in (("a", "1"), ("b", "2")))
    want = hashlib.sha512((hashlib.sha256(pairs.encode()).hexdigest() + "s").encode()).hexdigest()
    assert [r.d for r in df.select(text.parameter_digest(F.col("m"), "s").alias("d")).collect()] == [want] * 2

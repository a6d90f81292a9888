from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagelens.operators import curate, groups, keep, lookups, reports, timed

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def log(spark, items, extra=""):
    return spark.createDataFrame([(k, i, T0 + timedelta(seconds=s), *v) for i, (k, s, *v) in enumerate(items)], f"k string, i int, ts timestamp_ntz{extra}")


def test_keep_best_ties_and_positions(spark):
    df = spark.createDataFrame([("a", 1, 5, 1), ("a", 9, 1, 2), ("a", 9, 1, 3), ("b", None, 2, 4)], "k string, area int, size int, pos int")
    got = keep.keep_best(df, ["k"], [F.coalesce("area", F.lit(0)), F.col("size")], F.col("pos"))
    assert rows(got.select("k", "pos", "position")) == [("a", 2, 1), ("b", 4, 4)]
    got = keep.keep_best(df, ["k"], [F.coalesce("area", F.lit(0)), F.col("size")], F.col("pos"), at_first=False)
    assert rows(got.select("k", "position")) == [("a", 2), ("b", 4)]


def test_keep_latest_first_preferred(spark):
    df = spark.createDataFrame([("a", 1, 7, "x"), ("a", 2, 7, "B"), ("a", 3, 5, "a")], "k string, pos int, t int, label string")
    assert keep.keep_latest(df, ["k"], F.col("t"), F.col("pos")).first().pos == 1
    assert keep.keep_first(df, ["k"], [F.desc("pos")]).first().pos == 3
    assert keep.keep_preferred(df, ["k"], F.col("t"), F.col("label"), F.col("pos")).first().pos == 2


def test_dedupe_key_cascade(spark):
    cols = ("kind", "source", "name", "hash", "sid", "url", "raw")
    df = spark.createDataFrame([("img", "s", "f", "h", "i", "u", "r", 1), ("canvas", "s", "f", "", "", "u", "r", 2), ("img", "", "", "", "", "", "", 3)], ", ".join(f"{c} string" for c in cols) + ", dom int")
    got = df.select(keep.dedupe_key(*(F.col(c) for c in cols), F.col("dom")).alias("k"))
    assert [r.k for r in got.collect()] == ["s::f", "canvas:f", "dom:3"]


def test_host_lookup(spark):
    entries = spark.createDataFrame([("sub", 1, "a.x.y"), ("all", 0, "x.y")], "entry_id string, position int, domain string")
    hosts = spark.createDataFrame([("a.x.y",), ("zx.y",), ("",), (None,)], "h string")
    assert sorted((str(r.h), str(r.entry_id)) for r in lookups.by_host(hosts, F.col("h"), entries).collect()) == [("", "None"), ("None", "None"), ("a.x.y", "all"), ("zx.y", "None")]
    assert rows(lookups.by_host(hosts, F.col("h"), entries, first_only=False).select("h", "entry_id")) == [("a.x.y", "all"), ("a.x.y", "sub")]


def test_keyword_match(spark):
    df = spark.createDataFrame([("an ad here", []), ("advert", []), ("xpaywallx", []), ("none", ["my-modal"]), ("none", ["cookie-x"]), ("none", [])], "s string, n array<string>")
    got = df.select(lookups.keyword_match(F.col("s"), F.col("n"), ["ad", "paywall"]).alias("k"))
    assert [r.k for r in got.collect()] == ["ad", None, "paywall", "pattern:-modal", "pattern:cookie-", None]


def test_near_hashes_lose_no_pair(spark):
    import random

    random.seed(3)
    hs = [random.getrandbits(64) for _ in range(30)]
    hs += [h ^ sum(1 << b for b in random.sample(range(64), n)) for h in hs for n in (0, 3, 4, 5)]
    signed = [h - 2**64 if h >= 2**63 else h for h in hs]
    df = spark.createDataFrame(list(enumerate(signed)), "id int, h bigint")
    expected = [(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(len(hs)) for j in range(i + 1, len(hs)) if (hs[i] ^ hs[j]).bit_count() <= 4]
    assert rows(lookups.near_hashes(df, df)) == expected


def test_metadata_gate(spark):
    names = ("intrinsic_width", "intrinsic_height", "byte_length", "rendered_width", "rendered_height")
    base = (10, 10, 5, 8, 8)
    cases = {base: True, (None, 10, 5, 9, 7): True, (10, 10, 6, 8, 8): False, (10, 10, 5, 10, 8): False, (11, 10, 5, 8, 8): False}
    df = spark.createDataFrame([(*base, *c) for c in cases], ", ".join(f"{p}{n} int" for p in "ab" for n in names))
    got = df.select(lookups.passes_metadata({n: F.col(f"a{n}") for n in names}, {n: F.col(f"b{n}") for n in names}).alias("ok"))
    assert [r.ok for r in got.collect()] == list(cases.values())


def test_components_and_groups(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    got = dict(rows(groups.connected(edges)))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    df = spark.createDataFrame([(3, "h"), (1, "h"), (2, "g")], "id int, key string")
    assert [tuple(r) for r in groups.hash_groups(df, "key", "L1").collect()] == [("l1:h", 1, [1, 3])]


def test_unique_names_with_a_made_name_that_occurs(spark):
    df = spark.createDataFrame([("f", "a.png", 1), ("f", "a.png", 2), ("f", "a (1).png", 3), ("g", "a.png", 4)], "folder string, name string, pos int")
    got = rows(curate.unique_names(df, "folder", "name", "pos").select("pos", "unique_name"))
    assert got == [(1, "a.png"), (2, "a (1).png"), (3, "a (1) (1).png"), (4, "a.png")]


def test_serial_names_and_runs(spark):
    df = spark.createDataFrame([("g", i) for i in range(101)], "g string, i int")
    got = dict(rows(curate.serial_names(df, ["g"], [F.col("i")], F.lit("jpg")).select("i", "serial_name")))
    assert got[0] == "001.jpg" and got[100] == "101.jpg"
    df = log(spark, [("u", 0, "a"), ("u", 1, "a"), ("u", 2, "b"), ("u", 3, "a")], ", v string")
    assert rows(curate.collapse_runs(df, ["k"], [F.col("ts")], ["v"], "i").select("run", "v", "run_start", "run_end")) == [(1, "a", 0, 1), (2, "b", 2, 2), (3, "a", 3, 3)]


def test_search_is_literal(spark):
    df = spark.createDataFrame([("a.b", 5), ("axb", 5), ("a.B", None)], "n string, w int")
    assert [r.n for r in curate.matching(df, search="A.B", search_in=("n",), minimum={"w": 1}).collect()] == ["a.b"]


def test_ttl_keeps_the_edge(spark):
    df = log(spark, [("at", 0), ("old", -1), ("new", 5), ("old", -50)])
    got = timed.live_entries(df, ["k"], "ts", T0 + timedelta(seconds=60), 60)
    assert sorted(r.k for r in got.collect()) == ["at", "new"]


def test_budget(spark):
    df = log(spark, [("u", i, s) for i, s in enumerate((5, 50, 5, 5))], ", size int")
    assert [r.i for r in timed.within_budget(df, ["k"], "ts", "i", F.col("size"), 20, 10).orderBy("rank").collect()] == [3, 2]
    assert timed.within_budget(df, ["k"], "ts", "i", F.col("size"), 1000, 2).count() == 2


def test_breaker(spark):
    df = log(spark, [("h", 0, True), ("h", 1, True), ("h", 2, False), ("h", 400, False), ("h", 401, True), ("h", 402, False), ("h", 403, True), ("h", 404, False)], ", failed boolean")
    assert [r.blocked for r in timed.circuit_breaker(df, "k", "ts", "i", "failed").orderBy("i").collect()] == [False, False, True, False, False, False, False, False]


def test_debounce_throttle_distance(spark):
    df = log(spark, [("u", 0, "a", 0.0), ("u", 0.1, "b", 60.0), ("u", 5, "b", 120.0), ("u", 9, "c", 250.0)], ", v string, y double")
    assert [r.i for r in timed.debounced(df, "k", "ts", "i", 0.15, "v").orderBy("i").collect()] == [1, 3]
    assert [r.i for r in timed.throttled(df, "k", "ts", "i", 0.7, 1.0).orderBy("i").collect()] == [0, 2, 3]
    assert [(r.i, r.carried) for r in timed.by_distance(df, "k", "ts", "i", "y", 100.0, 1.0).orderBy("i").collect()] == [(2, 20.0), (3, 50.0)]


def test_latest_within(spark):
    facts = spark.createDataFrame([("u", T0, 1.0), ("u", T0 + timedelta(seconds=10), 2.0)], "k string, fact_at timestamp_ntz, fact double")
    df = log(spark, [("u", -1), ("u", 0), ("u", 10), ("u", 25), ("v", 5)])
    assert [r.fact for r in lookups.latest_within(df, facts, "k", "ts", 10).orderBy("i").collect()] == [None, 1.0, 2.0, None, None]


def test_first_success(spark):
    df = spark.createDataFrame([("a", False, 1, "x"), ("a", True, 3, "y"), ("a", True, 2, "z"), ("b", False, 1, "w")], "k string, ok boolean, t int, r string")
    assert rows(timed.first_success(df, ["k"], "ok", "t", "r")) == [("a", "z", True), ("b", None, False)]


def test_tile_order_is_the_generators(spark):
    def expected(size, seed):
        state, keys = (seed & 0xFFFFFFFF) or 1, []
        for _ in range(size * size):
            state ^= (state << 13) & 0xFFFFFFFF
            state ^= state >> 17
            state ^= (state << 5) & 0xFFFFFFFF
            keys.append(state)
        return sorted(range(size * size), key=lambda i: keys[i])

    cases = [(1, 5), (3, 0), (4, 12345), (5, -7)]
    df = spark.createDataFrame(cases, "size int, seed int")
    assert [r.o for r in df.select(reports.tile_order(F.col("size"), F.col("seed")).alias("o")).collect()] == [expected(*c) for c in cases]


def test_overlays(spark):
    schema = "page_id int, pos int, tag string, role string, aria_modal boolean, position string, width double, height double, view_width double, view_height double, z double"
    view = (100.0, 100.0)
    cases = [("DIV", None, None, "fixed", 90.0, 90.0, 1000.0), ("IMG", None, None, "fixed", 90.0, 90.0, 1000.0), ("DIV", None, None, "static", 90.0, 90.0, 1000.0), ("DIV", None, None, "fixed", 50.0, 90.0, 1000.0), ("DIV", None, True, "fixed", 90.0, 90.0, 1000.0), ("DIV", None, None, "sticky", 900.0, 60.0, 999.0), ("DIV", None, None, "fixed", 90.0, 90.0, None)]
    df = spark.createDataFrame([(1, i, t, r, m, p, w, h, *view, z) for i, (t, r, m, p, w, h, z) in enumerate(cases)], schema)
    assert [(r.pos, round(r.coverage, 2)) for r in reports.overlay_candidates(df).orderBy("pos").collect()] == [(0, 0.81), (5, 0.6)]


def test_marks_names_and_ranges(spark):
    chapters = spark.createDataFrame([("c", "m", "1", "f", None), ("c", "m", "2", None, "t"), ("c", "n", "1", "f", "t")], "connector string, manga string, id string, file string, title string")
    marks = spark.createDataFrame([("c", "m", "f"), ("c", "m", "t"), ("x", "n", "1")], "connector string, manga string, chapter string")
    assert [r.marked for r in reports.marked(chapters, marks).orderBy("manga", "id").collect()] == [True, True, False]
    names = spark.createDataFrame([(1, "A", True), (2, "B", False)], "id int, name string, licensed boolean")
    got = reports.with_names(spark.createDataFrame([("x", [2, 1]), ("y", [1]), ("z", [])], "k string, ids array<int>"), "ids", names, ["k"])
    assert {r.k: r.names for r in got.collect()} == {"x": ["B", "A"], "z": None}
    df = spark.createDataFrame([(0,), (5,), (2500,)], "n long")
    assert [r.p for r in df.select(reports.ranges(F.col("n"), 1024).alias("p")).collect()] == [[], ["0-4"], ["0-1023", "1024-2047", "2048-2499"]]

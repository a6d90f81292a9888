"""Pairs: all of them, copies included, as the SQL gives them."""

import itertools
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagelens.functions import imaging
from pagelens.operators import lookups
from pagelens.plans import more


@pytest.mark.parametrize("node, block", [(1000, 16_384), (2, 5)])
def test_near_images_gives_all_pairs_of_copies(spark, monkeypatch, node, block):
    monkeypatch.setattr(lookups, "NODE", node)
    monkeypatch.setattr(lookups, "BLOCK", block)
    r = random.Random(2)
    base = [[r.getrandbits(64) for _ in range(4)] for _ in range(3)] + [[0] * 4, [7, 7, 0, 1 << 63]]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    images = []
    for i in range(60):
        h = list(base[i % 5])
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            t = r.randrange(4)
            h[t] ^= 1 << r.randrange(64)
        k = i % 4 if i % 3 else 0
        images.append((i, h[k:] + h[:k], i % 7))
    want = []
    for a, b in itertools.combinations(images, 2):
        far = min((x ^ y).bit_count() for x in a[1] for y in b[1])
        if far <= 4:
            want.append((a[0], b[0], 0 if a[2] == b[2] else far))
    df = spark.createDataFrame([(i, [signed(x) for x in h], c) for i, h, c in images], "id long, hashes array<long>, content long")
    got = lookups.near_images(df)
    assert got.schema["id_a"].dataType == df.schema["id"].dataType and sorted(tuple(x) for x in got.collect()) == want


def test_equal_contents_with_far_hashes_are_no_pair(spark):
    # they share a band of 13 bits, and no more
    far = ((1 << 51) - 1) ^ (1 << 40)
    df = spark.createDataFrame([(1, [0] * 4, 5), (2, [far] * 4, 5)], "id long, hashes array<long>, content long")
    assert lookups.near_images(df).count() == 0


def test_no_bands_or_candidates_are_shuffled(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(i, [r.getrandbits(63) for _ in range(4)], i) for i in range(40)], "id long, hashes array<long>, content long")
    assert "Exchange" not in lookups.near_images(df)._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_many_runs_meet_once(monkeypatch):
    monkeypatch.setattr(imaging, "_AT_ONCE", 3)
    r = random.Random(6)
    nodes = [{"hashes": [r.choice((0, 1, 7, 1 << 40, (1 << 62) - 1)) ^ 1 << r.randrange(62) for _ in range(r.randrange(1, 6))], "ids": [3 * i, 3 * i + 1], "contents": [i, None]} for i in range(40)]
    kind = pa.struct({"hashes": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "contents": pa.list_(pa.int64())})
    far = {(a["ids"][0], b["ids"][0]): min((x ^ y).bit_count() for x in a["hashes"] for y in b["hashes"]) for a, b in itertools.combinations(nodes, 2)}
    want = sorted((a + i, b + j, d) for (a, b), d in far.items() if d <= 4 for i in (0, 1) for j in (0, 1))
    every, first, second = (pa.array(x, kind) for x in (nodes, nodes[:15], nodes[15:]))
    blocks = ((every, None),), ((first, None), (first, second), (second, None))
    for of in blocks:
        assert sorted(tuple(x.values()) for a, b in of for batch in imaging.near_nodes(a, b, 4) for x in batch.to_pylist()) == want


@pytest.mark.parametrize("name", ["q_near_images", "q_hash_shortcut"])
def test_copies_among_embeddings_give_the_sql_s_rows(spark, tmp_path, name):
    r = random.Random(3)
    base = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(5)]
    vectors = [base[i % 5] for i in range(30)] + [[0.0] * 64] * 4
    t = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())})
    pq.write_table(t, tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    got = more.QUERIES[name](spark, str(tmp_path))
    want = c.execute(f"select id_a, id_b, distance from ({more.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(x) for x in got.select("id_a", "id_b", "distance").collect()) == sorted(want) and len(want) > 75


@pytest.mark.parametrize("name", ["q_near_images", "q_hash_shortcut"])
@pytest.mark.parametrize("ids", [[*range(12), *range(1_000_000, 1_000_012), *range(2_000_000, 2_000_006)], [i // 2 for i in range(30)], [None if i % 9 == 4 else i for i in range(30)]], ids=["copies have others' ids", "twice", "null"])
def test_ids_that_repeat_or_are_missing_give_the_sql_s_rows(spark, tmp_path, name, ids):
    r = random.Random(7)
    base = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(6)]
    t = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array([r.choice(base) for _ in ids], pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())})
    pq.write_table(t, tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = c.execute(f"select id_a, id_b, distance from ({more.ORACLE_SQL[name]})").fetchall()
    got = more.QUERIES[name](spark, str(tmp_path)).select("id_a", "id_b", "distance")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and want


def test_images_without_hashes_are_in_no_pair(spark):
    rows = [(1, [5, 5, None, 5], 1), (2, [5, 6, 7, 8], 2), (3, None, 3), (4, None, 4), (5, [], 5), (6, [None] * 4, 6)]
    df = spark.createDataFrame(rows, "id long, hashes array<long>, content long")
    assert [tuple(x) for x in lookups.near_images(df).collect()] == [(1, 2, 0)]


def test_metadata_pairs_with_missing_sides(spark):
    r = random.Random(4)
    images = [(i, r.choice("xy"), *(r.choice((None, 1, 2)) for _ in range(3)), r.choice((None, 1.0, 1.5, 2.5, 9.0)), r.choice((None, 3, 4, 5))) for i in range(90)]
    df = spark.createDataFrame(images, "id long, g string, " + ", ".join(f"{n} {'double' if n == 'rendered_width' else 'int'}" for n in lookups.METADATA))
    far = (0, 0, 0, 1, 1)
    want = [(a[0], b[0]) for a, b in itertools.combinations(images, 2) if a[1] == b[1] and all(x is None or y is None or abs(x - y) <= w for x, y, w in zip(a[2:], b[2:], far, strict=True))]
    assert sorted(tuple(x) for x in lookups.metadata_pairs(df, "g").collect()) == want and want


def test_prefilter_leaves_out_null_sizes_as_its_sql_does(spark, tmp_path):
    t = pa.table({"p_partkey": pa.array(range(40), pa.int64()), "p_brand": ["b"] * 40, "p_size": pa.array([None if i % 7 == 3 else i % 5 for i in range(40)], pa.int32())})
    pq.write_table(t, tmp_path / "part.parquet")
    c = duckdb.connect()
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = c.execute(more.ORACLE_SQL["q_metadata_prefilter"]).fetchall()
    assert sorted(tuple(x) for x in more.QUERIES["q_metadata_prefilter"](spark, str(tmp_path)).collect()) == sorted(want) and want

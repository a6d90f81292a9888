import random
import re
from collections import Counter

import numpy as np
import pytest
from texts import prose

from pagelens.llm import decontamination as D

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        for i, x in items:
            v = WORD.findall((x or "").translate(LOWER))
            if not w or not v:
                continue
            c = grams(v)
            best = max((sum((g & c).values()) / sum((g | c).values()) for k in range(max(1, len(w) - len(v) + 1)) if (g := grams(w[k : k + len(v)]))), default=0)
            if best >= least:
                out[d, i] = round(best, 6)
    return out


@pytest.mark.parametrize("block", [500, 7])
def test_against_brute_force(spark, block):
    r = random.Random(block)
    items = [(i, prose(i, r.randint(3, 60), [f"w{k}" for k in range(60)])) for i in range(25)] + [(98, None), (99, "  ")]
    docs = []
    for d in range(60):
        t = prose(1000 + d, 80, [f"w{k}" for k in range(60)]).split()
        if d % 2:
            v = items[d % 25][1].split()
            if d % 4 == 1 and len(v) > 50:
                v[r.randrange(len(v))] = "changed"
            at = r.randrange(60)
            t[at:at] = [x.upper() if d % 3 == 0 else x for x in v]
        docs.append((d, " ".join(t)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(a, b, block=block).collect()
    assert {(x.doc_id, x.item_id): x.similarity for x in got} == brute(docs, items)
    assert len(got) == len(brute(docs, items)) > 20
    hit = {x.doc_id for x in got}
    assert {x.doc_id for x in D.without_contaminated(a, b, block=block).collect()} == {d for d, _ in docs} - hit


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = D.Items(list(range(40)), [prose(i, 20).encode() for i in range(40)], 5, 0.8, D.RADIUS)
    probes = []
    for k in range(300):
        bits = np.unpackbits(items.prints[k % 40].astype(">u2").view(np.uint8))
        bits[rng.choice(128, rng.integers(0, 45), replace=False)] ^= 1
        probes.append(np.packbits(bits).view(">u2").astype(np.int64))
    probes = np.array(probes)
    row, item = items.within(probes)
    far = np.bitwise_count(probes[:, None] ^ items.prints[None]).sum(axis=2)
    assert set(zip(row.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= D.RADIUS))))


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "w " * 40), (2, None), (3, ""), (3, "a b c"), (None, "one")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.contaminated(odd, bench).collect()}
    assert {(6, 3), (7, 3), (12, 1), (3, None), (4, None)} <= got
    assert D.contaminated(empty, bench).count() == 0 and D.contaminated(odd, bench.where("false")).count() == 0
    kept = D.without_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id in (6, 12)").count() == 0


def test_every_window_that_could_match_gets_a_fingerprint():
    """Against all windows of all item lengths: those left out hold no shingle of an item of their length."""
    r = random.Random(9)
    words = ["w0", "w1", "w2"]
    texts = [prose(i, r.randint(5, 14), words).encode() for i in range(8)]
    items = D.Items(list(range(8)), texts, 5, 0.8, D.RADIUS)
    docs = [prose(100 + d, r.randint(1, 60), words).encode() for d in range(40)]
    seen = []
    plain = items._windows
    items._windows = lambda *x: seen.append(plain(*x)) or seen[-1]
    off = np.cumsum([0, *map(len, docs)])
    items.found(np.frombuffer(b"".join(docs), np.uint8), off)
    first = np.cumsum([0, *(len(d.split()) for d in docs)])
    got = {(int(a - first[d]), int(n), int(d)) for a, n, d in seen[0]}
    want = set()
    for d, t in enumerate(docs):
        w = t.split()
        for x in texts:
            v = x.split()
            n = min(len(v), len(w))
            for k in range(len(w) - n + 1):
                if set(grams(w[k : k + n])) & set(grams(v)):
                    want.add((k, n, d))
    assert got == want and len(want) > 50


def test_recall_of_the_radius_against_all_windows(spark):
    """Passages with words changed at random, on the tables' own items: windows at 0.8 or more that the radius lets pass."""
    bench = [r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    items = D.Items(list(range(len(bench))), bench, 5, 0.8, D.RADIUS)
    r = random.Random(1)
    near = found = 0
    for i, text in enumerate(bench):
        for _ in range(20):
            w = text.lower().split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = b"zz%d" % r.randrange(99)
            a, b = grams(w), grams(text.lower().split())
            if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                near += 1
                t = b" ".join([b"q1 q2 q3", *w, b"q4 q5"])
                found += any(items.ids[k] == i for _, k in items.found(np.frombuffer(t, np.uint8), np.array([0, len(t)])))
    assert near > 100 and found >= 0.99 * near

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from texts import prose

from pagelens.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    shared = [prose(900 + k, r.randint(40, 120)) for k in range(5)]
    rows = []
    for d in range(60):
        t = prose(seed * 100 + d, r.randint(1, 150))
        for s in r.sample(shared, r.choice([0, 1, 2])):
            at = r.randrange(len(t))
            cut = r.randrange(len(s) // 3)
            t = t[:at] + s[cut:] + t[at:]
        rows.append((d, t))
    return rows + [(100, rows[0][1]), (101, "ab" * 400), (102, "é" * 260)]


@pytest.mark.parametrize(("seed", "length"), [(1, 200), (2, 64)])
def test_against_brute_force(spark, seed, length):
    rows = corpus(seed)
    got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, length)


def test_interval_expansion_on_random_strings():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 4, 30):
        parts = [bytes(rng.integers(0, sigma, rng.integers(0, 120)).astype(np.uint8)) for _ in range(8)]
        for length in (1, 3, 8, 20):
            count = Counter(p[k : k + length] for p in parts for k in range(len(p) - length + 1))
            for p, got in zip(parts, S.repeated_windows(parts, length), strict=True):
                assert got.tolist() == [count[p[k : k + length]] > 1 for k in range(len(p) - length + 1)]


def test_windows_are_owned_once():
    raw = np.frombuffer(("x" * 500 + prose(3, 300)).encode(), np.uint8)
    off = np.array([0, 500, 500, 650, len(raw)])
    h, doc, start, count, at = S.owned_windows(raw, off, 200)
    assert (at >= count - 1).all() and (at <= 200 - S.KMER).all()
    assert len(h) == len(doc)
    got = sorted((d, k) for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist()) for k in range(s, s + n))
    assert got == [(d, k) for d in range(4) for k in range(max(0, int(off[d + 1] - off[d]) - 199))]


def test_rows_of_one_id_are_told_apart(spark):
    a, b, c = prose(1, 200), prose(2, 200, ["qq", "ww", "ee", "rr", "tt", "yy", "uu"]), prose(3, 200, ["ä", "ö", "ü", "ß", "å", "ø", "æ"])
    rows = [(5, a), (5, b), (9, a), (None, c), (None, b + "."), (None, c), (None, c), (0, c[:300])]
    got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 200)
    rows = [(5, a), (5, b), (9, a)]
    got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted([(len(a.encode()), len(a.encode()))] * 2 + [(len(b), 0)])


def test_an_anchor_in_many_contexts(spark):
    """One line between different words in all rows, some of them longer alike: groups are split, results stay exact."""
    line = "The licence of this file is the Mozilla Public Licence, version 2.0 or later. "
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    sides = [prose(k, 40, words) for k in range(60)]
    rows = [(i, r.choice(sides)[: r.randint(60, 160)] + " " + line + r.choice(sides)[: r.randint(60, 160)]) for i in range(600)]
    got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=3000).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 200)


def test_halves_keep_every_window():
    r = random.Random(5)
    for _ in range(300):
        length = S.KMER + r.randint(1, 60)
        piece = bytes(r.randrange(97, 100) for _ in range(length + r.randint(0, length - S.KMER)))
        windows = len(piece) - length + 1
        todo, seen = [(piece, r.randint(windows - 1, length - S.KMER), 0, 0, 0)], []
        while todo:
            part, at, left, right, base = todo.pop()
            some = list(S.halves(part, at, left, right, length))
            if not some:
                assert left + right + S.KMER == length and len(part) == length
                seen.append((base, part))
            for first, more_left, more_right, _, p in some:
                todo.append((p, at - first, more_left, more_right, base + first))
        assert sorted(seen) == [(k, piece[k : k + length]) for k in range(windows)]


def test_odd_rows(spark, odd, empty):
    got = S.without_repeats(odd).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()], 200)
    assert S.without_repeats(empty).count() == 0

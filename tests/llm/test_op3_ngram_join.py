import itertools
import random
import re

import pytest
from texts import prose

from pagelens.llm import ngram_join

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute(rows, n=4, percent=85):
    sets, parent = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        s = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(i, s) for i, own in sets.items() if i is not None for s in own if s], 2):
        both = len(x & y)
        if 100 * both >= percent * (len(x) + len(y) - both):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return sorted(((i, len(s), None if i is None else root(i)) for i, own in sets.items() for s in own), key=str)


def corpus(seed, groups=25):
    r = random.Random(seed)
    rows, shared = [], prose(99, 30)
    for g in range(groups):
        words = prose(seed * 1000 + g, r.randint(5, 80)).split()
        if g % 3 == 0:
            words += shared.split()
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2])):
                own[r.randrange(len(own))] = f"e{r.randint(0, 5)}"
            rows.append((len(rows), " ".join(own)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"short": 2}), (3, {"short": 1, "group": 150}), (4, {"n": 5, "percent": 80, "short": 3})])
def test_against_brute_force(spark, seed, options):
    rows = corpus(seed)
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, options.get("n", 4), options.get("percent", 85))


def test_odd_rows(spark, odd, empty):
    got = ngram_join.link_components(odd).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.link_components(empty).count() == 0


def test_one_id_with_two_texts_joins_their_classes(spark):
    a, b = prose(5, 30), prose(6, 30)
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_one_of_each(spark, odd):
    kept = ngram_join.one_of_each(odd)
    got = kept.collect()
    assert kept.columns == odd.columns and len({r.doc_id for r in got}) == len(got)
    assert {r.doc_id for r in got} == {r.component_id for r in ngram_join.link_components(odd).collect()}


def test_columns_with_names_of_our_own(spark):
    names = ["_gone", "_row", "gone_id", "row_number", "component_id"]
    df = spark.createDataFrame([(1, prose(5, 30), *names), (2, prose(5, 30), *names), (3, prose(6, 30), *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3] and all(tuple(r[2:]) == tuple(names) for r in got.collect())

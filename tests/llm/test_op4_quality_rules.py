import re
from collections import Counter

import numpy as np
from texts import prose

from pagelens.llm import quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def stats(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_statistics(spark, odd, empty):
    texts = ["a b c d e f a b c d e", "a a a a a a a", "x y\nx y\n\n \nx y", "1 2 3 4 5 6 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6", "#*$%&|<> ok", "nul\x00 \x1c sep\u2028arated\xa0 words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source")
    assert {r.doc_id: stats(r) for r in quality_rules.judged(df).collect()} == {i: base(t) for i, t in enumerate(texts)}
    got = quality_rules.judged(odd).collect()
    assert sorted(map(stats, got)) == sorted(base(r.text) for r in odd.collect())
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judged(empty).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    rows = [(i, prose(i, 60 + i % 200, [w for w in "ab cd efg hi jklm no pq rst uv wxy z0".split()]), "en", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "%%%###" for w in prose(i, 80).split()), "en", "s0") for i in range(20)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i, *_ in rows)
    assert not any(got[i].kept for i, *_ in junk)


def test_small_groups_get_their_languages_then_the_corpus_estimate(spark):
    rows = [(i, prose(i, 50), "fr", f"s{i}") for i in range(60)] + [(100, prose(1, 40), "de", "x"), (101, " ".join(w + "%%%%####$$$$" for w in prose(2, 40).split()), "de", "y")]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.d2 is not None for r in got.values()) and all(got[i].kept for i, *_ in rows[:-1]) and not got[101].kept
    few = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows[55:], "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.d2 is not None for r in few.values())


def steps(x, mean, cov, h):
    """Concentration steps by numpy until nothing changes."""
    floor = np.diag(np.array(quality_rules.FLOOR) ** 2)
    for _ in range(50):
        d = x - mean
        near = x[np.argsort((d @ np.linalg.inv(cov + floor) * d).sum(axis=1))[:h]]
        new = near.mean(axis=0), np.cov(near.T, bias=True)
        if np.allclose(new[0], mean):
            break
        mean, cov = new
    return np.linalg.det(cov + floor), mean


def test_least_determinant_against_many_random_starts(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 5)) * [1, 0.3, 1, 1, 1] + [5, 1, 1, 1, 1]
    x = np.vstack([good, rng.normal(size=(80, 5)) * 0.2 + [9, 3, 7, 7, 7]])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{z} double" for z in quality_rules.Z))
    best = min((steps(x, x[(i := rng.choice(len(x), 12, replace=False))].mean(axis=0), np.cov(x[i].T), int(0.75 * len(x))) for _ in range(60)), key=lambda r: r[0])
    m = quality_rules.estimates(df).first()
    mean = np.array([m[f"m{i}"] for i in range(5)])
    assert np.abs(best[1] - good.mean(axis=0)).max() < 0.3  # the search itself finds the bulk
    assert np.abs(mean - best[1]).max() < 0.3 and np.abs(mean - good.mean(axis=0)).max() < 0.2


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [1, 0.2, 1, 1, 1] + [5, 1, 0, 0, 0]
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{z} double" for z in quality_rules.Z))
    model = quality_rules.estimates(df)
    m = model.first()
    low = np.zeros((5, 5))
    for i in range(5):
        for j in range(i + 1):
            low[i, j] = m[f"l{i}{j}"]
    mean = np.array([m[f"m{i}"] for i in range(5)])
    want = [(r - mean) @ np.linalg.inv(low @ low.T) @ (r - mean) for r in x]
    got = [r.d2 for r in quality_rules._distance(df, model).orderBy("z1").collect()]
    assert np.allclose(got, np.array(want)[np.argsort(x[:, 0])])
    assert np.allclose(mean, x.mean(axis=0), atol=0.3)


def test_chi_squared_constants():
    assert abs(quality_rules._chi2_at(0.95, 5) - 11.0705) < 1e-3 and abs(quality_rules._chi2_below(14.0671, 7) - 0.95) < 1e-4

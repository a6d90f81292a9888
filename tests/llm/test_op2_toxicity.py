import random

import numpy as np
from texts import prose

from pagelens.llm import common as C
from pagelens.llm import toxicity


def tables(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = prose(i, 40).split()
        if toxic:
            for k, w in enumerate(random.Random(i).sample(["vile", "scummy", "rotten", "awful"], 2)):
                words.insert(7 * k, w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = tables(spark)
    got = toxicity.scored(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and len(got) == 600
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    for r in held:
        assert 0 <= r.score <= 1 and r.doc_id not in r.evidence
        if r.score >= 0.5:
            assert r.evidence and r.evidence[0] % 5 == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.3}


def test_neighbours_are_exact(spark):
    docs, labels = tables(spark, 400)
    index = toxicity.learned(docs, labels, 3000)
    dense = np.zeros((len(index.ids), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        dense[index.example[index.begin[t] : index.begin[t + 1]], t] = index.weight[index.begin[t] : index.begin[t + 1]]
    rng = np.random.default_rng(0)
    for _ in range(200):
        term = np.sort(rng.choice(len(index.vocabulary), rng.integers(1, min(8, len(index.vocabulary)) + 1), replace=False))
        w = rng.random(len(term))
        w /= np.sqrt((w * w).sum())
        at, sims = index.nearest(term, w)
        cos = dense[:, term] @ w
        want = np.sort(cos[cos > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(sims, want) and np.allclose(cos[at], sims)


def test_odd_rows(spark, odd, empty):
    _, labels = tables(spark, 30)
    assert toxicity.scored(odd, labels).count() == odd.count()
    assert toxicity.scored(empty, labels).count() == 0
    none = toxicity.scored(odd, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.0}
    strange = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (2, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.scored(odd, strange).count() == odd.count()
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def unanimous(vote, toxic_rate):
    """An index of 15 toxic examples of one term, with such a vote each."""
    n = toxicity.NEIGHBOURS
    return toxicity.Index(np.arange(n), np.ones(n), np.full(n, vote), np.array([5], np.uint64), np.ones(1), np.arange(n), np.zeros(n, np.int64), np.full(n, 0.9), toxic_rate, 0.0)


def test_score_does_not_depend_on_the_size_of_votes():
    # 1% toxic: on a large table a toxic example's vote is about a hundredth of a clean one's
    small, large = (unanimous(v, 0.01).scored(np.array([0]), np.array([1])) for v in (1.0, 0.0101))
    assert small[0] > 0.9 and abs(small[0] - large[0]) < 1e-4


def test_sampled_labels_score_as_all_labels_do(spark):
    docs, labels = tables(spark, 600)
    whole, sampled = ({r.doc_id: r.score for r in toxicity.scored(docs, labels, n).collect()} for n in (3000, 60))
    toxic = [i for i in whole if i % 5 == 0]
    assert np.mean([sampled[i] >= 0.3 for i in toxic]) > 0.97 and np.mean([whole[i] >= 0.3 for i in toxic]) > 0.97


def test_words_of_few_toxic_texts_are_kept_and_copies_count_once(spark):
    rows, labels = [], []
    copied = prose(7, 40, [f"c{k}opied" for k in range(60)])
    for i in range(6000):
        toxic = i % 2 == 0
        # each insult is in about 2.5% of the toxic texts; one harmless toxic text has 60 near copies
        text = f"{copied} n{i}" if toxic and i < 120 else prose(i, 30) + (f" insult{chr(97 + i // 2 % 40 % 26)}{chr(97 + i // 2 % 40 // 26)}" if toxic else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    index = toxicity.learned(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), 3000)
    raw = np.frombuffer(f"insultaa {copied}".encode(), np.uint8)
    h, _ = toxicity.terms(raw, np.array([0, len(raw)]))
    assert h[0] in index.vocabulary and not np.isin(h[1:41], index.vocabulary).any()


def test_scores_are_calibrated(spark):
    """A word that is in toxic texts three times of four, and one that always is: scores are the shares, on rows never learned from."""
    rows, labels = [], []
    for i in range(4000):
        r = random.Random(i)
        kind = r.choice(["plain"] * 8 + ["sure", "perhaps"])
        toxic = kind == "sure" or (kind == "perhaps" and r.random() < 0.75) or r.random() < 0.01
        rows.append((i, prose(i, 25) + {"plain": "", "sure": " vileness", "perhaps": " scumbag"}[kind]))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [(r.score, r.toxic) for r in toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()]
    for lo, hi in ((0, 0.3), (0.3, 0.9), (0.9, 1.01)):
        some = [x for x in got if lo <= x[0] < hi]
        assert len(some) > 50 and abs(np.mean([x[0] for x in some]) - np.mean([x[1] for x in some])) < 0.08


def test_rising_curve_and_chance():
    value, toxic = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1, 0, 1])
    x, y = toxicity.rising(value, toxic, np.ones(4), 0.5)
    assert np.allclose(x, [0.1, 0.25, 0.4]) and np.allclose(y, [0.25, 0.5, 0.75])
    assert np.isclose(C.chance_of(10, 8, 0.5), 56 / 1024) and C.chance_of(5, 1, 0.0) == 1.0

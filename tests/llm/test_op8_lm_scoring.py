import math
import re
from collections import Counter

import pytest
from texts import prose

from pagelens.llm import lm_scoring as M

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, order=3, least=2):
    docs = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in rows]
    count = Counter()
    for _, x in docs:
        s = [1, *x] if x else []
        count.update(tuple(s[i : i + n]) for n in range(1, order + 1) for i in range(len(s) - n + 1))
    size = sum(len(x) for _, x in docs)

    def score(gram):
        if len(gram) == 1:
            return count[gram] / size
        return count[gram] / count[gram[:-1]] if count[gram] >= least else 0.4 * score(gram[1:])

    out = {}
    for i, x in docs:
        s, (total, n) = [1, *x], out.get(i, (0.0, 0))
        total += sum(math.log(score(tuple(s[max(0, k - order + 1) : k + 1]))) for k in range(1, len(s)))
        out[i] = (total, n + len(x))
    return out


@pytest.mark.parametrize(("order", "least", "block", "keys"), [(3, 2, 1_000_000, 2_000_000), (3, 2, 40, 50), (2, 3, 200, 1_000), (5, 2, 300, 400), (4, 1, 100, 500)])
def test_against_brute_force(spark, order, least, block, keys):
    rows = [(i, prose(i, i % 90, [f"w{k * k % 97}" for k in range(60)] + ["The", "the", f"rare{i}"])) for i in range(120)] + [(5, "same id again the end"), (500, prose(7, 60, ["a", "b", "c"])), (501, prose(7, 60, ["a", "b", "c"]))]
    got = {r.doc_id: r for r in M.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"), order, least, block, keys).collect()}
    want = brute(rows, order, least)
    assert got.keys() == want.keys()
    for i, (total, n) in want.items():
        assert got[i].n_tokens == n
        assert (got[i].log_prob is None) == (n == 0) and (not n or abs(got[i].log_prob - total) < 1e-3)


def test_rare_words_are_told_apart_at_any_share(spark):
    """A word that occurs twice among many isn't one with a word that occurs three times, whatever its share of all tokens."""
    rows = [(i, "common " * 1_000) for i in range(300)] + [(1000, "twice"), (1001, "twice"), (1002, "thrice"), (1003, "thrice"), (1004, "thrice"), (1005, "once")]
    got = {r.doc_id: r.log_prob for r in M.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] == got[1001] < got[1002] and got[1005] < got[1000]
    assert abs(got[1000] - math.log(2 / 306)) < 1e-3 and abs(got[1005] - math.log(0.4 / 300_006)) < 1e-3


def test_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in M.scored(odd).collect()}
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert {i: r.n_tokens for i, r in got.items()} == {i: n for i, (_, n) in want.items()}
    assert got[0].log_prob is None and got[0].perplexity is None
    assert M.scored(empty).count() == 0
    for i, (total, n) in want.items():
        assert not n or abs(got[i].log_prob - total) < 1e-3

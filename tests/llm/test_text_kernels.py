import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import common as C

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é \n\t\x0b\x1c", max_size=30)), max_size=6))
def test_words_of_batches_are_words_of_texts(texts):
    raw, off = C.buffers(pa.array(texts, pa.string()))
    starts, ends, first = C.word_spans(raw, off)
    data = raw.tobytes()
    for i, t in enumerate(texts):
        assert [data[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == WORD.findall((t or "").encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_sets_depend_on_the_text_alone(texts, n):
    raw, off = C.buffers(pa.array(texts))
    h, begin = C.doc_sets(raw, off, n)
    for i, t in enumerate(texts):
        one, at = C.doc_sets(*C.buffers(pa.array([t])), n)
        assert np.array_equal(h[begin[i] : begin[i + 1]], one)
        w = WORD.findall(t.lower().encode())
        want = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        assert len(one) == len(want)


def test_long_words_and_slices():
    texts = ["x" * 1000, "x" * 1000 + "y", "x" * 1000]
    raw, off = C.buffers(pa.array([None, *texts]).slice(1))
    starts, ends, _ = C.word_spans(raw, off)
    a, b, c = C.word_hashes(raw, starts, ends)
    assert a == c != b


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 150)], "a long, b long")
    got = dict((r.node, r.component) for r in C.components(edges).collect())
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[150] == 100
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0

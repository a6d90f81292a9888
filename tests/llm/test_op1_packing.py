import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagelens.llm import packing
from pagelens.llm.queries import QUERIES

TOKENIZER = Tokenizer.from_file(packing.vocabulary())
STRANGE = ["", " ", "don't  STOP'S I've", "İstanbul Σίσυφος ΑΣ", "éa é", "<|endoftext|> a", "a\x1cb\x85c", "１２3 ½", "日本語 テスト", "a<|startoftext|>b", "“quote”—dash…", "ﬁ ﬂ K Å", "̀a b", "it's'll 'd x'", "a" * 300 + " ok", "\x00 nul\x00x", "x9. 9x_ a-b'"]


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def encoded(tokenizer, texts):
    parts = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, parts)])
    got, bounds = tokenizer(np.frombuffer(b"".join(parts), np.uint8), off)
    return [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_word_ids_are_the_tokenizers(monkeypatch):
    tokenizer = packing.WordTokenizer(packing.vocabulary())
    plain = [t for t in STRANGE if "<|" not in t]
    for texts in (STRANGE, plain, STRANGE[3:5], [""], []):
        assert encoded(tokenizer, texts) == [ids(t)[:-1] for t in texts]
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)  # the worker begins anew, also with more words in one piece
    for texts in (STRANGE, plain[:3], plain):
        assert encoded(tokenizer, texts) == [ids(t)[:-1] for t in texts]


def checked(pieces, texts, most=2048):
    """Pieces cover each text's ids once, sequences are gapless; returns tokens and padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, own in by_doc.items():
        want, at = ids(texts[doc]), 0
        times = sum(p.start == 0 for p in own)  # equal rows are packed each
        for p in sorted(own, key=lambda p: (p.start, p.length)):
            part = np.array(want[p.start : p.start + p.length], "<u4").tobytes()
            assert p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(want) * times
    total = pad = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else most - at)
    return total, pad


def test_query_over_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    total, pad = checked(QUERIES["op1_packing"](spark, "/root/testdata/sf0.001").collect(), texts)
    assert total == sum(len(ids(t)) for t in texts.values()) and pad <= 0.01 * total


def test_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    out = packing.pack(odd, packing.vocabulary()).withColumn("ids_crc32", F.crc32("ids"))
    texts = {r.doc_id: r.text for r in odd.collect()}
    checked(out.collect(), texts)
    assert packing.pack(empty, packing.vocabulary()).count() == 0


def test_limits_hold_together():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 300, 400)
    sizes = np.stack([tokens, np.ones_like(tokens), tokens // 3], axis=1)
    capacity = np.array([1024.0, 6, 200])
    out = packing.bins(sizes, capacity, cut=False)
    assert sorted(i for s in out for i, _, _ in s) == list(range(400))
    assert all((sizes[[i for i, _, _ in s]].sum(axis=0) <= capacity).all() for s in out)
    least = max(np.ceil(sizes.sum(axis=0) / capacity))
    assert len(out) <= 1.15 * least
    with pytest.raises(ValueError):
        packing.bins(np.array([[2000, 1, 0]]), capacity, cut=False)


def test_loss_limit_for_instructions(spark):
    rows = [(i, "word " * (50 + i), i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, loss boolean").coalesce(1)
    out = packing.pack(df, packing.vocabulary(), max_tokens=512, max_segments=5, max_loss=128).collect()
    for s in {p.sequence_id for p in out}:
        own = [p for p in out if p.sequence_id == s]
        assert len(own) <= 5 and sum(p.length for p in own) <= 512 and sum(p.length for p in own if p.doc_id % 2 == 0) <= 128


def test_powers():
    out = packing.at_powers([(0, 5, 100), (1, 0, 51)])
    assert [sum(n for _, _, n in s) for s in out] == [128, 16, 4, 2, 1]
    assert sum(n for s in out for i, _, n in s if i == 1) == 51


def test_the_dot_product_decides_the_packing():
    """With the same tokens but other loss-bearing ones the packing is another; against filling sequences with the largest item that fits it needs about as many."""

    def largest_first(sizes, capacity):
        left, n = [tuple(x) for x in sorted(sizes.tolist(), reverse=True)], 0
        while left:
            room, rest = capacity.copy(), []
            for x in left:
                if all(a <= b for a, b in zip(x, room)):
                    room = room - x
                else:
                    rest.append(x)
            left, n = rest, n + 1
        return n

    for seed in range(10):
        rng = np.random.default_rng(seed)
        tokens = rng.integers(20, 600, 300)
        sizes = np.stack([tokens, np.ones_like(tokens), (tokens * rng.random(300)).astype(int)], axis=1)
        capacity = np.array([2048.0, 8, 700])
        mine = packing.bins(sizes, capacity, cut=False)
        assert len(mine) <= 1.05 * largest_first(sizes, capacity)
        other = sizes.copy()
        other[:, 2] = rng.permutation(tokens)[: len(tokens)] // 3
        assert {frozenset(i for i, _, _ in q) for q in mine} != {frozenset(i for i, _, _ in q) for q in packing.bins(other, capacity, cut=False)}

"""Stupid-backoff language model scores, computed with count tables, joins and sums.

The corpus scores itself: counts of all n-grams up to ORDER words come from all
documents, by 64-bit hash, with no vocabulary and no floor that rises with the
corpus. Words are lower-cased `[^\\x20\\x09-\\x0D]+`; a start before each text
with words is the context of its first word. With c for counts and N for the
number of words, the score of w after n - 1 others is

    S(w | v1 .. vk) = c(v1 .. vk w) / c(v1 .. vk)      if v1 .. vk w occurs MIN_COUNT times or more,
                      BACKOFF * S(w | v2 .. vk)        else,
    S(w)            = c(w) / N.

Texts are laid in blocks of about BLOCK_TOKENS words, one row each, written once.
A block sends each distinct n-gram with its count, in ranges of the hash; a range
sums the counts and answers each block with the totals in the order asked, so
no key comes back. So an n-gram sends a row's entry per block, however often it
occurs: a word with a third of all occurrences loads its range no more than one
that each block has once. N-grams of three or more words are sent only where both
shorter ones in them occur MIN_COUNT times, since they can't do so otherwise.
Then blocks join their totals, and logarithms are summed by document. The number
of ranges grows with the words, so that a range has about RANGE_KEYS entries.

A null or empty text has no tokens and null scores. Rows that share a doc_id are
scored as texts of their own and summed as one document, a null doc_id too; equal
rows under several ids get equal scores. A very long text is a block of its own,
in one task. An n-gram that occurs exactly MIN_COUNT times is used. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common as C

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
#: Words of a block, and n-grams that a range of hashes gets before equal ones of a block are one.
BLOCK_TOKENS, RANGE_KEYS = 500_000, 2_000_000
#: Stands before each text's first word.
START = np.uint64(0x5374617274)

_BLOCK = "block long, n_tokens long, ids array<long>, sizes array<long>, text binary"
_ASKED = "range long, block long, step int, keys binary, counts binary"
_TOTALS = "range long, block long, step int, totals binary"


def _packed(a: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, so that the equal leading bytes of sorted or small ones compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _new(keys: np.ndarray) -> np.ndarray:
    """Of sorted hashes, which differ from the one before."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Each hash's range of n, rising with the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    def row(seq: int, held: list, tokens: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([p.column(0) for p, _, _ in held])
        sizes = np.concatenate([np.diff(off) for _, _, off in held])
        text = pa.Codec("zstd", compression_level=1).compress(np.concatenate([raw for _, raw, _ in held]).tobytes(), asbytes=True)
        block = TaskContext.get().partitionId() << 32 | seq
        lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(sizes, pa.int64()))]
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([tokens], pa.int64()), *lists, pa.array([text], pa.binary())], ["block", "n_tokens", "ids", "sizes", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, seq = [], 0, 0
        for part, raw, off in C.pieces(batches, 1):
            low = C.lowered(raw)
            held.append((part, low, off))
            tokens += len(C.word_spans(low, off)[0])
            if tokens >= block_tokens:
                yield row(seq, held, tokens)
                held, tokens, seq = [], 0, seq + 1
        if held:
            yield row(seq, held, tokens)

    return C.arrow_map(docs, run, _BLOCK)


class Block:
    """A block's words with the starts between them, its n-grams and what is known of their counts."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, text: bytes):
        raw = np.frombuffer(pa.Codec("zstd").decompress(text, decompressed_size=int(sizes.sum()), asbytes=True), dtype=np.uint8) if len(text) and sizes.sum() else np.zeros(0, np.uint8)
        off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        starts, ends, first = C.word_spans(raw, off)
        some = np.diff(first) > 0
        self.ids = ids
        self.words = np.insert(C.word_hashes(raw, starts, ends), first[:-1][some], START)
        self.first = first + np.concatenate([[0], np.cumsum(some)])
        self.starts = self.first[:-1][some]
        self.counts: dict[int, np.ndarray] = {}

    def count(self, n: int) -> np.ndarray:
        """Of the n-gram that ends at each word how often it occurs; 0 is not known to be frequent."""
        return self.counts.get(n, np.zeros(len(self.words), dtype=np.int64))

    def grams(self, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n-grams and the word at which each ends, without those whose parts say that they are rare."""
        h, at = C.windows(self.words, self.first, n)
        end = at + n - 1
        if n > 2:
            shorter = self.count(n - 1)
            both = (shorter[end] >= least) & (shorter[end - 1] >= least)
            h, end = h[both], end[both]
        return h, end

    def asked(self, step: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a step, and how often each occurs here; the first step has words and pairs."""
        keys = np.sort(np.concatenate([self.grams(n, least)[0] for n in _orders(step)]))
        at = np.flatnonzero(_new(keys))
        return keys[at], np.diff(np.append(at, len(keys)))

    def learn(self, step: int, least: int, totals: np.ndarray) -> None:
        """Takes the totals of asked(step), in its order."""
        grams = {n: self.grams(n, least) for n in _orders(step)}
        keys = np.concatenate([h for h, _ in grams.values()])
        order = np.argsort(keys)
        number = np.cumsum(_new(keys[order]))
        if len(totals) != (number[-1] if len(number) else 0):
            raise RuntimeError("totals of a block are missing")
        found = np.empty(len(keys), dtype=np.int64)
        found[order] = totals[number - 1]
        for n, (h, end) in grams.items():
            self.counts[n] = np.zeros(len(self.words), dtype=np.int64)
            self.counts[n][end], found = found[: len(h)], found[len(h) :]

    def sums(self, order: int, least: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Each text's number of words and the sum of their logarithms."""
        size, n_words = len(self.words), np.diff(self.first)
        value = np.log(np.maximum(self.count(1), 1)) - math.log(max(1, tokens))
        place = np.arange(size) - np.repeat(self.first[:-1], n_words)
        for n in range(2, order + 1):
            exists = place >= n - 1
            here, before = self.count(n), self.count(n - 1)
            seen = np.flatnonzero(exists & (here >= least))
            value[exists] += math.log(BACKOFF)
            value[seen] = np.log(here[seen]) - np.log(before[seen - 1])
        value[self.starts] = 0
        doc = np.repeat(np.arange(len(n_words)), n_words)
        return n_words - (n_words > 0), np.bincount(doc, weights=value, minlength=len(n_words))


def _orders(step: int) -> tuple[int, ...]:
    return (1, 2) if step == 2 else (step,)


def _loaded(left: pa.Table | pa.RecordBatch, i: int = 0) -> Block:
    return Block(left.column("ids")[i].values, left.column("sizes")[i].values.to_numpy(zero_copy_only=False), left.column("text")[i].as_py())


def _known(left: pa.Table, right: pa.Table, least: int) -> Block:
    """A block with the totals that ranges have answered."""
    block = _loaded(left)
    steps: dict[int, list] = {}
    for r, step, totals in zip(right.column("range").to_pylist(), right.column("step").to_pylist(), right.column("totals").to_pylist()):
        steps.setdefault(step, []).append((r, totals))
    last = max(steps, default=1)
    for step in range(2, last + 1):
        block.learn(step, least, np.concatenate([_unpacked(t) for _, t in sorted(steps.get(step, []))] or [np.zeros(0, np.uint64)]).astype(np.int64))
    return block


def _question(block: Block, number: int, step: int, least: int, ranges: int) -> pa.Table:
    keys, counts = block.asked(step, least)
    r = _ranges(keys, ranges)
    cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    to = np.append(cut[1:], len(r))
    return pa.table(
        [pa.array(r[cut].astype(np.int64)), pa.array(np.full(len(cut), number), pa.int64()), pa.array(np.full(len(cut), step), pa.int32()), pa.array([_packed(keys[a:b]) for a, b in zip(cut, to)], pa.binary()), pa.array([_packed(counts[a:b]) for a, b in zip(cut, to)], pa.binary())],
        ["range", "block", "step", "keys", "counts"],
    )


def _answer(asked: pa.Table) -> pa.Table:
    """The sums of a range's counts over all blocks, for each block in the order of its question."""
    keys = [_unpacked(k.as_py()) for k in asked.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    counts = np.concatenate([_unpacked(c.as_py()) for c in asked.column("counts")])
    order = np.argsort(keys)
    new = _new(keys[order])
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    totals = np.empty(len(keys), dtype=np.uint64)
    totals[order] = sums[np.cumsum(new) - 1]
    packed = pa.array([_packed(t) for t in np.split(totals, ends[:-1])], pa.binary())
    return pa.table([asked.column("range"), asked.column("block"), asked.column("step"), packed], ["range", "block", "step", "totals"])


def scored(documents: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, n_tokens, log_prob (natural logarithm) and perplexity of each document of `documents` (doc_id, text)."""
    if order < 2 or min_count < 1:
        raise ValueError("order is 2 at least, min_count 1")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = C.stored(_blocks(docs, block_tokens))
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0

    def first_questions(ranges: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _question(_loaded(batch, i), batch.column("block")[i].as_py(), 2, min_count, ranges).to_batches()

        return C.arrow_map(blocks, run, _ASKED)

    def joined(answers: DataFrame, f, schema: str) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = f(left.column("block")[0].as_py(), _known(left, right, min_count))
            C.trim()
            return out

        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    stored = []
    for step in range(2, order + 1):
        ranges = max(1, math.ceil(tokens * len(_orders(step)) / range_keys))
        if step == 2:
            asked = first_questions(ranges)
        else:
            asked = joined(_all(stored), lambda number, block, step=step, ranges=ranges: _question(block, number, step, min_count, ranges), _ASKED)
        stored.append(C.stored(asked.groupBy("range").applyInArrow(_answer, _TOTALS)))

    def sums(number: int, block: Block) -> pa.Table:
        n_tokens, total = block.sums(order, min_count, tokens)
        return pa.table([block.ids, pa.array(n_tokens, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "n_tokens", "total"])

    by_text = C.stored(joined(_all(stored), sums, "doc_id long, n_tokens long, total double"))
    C.forget(blocks, *stored)
    by_doc = by_text.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("total").alias("total"))
    some = F.col("n_tokens") > 0
    return by_doc.select("doc_id", "n_tokens", F.when(some, F.round("total", 4)).alias("log_prob"), F.when(some, F.round(F.exp(-F.col("total") / F.col("n_tokens")), 3)).alias("perplexity"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(C.table(spark, sf_dir, "documents"))

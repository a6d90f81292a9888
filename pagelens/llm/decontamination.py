"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

An item's shingles are its n-word sequences (its whole text, if it has fewer
words), in lower case and counted. A document's windows have the length of an
item (or the document's, if that is shorter) and begin at every word. Windows
that hold no shingle of an item of their length have an exact similarity of 0
and are skipped; every other window gets a fingerprint.

Fingerprints have 128 bits. They are cut into 8 blocks; an index per block lists
the items under every value within radius // 8 bits of theirs, so by the
pigeonhole principle a window within the radius of an item finds it in at least
one block. Candidates within the radius are verified by the exact similarity of
counted shingles (the sum of minima over the sum of maxima).

Items are sent out in blocks of about `block` items, so what is sent has a bound
for benchmarks of any size. With more than one block, the documents that hold a
shingle of any item are stored first, in a scan for each SHINGLES_AT_ONCE
shingles, and only those are compared with the blocks. Nothing else is shuffled.

Null or empty texts and items match nothing, and an empty table gives nothing.
Equal rows are returned each; equal items match each. Of a document's windows
that are equally like an item, the first is named. A very long text is read in
one task, its windows fingerprinted some thousands at once. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common as C

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 31, 8
ITEMS_AT_ONCE, SHINGLES_AT_ONCE = 500, 4_000_000
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double"
_WIDTH = 128 // BLOCKS


def _bits(h: np.ndarray) -> np.ndarray:
    """128 signs for each shingle hash."""
    both = np.stack([C.mix(h ^ np.uint64(0x1F83D9AB)), C.mix(h ^ np.uint64(0x5BE0CD19))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _fingerprints(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SimHash of each run of shingles, as 8 blocks of 16 bits; runs aren't empty."""
    total = np.add.reduceat(_bits(h).astype(np.int32), begin[:-1], axis=0)
    return np.packbits(total > 0, axis=1).view(">u2").astype(np.int64)


class Items:
    """A block of benchmark items: shingles, fingerprints and the block indexes."""

    def __init__(self, ids: list[int], texts: list[bytes], words: int, similarity: float, radius: int):
        self.words, self.similarity, self.radius = words, similarity, radius
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        low = C.lowered(np.frombuffer(b"".join(texts), np.uint8))
        starts, ends, first = C.word_spans(low, off)
        h, at = C.shingles(C.word_hashes(low, starts, ends), first, words)
        item = np.searchsorted(first, at, side="right") - 1
        some = np.flatnonzero(np.diff(first) > 0)  # items with words
        self.ids, self.size = [ids[i] for i in some.tolist()], np.diff(first)[some]
        rename = np.full(len(texts), -1)
        rename[some] = np.arange(len(some))
        self.item, self.offset = rename[item], at - first[item]
        order = np.argsort(h, kind="stable")
        self.h, self.item_of, self.offset_of = h[order], self.item[order], self.offset[order]
        begin = np.searchsorted(self.item, np.arange(len(some) + 1))
        self.shingles = [h[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        self.sorted = [np.sort(s) for s in self.shingles]
        self.prints = _fingerprints(h, begin) if len(some) else np.zeros((0, BLOCKS), np.int64)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.tables = None

    def index(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block, the items under each value within radius // BLOCKS bits; made once by each worker."""
        if self.tables is None:
            masks = [sum(1 << b for b in c) for n in range(self.radius // BLOCKS + 1) for c in combinations(range(_WIDTH), n)]
            self.tables = []
            for k in range(BLOCKS):
                value = (self.prints[:, k, None] ^ np.array(masks)[None, :]).reshape(-1)
                item = np.repeat(np.arange(len(self.prints)), len(masks))
                order = np.argsort(value, kind="stable")
                self.tables.append((np.searchsorted(value[order], np.arange((1 << _WIDTH) + 1)), item[order]))
        return self.tables

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item) within the radius."""
        rows, items = [], []
        for k, (begin, item) in enumerate(self.index()):
            lo, hi = begin[prints[:, k]], begin[prints[:, k] + 1]
            count = hi - lo
            row = np.repeat(np.arange(len(prints)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]
            rows.append(row), items.append(item[at])
        pair = np.unique(np.concatenate(rows) * len(self.ids) + np.concatenate(items))
        row, item = pair // len(self.ids), pair % len(self.ids)
        near = np.bitwise_count(prints[row] ^ self.prints[item]).sum(axis=1) <= self.radius
        return row[near], item[near]

    def _short(self, best: dict[tuple[int, int], tuple[float, int]], words: np.ndarray, first: np.ndarray) -> None:
        """Items with fewer words than a shingle: their windows are one shingle, and equal or not."""
        for n in np.unique(self.size[self.size < self.words]).tolist():
            own = np.flatnonzero(self.size == n)
            target = np.array([self.shingles[i][0] for i in own])
            h, at = C.windows(words, first, n)
            for k in np.flatnonzero(np.isin(h, target)).tolist():
                doc = int(np.searchsorted(first, at[k], side="right")) - 1
                for i in own[target == h[k]].tolist():
                    best.setdefault((doc, i), (1.0, int(at[k] - first[doc])))

    def _windows(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(first word, words, document) of every item-sized window that holds a shared shingle: one at `word`, of the items in lo:hi."""
        count = hi - lo
        row = np.repeat(np.arange(len(word)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]
        pair = np.unique(np.stack([word[row], self.size[self.item_of[k]]], axis=1), axis=0)
        word, size = pair.T
        doc = np.searchsorted(first, word, side="right") - 1
        begin, end = first[doc], first[doc + 1]
        size = np.minimum(size, end - begin)
        # windows of that length in which the shingle lies
        last = np.minimum(word, end - size)
        start = np.minimum(np.maximum(begin, word + np.minimum(self.words, size) - size), last)
        n = last - start + 1
        row = np.repeat(np.arange(len(word)), n)
        start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]
        return np.unique(np.stack([start, size[row], doc[row]], axis=1), axis=0)

    def found(self, raw: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """By document and item: the best similarity and the window's first word."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if not len(self.ids):
            return best
        low = C.lowered(raw)
        starts, ends, first = C.word_spans(low, off)
        words = C.word_hashes(low, starts, ends)
        self._short(best, words, first)
        h, at = C.shingles(words, first, self.words)
        some = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.h, h[some]), np.searchsorted(self.h, h[some], side="right")
        some, lo, hi = some[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(some):
            return best
        win = self._windows(at[some], lo, hi, first)
        # shingles of each window: those that begin in it and end in it
        a = np.searchsorted(at, win[:, 0])
        b = np.maximum(a + 1, np.searchsorted(at, win[:, 0] + np.maximum(1, win[:, 1] - self.words + 1)))
        for part in range(0, len(win), 2000):
            w, lo, hi = win[part : part + 2000], a[part : part + 2000], b[part : part + 2000]
            n = hi - lo
            begin = np.concatenate([[0], np.cumsum(n)])
            flat = h[np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(lo, n)]
            for r, i in zip(*(x.tolist() for x in self.within(_fingerprints(flat, begin))), strict=True):
                s = similarity(np.sort(flat[begin[r] : begin[r + 1]]), self.sorted[i])
                key = (int(w[r, 2]), i)
                if s >= self.similarity and (-s, w[r, 0]) < (-best.get(key, (0, 0))[0], best.get(key, (0, 0))[1] + first[w[r, 2]]):
                    best[key] = (s, int(w[r, 0] - first[w[r, 2]]))
        return best


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted runs of hashes, with repeats: the sum of minimal counts over the sum of maximal counts."""
    keys = np.concatenate([a, b])
    _, at = np.unique(keys, return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=at.max() + 1), np.bincount(at[len(a) :], minlength=at.max() + 1)
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _hits(docs: DataFrame, items: Items) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for part, raw, off in C.pieces(batches, 1):
            if best := items.found(raw, off):
                ids = part.column(0).take(pa.array([d for d, _ in best]))
                item = np.array([i for _, i in best])
                yield pa.record_batch([ids, pa.array([items.ids[i] for i in item], pa.int64()), pa.array([s for _, s in best.values()], pa.int64()), pa.array(items.size[item]), pa.array([round(s, 6) for s, _ in best.values()])], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return C.arrow_map(docs, run, SCHEMA)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")


def _parts(items: DataFrame, block: int) -> int:
    return max(1, -(-items.count() // block))


def _blocks(items: DataFrame, parts: int, words: int, similarity: float, radius: int) -> Iterator[Items]:
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow().sort_by([("item_id", "ascending")])
        yield Items(rows.column(0).to_pylist(), rows.column(1).to_pylist(), words, similarity, radius)


def _marked(docs: DataFrame, items: DataFrame, words: int, name: str) -> DataFrame:
    """The rows of docs with a column that tells whether they hold a shingle of an item, or are as short as one."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in C.pieces(batches, 0):
            low = C.lowered(raw)
            starts, ends, first = C.word_spans(low, off)
            own = C.word_hashes(low, starts, ends)
            yield pa.record_batch([pa.array(np.unique(C.shingles(own, first, words)[0]).view(np.int64))], ["h"])

    every = C.checkpointed(C.arrow_map(items.select("text"), of_items, "h long").distinct())
    scans = max(1, -(-every.count() // SHINGLES_AT_ONCE))
    at, out = docs.columns.index("text"), docs.withColumn(name, F.lit(False))
    for k in range(scans):
        some = np.sort(every.where(F.pmod("h", F.lit(scans)) == k).toArrow().column(0).to_numpy().view(np.uint64))
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for part, raw, off in C.pieces(batches, at):
                low = C.lowered(raw)
                starts, ends, first = C.word_spans(low, off)
                own = C.word_hashes(low, starts, ends)
                keep = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).copy()
                for n in range(1, words + 1):  # items of fewer words are shingles of that length
                    h, word = C.shingles(own, first, n)
                    hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), dtype=bool)
                    keep[np.searchsorted(first, word[hit], side="right") - 1] = True
                yield part.set_column(part.num_columns - 1, name, pa.array(keep))

        out = C.arrow_map(out, run, out.schema)
    return C.stored(out)


def contaminated(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = ITEMS_AT_ONCE) -> DataFrame:
    """Hits (doc_id, item_id, start_word, n_words, similarity), the best window for each document and item."""
    docs, items = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _items(benchmark)
    if (parts := _parts(items, block)) > 1:
        docs = _marked(docs, items, words, "held").where("held").drop("held")
    return reduce(DataFrame.unionByName, [_hits(docs, some) for some in _blocks(items, parts, words, similarity, radius)])


def without_contaminated(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of `documents`, with all their columns, in which no item is found."""
    at = documents.columns.index("text")

    def passed(df: DataFrame, items: Items) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, raw, off in C.pieces(batches, at):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[d for d, _ in sent.value.found(raw, off)]] = False
                yield part.filter(pa.array(keep))

        return C.arrow_map(df, run, df.schema)

    items = _items(benchmark)
    if (parts := _parts(items, block)) == 1:
        return passed(documents, *_blocks(items, 1, words, similarity, radius))
    name = C.unused(documents.columns, "held")
    marked = _marked(documents, items, words, name)
    held = reduce(passed, _blocks(items, parts, words, similarity, radius), marked.where(name).drop(name))
    return marked.where(~F.col(name)).drop(name).unionByName(held)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))

"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are lower-cased words and their 4-, 5- and 6-byte beginnings, as 64-bit
hashes. The vocabulary has those that are MIN_LIFT times as frequent under
label 1 as under label 0 in the learning sample, and significantly so: were the
label drawn by its rate, the chance of so many texts with it, times the number
of terms tried, is at most CHANCE. Exact and near copies of a document count
once there (many copies would lend their words significance). Weights are
(1 + ln tf) * idf, vectors have length 1.

Examples are cut into blocks, and for each term and block the greatest weight is
kept. A query's blocks are visited by descending upper bound of the cosine, and
the search ends where no block left can reach the k-th neighbour, so the
neighbours are exact. Votes are weighted by similarity and by the inverse of
each label's sampling rate, and drawn to the base rate by PRIOR mean votes of
the neighbours. The score is that value on a rising curve, fitted to the
learning sample (each example scored without itself), of the share of label 1.
The nearest examples are returned as evidence. A text without a term of the
vocabulary has no neighbours, and gets the rate of label 1 among such examples.

Learning sees a bounded sample (`per_label` rows of each label, chosen by a hash
of the row) of labelled rows outside the held-out fold. Scoring reads each text
once and shuffles nothing. A null text counts as empty, and a very long one is
read in one task. Equal rows get equal results; a doc_id labelled twice counts
once for each distinct label. Of equally near examples the smaller doc_id comes
first. With nothing to learn from (empty tables too), all scores are 0. Other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common as C

MIN_DOCUMENTS, CHANCE, MIN_LIFT = 4, 0.01, 5.0
BLOCK, NEIGHBOURS, PRIOR = 64, 15, 0.3
#: Texts that share at least ALIKE of the smallest SKETCH hashes of their 3-word shingles are near copies.
SKETCH, ALIKE = 32, 0.5
#: Fewer examples with terms give no curve.
MIN_CURVE = 20
#: Bytes of queries and results that a worker keeps.
KEPT_BYTES = 24 << 20
_PREFIXES = (4, 5, 6)


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, with their document."""
    low = C.folded(raw)
    starts, ends, first = C.word_spans(low, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    size = ends - starts
    out, by = [C.word_hashes(low, starts, ends)], [doc]
    lane = C.lanes(low)[starts]
    for n in _PREFIXES:
        some = size > n
        out.append(C.mix((lane[some] & np.uint64((1 << 8 * n) - 1)) ^ np.uint64(0xA5A5 + n << 48)))
        by.append(doc[some])
    return np.concatenate(out), np.concatenate(by)


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) and how often."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


class Index:
    """The labelled examples by term, with block maxima."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, vote: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray, base: float, without: float):
        self.ids, self.toxic, self.vote, self.base, self.without = ids, toxic, vote, base, without
        self.vocabulary, self.idf = vocabulary, idf
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.blocks = -(-max(1, len(ids)) // BLOCK)
        self.most = np.zeros((len(vocabulary), self.blocks), dtype=np.float32)
        np.maximum.at(self.most, (term, example // BLOCK), np.nextafter(weight.astype(np.float32), np.float32(2)))
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        self.results: dict[bytes, tuple] = {}
        self.kept_bytes = 0

    def known(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the vocabulary by number, with document and count."""
        some = self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        h, doc = h[some], doc[some]
        if not len(self.vocabulary):
            h, doc = h[:0], doc[:0]
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        some = self.vocabulary[at] == h
        return counted(at[some], doc[some])

    def nearest(self, term: np.ndarray, weight: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (but one) and their cosines, nearest first; equals by example."""
        bound = weight @ self.most[term]
        found, sims = np.zeros(0, np.int64), np.zeros(0)
        lists = [(slice(self.begin[t], self.begin[t + 1]), w) for t, w in zip(term.tolist(), weight.tolist(), strict=True)]
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(found) >= NEIGHBOURS and bound[b] + 1e-6 < sims[NEIGHBOURS - 1]):
                break
            total = np.zeros(BLOCK)
            for part, w in lists:
                x = self.example[part]
                lo, hi = np.searchsorted(x, (b * BLOCK, (b + 1) * BLOCK))
                total[x[lo:hi] - b * BLOCK] += w * self.weight[part][lo:hi]
            if b * BLOCK <= without < (b + 1) * BLOCK:
                total[without - b * BLOCK] = 0
            some = np.flatnonzero(total > 0)
            found, sims = np.concatenate([found, some + b * BLOCK]), np.concatenate([sims, total[some]])
            order = np.lexsort((found, -np.round(sims, 9)))[:NEIGHBOURS]
            found, sims = found[order], sims[order]
        return found, sims

    def voted(self, at: np.ndarray, sims: np.ndarray) -> float:
        """The share of label 1 among the neighbours' votes."""
        vote = sims**2 * self.vote[at]
        # in units of the neighbours' mean vote, the prior weighs as much at any size of the table
        prior = PRIOR * self.vote[at].mean() if len(at) else 1.0
        return float(((vote * self.toxic[at]).sum() + prior * self.base) / (vote.sum() + prior))

    def scored(self, term: np.ndarray, count: np.ndarray) -> tuple[float, list[int], list[float]]:
        """The score, and ids and cosines of the nearest examples."""
        if not len(term):
            return self.without, [], []
        key = term.tobytes() + count.tobytes()
        if key not in self.results:
            if self.kept_bytes >= KEPT_BYTES:
                self.results.clear()
                self.kept_bytes = 0
            self.kept_bytes += len(key) + 600
            w = (1 + np.log(count)) * self.idf[term]
            at, sims = self.nearest(term, w / np.sqrt((w * w).sum()))
            score = self.voted(at, sims)
            if self.curve:
                score = float(np.interp(score, *self.curve))
            self.results[key] = (round(score, 6), self.ids[at[:3]].tolist(), np.round(sims[:3], 6).tolist())
        return self.results[key]

    def calibrate(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Fits the curve to the examples (rows of example, term and weight, by example) that have terms."""
        own, begin = np.unique(example, return_index=True)
        if len(own) < MIN_CURVE or not 0 < self.toxic[own].sum() < len(own):
            return
        ends = np.append(begin[1:], len(example))
        value = np.array([self.voted(*self.nearest(term[a:b], weight[a:b], i)) for i, a, b in zip(own.tolist(), begin.tolist(), ends.tolist(), strict=True)])
        self.curve = rising(value, self.toxic[own], self.vote[own], self.base)


def rising(value: np.ndarray, toxic: np.ndarray, weight: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to the labels by squares (neighbours that violate the order are pooled), as points to interpolate; each point is drawn to the base rate by one mean weight."""
    blocks: list[list[float]] = []  # weight, weight of label 1, weighted values
    for i in np.argsort(value, kind="stable").tolist():
        blocks.append([weight[i], weight[i] * toxic[i], weight[i] * value[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    n, pos, at = np.array(blocks).T
    mean = weight.mean()
    return at / n, np.maximum.accumulate((pos + mean * base) / (n + mean))


def leaders(sketches: list[list[int]], toxic: list[int]) -> list[int]:
    """The examples that are no copies of an earlier one with the same label."""
    out, by = [], defaultdict(list)
    sets = [frozenset(x) for x in sketches]
    for i, mine in enumerate(sets):
        met = {j for h in mine for j in by[toxic[i], h]}
        for j in met:
            least = sorted(mine | sets[j])[:SKETCH]
            if sum(h in mine and h in sets[j] for h in least) >= ALIKE * len(least):
                break
        else:
            out.append(i)
            for h in mine:
                by[toxic[i], h].append(i)
    return out


def learned(documents: DataFrame, labels: DataFrame, per_label: int) -> Index | None:
    """The index of a bounded sample of labelled rows outside the held-out fold."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~C.held_out()).distinct()
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not counts:
        return None
    limit = {t: C.limit_for(per_label, c) for t, c in counts.items()}
    rate = {t: x / C.SHARES for t, x in limit.items()}
    cut = F.create_map(*(F.lit(v) for t, x in limit.items() for v in (t, x)))
    chosen = marked.where(C.drawn(cut[F.col("toxic")], "toxicity", "doc_id")).limit(4 * per_label)
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in C.pieces(batches, 1):
            h, doc, _ = counted(*terms(raw, off))
            toxic = part.column(2).to_numpy()
            h, at = np.unique(h, return_inverse=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.bincount(at, minlength=len(h))), pa.array(np.bincount(at, weights=toxic[doc], minlength=len(h)).astype(np.int64))], ["h", "n", "toxic"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in C.pieces(batches, 1):
            h, begin = C.doc_sets(raw, off, 3)
            h = (h >> np.uint64(1)).astype(np.int64)
            yield pa.record_batch([part.column(0), part.column(2), pa.array([h[a : min(b, a + SKETCH)] for a, b in pairwise(begin.tolist() + [len(h)])][: part.num_rows], pa.list_(pa.int64()))], ["doc_id", "toxic", "sketch"])

    # the sample's texts are read three times, only rows that the bounded sample names
    drawn = C.arrow_map(sample.select("doc_id", "text", "toxic"), sketches, "doc_id long, toxic int, sketch array<long>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    apart = drawn.select(["doc_id", "toxic"]).take(pa.array(leaders(drawn.column("sketch").to_pylist(), drawn.column("toxic").to_pylist()), pa.int64()))
    every, sample = sample, sample.join(F.broadcast(documents.sparkSession.createDataFrame(apart).distinct()), ["doc_id", "toxic"], "left_semi")
    total = sample.groupBy().agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, pos = total["n"], total["toxic"] or 0
    if not n:
        return None
    # of the bounded sample's terms only a number and those of label 1 come here
    tried = C.checkpointed(C.arrow_map(sample.select("doc_id", "text", "toxic"), counts_of, "h long, n long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_DOCUMENTS))
    a, b = F.col("toxic"), F.col("n") - F.col("toxic")
    terms_tried, some = tried.count(), tried.where(a * (n - pos) >= MIN_LIFT * b * pos).toArrow()
    h, having, toxic_having = (some.column(k).to_numpy() for k in ("h", "n", "toxic"))
    sure = np.array([C.chance_of(x, y, pos / n) * terms_tried <= CHANCE for x, y in zip(having.tolist(), toxic_having.tolist(), strict=True)], dtype=bool)
    h, having = h[sure].view(np.uint64), having[sure]
    order = np.argsort(h)
    vocabulary, idf = h[order], np.log(1 + n / having[order])
    look = Index(*(np.zeros(0, np.int64),) * 3, vocabulary, idf, *(np.zeros(0, np.int64),) * 2, np.zeros(0), 0.0, 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in C.pieces(batches, 1):
            term, doc, count = look.known(*terms(raw, off))
            at = np.searchsorted(doc, np.arange(len(off)))
            offsets = pa.array(at.astype(np.int32))
            yield pa.record_batch([part.column(0), part.column(2), pa.ListArray.from_arrays(offsets, pa.array(term)), pa.ListArray.from_arrays(offsets, pa.array(count))], ["doc_id", "toxic", "term", "count"])

    rows = C.arrow_map(every.select("doc_id", "text", "toxic"), vectors, "doc_id long, toxic int, term array<long>, count array<long>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy().astype(np.float64)
    vote = np.array([1 / rate[int(t)] for t in toxic])
    lists = [np.array(x, dtype=np.int64) for x in rows.column("term").to_pylist()]
    size = np.array([len(x) for x in lists])
    example = np.repeat(np.arange(len(ids)), size)
    term = np.concatenate([*lists, np.zeros(0, np.int64)])
    count = np.concatenate([*(np.array(x, dtype=np.int64) for x in rows.column("count").to_pylist()), np.zeros(0, np.int64)])
    w = (1 + np.log(count)) * idf[term] if len(term) else np.zeros(0)
    norm = np.sqrt(np.bincount(example, weights=w * w, minlength=len(ids)))
    w = w / norm[example] if len(term) else w
    base = float((vote * toxic).sum() / vote.sum())
    bare = size == 0
    prior = PRIOR * (vote[bare].mean() if bare.any() else 1.0)
    without = float(((vote * toxic)[bare].sum() + prior * base) / (vote[bare].sum() + prior))
    index = Index(ids, toxic, vote / vote.max(), vocabulary, idf, example, term, w, base, round(without, 6))
    index.calibrate(example, term, w)
    return index


def scored(documents: DataFrame, labels: DataFrame, per_label: int = 3000) -> DataFrame:
    """doc_id, held_out, score, evidence (nearest examples' ids) and similarity (their cosines) of each row of `documents` (doc_id, text)."""
    index = learned(documents, labels, per_label)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", C.held_out().alias("held_out"))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part, raw, off in C.pieces(batches, 1):
            if index is None:
                found = [(0.0, [], [])] * part.num_rows
            else:
                term, doc, count = index.known(*terms(raw, off))
                at = np.searchsorted(doc, np.arange(len(off)))
                found = [index.scored(term[a:b], count[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            score, evidence, similarity = zip(*found, strict=True)
            yield pa.record_batch([part.column(0), part.column(2), pa.array(score, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), pa.array(similarity, pa.list_(pa.float64()))], ["doc_id", "held_out", "score", "evidence", "similarity"])

    return C.arrow_map(docs, run, "doc_id long, held_out boolean, score double, evidence array<long>, similarity array<double>")


def without_toxic(documents: DataFrame, labels: DataFrame, limit: float = 0.3, per_label: int = 3000) -> DataFrame:
    """The rows of `documents`, with all their columns, whose score is below the limit."""
    sent = documents.sparkSession.sparkContext.broadcast(learned(documents, labels, per_label))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part, raw, off in C.pieces(batches, at):
            if index is not None:
                term, doc, count = index.known(*terms(raw, off))
                x = np.searchsorted(doc, np.arange(len(off)))
                part = part.filter(pa.array([index.scored(term[a:b], count[a:b])[0] < limit for a, b in zip(x[:-1].tolist(), x[1:].tolist(), strict=True)]))
            yield part

    return C.arrow_map(documents, run, documents.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    out = scored(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", "similarity")

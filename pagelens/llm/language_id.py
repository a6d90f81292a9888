"""Language identification by hierarchical discrimination.

A text's features are the relative frequencies of its letter trigrams (bytes of
lower-cased UTF-8, other characters as spaces), hashed to a fixed number of
buckets. One-versus-one linear support vector machines first tell language
families apart, then the languages within the family that won. Languages that
no family names are a family each.

Models are fitted on a bounded sample: about `per_language` rows of each
language, chosen by a hash of the row; the driver gets them as sparse vectors,
and makes two classes' rows dense at once. Prediction reads each text once and
shuffles nothing; it takes a pass over the trigrams for each pair of classes.

A null text or one without a letter is `und` with score 0, and so is every text
if there is nothing to learn from (an empty table, or no labels). A very short
text gets what its few trigrams say; a very long one is read in one task. Ties
go to the first class by name. Equal rows get equal results, and so do rows of
one doc_id with equal texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common as C

BUCKETS = 8192
#: Fixed facts: families of ISO 639-1 languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def _trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and where each document's begin and end; two spaces stand between texts."""
    n = len(off) - 1
    size = np.diff(off)
    begin = off[:-1] + 1 + 2 * np.arange(n)
    padded = np.full(len(raw) + 2 * n + 2, 32, dtype=np.uint8)
    padded[np.repeat(begin - off[:-1], size) + np.arange(len(raw))] = C.folded(raw)
    x = padded.astype(np.uint32)
    code = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    bucket = (code >> np.uint32(19)).astype(np.int64)
    return bucket, begin - 1, begin + size


#: A text's buckets (16 bits) and their shares of its trigrams (half precision).
Frequencies = tuple[np.ndarray, np.ndarray]


def frequencies(raw: np.ndarray, off: np.ndarray) -> list[Frequencies]:
    """Each document's trigram frequencies, for samples."""
    bucket, begin, end = _trigrams(raw, off)
    out = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        at, count = np.unique(bucket[a:b], return_counts=True)
        out.append((at.astype(np.uint16), (count / max(1, b - a)).astype(np.float16)))
    return out


def dense(x: list[Frequencies]) -> np.ndarray:
    out = np.zeros((len(x), BUCKETS), dtype=np.float32)
    for row, (at, share) in zip(out, x, strict=True):
        row[at] = share
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge loss), by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.full((len(x), 1), 1.0, dtype=x.dtype)])
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x.astype(np.float64) ** 2).sum(axis=1) + 0.5 / cost
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    slack = 0.5 / cost * 2 * share  # classes weigh alike
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]) / (square[i] - 0.5 / cost + slack[i])
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Groups of classes, each with the pairs that are told apart there, and one row of weights and a bias for each pair."""

    levels: dict[str, tuple[str, ...]]  # a family's languages; under "" the families
    pairs: list[tuple[str, str, str]]  # level, positive class, other class
    weights: np.ndarray
    bias: np.ndarray
    scale: float


def fitted(x: list[Frequencies], langs: list[str]) -> Model | None:
    if not langs:
        return None
    names = np.array(langs)
    family = np.array([_FAMILY.get(a, a) for a in langs])
    levels = {"": tuple(sorted(set(family)))} | {f: tuple(sorted(set(names[family == f]))) for f in set(family)}
    scale = 1.0 / max(float(np.mean([np.sqrt((share.astype(np.float64) ** 2).sum()) for _, share in x])), 1e-9)
    pairs, weights, bias = [], [], []
    for level, classes in sorted(levels.items()):
        of = names if level else family
        for a, b in combinations(classes, 2):
            rows = np.flatnonzero((of == a) | (of == b))
            w, c = support_vectors(dense([x[i] for i in rows.tolist()]) * np.float32(scale), np.where(of[rows] == a, 1.0, -1.0))
            pairs.append((level, a, b)), weights.append(w), bias.append(c)
    return Model(levels, pairs, np.array(weights, dtype=np.float32).reshape(len(pairs), BUCKETS), np.array(bias), scale)


def predicted(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text, and a score from 0 to 1."""
    bucket, begin, end = _trigrams(raw, off)
    count = end - begin
    votes: dict[tuple[str, str], np.ndarray] = {}
    for (level, a, b), w, c in zip(model.pairs, model.weights, model.bias, strict=True):
        total = np.concatenate([[0.0], np.cumsum(w[bucket], dtype=np.float64)])
        margin = np.round(model.scale * (total[end] - total[begin]) / count + c, 6)
        p = 1 / (1 + np.exp(-3 * np.clip(margin, -50, 50)))
        for name, v in ((a, p), (b, 1 - p)):
            votes[level, name] = votes.get((level, name), 0) + v
    n = len(off) - 1

    def best(level: str) -> tuple[np.ndarray, np.ndarray]:
        classes = model.levels[level]
        if len(classes) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        v = np.stack([votes[level, x] for x in classes]) / (len(classes) - 1)
        return v.argmax(axis=0), v.max(axis=0)

    family, score = best("")
    lang = np.empty(n, dtype=object)
    for i, f in enumerate(model.levels[""]):
        mine = family == i
        at, p = best(f)
        lang[mine] = np.array(model.levels[f], dtype=object)[at[mine]]
        score = np.where(mine, score * p, score)
    return lang.tolist(), np.round(score, 6)


def _sample(rows: DataFrame, per_language: int) -> tuple[list[Frequencies], list[str]]:
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return [], []
    limit = F.create_map(*(F.lit(v) for lang, c in counts.items() for v in (lang, C.limit_for(per_language, c))))
    chosen = rows.where(C.drawn(F.coalesce(limit[F.col("lang")], F.lit(0)), "language", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in C.pieces(batches, 1):
            at, share = zip(*frequencies(raw, off), strict=True)
            yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in at]), pa.array([x.tobytes() for x in share]), part.column(2)], ["lang", "at", "share", "doc_id"])

    found = C.arrow_map(chosen.select("lang", "text", "doc_id"), run, "lang string, at binary, share binary, doc_id long").limit(2 * per_language * len(counts)).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("at", "ascending"), ("share", "ascending")])
    x = [(np.frombuffer(a, np.uint16), np.frombuffer(v, np.float16)) for a, v in zip(found.column("at").to_pylist(), found.column("share").to_pylist(), strict=True)]
    return x, found.column("lang").to_pylist()


def identify(documents: DataFrame, per_language: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `documents` (doc_id, text, lang)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = fitted(*_sample(docs.where(~C.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")), per_language))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in C.pieces(batches, 2):
            letters = C.with_letters(raw, off)
            lang, score = predicted(sent.value, raw, off) if sent.value else (["und"] * part.num_rows, np.zeros(part.num_rows))
            yield pa.record_batch([part.column(0), part.column(1), pa.array([a if ok else "und" for a, ok in zip(lang, letters, strict=True)]), pa.array(np.where(letters, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return C.arrow_map(docs.select("doc_id", C.held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents"))

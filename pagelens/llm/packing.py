"""Packing of tokenized examples into fixed-length sequences by vector bin packing.

Each item is a vector (tokens, segments, loss-bearing tokens), and so is a
sequence's capacity. The dot-product heuristic fills one sequence at a time: of
the items that fit in every dimension it takes the one whose vector has the
largest weighted dot product with what is left of the capacity. Where none fits
and cutting is allowed, the best item is cut to fill the sequence. Texts longer
than a sequence give full ones first. A block's last sequence, which stays
partly filled, is cut at powers of two, so it needs no padding.

Documents are packed block by block inside their partition as they stream
through, so nothing is shuffled and memory is bounded by a block (BLOCK_ITEMS
rows or BLOCK_BYTES of ids) and the longest text.

Tokenizing keeps the exact ids of the tokenizer: its pre-tokenizer never joins
characters across white space, so ids are kept per word under a 64-bit hash
(exact up to collisions); new words go to the tokenizer itself.

A null or empty text is the end id alone. Equal rows are packed each. A null
doc_id is returned as it is. A very long text is held whole, cut into full
sequences first. Of items with equal products the first in the block is taken.
An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common as C

BLOCK_ITEMS, BLOCK_BYTES = 1024, 16 << 20
#: Words and ids that a worker keeps (about 8 + 8 + 8 and 4 bytes each); the parts of words whose ids it keeps, each of no more bytes than KEPT_BYTES.
KNOWN_WORDS, KNOWN_IDS, KNOWN_PARTS, KEPT_BYTES = 1_000_000, 4_000_000, 100_000, 64
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # the vocabulary's own pre-tokenizer
_PLAIN = regex.compile("[\x21-\x7e\xa1-\xff]+")


def _byte_names() -> list[str]:
    """Byte-level vocabularies name visible Latin-1 bytes by their own characters, and the others by those from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in seen else next(other)) for b in range(256)]


_BYTE = _byte_names()


class WordTokenizer:
    """Ids of word_bpe-like tokenizers (lower case, white space dropped), of whole pieces of text at once.

    A word's ids are kept under a 64-bit hash of its bytes, in arrays; beyond
    KNOWN_WORDS words or KNOWN_IDS ids the worker begins anew.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [str(x.content).encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def of_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; a word's parts are those of the vocabulary's own pre-tokenizer."""
        known, part = self.parts, self.part
        if len(known) > KNOWN_PARTS:
            known.clear()
        out: list[list[int] | None] = []
        odd: list[int] = []
        for w in words:
            if w.isalpha():  # A-Z and a-z only
                p = w.decode().lower()
                out.append(known.get(p) or part(p))
            elif w.isascii() and w[:-1].isalpha() and w[-1] > 32 and w[-1] != 127 and w[-1] not in b"'":
                p, last = w[:-1].decode().lower(), chr(w[-1])
                out.append((known.get(p) or part(p)) + (known.get(last) or part(last)))
            elif _PLAIN.fullmatch(s := w.decode("utf-8", "replace")):
                out.append([i for p in _SPLIT.findall(s.lower()) for i in known.get(p) or part(p)])
            else:
                odd.append(len(out))
                out.append(None)
        for i, ids in zip(odd, self.whole([words[i] for i in odd]) if odd else (), strict=True):
            out[i] = ids
        return out

    def part(self, p: str) -> list[int]:
        """Ids of what the pre-tokenizer leaves in one part, by the vocabulary's merges."""
        ids = [t.id for t in self.model.tokenize(p if p.isascii() else "".join([_BYTE[b] for b in p.encode()]))]
        if len(p) <= KEPT_BYTES:
            self.parts[p] = ids
        return ids

    def learn(self, h: np.ndarray, words: list[bytes]) -> None:
        """Adds words that aren't known, by their hashes."""
        found = self.of_words(words)
        count = np.array([len(x) for x in found], dtype=np.int64)
        begin = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], dtype=np.uint32)])
        h, begin, count = np.concatenate([self.hashes, h]), np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        order = np.argsort(h)
        self.hashes, self.begin, self.count = h[order], begin[order], count[order]

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes lie, and which do."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more entry at the end)."""
        data = raw.tobytes()
        starts, ends, first = C.word_spans(raw, off)
        h, at, place = np.unique(C.word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        new = ~self.known(h)[1]
        if len(self.hashes) + int(new.sum()) > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self.clear()  # what is kept then is this piece's own
            new[:] = True
        if new.any():
            self.learn(h[new], [data[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        slot, _ = self.known(h)
        slot = slot[place]
        count = self.count[slot] if len(slot) else np.zeros(0, np.int64)
        total = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.ids[np.repeat(self.begin[slot] - total[:-1], count) + np.arange(total[-1])] if len(slot) else np.zeros(0, np.uint32)
        bounds = total[first]
        if any(x in data for x in self.special):
            texts = [ids[a:b] for a, b in pairwise(bounds.tolist())]
            for i, (a, b) in enumerate(pairwise(off.tolist())):
                if any(x in data[a:b] for x in self.special):
                    texts[i] = np.array(self.whole([data[a:b]])[0], dtype=np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            ids = np.concatenate(texts)
        return ids, bounds


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def bins(sizes: np.ndarray, capacity: np.ndarray, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, first token, tokens) for items (tokens, segments, loss-bearing tokens).

    With `cut`, an item's loss-bearing tokens are all of its tokens or none.
    """
    x = sizes.astype(np.float64)
    start = np.zeros(len(x), dtype=np.int64)
    weight = x.sum(axis=0) / capacity
    weight = weight / max(weight.sum(), 1e-9) / capacity**2
    ident = np.arange(len(x))
    out: list[list[tuple[int, int, int]]] = []
    while len(x):
        left, placed, gone = capacity.astype(np.float64), [], []
        free = np.ones(len(x), dtype=bool)
        while True:
            score = np.where(free & (x <= left).all(axis=1), x @ (weight * left), -1.0)
            best = int(score.argmax())
            if score[best] >= 0 and free[best]:
                placed.append((int(ident[best]), int(start[best]), int(x[best, 0])))
                left -= x[best]
                free[best] = False
                gone.append(best)
                continue
            if cut and left[0] >= 1 and left[1] >= 1 and free.any():
                score = np.where(free, x @ (weight * left), -1.0)
                best = int(score.argmax())
                room = int(min(left[0], left[2] if x[best, 2] else left[0]))
                if room >= 1:
                    placed.append((int(ident[best]), int(start[best]), room))
                    start[best] += room
                    x[best, 0] -= room
                    x[best, 2] -= room if x[best, 2] else 0
            break
        if not placed:
            raise ValueError("an item is larger than a sequence; allow cutting")
        out.append(placed)
        keep = np.ones(len(x), dtype=bool)
        keep[gone] = False
        x, start, ident = x[keep], start[keep], ident[keep]
    return out


def at_powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The sequence cut into sequences whose lengths are powers of two, largest first."""
    total = sum(n for _, _, n in sequence)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out: list[list[tuple[int, int, int]]] = []
    todo = list(reversed(sequence))
    for size in sizes:
        now: list[tuple[int, int, int]] = []
        while size:
            item, start, n = todo.pop()
            if n > size:
                todo.append((item, start + size, n - size))
                n = size
            now.append((item, start, n))
            size -= n
        out.append(now)
    return out


def pack(examples: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, cut: bool = True) -> DataFrame:
    """Pieces of the rows of `examples` (doc_id, text and, if there is one, loss: whether its tokens bear loss).

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and ids (the
    piece's ids as little-endian unsigned 32-bit integers). Without `cut`, every
    example stays whole, and one that is larger than a sequence is an error.
    """
    capacity = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss], dtype=np.float64)
    if capacity.min() < 1:
        raise ValueError("a sequence holds at least one token, one segment and one loss-bearing token")
    loss = F.coalesce(F.col("loss").cast("boolean"), F.lit(True)) if "loss" in examples.columns else F.lit(True)
    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), loss.alias("loss"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def block(held: list[tuple[int | None, np.ndarray, bool]], number: int) -> tuple[pa.RecordBatch, int]:
        sequences: list[list[tuple[int, int, int]]] = []
        sizes, first = np.zeros((len(held), 3), dtype=np.int64), np.zeros(len(held), dtype=np.int64)
        for i, (_, ids, bears) in enumerate(held):
            n = len(ids)
            if cut:
                most = int(min(max_tokens, capacity[2])) if bears else max_tokens
                sequences.extend([(i, k * most, most)] for k in range(n // most))
                first[i] = n // most * most
            left = n - first[i]
            sizes[i] = (left, 1, left if bears else 0)
        rest = np.flatnonzero(sizes[:, 0] > 0)
        found = [[(int(rest[i]), int(first[rest[i]]) + s, n) for i, s, n in seq] for seq in bins(sizes[rest], capacity, cut)] if len(rest) else []
        for seq in found:
            sequences.extend(at_powers(seq) if cut and sum(n for _, _, n in seq) < max_tokens else [seq])
        cols: tuple[list, ...] = ([], [], [], [], [], [], [])
        for seq in sequences:
            offset = 0
            for i, start, n in seq:
                ident, ids, _ = held[i]
                for c, v in zip(cols, (ident, start, n, len(ids), number, offset, ids[start : start + n].tobytes()), strict=True):
                    c.append(v)
                offset += n
            number += 1
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema), number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray, bool]] = []
        size = 0
        for part, raw, off in C.pieces(batches, 1, 1 << 20):
            ids, bounds = encode(raw, off)
            ends = bounds[1:] + np.arange(part.num_rows)
            closed = np.full(len(ids) + part.num_rows, end_id, dtype="<u4")
            closed[np.delete(np.arange(len(closed)), ends)] = ids
            held.extend(zip(part.column(0).to_pylist(), np.split(closed, ends[:-1] + 1), part.column(2).to_pylist(), strict=True))
            size += closed.nbytes
            if len(held) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
                out, number = block(held, number)
                yield out
                held, size = [], 0
        if held:
            yield block(held, number)[0]

    return C.arrow_map(rows, run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(C.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

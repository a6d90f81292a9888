"""Removal of byte strings that occur twice or more, by bounded interval expansion on a Burrows-Wheeler transform.

Every 200-byte window of the corpus belongs to one anchor: the k-mer with the
smallest hash inside it (the leftmost of equals). The windows that one anchor
owns are consecutive and make one piece of text. Equal windows have equal
anchors, so only pieces of one anchor hash can share a window, and anchors seen
once are done with. Pieces meet by anchor hash; equal ones, compared by their
bytes, are one with a number of places.

An anchor whose distinct pieces are more than `group_bytes` is split: a window
that isn't covered by its anchor has at least half of the bytes left over on
one side of it, so its windows go to groups by that side and those bytes, and
equal windows to the same group. Splitting ends when groups are small, at the
latest when a group's windows are equal; so no task holds more than that.

The distinct pieces are concatenated (a separator after each), sorted by
suffix, and their common prefix lengths derived by increasing value: starting
from the empty string's interval, intervals are extended backward by each
character through the transform's rank mapping, breadth first; a boundary
between suffixes gets its value when the first interval ends there. Expansion
stops at the minimum length: boundaries without a value then join suffixes that
share at least that many bytes. That tells which windows repeat. Memory is
linear in the text sorted at once.

Anchors and pieces are named by 64-bit hashes when rows are joined, so results
are exact up to a collision of both of a piece's names.

Texts are UTF-8 bytes; a null is empty, and an empty or short text loses
nothing. Matches never cross documents. Rows are told apart by doc_id (null is
an id) and text; equal rows are different places and get equal results, and
rows of one doc_id with different texts are different documents. A very long
text gives as many pieces as it has anchors and is held whole by one row. Ties
don't arise: every repeated byte goes, the first place's too. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import common as C

#: Bytes of an anchor.
KMER = 32
#: Bytes of pieces that are sorted at once, and the most bytes of distinct pieces in a group.
SORT_BYTES, GROUP_BYTES = 100_000, 500_000
#: So many hashes of hot anchors (8 bytes each) are broadcast.
MOST_BROADCAST = 200_000
_ROW = ("id", "th")  # a row's name: doc_id (0 for null), and a hash of both doc_id and text


def _kmer_hashes(raw: np.ndarray) -> np.ndarray:
    view, n = C.lanes(raw), len(raw) - KMER + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(0, KMER, 8):
        h = (h ^ view[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return C.mix(h)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Where the smallest of each w neighbours lies, the leftmost of equals; running minima from both ends of blocks of w."""
    n, pad = len(h), -len(h) % w
    full = np.concatenate([h, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    at = np.arange(n + pad).reshape(-1, w)
    low = np.minimum.accumulate(full, axis=1)
    first = np.ones(full.shape, dtype=bool)
    first[:, 1:] = low[:, 1:] < low[:, :-1]
    ahead = np.maximum.accumulate(np.where(first, at, 0), axis=1).reshape(-1)
    low = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1]
    back = np.minimum.accumulate(np.where(full == low, at, n + pad)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - w + 1
    back, ahead = back[:m], ahead[w - 1 : w - 1 + m]
    return np.where(h[back] <= h[ahead], back, ahead)


def owned_windows(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, document, first window, number of windows and the anchor's place in the first one, of each run of windows with one anchor."""
    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return empty.astype(np.uint64), empty, empty, empty, empty
    h = _kmer_hashes(raw)
    n = len(raw) - length + 1
    owner = _least(h, length - KMER + 1)
    ok = np.zeros(len(raw) + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(off) >= length)
    ok[off[long]] += 1
    np.add.at(ok, off[long + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(ok)[:n] > 0)
    if not len(at):
        return empty.astype(np.uint64), empty, empty, empty, empty
    own = owner[at]
    doc = np.searchsorted(off, at, side="right") - 1
    new = np.ones(len(at), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(new)
    return h[own[s]], doc[s], at[s] - off[doc[s]], np.diff(np.append(s, len(at))), own[s] - at[s]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(h, id, th, start, windows, at) of every run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in C.pieces(batches, 2):
            h, doc, start, count, at = owned_windows(raw, off, length)
            doc = pa.array(doc)
            yield pa.record_batch([pa.array(h.view(np.int64)), rows.column(0).take(doc), rows.column(1).take(doc), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(at.astype(np.int16))], ["h", *_ROW, "start", "windows", "at"])

    return C.arrow_map(docs, run, "h long, id long, th long, start int, windows int, at short")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, sorted by their first `depth` symbols (below 512) or more; equals in any order.

    Seven symbols at first, then twice as many in each round; a round sorts only suffixes that are still equal.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(7, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = key << 9 | padded[j : j + n]
    order = np.argsort(key)
    idx, key, at, known = order, key[order], np.arange(n), 7
    rank = np.empty(n, dtype=np.int64)
    while True:
        new = np.ones(len(idx), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(idx)))
        rank[idx] = np.repeat(at[begin], size)
        tied = np.repeat(size > 1, size)
        if known >= depth or not tied.any():
            return order
        at, idx = at[tied], idx[tied]
        behind = np.zeros(len(idx), dtype=np.int64)
        inside = idx + known < n
        behind[inside] = rank[idx[inside] + known] + 1
        key = rank[idx] * (n + 1) + behind
        o = np.argsort(key)
        idx, key = idx[o], key[o]
        order[at] = idx
        known *= 2


def long_common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order shares `length` symbols or more with the one before it; symbol 0 separates texts."""
    n = len(text)
    last = text[order - 1].astype(np.uint16)  # the transform
    place = np.argsort(last, kind="stable")
    rank = np.empty(n, dtype=np.int64)  # of the suffix that is longer by the transform's symbol
    rank[place] = np.arange(n)
    # places of the transform that hold the same symbol, before and after
    before, after = np.full(n, -1), np.full(n, n)
    same = last[place[1:]] == last[place[:-1]]
    before[1:][same] = place[:-1][same]
    after[:-1][same] = place[1:][same]
    unset = np.ones(n + 1, dtype=bool)  # boundaries before each place that have no value yet
    unset[0] = unset[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for depth in range(1, length + 1):
        if not len(lo):
            break
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        low, high = np.repeat(lo, size), np.repeat(hi, size)
        if depth > 1:  # no string begins with a separator
            some = last[at] > 0
            at, low, high = at[some], low[some], high[some]
        # an extension by a symbol begins with its first occurrence in the interval and ends with its last
        to = rank[at]
        left, right = np.sort(to[before[to] < low]), np.sort(to[after[to] >= high]) + 1
        fresh = unset[right]
        unset[right] = False
        lo, hi = left[fresh], right[fresh]
    return unset[:n]


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, whether the window at each of its starts occurs elsewhere in the strings."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    begin = np.zeros(len(parts), dtype=np.int64)
    np.cumsum(sizes[:-1] + 1, out=begin[1:])
    text[begin + sizes] = 0
    order = suffix_order(text, length)
    joined = long_common_prefixes(text, order, length)
    twice = joined.copy()
    twice[:-1] |= joined[1:]
    flag = np.zeros(len(text), dtype=bool)
    flag[order] = twice
    return [flag[b : b + max(0, s - length + 1)] for b, s in zip(begin, sizes, strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


_FOUND = pa.schema([("h", pa.int64()), ("ph", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def judged(distinct: DataFrame, length: int) -> DataFrame:
    """(h, ph, lo, hi): window ranges of each distinct piece that repeat, from (h, ph, piece, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        waiting: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal size
            flags = repeated_windows([r[2] for r in waiting], length)
            for (h, ph, piece, places), found in zip(waiting, flags, strict=True):
                lo, hi = ([0], [len(piece) - length + 1]) if places > 1 else _runs(found)
                out.extend((h, ph, a, b) for a, b in zip(lo, hi, strict=True))
            waiting.clear()
            size = 0

        def close(group: list[tuple]) -> None:
            nonlocal size
            if all(r[3] > 1 for r in group):  # nothing left to find out
                out.extend((r[0], r[1], 0, len(r[2]) - length + 1) for r in group)
            elif len(group) > 1:
                waiting.extend(group)
                size += sum(len(r[2]) for r in group)
                if size >= SORT_BYTES:
                    flush()

        def rows() -> pa.RecordBatch:
            done = pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)
            out.clear()
            return done

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    close(group)
                    group = []
                if group and group[-1][2] == row[2]:
                    group[-1] = (*row[:3], group[-1][3] + row[3])
                else:
                    group.append(row)
            if out:
                yield rows()
        if group:
            close(group)
        if waiting:
            flush()
        if out:
            yield rows()

    dealt = distinct.repartition("h").sortWithinPartitions("h", "piece")
    return C.arrow_map(dealt.select("h", "ph", "piece", "places"), run, "h long, ph long, lo int, hi int")


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal pieces of a batch to one row with their number."""
    for batch in batches:
        held: dict[tuple, int] = {}
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[row] = held.get(row, 0) + 1
        if held:
            h, ph, piece = zip(*held, strict=True)
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(ph, pa.int64()), pa.array(piece, pa.binary()), pa.array(held.values(), pa.int64())], ["h", "ph", "piece", "places"])


_PLACED = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("at", pa.int16()), ("left", pa.int16()), ("right", pa.int16()), ("piece", pa.binary())])


def halves(piece: bytes, at: int, left: int, right: int, length: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """The two parts of a piece whose windows all hold the bytes from at - left to at + KMER + right.

    Windows that have half or more of their other bytes, rounded up, after
    those, and windows that have that many before them: first window, new left,
    new right, the bytes that are new to all these windows, the part.
    """
    windows = len(piece) - length + 1
    half = -(-(length - KMER - left - right) // 2)
    # the window at s has length - KMER - right - (at - s) bytes after the covered ones
    cut = min(max(at + KMER + right + half - length, 0), windows)
    if half and cut:
        yield 0, left + half, right, b"<" + piece[at - left - half : at - left], piece[: cut - 1 + length]
    if half and cut < windows:
        end = at + KMER + right
        yield cut, left, right + half, b">" + piece[end : end + half], piece[cut:]


def _split(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, ident, th, start, at, left, right, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = list(halves(piece, at, left, right, length))
                for first, more_left, more_right, new, part in some:
                    name = hashlib.blake2b(h.to_bytes(8, "little", signed=True) + new, digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), ident, th, start + first, at - first, more_left, more_right, part))
                if not some:  # all its windows are covered
                    out.append((h, ident, th, start, at, left, right, piece))
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _PLACED, strict=True)], schema=_PLACED)

    return run


def grouped(placed: DataFrame, length: int, group_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pieces (as in _PLACED, with their hash ph), of which no h has more than about group_bytes of distinct ones, and the stored tables they are in."""
    tables, out, columns = [placed], [], [f.name for f in _PLACED]
    # the bytes that a window has besides its anchor are halved each time
    for _ in range((length - KMER).bit_length() + 1):
        size = placed.groupBy("h", "ph").agg(F.max(F.length("piece")).alias("b")).groupBy("h").agg(F.sum("b").alias("b"))
        hot = C.checkpointed(size.where(F.col("b") > group_bytes).select("h"))
        if not (n := hot.limit(MOST_BROADCAST + 1).count()):
            break
        # a few hashes are sent to the pieces; the pieces would be shuffled to more
        hot = F.broadcast(hot) if n <= MOST_BROADCAST else hot
        out.append(placed.join(hot, "h", "left_anti"))
        parts = C.arrow_map(placed.join(hot, "h", "left_semi").select(*columns), _split(length), "h long, id long, th long, start int, at short, left short, right short, piece binary")
        placed = C.stored(parts.withColumn("ph", F.xxhash64("piece")))
        tables.append(placed)
    return reduce(DataFrame.unionByName, [*out, placed]), tables


def repeated_spans(docs: DataFrame, length: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, th, lo, hi): byte ranges, not yet merged, that strings of `length` bytes with a second place cover, of rows (id, th, text)."""
    every = C.stored(anchors(docs, length))
    runs = C.stored(every.join(every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "h"))
    C.forget(every)
    # equal rows name equal runs; each row then brings its own pieces
    lists = runs.groupBy(*_ROW).agg(F.collect_set(F.struct("h", "start", "windows", "at")).alias("runs"))
    piece = F.expr(f"substring(text, cast(start + 1 as int), windows + {length - 1})")
    nil = F.lit(0).cast("short")
    placed = docs.join(lists, list(_ROW)).select(*_ROW, "text", F.inline("runs")).select("h", *_ROW, "start", "at", nil.alias("left"), nil.alias("right"), piece.alias("piece"))
    placed = C.stored(placed.withColumn("ph", F.xxhash64("piece")))
    C.forget(runs)
    every, tables = grouped(placed, length, group_bytes)
    found = judged(C.arrow_map(every.select("h", "ph", "piece"), _collapsed, "h long, ph long, piece binary, places long"), length)
    spans = every.select("h", "ph", *_ROW, "start").join(found, ["h", "ph"]).select(*_ROW, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + F.lit(length - 1)).alias("hi"))
    spans = C.stored(spans)
    C.forget(*tables)
    return spans


def _removal():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = C.buffers(batch.column(1))
            lists = batch.column(2)
            cols = ([], [], [], [], [])
            for i, (ident, spans) in enumerate(zip(batch.column(0).to_pylist(), lists.to_pylist(), strict=True)):
                data = raw[off[i] : off[i + 1]]
                removed = count = 0
                kept, at = [], 0
                for lo, hi in merged(spans or []):
                    kept.append(data[at:lo].tobytes())
                    removed, count, at = removed + hi - lo, count + 1, hi
                kept.append(data[at:].tobytes())
                for c, v in zip(cols, (ident, len(data), removed, count, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal ranges; ranges that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def without_repeats(documents: DataFrame, length: int = 200, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `documents` (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("th"), "text")
    spans = repeated_spans(docs.select(*_ROW, "text"), length, group_bytes).groupBy(*_ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = docs.join(spans, list(_ROW), "left").select("doc_id", "text", "spans")
    return C.arrow_map(rows, _removal(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_array(spark, sf_dir: str) -> DataFrame:
    return without_repeats(C.table(spark, sf_dir, "documents"))

"""Perceptual hashes and structural similarity on arrays of grey values."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BANDS = (13, 13, 13, 13, 12)
MAX_DISTANCE, SSIM_PASS = 4, 0.995
_C1, _C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def dhash(grey: Column, width: int = 9, height: int = 8) -> Column:
    """64 bits of a row-major grid: whether each value is greater than its right neighbour, the first comparison highest."""
    bits = width - 1
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits * height - 1)), F.lit(0).cast("bigint"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(F.when(grey[(F.floor(i / bits) * width + i % bits).cast("int")] > grey[(F.floor(i / bits) * width + i % bits + 1).cast("int")], F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))


def _places(side: int, turns: int) -> np.ndarray:
    """Of a square grid turned clockwise, where each value stands in the grid as it was."""
    return np.rot90(np.arange(side * side).reshape(side, side), -turns)


def turned(grid: Column, side: int, turns: int = 1) -> Column:
    """A square row-major grid, turned by so many quarters clockwise."""
    return F.transform(F.lit(_places(side, turns).reshape(-1).tolist()), lambda i: F.get(grid, i))


def turn_hashes(grid: Column, side: int = 9) -> Column:
    """dHash of a square grid (a stored column; its last row is left out) turned by 0, 90, 180 and 270 degrees clockwise."""

    def hashed(turns: int) -> Column:
        at = _places(side, turns)[:-1]
        pairs = F.arrays_zip(F.lit(at[:, :-1].reshape(-1).tolist()).alias("a"), F.lit(at[:, 1:].reshape(-1).tolist()).alias("b"))
        return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda h, x: F.shiftleft(h, 1).bitwiseOR((F.get(grid, x["a"]) > F.get(grid, x["b"])).cast("bigint")))

    return F.array(*(hashed(turns) for turns in range(4)))


def bands(h: Column) -> Column:
    """The hash's bands as an array of (band, value). Up to 4 differing bits leave one of 5 bands equal."""
    out, at = [], 64
    for i, n in enumerate(BANDS):
        at -= n
        out.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1)).alias("value")))
    return F.array(*out)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two arrays of one length as one global window, with population moments."""
    n = F.size(a)
    zero = F.lit(0.0)
    ma, mb = (F.aggregate(x, zero, lambda s, v: s + v) / n for x in (a, b))
    va = F.aggregate(a, zero, lambda s, v: s + v * v) / n - ma * ma
    vb = F.aggregate(b, zero, lambda s, v: s + v * v) / n - mb * mb
    cov = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, v: s + v) / n - ma * mb
    return (2 * ma * mb + _C1) * (2 * cov + _C2) / ((ma * ma + mb * mb + _C1) * (va + vb + _C2))


def least_distance(a: Column, b: Column) -> Column:
    """The least distance between any hash of one array and any of the other."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: distance(x, y)))))


#: Pairs that are compared, or written, at once.
_AT_ONCE = 1 << 18


def _nodes(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of nodes (hashes, ids, contents): all hashes, where each node's begin, where its ids begin, all ids and contents."""
    hashes, ids, contents = block.flatten()
    at = hashes.offsets.to_numpy()
    start = ids.offsets.to_numpy()
    return hashes.flatten().to_numpy().view(np.uint64), at - at[0], start - start[0], ids.flatten(), contents.flatten()


def near_nodes(left: pa.StructArray, right: pa.StructArray | None, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs (id_a, id_b, distance) between two blocks of nodes (hashes, ids, contents), or in one if right is None; nodes have any number of hashes.

    Hashes meet by each of their bands, a run of the left nodes at a time, so a
    pair of nodes is complete within a run: its least distance is known there.
    """
    h_a, at_a, start_a, ids_a, contents_a = _nodes(left)
    h_b, at_b, start_b, ids_b, contents_b = (h_a, at_a, start_a, ids_a, contents_a) if right is None else _nodes(right)
    owner_b, n_b = np.repeat(np.arange(len(at_b) - 1), np.diff(at_b)), len(at_b) - 1
    values_a, values_b, size_a, size_b = ids_a.to_numpy(), ids_b.to_numpy(), np.diff(start_a), np.diff(start_b)
    met, earlier = [], []
    for n, end in zip(BANDS, 64 - np.cumsum(BANDS), strict=True):
        key_a, key_b = ((h >> np.uint64(end) & np.uint64((1 << n) - 1)).astype(np.int64) for h in (h_a, h_b))
        order, number = np.argsort(key_b, kind="stable"), np.bincount(key_b, minlength=1 << n)
        met.append(((np.cumsum(number) - number)[key_a], number[key_a], owner_b[order], h_b[order], list(earlier)))
        earlier.append(np.uint64(((1 << n) - 1) << int(end)))
    work = np.concatenate([[0], np.cumsum(sum(number for _, number, *_ in met))])[at_a]
    lo = 0
    while lo < len(at_a) - 1:
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + _AT_ONCE, side="right")) - 1)
        run = slice(at_a[lo], at_a[hi])
        h, owner, found = h_a[run], np.repeat(np.arange(lo, hi), np.diff(at_a[lo : hi + 1])), []
        for first, number, owners, there, others in met:
            n = number[run]
            i = np.repeat(np.arange(len(h)), n)
            j = np.arange(len(i)) + np.repeat(first[run] - (np.cumsum(n) - n), n)
            differ = h[i] ^ there[j]
            near = np.flatnonzero(np.bitwise_count(differ) <= most)
            for mask in others:
                near = near[(differ[near] & mask) != 0]
            a, b = owner[i[near]], owners[j[near]]
            code = (a * n_b + b) * 128 + np.bitwise_count(differ[near])
            found.append(code[a < b] if right is None else code)
        code = np.sort(np.concatenate(found))
        code = code[np.diff(code >> 7, prepend=-1) != 0]
        (a, b), far = np.divmod(code >> 7, n_b), code & 127
        pairs = size_a[a].astype(np.int64) * size_b[b]
        total = np.concatenate([[0], np.cumsum(pairs)])
        of_lo = 0
        while of_lo < len(a):
            of_hi = max(of_lo + 1, int(np.searchsorted(total, total[of_lo] + _AT_ONCE, side="right")) - 1)
            of = np.repeat(np.arange(of_lo, of_hi), pairs[of_lo:of_hi])
            k = np.arange(len(of)) - (total[of] - total[of_lo])
            i, j = start_a[a[of]] + k // size_b[b[of]], start_b[b[of]] + k % size_b[b[of]]
            equal = pc.fill_null(pc.equal(contents_a.take(pa.array(i)), contents_b.take(pa.array(j))), False).to_numpy(zero_copy_only=False)
            x, y = values_a[i], values_b[j]
            yield pa.record_batch([pa.array(np.minimum(x, y), ids_a.type), pa.array(np.maximum(x, y), ids_a.type), pa.array(np.where(equal, 0, far[of]).astype(np.int32))], ["id_a", "id_b", "distance"])
            of_lo = of_hi
        lo = hi


def exif_orientation(content: bytes) -> int:
    """The orientation (1 to 8) that a JPEG's Exif header names; 1 without one."""
    try:
        if content[:2] != b"\xff\xd8":
            return 1
        at = 2
        while at < len(content) - 4 and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                tiff = content[at + 10 :]
                order = "little" if tiff[:2] == b"II" else "big"
                (first,) = struct.unpack(("<" if order == "little" else ">") + "I", tiff[4:8])
                for k in range(int.from_bytes(tiff[first : first + 2], order)):
                    entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                    if int.from_bytes(entry[:2], order) == 0x0112:
                        value = int.from_bytes(entry[8:10], order)
                        return value if 1 <= value <= 8 else 1
            at += 2 + size
    except (struct.error, IndexError):
        pass
    return 1


@F.pandas_udf(T.IntegerType())
def orientation(content: pd.Series) -> pd.Series:
    return content.map(lambda x: exif_orientation(bytes(x)) if x is not None else 1).astype("int32")


# The quarter turns clockwise and the mirroring that undo each Exif orientation.
UPRIGHT = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (1, False), 7: (3, True), 8: (3, False)}


def upright(pixels: np.ndarray, orientation_: int) -> np.ndarray:
    """An image (rows, columns, channels) as its orientation wants it shown."""
    turns, mirrored = UPRIGHT.get(orientation_, UPRIGHT[1])
    # mirrored before the turn: along the rows, or for quarter turns along the columns
    if mirrored:
        pixels = pixels[::-1] if turns % 2 else pixels[:, ::-1]
    return np.rot90(pixels, -turns)


@F.pandas_udf(T.StringType())
def pixel_hash(rgba: pd.Series, width: pd.Series, height: pd.Series, orientation_: pd.Series) -> pd.Series:
    """SHA-256 of the upright image's width, height (32-bit, little-endian) and RGBA bytes; null above 64 Mpx or without an image."""
    out = []
    for data, w, h, o in zip(rgba, width, height, orientation_, strict=True):
        if data is None or w * h > 64_000_000 or len(data) != 4 * w * h:
            out.append(None)
            continue
        shown = upright(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 4), int(o))
        out.append(hashlib.sha256(struct.pack("<II", shown.shape[1], shown.shape[0]) + shown.tobytes()).hexdigest())
    return pd.Series(out, dtype=object)


def resized(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, sampled at the top-left corner, rounded half up."""
    h, w = grey.shape
    x, y = np.arange(width) * (w / width), np.arange(height) * (h / height)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    g, fx, fy = grey.astype(np.float64), (x - x0)[None, :], (y - y0)[:, None]
    top = g[y0][:, x0] + fx * (g[y0][:, x1] - g[y0][:, x0])
    low = g[y1][:, x0] + fx * (g[y1][:, x1] - g[y1][:, x0])
    return np.floor(top + fy * (low - top) + 0.5).astype(np.uint8)


def grey(rgba: np.ndarray) -> np.ndarray:
    return np.floor(rgba[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def _hash(g: np.ndarray) -> int:
    small = resized(g, 9, 8)
    bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def rotation_hashes(pixels: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """dHash of a grey image (row-major bytes, width, height) turned by 0, 90, 180 and 270 degrees clockwise."""
    for data, width, height in pixels:
        out = []
        for d, w, h in zip(data, width, height, strict=True):
            g = np.frombuffer(d, np.uint8).reshape(int(h), int(w))
            out.append([_hash(np.rot90(g, -k)) for k in range(4)])
        yield pd.Series(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a.astype(np.float64), b.astype(np.float64)
    mx, my = x.mean(), y.mean()
    cov = ((x - mx) * (y - my)).mean()
    return float((2 * mx * my + _C1) * (2 * cov + _C2) / ((mx * mx + my * my + _C1) * (x.var() + y.var() + _C2)))


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("rotation", T.IntegerType()), T.StructField("mirror", T.BooleanType())]))
def confirmed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The first of 8 transforms (rotations, then mirrored rotations) of square b that is similar enough to a; score 0 and nulls without one."""
    rows = []
    for x, y in zip(a, b, strict=True):
        side = int(len(x) ** 0.5)
        p, q = np.asarray(x).reshape(side, side), np.asarray(y).reshape(side, side)
        found = ((s, 90 * r, m) for m in (False, True) for r in range(4) if (s := similarity(p, np.rot90(q[:, ::-1] if m else q, -r))) >= SSIM_PASS)
        rows.append(next(found, (0.0, None, None)))
    return pd.DataFrame(rows, columns=["score", "rotation", "mirror"]).astype({"rotation": "Int32", "mirror": "boolean"})

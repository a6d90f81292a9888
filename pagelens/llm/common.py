"""What the corpus operators share: byte-level text kernels on numpy, Arrow plumbing and checkpoints.

The kernels work on whole Arrow buffers: a text column is one run of UTF-8
bytes with offsets, so words, shingles and k-mers of thousands of documents
come out of a few array passes. Inputs are cut into pieces of a few MB, which
bounds a Python worker's memory whatever Spark's batch size is.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import math
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the kernels take at once.
PIECE_BYTES = 2 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = bytes(_LOWER)
_U = np.uint64
_C1, _C2, _GOLD, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of our own only where none is set and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While it is open, an action's shuffle files go when the action ends; what it has written needs them no more."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, with no lineage; for tables of ids and numbers, never of texts."""
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed(), as a Parquet table: smaller, and read by column; removed by forget(), or when the driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    _STORED[path] = weakref.ref(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_STORED: dict[str, weakref.ref] = {}


def forget(*tables: DataFrame) -> None:
    """Removes tables of stored(), once what reads them is written."""
    for t in tables:
        _drop(t._stored_at)


def _drop(path: str) -> None:
    session = _STORED.pop(path, lambda: None)()
    try:
        place = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
        return


@atexit.register
def drop_stored() -> None:
    """Removes the tables that stored() has written; nothing that reads them may run later."""
    for path in list(_STORED):
        _drop(path)


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Samples take a share of so many values of a hash, so that some rows of any number of rows are drawn.
SHARES = 1 << 62


def drawn(limit: Column, seed: str, *columns: str) -> Column:
    """Whether a row's hash is below the limit, `limit` of SHARES."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(SHARES)) < limit


def limit_for(rows: int, of: int) -> int:
    """The limit by which drawn() takes about `rows` of `of` rows."""
    return SHARES if rows >= of else rows * SHARES // of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """The fold that no model learns from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def chance_of(n: int, at_least: int, rate: float) -> float:
    """The chance of so many of n if each is drawn by the rate."""
    if rate <= 0 or rate >= 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(at_least, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> _U(30))
    h = h * _C1
    h = h ^ (h >> _U(27))
    h = h * _C2
    return h ^ (h >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and offsets; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of about `size` bytes of text with that text's bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = buffers(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
            hi = min(hi, batch.num_rows, lo + 20_000)
            yield batch.slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def lanes(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, as integers; zeros follow the end."""
    padded = np.zeros(len(raw) + 16, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(shape=(len(raw) + 8,), dtype="<u8", buffer=padded.data, strides=(1,))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each document's first word (one more entry at the end)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < len(raw))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + _GOLD)
    view = lanes(raw)
    todo = np.arange(len(starts))
    todo = todo[size <= LONG_WORD]
    k = 0
    while len(todo):
        left = size[todo] - k
        lane = view[starts[todo] + k]
        cut = np.clip(8 - left, 0, 7).astype(np.uint64) * _U(8)
        lane = (lane << cut) >> cut
        h[todo] = mix((h[todo] ^ lane) * _GOLD)
        todo = todo[left > 8]
        k += 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def windows(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside documents, and the word at which each begins."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        h = h * _BASE + words[j : j + m]
    ok = np.ones(m, dtype=bool)
    for e in np.unique(first[1:-1]):
        ok[max(0, e - n + 1) : min(e, m)] = False
    at = np.flatnonzero(ok)
    return mix(h[at]), at


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(); a document with fewer words gives its whole sequence as one."""
    h, at = windows(words, first, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        more = np.zeros(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            x = count[d]
            v = int(x)
            for w in words[first[d] : first[d] + x]:
                v = (v * int(_BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF
            more[i] = v
        h, at = np.concatenate([h, mix(more)]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[raw]


def distinct_by_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted by document, then hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def doc_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct n-word shingles of its lower-cased text: sorted hashes, and where each document's begin."""
    low = lowered(raw)
    starts, ends, first = word_spans(low, off)
    h, at = shingles(word_hashes(low, starts, ends), first, n)
    doc = np.searchsorted(first, at, side="right") - 1
    h, doc = distinct_by_doc(h, doc)
    return h, np.searchsorted(doc, np.arange(len(off)))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def trim() -> None:
    """Gives memory that a task has freed back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() with batches of a few MB: both sides hold a batch at once.

    Spark reads the size of batches from the session when the result is run, so
    it is set there, unless the session has a size of its own already.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "67108864b") == "67108864b":
        conf.set(_BATCH, "4m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a, b) as (node, component): the component is its smallest node.

    Large-star and small-star steps in turn, until nothing changes; each round
    is checkpointed. The stars contract, so chains of any length end in
    logarithmically many rounds, and no node's neighbours meet in one task:
    each step only takes a minimum by node.
    """
    e = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = checkpointed(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component")


_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with Latin letters in lower case and other ASCII characters as spaces."""
    out = _FOLD[raw]
    if len(raw) > 1:
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][upper] += 32
    return out


def with_letters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    total = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122), out=total[1:])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out

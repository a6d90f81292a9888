"""N-gram Jaccard join with set-relation skipping, and the classes that its links form.

Sets are the distinct n-word shingles of lower-cased texts. Equal sets are one
node from the start. Every set enters an inverted index with its prefix only
(so many of its shingles that two linked sets must meet in one list), rare
shingles first: shingles that repeat in some block of documents go last.

Index-level skipping: each list is ordered by set size and read in blocks of
sizes. A set meets only its own block and the one before, and skips the latter
if the position of the shared shingle in both leaves too few shingles behind it.
Pairs from short lists are skipped if they share too few lists.

Answer-level skipping: a block's first set is its leader. All overlaps with the
leader are computed once; a set that links to the leader has its answers from
the leader's. Between two other sets y, z the overlap is derived incrementally:
the part inside the leader from the two answers, and the rest from the few
shingles that the leader lacks. Only sets that don't link to the leader need
those comparisons, so a group of n near copies costs n comparisons, not n * n / 2.

Shingles are 64-bit hashes, and a set is named by its size and a 64-bit sum of
mixed hashes; results are exact up to collisions of these.

Null, empty or wordless text: size 0, linked with nothing. Rows that share a
doc_id are one node and all returned. A null doc_id is returned with no component
(other rows' components don't see it). A very long text's set is made in one
task. Equal sets are linked whatever their texts' order; a tie for the smallest
doc_id can't be. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelens.llm import common as C

#: Most shingles that go last in the order; a bound for what the driver sends out. It affects speed only.
MOST_FREQUENT = 300_000
#: A shingle counts as frequent in a block of so many shingles if so many of its documents hold it.
BLOCK_SHINGLES, FREQUENT = 4_000_000, 2
#: Lists of up to so many sets give pairs.
SHORT = 32
#: Shingles of the sets that one task compares with each other at once.
GROUP_SHINGLES = 1_000_000

EDGE = pa.schema([(k, pa.int64()) for k in ("a_fp", "a_n", "b_fp", "b_n")] + [("loose", pa.bool_())])


def _fingerprints(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(C.mix(h + np.uint64(0x51ED270B)), out=total[1:])
    return C.mix(total[begin[1:]] - total[begin[:-1]])


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, the set's size and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in C.pieces(batches, 1):
            h, begin = C.doc_sets(raw, off, n)
            yield pa.record_batch([rows.column(0), pa.array(np.diff(begin)), pa.array(_fingerprints(h, begin).view(np.int64))], ["doc_id", "n", "fp"])

    return C.arrow_map(docs, run, "doc_id long, n long, fp long")


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of shingles that repeat most within blocks; they only decide the order of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held.clear()
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(h)))
            often = count >= FREQUENT
            return pa.record_batch([pa.array(h[at][often].view(np.int64)), pa.array(count[often])], ["h", "c"])

        size = 0
        for _, raw, off in C.pieces(batches, 0):
            h, _ = C.doc_sets(raw, off, n)
            held.append(h)
            size += len(h)
            if size >= BLOCK_SHINGLES:
                yield flush()
                size = 0
        yield flush()

    found = C.arrow_map(docs.select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = found.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def postings(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The index: each set's prefix as (token, fp, n, pos)."""
    often = frequent_shingles(docs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, off in C.pieces(batches, 0):
            h, begin = C.doc_sets(raw, off, n)
            size = np.diff(begin)
            fp = _fingerprints(h, begin)
            doc = np.repeat(np.arange(len(size)), size)
            last = np.zeros(len(h), dtype=bool)
            if len(often):
                last = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
            order = np.lexsort((h, last, doc))
            pos = np.arange(len(h)) - begin[doc]
            need = -(-size * percent // 100)
            keep = pos < (size - need + 1)[doc]
            doc, pos, h = doc[keep], pos[keep], h[order][keep]
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(fp[doc].view(np.int64)), pa.array(size[doc].astype(np.int32)), pa.array(pos.astype(np.int32))], ["token", "fp", "n", "pos"])

    return C.arrow_map(docs.select("text"), run, "token long, fp long, n int, pos int")


def leaders(index: DataFrame, percent: int, short: int = SHORT) -> DataFrame:
    """Sets that may link, as members of groups: (lead_fp, lead_n, fp, n).

    Short lists give all their pairs, and a pair's lists are counted: of the
    shingles up to where one prefix ends, both prefixes hold all that the sets
    share, so a pair with too few common lists can't link and is skipped. Long
    lists give blocks with leaders; in their pairs' counts, every long list of
    a set counts as common. Lists are read in order; no more than `short` of
    one are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = None
        held: list[tuple[int, int, int]] = []
        lead = before = seen = None
        rest = most = rest_before = most_before = 0
        pairs: list[tuple[int, int, int, int]] = []
        grouped: list[tuple[int, int, int, int]] = []
        counted: list[tuple[int, int]] = []

        def place(f: int, size: int, p: int) -> None:
            """The next set of a long list."""
            nonlocal lead, before, rest, most, rest_before, most_before
            counted.append((f, size))
            if lead is None or size * percent > lead[1] * 100:
                before, rest_before, most_before = lead, rest, most
                lead, rest, most = (f, size), 0, 0
            else:
                grouped.append((*lead, f, size))
            # the block before: skipped if no set there is long enough, or too few shingles follow this one
            if before and size * percent <= most_before * 100 and (100 + percent) * min(size - p, rest_before) >= percent * (size + before[1]):
                grouped.append((*before, f, size))
            rest, most = max(rest, size - p), size

        def close() -> None:
            nonlocal lead, before, rest, most
            if lead is None:
                for i, (f, size, _) in enumerate(held):
                    for g, other, _ in held[i + 1 :]:
                        if other * percent > size * 100:
                            break
                        pairs.append((f, size, g, other))
            held.clear()
            lead = before = None
            rest = most = 0

        for batch in batches:
            t, fp, n, pos = (c.to_numpy() for c in batch.columns)
            live = np.ones(len(t), dtype=bool)
            if len(t) > 1:
                same = t[1:] == t[:-1]
                live[1:-1] = same[:-1] | same[1:]
            at = np.flatnonzero(live)
            for tk, f, size, p in zip(t[at].tolist(), fp[at].tolist(), n[at].tolist(), pos[at].tolist(), strict=True):
                if tk != token:
                    close()
                    token, seen = tk, None
                if seen == (f, size):
                    continue
                seen = (f, size)
                if lead is not None:
                    place(f, size, p)
                    continue
                held.append((f, size, p))
                if len(held) > short:
                    for x in held:
                        place(*x)
                    held.clear()
            if len(pairs) + len(grouped) + len(counted) > 200_000:
                yield from _counted_rows(pairs, grouped, counted)
        close()
        yield from _counted_rows(pairs, grouped, counted)

    dealt = index.repartition("token").sortWithinPartitions("token", "n", "fp", "pos")
    found = C.checkpointed(C.arrow_map(dealt, run, "kind int, lead_fp long, lead_n long, fp long, n long, c long").groupBy("kind", "lead_fp", "lead_n", "fp", "n").agg(F.sum("c").alias("c")))
    long_lists = found.where("kind = 2").select("fp", "n", "c")
    pairs = found.where("kind = 0")
    for end, (f, size) in {"a": ("lead_fp", "lead_n"), "b": ("fp", "n")}.items():
        own = long_lists.select(F.col("fp").alias("f"), F.col("n").alias("s"), F.col("c").alias(f"long_{end}"))
        pairs = pairs.join(own, (F.col(f) == F.col("f")) & (F.col(size) == F.col("s")), "left").drop("f", "s")
    common = F.col("c") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    behind = F.ceil(F.greatest("lead_n", "n") * percent / 100) - 1
    pairs = pairs.where((100 + percent) * (common + behind) >= percent * (F.col("lead_n") + F.col("n")))
    columns = ["lead_fp", "lead_n", "fp", "n"]
    return pairs.select(*columns).unionByName(found.where("kind = 1").select(*columns)).distinct()


def _counted_rows(pairs: list, grouped: list, counted: list) -> Iterator[pa.RecordBatch]:
    """The rows so far, equal ones counted; the lists are emptied."""
    for kind, rows in enumerate((pairs, grouped, [(0, 0, *x) for x in counted])):
        if rows:
            x = np.array(rows, dtype=np.int64)
            key = C.mix(C.mix(C.mix(x[:, 0].view(np.uint64)) ^ x[:, 2].view(np.uint64)) ^ (x[:, 1] << 32 | x[:, 3]).view(np.uint64))
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(np.ascontiguousarray(x[at, k])) for k in range(4)), pa.array(count)], ["kind", "lead_fp", "lead_n", "fp", "n", "c"])
    pairs.clear(), grouped.clear(), counted.clear()


def solve(h: np.ndarray, begin: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what links connect, for sets of which the first is the leader; and which others don't link to it."""
    size = np.diff(begin)
    m, lead = len(size), h[: begin[1]]
    doc = np.repeat(np.arange(m), size)
    at = np.minimum(np.searchsorted(lead, h), len(lead) - 1)
    inside = lead[at] == h
    shared = np.bincount(doc[inside], minlength=m)
    linked = 100 * shared >= percent * (size[0] + size - shared)
    loose = np.flatnonzero(~linked)
    edges = [(0, int(j)) for j in np.flatnonzero(linked) if j]
    if not len(loose) or m < 3:
        return edges, loose
    parent = np.where(linked, 0, np.arange(m)).tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    own = np.zeros((m, len(lead)), dtype=np.float32)
    own[doc[inside], at[inside]] = 1
    # the shingles that the leader lacks, if two sets or more hold them
    other, by = h[~inside], doc[~inside]
    _, inverse, count = np.unique(other, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    other, by = inverse[keep], by[keep]
    order = np.argsort(other, kind="stable")
    lists, start = by[order], np.searchsorted(other[order], np.arange(len(count) + 1))
    mine = np.searchsorted(by, np.arange(m + 1))  # by is in order
    for u in loose.tolist():
        overlap = own @ own[u]
        for e in other[mine[u] : mine[u + 1]]:
            overlap[lists[start[e] : start[e + 1]]] += 1
        for y in np.flatnonzero(100 * overlap.astype(np.int64) >= percent * (size + size[u] - overlap.astype(np.int64))).tolist():
            if y != u and (a := root(u)) != (b := root(y)):
                parent[a] = b
                edges.append((u, y))
    return edges, loose


def compared(groups: DataFrame, n: int, percent: int) -> DataFrame:
    """Links within groups of (lead_fp, lead_n, chunk) and, flagged, (leader, set) of those that don't link to their leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        held: list[tuple[int, int, bytes]] = []
        texts: set[bytes] = set()

        def flush() -> pa.RecordBatch | None:
            off = np.zeros(len(held) + 1, np.int64)
            np.cumsum([len(x[2]) for x in held], out=off[1:])
            h, begin = C.doc_sets(np.frombuffer(b"".join(x[2] for x in held), np.uint8), off, n)
            # rows that share a doc_id with others have brought those rows' texts too
            own = _fingerprints(h, begin).view(np.int64) == np.array([x[0] for x in held])
            rows = [i for i in range(len(held)) if own[i] and (not i or not own[i - 1] or held[i][:2] != held[i - 1][:2])]
            if len(rows) < 2 or held[rows[0]][:2] != key[:2]:
                return None
            if len(rows) < len(held):
                h = np.concatenate([h[begin[i] : begin[i + 1]] for i in rows])
                begin = np.concatenate([[0], np.cumsum(np.diff(begin)[rows])])
            edges, loose = solve(h, begin, percent)
            node = [held[i][:2] for i in rows]
            out = [(*node[a], *node[b], False) for a, b in edges] + [(*key[:2], *node[j], True) for j in loose.tolist()]
            return pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), EDGE, strict=True)], schema=EDGE) if out else None

        for batch in batches:
            lf, ln, ch, _, fp, size, text = (c.to_pylist() for c in batch.columns)
            for row in zip(lf, ln, ch, fp, size, text, strict=True):
                if row[:3] != key:
                    if len(held) > 1 and (done := flush()):
                        yield done
                    key, held = row[:3], []
                if not held or held[-1][:2] != row[3:5]:
                    texts = set()
                if row[5] not in texts:
                    texts.add(row[5])
                    held.append(row[3:])
        if len(held) > 1 and (done := flush()):
            yield done

    dealt = groups.repartition("lead_fp", "lead_n", "chunk").sortWithinPartitions("lead_fp", "lead_n", "chunk", "other", "fp", "n")
    return C.arrow_map(dealt.select("lead_fp", "lead_n", "chunk", "other", "fp", "n", F.col("text").cast("binary").alias("text")), run, "a_fp long, a_n long, b_fp long, b_n long, loose boolean")


def _with_texts(groups: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    nodes = groups.select("fp", "n").distinct().join(classes, ["fp", "n"]).select("fp", "n", "rep")
    texts = docs.join(nodes, docs.doc_id == nodes.rep).select("fp", "n", "text")
    return groups.join(texts, ["fp", "n"])


def link_components(documents: DataFrame, n: int = 4, percent: int = 85, short: int = SHORT, group: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of `documents` (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id is not null")
    sets = C.checkpointed(signatures(docs, n))
    classes = C.checkpointed(sets.where("n > 0 and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("rep")))

    members = C.checkpointed(leaders(postings(named, n, percent), percent, short))
    lead = F.struct("lead_fp", "lead_n")
    load = members.groupBy("lead_fp", "lead_n").agg(F.sum("n").alias("load")).withColumn("chunks", F.ceil(F.col("load") / group).cast("int"))
    load = C.checkpointed(load)
    split = members.join(load, ["lead_fp", "lead_n"]).withColumn("chunk", F.pmod(F.xxhash64("fp", "n"), F.col("chunks")))
    heads = load.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("lead_fp", "lead_n", F.col("chunk").cast("long").alias("chunk"), F.lit(False).alias("other"), F.col("lead_fp").alias("fp"), F.col("lead_n").alias("n"))
    groups = split.select("lead_fp", "lead_n", "chunk", F.lit(True).alias("other"), "fp", "n").unionByName(heads)
    found = C.checkpointed(compared(_with_texts(groups, classes, named), n, percent))

    edges = found.where("not loose").select("a_fp", "a_n", "b_fp", "b_n")
    if load.where("chunks > 1").limit(1).count():
        # sets of split groups that don't link to their leader meet the group's other chunks
        loose = found.where("loose").select(F.col("a_fp").alias("lead_fp"), F.col("a_n").alias("lead_n"), F.col("b_fp").alias("fp"), F.col("b_n").alias("n")).distinct()
        loose = loose.join(load.where("chunks > 1"), ["lead_fp", "lead_n"])
        parts = loose.groupBy("lead_fp", "lead_n").agg(F.ceil(F.sum("n") / group).cast("int").alias("parts"))
        cell = (F.col("c") * F.lit(1 << 20) + F.col("p")).cast("long").alias("chunk")
        row = ["lead_fp", "lead_n", cell, F.lit(True).alias("other"), "fp", "n"]
        base = split.where("chunks > 1").join(parts, ["lead_fp", "lead_n"]).withColumn("c", F.col("chunk")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*row)
        guests = loose.join(parts, ["lead_fp", "lead_n"]).withColumn("p", F.pmod(F.xxhash64("fp", "n"), F.col("parts"))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*row)
        tops = load.join(parts, ["lead_fp", "lead_n"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("lead_fp", "lead_n", cell, F.lit(False).alias("other"), F.col("lead_fp").alias("fp"), F.col("lead_n").alias("n"))
        again = base.unionByName(guests).distinct().unionByName(tops)
        more = compared(_with_texts(again, classes, named), n, percent).where("not loose").select("a_fp", "a_n", "b_fp", "b_n")
        edges = edges.unionByName(more)
    left = classes.select(F.col("fp").alias("a_fp"), F.col("n").alias("a_n"), F.col("rep").alias("a"))
    right = classes.select(F.col("fp").alias("b_fp"), F.col("n").alias("b_n"), F.col("rep").alias("b"))
    ids = edges.distinct().join(left, ["a_fp", "a_n"]).join(right, ["b_fp", "b_n"]).select("a", "b")
    # rows of one doc_id with different texts are one node too
    placed = C.checkpointed(sets.join(classes, ["fp", "n"], "left"))
    same = placed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1).select(F.explode("reps").alias("a"), "b")
    nodes = C.components(ids.unionByName(same))
    return placed.join(nodes, placed.rep == nodes.node, "left").select(placed.doc_id, F.col("n").alias("n_shingles"), F.when(placed.doc_id.isNotNull(), F.coalesce("component", "rep", placed.doc_id)).alias("component_id"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The rows of `documents`, with all their columns, that stay: of each component the smallest doc_id, of rows with one doc_id one.

    Rows with a null doc_id stay.
    """
    found = link_components(documents, **options)
    gone, row = C.unused(documents.columns, "gone_id"), C.unused(documents.columns, "row_number")
    out = C.checkpointed(found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct())
    left = documents.join(out, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    which = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64(*documents.columns))
    return left.withColumn(row, F.row_number().over(which)).where(F.col(row).eqNullSafe(1) | F.col("doc_id").isNull()).select(*documents.columns)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return link_components(C.table(spark, sf_dir, "documents"))

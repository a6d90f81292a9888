"""Filters, orders, numbering and renaming of item tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matching(df: DataFrame, search: str = "", search_in: tuple[str, ...] = (), minimum: dict[str, float] | None = None, equal: dict[str, object] | None = None) -> DataFrame:
    """Rows whose columns have the equal values, reach the minima (a null doesn't), and hold the search text literally in any case."""
    if search:
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in search_in)))
        df = df.where(F.contains(hay, F.lit(search.lower())))
    for c, v in (minimum or {}).items():
        df = df.where(F.col(c) >= v)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    return df


def by_name(df: DataFrame, name: str, detected: str) -> DataFrame:
    """Sorted by name regardless of case and accents, then by detection."""
    return df.orderBy(*name_order(name, detected))


def first_match(df: DataFrame, search: str, search_in: tuple[str, ...], position: str) -> DataFrame:
    """The first row by position that holds the search text, in any case; no row if none does."""
    return matching(df, search=search, search_in=search_in).orderBy(position).limit(1)


def by_dom_order(df: DataFrame, order: str, sequence: str, name: str) -> DataFrame:
    """Sorted by the place in the page, the order of discovery, then the name; rows without a place last."""
    return df.orderBy(*dom_order(order, sequence, name))


def dom_order(order: str, sequence: str, name: str) -> list[Column]:
    return [F.asc_nulls_last(order), F.asc_nulls_last(sequence), F.collate(F.coalesce(F.col(name), F.lit("")), "UNICODE")]


def title_order(title: str, added: str, label: str, key: str) -> list[Column]:
    """By title without case, the last added first, by label; `key` settles ties."""
    return [F.lower(title), F.desc(added), F.asc(label), F.asc(key)]


def name_order(name: str, detected: str) -> list[Column]:
    """By name regardless of case and accents, then by detection."""
    return [F.collate(F.coalesce(F.col(name), F.lit("")), "UNICODE_CI_AI"), F.col(detected)]


def stamped(pages: DataFrame, nodes: Column, most: int = 20_000) -> DataFrame:
    """(page_id, node, dom_order) of an array of nodes in page order, from 1, at most so many of a page."""
    return pages.select("page_id", F.posexplode(nodes).alias("pos", "node")).where(F.col("pos") < most).select("page_id", "node", (F.col("pos") + 1).alias("dom_order"))


def last_runs(df: DataFrame, group: list[str], order: list[Column], same: list[str], at: str, k: int = 5) -> DataFrame:
    """The last runs of collapse_runs(), each group's newest first."""
    return top_per_group(collapse_runs(df, group, order, same, at), group, [F.desc("run")], k)


def by_greatest(df: DataFrame, value: Column, detected: str) -> DataFrame:
    return df.orderBy(F.when(value > 0, value).otherwise(0).desc(), detected)


def natural(df: DataFrame, path: str) -> DataFrame:
    """By the first number in the path, paths without one last, then by path."""
    return df.orderBy(F.asc_nulls_last(F.regexp_extract(path, r"(\d+)", 1).try_cast("int")), path)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ordinals(df: DataFrame, key: str, position: str) -> DataFrame:
    """Column `ordinal`: the key's rank by its first position."""
    first = df.groupBy(key).agg(F.min(position).alias("_first"))
    return df.join(first.withColumn("ordinal", F.row_number().over(Window.orderBy("_first"))).drop("_first"), key)


def serial_names(df: DataFrame, group: list[str], order: list[Column], ext: Column, start: int = 1) -> DataFrame:
    """Column `serial_name`: numbers in order with leading zeros to two digits or the longest number's."""
    w = Window.partitionBy(*group)
    number = F.row_number().over(w.orderBy(*order)) + F.lit(start - 1)
    digits = F.greatest(F.lit(2), F.length((F.count(F.lit(1)).over(w) + (start - 1)).cast("string")))
    text = number.cast("string")
    return df.withColumn("serial_name", F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), digits - F.length(text))), text, F.lit("."), ext))


def numbered_repeats(df: DataFrame, folder: str, name: str, order: list[Column]) -> DataFrame:
    """Column `unique_name`: the second, third ... equal name of a folder gets (1), (2) ... before its extension.

    Right unless a name that this makes also occurs by itself; unique_names() has no such exception.
    """
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(*order)) - 1
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^.+?(\.[^.]*)?$", 1)
    return df.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)))


def _split(name: str) -> tuple[str, str]:
    dot = name.rfind(".")
    return (name[:dot], name[dot:]) if dot > 0 else (name, "")


def _numbered(name: str, n: int) -> str:
    stem, ext = _split(name)
    return f"{stem} ({n}){ext}"


_MADE = re.compile(r"(.*) \(([1-9][0-9]*)\)", re.DOTALL)


class _Names:
    """Names given so far, among names of one root: what it holds grows with the distinct names, not with the rows."""

    def __init__(self) -> None:
        self.own: set[str] = set()  # given as they are
        self.next: dict[str, int] = {}  # all smaller numbers of a name are taken

    def made(self, name: str) -> bool:
        stem, ext = _split(name)
        m = _MADE.fullmatch(stem)
        if not m:
            return False
        base, n = m[1] + ext, int(m[2])
        return n < self.next.get(base, 1) and _numbered(base, n) == name

    def give(self, name: str) -> str:
        if name not in self.next:
            self.next[name] = 1
            if not self.made(name):
                self.own.add(name)
                return name
        n = self.next[name]
        while (new := _numbered(name, n)) in self.own:
            n += 1
        self.next[name] = n + 1
        return new


def unique_names(df: DataFrame, folder: str, name: str, position: str) -> DataFrame:
    """As numbered_repeats(), folder by folder in order, without names that collide; a null name stays null.

    Only names that are equal without their numbers, such as (1), can collide.
    Those of a folder pass through one task in order, in time that grows with
    their number, and only distinct names are held.
    """
    root = "_root"
    while root in df.columns:
        root += "_"
    keyed = df.withColumn(root, F.regexp_replace(name, r"(?s)(?: \([1-9][0-9]*\))+(?=(?:\.[^.]*)?\z)", ""))
    dealt = keyed.repartition(folder, root).sortWithinPartitions(folder, root, F.asc_nulls_last(position))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names = None, _Names()
        for batch in batches:
            out = []
            for f, r, x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (folder, root, name)), strict=True):
                if key != (f, r):
                    key, names = (f, r), _Names()
                out.append(None if x is None else names.give(x))
            columns = batch.schema.get_field_index(root)
            yield pa.record_batch([*batch.columns[:columns], pa.array(out, pa.string())], [*batch.schema.names[:columns], "unique_name"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, unique_name string")


def collapse_runs(df: DataFrame, group: list[str], order: list[Column], same: list[str], at: str) -> DataFrame:
    """Runs of rows that agree in the columns `same`, as one row each: run number, start, end and length."""
    w = Window.partitionBy(*group).orderBy(*order)
    value = F.struct(*same)
    new = F.when(F.lag(value).over(w).eqNullSafe(value), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "run", *same).agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count("*").alias("run_rows"))


def page_of_rows(df: DataFrame, order: list[Column], scroll: int, row_height: int, visible: int, margin: int = 12) -> DataFrame:
    """The rows that a scrolled list shows, with a margin on both sides."""
    start = max(0, scroll // row_height - margin)
    return df.orderBy(*order).offset(start).limit(visible + 2 * margin)


def access_open(purchased: Column, coin: Column, freed_at: Column, prefree_until: Column, now) -> Column:
    return F.coalesce(purchased, F.lit(False)) | F.coalesce(coin == 0, F.lit(False)) | F.coalesce(freed_at <= F.lit(now), F.lit(False)) | F.coalesce(prefree_until > F.lit(now), F.lit(False))

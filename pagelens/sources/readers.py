"""Catalogue sources and the keyed tables they are kept in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], list[tuple]], pages: int, parts: int):
        self.fetch, self.pages, self.parts = fetch, pages, parts

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-self.pages // self.parts))
        return [PageRange(i, min(i + step, self.pages)) for i in range(0, self.pages, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(*partition.value):
            rows = self.fetch(page)
            if not rows:  # an empty page ends the list
                return
            yield from rows


def paged_source(name: str, schema_: str, fetch: Callable[[int], list[tuple]], pages: int, parts: int = 8) -> type[DataSource]:
    """A data source whose rows come page by page; register it with spark.dataSource.register()."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return _PagedReader(fetch, pages, parts)

    return Paged


def series_list(rows: DataFrame) -> DataFrame:
    """The first row of each id, by lower-cased title, then id."""
    w = Window.partitionBy("id").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.lower("title"), "id")


def atom_entries(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """(feed_id, pos, title, link, locked) of Atom entries."""
    entry = F.regexp_extract_all(column, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), 1)
    each = feeds.select("feed_id", F.posexplode(entry).alias("pos", "e"))
    title = F.trim(F.regexp_extract("e", r"(?s)<title[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>", 1))
    return each.select("feed_id", "pos", title.alias("title"), F.regexp_extract("e", r'<link\b[^>]*?href="([^"]*)"', 1).alias("link"), F.col("e").rlike(r"(?i)<[\w:]*locked>\s*true").alias("locked"))


def page_list(documents: DataFrame, column: str, array_path: str, names: tuple[str, ...]) -> DataFrame:
    """(id, pos, url) from JSON page lists: the first of the alternative fields that isn't empty."""
    items = documents.select("id", F.posexplode(F.from_json(F.get_json_object(column, array_path), "array<map<string,string>>")).alias("pos", "item"))
    return items.select("id", "pos", F.coalesce(*(F.nullif(F.col("item")[n], F.lit("")) for n in names)).alias("url")).where("url is not null")


def until_empty(rows: DataFrame, source: str, page: str) -> DataFrame:
    """Rows of a list read page by page from 0, as far as the first page without rows."""
    pages = rows.groupBy(source, page).agg(F.lit(1).alias("one")).withColumn("n", F.row_number().over(Window.partitionBy(source).orderBy(page)) - 1)
    return rows.join(pages.where(F.col("n") == F.col(page)).select(source, page), [source, page], "left_semi")


def json_records(documents: DataFrame, column: str, path: str, fields: str) -> DataFrame:
    """(id, pos and the fields) of an array of records that a JSON or GraphQL answer holds at the path."""
    items = documents.select("id", F.posexplode(F.from_json(F.get_json_object(column, path), f"array<struct<{fields}>>")).alias("pos", "item"))
    return items.select("id", "pos", "item.*")


def pattern_records(documents: DataFrame, column: str, pattern: str) -> DataFrame:
    """(id, pos, value) of the pattern's first group, for every match."""
    return documents.select("id", F.posexplode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("pos", "value"))


def sqlite_rows(spark: SparkSession, path: str, table: str, columns: tuple[str, ...]) -> DataFrame:
    """The columns, as text, of a table in SQLite files at a path that Spark can read, a file for each task."""

    def run(batches):
        import sqlite3

        import pandas as pd

        names = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
        quoted = '"' + table.replace('"', '""') + '"'
        for batch in batches:
            for content in batch["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                rows = con.execute(f"SELECT {names} FROM {quoted}").fetchall()  # noqa: S608  names are quoted
                yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in rows], columns=list(columns), dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def imported(favorites: DataFrame, ids: DataFrame) -> DataFrame:
    """Favorites (module, title, link, read) of another program under this one's ids (module, connector); those without one go."""
    return favorites.join(ids, "module").select("connector", "title", "link", "read")


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(folder, name, content, length) of the files below a path that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A keyed table after new rows; columns that a new row leaves null keep the old value."""
    cols = [c for c in old.columns if c not in key]
    n = new.select(*key, *(F.col(c).alias(f"_{c}") for c in cols))
    return old.join(n, key, "full_outer").select(*key, *(F.coalesce(f"_{c}", c).alias(c) for c in cols))


def with_prefix(store: DataFrame, prefix: str) -> DataFrame:
    """Entries (key, value) of a namespace."""
    return store.where(F.col("key").startswith(prefix))


def removed(store: DataFrame, keys: list[str]) -> DataFrame:
    return store.where(~F.col("key").isin(*keys))


def by_index(store: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of a keyed table by another column's values, as a secondary index gives them."""
    return store.join(wanted.select(column).distinct(), column, "left_semi").select(*store.columns)


class Modules:
    """Site modules by id: a pattern of URLs they take, and functions of DataFrames."""

    METHODS = ("list_chapters", "list_pages")

    def __init__(self):
        self._all: dict[str, tuple[str, dict[str, Callable]]] = {}

    def register(self, ident: str, url_pattern: str, **methods: Callable[[DataFrame], DataFrame]) -> None:
        """A module under a new id; all have the methods of METHODS and may have more."""
        if missing := [m for m in self.METHODS if not callable(methods.get(m))]:
            raise TypeError(f"module {ident} lacks {', '.join(missing)}")
        if not ident or ident in self._all:
            raise ValueError(f"module id {ident!r} is empty or taken")
        re.compile(url_pattern)
        self._all[ident] = (url_pattern, methods)

    def detect(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """Column module: the first registered module that takes the URL."""
        hits = [F.when(F.col(url).rlike(p), F.lit(i)) for i, (p, _) in self._all.items()]
        return pages.withColumn("module", F.coalesce(*hits, F.lit(None).cast("string")))

    def call(self, ident: str, method: str, rows: DataFrame) -> DataFrame:
        try:
            return self._all[ident][1][method](rows)
        except KeyError:
            raise LookupError(f"no method {method} of module {ident}") from None

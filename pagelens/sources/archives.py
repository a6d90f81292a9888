"""Packed exports: store-only ZIP archives (also as CBZ and EPUB), and series metadata."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

# The container of an EPUB.
_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def zip_bytes(entries: list[tuple[str, bytes]]) -> bytes:
    """A store-only archive in order; equal inputs give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def epub_bytes(title: str, pages: list[tuple[str, bytes]]) -> bytes:
    items = "".join(f'<item id="p{i}" href="{escape(n)}" media-type="application/octet-stream"/>' for i, (n, _) in enumerate(pages))
    spine = "".join(f'<itemref idref="p{i}"/>' for i in range(len(pages)))
    opf = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata><title>{escape(title)}</title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    return zip_bytes([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", _CONTAINER.encode()), ("OEBPS/content.opf", opf.encode()), *((f"OEBPS/{n}", d) for n, d in pages)])


def comic_info(series: str, title: str, pages: int) -> str:
    return f'<?xml version="1.0"?><ComicInfo><Series>{escape(series)}</Series><Title>{escape(title)}</Title><PageCount>{pages}</PageCount></ComicInfo>'


def packed(files: DataFrame, archive: str = "archive", name: str = "name", content: str = "content", order: str = "pos", kind: str = "zip") -> DataFrame:
    """(archive, n_files, bytes, content) with one archive of each key; an archive is built in one task's memory."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, name])
        entries = list(zip(rows[name], (bytes(x) for x in rows[content]), strict=True))
        key = rows[archive].iloc[0]
        data = epub_bytes(str(key), entries) if kind == "epub" else zip_bytes(entries)
        return pd.DataFrame({"archive": [str(key)], "n_files": [len(entries)], "bytes": [len(data)], "content": [data]})

    return files.select(archive, name, content, order).groupBy(archive).applyInPandas(run, "archive string, n_files int, bytes long, content binary")

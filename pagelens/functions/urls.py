"""URL columns: parts, canonical forms, sources and file names. All are expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only bust caches.
CACHE_PARAMS = ("_nc_ht", "_nc_cat", "_nc_ohc", "_nc_oc", "_nc_gid", "ccb", "oh", "oe", "_nc_sid", "edm", "efg", "stp")
VIDEO_EXTENSIONS = ("mp4", "webm", "m4v", "mov", "m3u8", "mpd", "ts")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def bare(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def canonical(url: Column, drop: tuple[str, ...] = CACHE_PARAMS) -> Column:
    """Without the named query parameters; the order of the others and the fragment stay."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~F.substring_index(p, "=", 1).isin(*drop))
    left = F.array_join(kept, "&")
    return F.when(query == "", url).otherwise(F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.when(left == "", "").otherwise(F.concat(F.lit("?"), left)), F.regexp_extract(url, "(#.*)$", 1)))


def file_name(url: Column) -> Column:
    """The last path segment."""
    return F.element_at(F.split(bare(url), "/"), -1)


def unescaped(part: Column) -> Column:
    """Percent-decoded; a plus sign stays one, and what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def source_link(url: Column) -> Column:
    """The folder of an http, https or file URL, in lower case; null for other schemes or without a file name."""
    plain = bare(url)
    folder = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^(.*)/[^/]*$", 1)), "/+$", "")
    return F.when(scheme(url).isin("http", "https", "file") & (F.regexp_extract(plain, r"/([^/]+)$", 1) != "") & folder.contains("://"), folder)


def source_file(url: Column) -> Column:
    """The decoded file name that goes with source_link, in lower case."""
    return F.when(source_link(url).isNotNull(), F.lower(F.trim(unescaped(F.regexp_extract(bare(url), r"/([^/]+)$", 1)))))


def attribute(raw: Column) -> Column:
    """A URL as it stands in an HTML attribute: outer quotes and escaped ampersands undone."""
    value = F.trim(raw)
    value = F.trim(F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2"))
    return F.replace(F.regexp_replace(value, "(?i)&amp;", "&"), F.lit("&#38;"), F.lit("&"))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(bare(url), r"\.([A-Za-z0-9]+)$", 1))


def kind(url: Column) -> Column:
    """img, dataUri or blob, by scheme."""
    return F.when(url.startswith("data:"), "dataUri").when(url.startswith("blob:"), "blob").otherwise("img")


def is_video(url: Column, type_hint: Column | None = None) -> Column:
    by_name = extension(url).isin(*VIDEO_EXTENSIONS)
    return by_name if type_hint is None else by_name | F.coalesce(F.lower(type_hint).startswith("video/"), F.lit(False))


def suffixes(name: Column) -> Column:
    """A host and all its parent domains, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matches_domain(name: Column, domain: Column | str) -> Column:
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (name == d) | F.endswith(name, F.concat(F.lit("."), d))


def decoded_data(url: Column) -> Column:
    """The bytes of a data URL; null if it isn't one or can't be decoded."""
    body = F.regexp_extract(url, r"(?s)^data:[^,]*,(.*)$", 1)
    base64 = F.regexp_extract(url, r"(?s)^data:([^,]*),", 1).endswith(";base64")
    return F.when(url.startswith("data:"), F.when(base64, F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(unescaped(body), "UTF-8")))

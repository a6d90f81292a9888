"""Names, formats, titles and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that file systems reserve.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
KNOWN_FORMATS = ("png", "jpg", "webp", "gif", "svg", "ico", "avif", "bmp")
STEM_LENGTH, NAME_LENGTH = 120, 180


def safe_extension(ext: Column, default: str = "png") -> Column:
    cleaned = F.left(F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), "[^a-z0-9]", ""), F.lit(8))
    return F.when(cleaned == "", default).otherwise(cleaned)


def safe_stem(stem: Column, default: str = "image") -> Column:
    """A file name's stem without characters that file systems refuse."""
    value = F.regexp_replace(F.coalesce(stem, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', "_")
    value = F.trim(F.regexp_replace(F.regexp_replace(value, r"[. ]+$", ""), r"^\.+", ""))
    value = F.when(value == "", default).otherwise(value)
    return F.left(F.when(F.lower(value).isin(*RESERVED), F.concat(F.lit("_"), value)).otherwise(value), F.lit(STEM_LENGTH))


def safe_name(name: Column, default_ext: str = "png", default: str = "image") -> Column:
    """Stem and extension made safe, the whole no longer than NAME_LENGTH."""
    base = F.element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), "/"), -1)
    ext = F.regexp_extract(base, r"^.+\.([^.]*)$", 1)
    stem = F.when(F.instr(F.substring(base, 2, 100000), ".") > 0, F.regexp_extract(base, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(base)
    e, s = safe_extension(ext, default_ext), safe_stem(stem, default)
    return F.concat(F.left(s, F.greatest(F.lit(1), F.lit(NAME_LENGTH - 1) - F.length(e))), F.lit("."), e)


def mime_extension(mime: Column) -> Column:
    """The usual extension of an image type; empty for others."""
    kind = F.regexp_extract(F.trim(F.substring_index(F.lower(F.coalesce(mime, F.lit(""))), ";", 1)), "^image/(.+)$", 1)
    return F.when(kind.contains("svg"), "svg").when(kind.contains("jpeg"), "jpg").when(kind.contains("x-icon"), "ico").otherwise(F.regexp_replace(kind, "[^a-z0-9]", ""))


def first_known_format(*candidates: Column) -> Column:
    """The first candidate that names a known format; without one the last that isn't empty; else "data"."""
    some = F.filter(F.transform(F.array(*candidates), lambda c: F.when(F.lower(c) == "jpeg", "jpg").otherwise(F.lower(c))), lambda c: c.isNotNull() & (c != ""))
    known = F.filter(some, lambda c: c.isin(*KNOWN_FORMATS))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.try_element_at(some, F.lit(-1)), F.lit("data"))


def sniffed_mime(content: Column) -> Column:
    """An image's type by its first bytes; an SVG's by its element in the first 512; empty if unknown."""
    head = F.hex(F.substring(content, 1, 16))
    is_ = head.startswith
    return (
        F.when(is_("89504E47"), "image/png").when(is_("FFD8FF"), "image/jpeg").when(is_("47494638"), "image/gif")
        .when(is_("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(is_("00000100"), "image/x-icon").when(is_("424D"), "image/bmp")
        .when(is_("49492A00") | is_("4D4D002A"), "image/tiff").when(F.substring(head, 9, 16) == "6674797061766966", "image/avif")
        .when(F.decode(F.substring(content, 1, 512), "ISO-8859-1").rlike(r"(?i)<svg[\s>]"), "image/svg+xml").otherwise("")
    )


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def positive_int(raw: Column) -> Column:
    """A positive finite number rounded half up; else 0."""
    x = raw.try_cast("double")
    return F.when((x > 0) & (x < 9e15), half_up(x)).otherwise(F.lit(0)).cast("bigint")


def human_size(n: Column) -> Column:
    def shown(unit: str, power: int) -> Column:
        v = n / float(1024**power)
        return F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(half_up(v).cast("string")), F.lit(f" {unit}"))

    return F.when(n.isNull() | (n <= 0), "").when(n < 1024, F.concat(half_up(n).cast("string"), F.lit(" B"))).when(n < 1024**2, shown("KB", 1)).when(n < 1024**3, shown("MB", 2)).otherwise(shown("GB", 3))


def human_duration(ms: Column) -> Column:
    sec = half_up(ms / 1000.0)
    long = F.concat(F.floor(sec / 60).cast("string"), F.lit("m "), F.lpad((sec % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms.isNull() | (ms < 0), "-").when(ms < 1000, F.concat(half_up(ms).cast("string"), F.lit(" ms"))).when(ms < 5000, F.format_string("%.2f s", ms / 1000.0)).when(ms < 60000, F.format_string("%.1f s", ms / 1000.0)).otherwise(long)


# What messages of each class say.
ERROR_PATTERNS = (("auth", "401|403|unauth|forbidden|login|cookie"), ("blocked", "cors|blocked by client|fetch failed|network"), ("timeout", "timeout|timed out"))


def error_class(message: Column) -> Column:
    """auth, blocked, timeout or null."""
    m = F.lower(message)
    return F.coalesce(*(F.when(m.rlike(p), F.lit(name)) for name, p in ERROR_PATTERNS))


def parameter_digest(params: Column, seed: str = "") -> Column:
    """A digest of a map's entries whatever their order: of each entry, in order of keys, the key's and the value's digests."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(F.sha2(e["key"], 256), F.lit("_"), F.sha2(e["value"], 512)))
    return F.sha2(F.concat(F.sha2(F.array_join(pairs, ","), 256), F.lit(seed)), 512)


def merged_settings(defaults: Column, given: Column, fields: dict[str, str | dict]) -> Column:
    """Two structs (null fields are not set) as one, leaf by leaf: the given value, else the default; `fields` names the leaves, nested."""
    out = []
    for name, kind in fields.items():
        a, b = defaults[name], given[name]
        out.append((merged_settings(a, b, kind) if isinstance(kind, dict) else F.coalesce(b, a)).alias(name))
    return F.struct(*out)


def safeguarded(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The lower-cased value if it is allowed, else the default."""
    return F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise(F.lit(default))


def clamped(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """A numeric setting within its limits; a null stays one."""
    if least is not None:
        value = F.when(value < least, F.lit(least)).otherwise(value)
    return value if most is None else F.when(value > most, F.lit(most)).otherwise(value)


def text_hash(text: Column, signed: bool = False) -> Column:
    """h = 31 h + unit over UTF-16 code units, modulo 2**32; signed wraps to 32 bits with sign."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    n = F.length(units) / 4
    at = F.when(n >= 1, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(at, F.lit(0).cast("bigint"), lambda a, i: (a * 31 + F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")) % F.lit(1 << 32))
    return F.when(h >= 1 << 31, h - F.lit(1 << 32)).otherwise(h) if signed else h


def padded(number: Column, digits: int) -> Column:
    """Zeros before a number's leading digits, up to so many of them."""
    lead = F.length(F.regexp_extract(number, r"^(\d+)", 1))
    return F.when((lead == 0) | (lead >= digits), number).otherwise(F.concat(F.repeat(F.lit("0"), F.lit(digits) - lead), number))


def chapter_title(title: Column, template: str, series: Column, label: Column) -> Column:
    """The template with volume, chapter, rest of the title, title, series and source filled in."""
    vol_re, ch_re = r"(?i)\s*(?:vol(?:ume)?\.?)\s*(\d+(?:\.\d+)?)", r"(?i)\s*(?:ch(?:apter)?\.?)\s*(\d+(?:\.\d+)?)"
    volume = padded(F.regexp_extract(title, vol_re, 1), 3)
    rest = F.trim(F.regexp_replace(title, vol_re, ""))
    chapter = padded(F.regexp_extract(rest, ch_re, 1), 4)
    rest = F.trim(F.regexp_replace(rest, ch_re, ""))
    out = F.lit(template)
    for mark, value in (("%VOL%", volume), ("%CH%", chapter), ("%T%", rest), ("%O%", title), ("%M%", series), ("%C%", label)):
        out = F.replace(out, F.lit(mark), value)
    return out


def coords(text: Column) -> Column:
    """`id:x,y+w,h>dx,dy` as a struct; null if it isn't one."""
    pattern = r"^([^:]+):(-?\d+),(-?\d+)\+(\d+),(\d+)>(-?\d+),(-?\d+)$"
    names = ("id", "x", "y", "w", "h", "dx", "dy")
    parts = [F.regexp_extract(text, pattern, i + 1) for i in range(7)]
    return F.when(text.rlike(pattern), F.struct(parts[0].alias("id"), *(p.try_cast("int").alias(n) for p, n in zip(parts[1:], names[1:], strict=True))))

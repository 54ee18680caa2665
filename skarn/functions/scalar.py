"""Scalar rules for image metadata, as native column expressions."""

from __future__ import annotations

import html
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The collection's domains and thresholds.
KEYWORDS = ("mountain", "forest", "sea", "desert", "snow")
SOURCES = ("pexels", "unsplash", "google")
MIN_SIDE = 200
MIN_GRAY_STD = 8.0
UNKNOWN = "unknown"
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def truthy(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def first_truthy(*columns: Column) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*[truthy(c) for c in columns])


def first_nonzero(*columns: Column) -> Column:
    """The first value that is neither null, empty nor zero, as a string."""
    return F.coalesce(*[F.when(~c.cast("string").isin("", "0", "0.0"), c.cast("string")) for c in columns])


def strip(c: Column) -> Column:
    """White space of all kinds removed at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_label(label: Column, keyword: Column) -> Column:
    """First truthy of label and keyword, else ``unknown``; lower case, stripped (only white space becomes empty)."""
    return strip(F.lower(F.coalesce(truthy(label), truthy(keyword), F.lit(UNKNOWN))))


def to_int(*columns: Column) -> Column:
    """The first truthy of text columns as an integer; 0 if there is none or it is no integer (see ``number_to_int`` for floats)."""
    text = first_nonzero(*columns)
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), strip(text).try_cast("int")), F.lit(0))


def number_to_int(c: Column) -> Column:
    """A numeric column truncated to an integer; null and NaN give 0."""
    return F.coalesce(F.when(~F.isnan(c.cast("double")), F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))).cast("int"), F.lit(0))


def not_true(c: Column) -> Column:
    """True unless the flag is true; null counts as not true."""
    return ~c.eqNullSafe(F.lit(True))


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c.cast("string") != "")


def big_enough(width: Column, height: Column, side: int = MIN_SIDE) -> Column:
    """Cleaning rule: both sides reach ``side``."""
    return (width >= side) & (height >= side)


def big_enough_to_crawl(width: Column, height: Column, side: int = MIN_SIDE) -> Column:
    """Crawling rule: the longer side reaches ``side``."""
    return F.greatest(width, height) >= side


def reject_category(reason: Column) -> Column:
    """Category of a reject reason by ordered substring tests; null gives ``other``."""
    text = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(text.contains("corrupt") | text.contains("download"), "corrupt")
        .when(text.contains("small"), "too_small")
        .when(text.contains("monotone"), "monotone")
        .when(text.contains("duplicate_url"), "duplicate_url")
        .when(text.contains("duplicate_phash"), "duplicate_phash")
        .when(text.contains("missing_url"), "missing_url")
        .otherwise("other")
    )


def large_url(kind: str, urls: Column) -> Column:
    """Preferred image address of an API record (a struct or map of sizes)."""
    sizes = {"pexels": ("large", "large2x", "original"), "unsplash": ("raw", "full", "regular")}[kind]
    return first_truthy(*[urls[s] for s in sizes])


def described(kind: str, text: Column, keyword: Column) -> Column:
    """Description of a record, with its default."""
    return F.concat(keyword, F.lit(" landscape")) if kind == "google" else first_truthy(text, keyword)


def padded_name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%06d", number), F.lit(".jpg"))


def fixed_name(prefix: str, number: Column) -> Column:
    """A name whose number always has six digits, as SQL's ``lpad`` makes it: a longer number keeps its first six, so such names are not unique."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 6, "0"), F.lit(".jpg"))


def stem(name: Column) -> Column:
    """Name without its last extension; a leading dot is part of the stem."""
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def id_in_name(name: Column, fallback: Column) -> Column:
    """Number between the last ``_`` and the extension, else ``fallback``."""
    return F.coalesce(F.regexp_extract(name, r"_([0-9]+)\.[^.]*$", 1).try_cast("int"), fallback.cast("int"))


def web_url(url: Column) -> Column:
    """The URL if it begins with http, else null (inline images)."""
    return F.when(url.startswith("http"), url)


def inline_bytes(url: Column) -> Column:
    """Bytes of a ``data:...;base64,`` URL, split at the first comma; null for others and for bad payloads."""
    return F.when(url.startswith("data:"), F.try_to_binary(F.substr(url, F.instr(url, ",") + F.lit(1)), F.lit("base64")))


def number(c: Column) -> Column:
    """Numeric coercion: text that is no number gives null."""
    return strip(c.cast("string")).try_cast("double")


def parsed_time(c: Column) -> Column:
    """UTC timestamp of a text in one of three formats, else null (the session time zone must be UTC)."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS])


def ratio(width: Column, height: Column, digits: int = 3) -> Column:
    """Quotient rounded as doubles are by numpy and SQL engines: scaled, rounded to a whole number (halves away from 0) and scaled back.

    ``F.round`` rounds the shortest decimal text of a double instead, so it takes 8.0955 up although 8.0955 * 1000 is below 8095.5.
    """
    scale = float(10**digits)
    return F.round(F.try_divide(width.cast("double"), height.cast("double")) * scale, 0) / scale


def confidence(distance: Column) -> Column:
    return F.round(1 / (1 + distance), 4)


def grade(purity: Column, excellent: float = 0.9, good: float = 0.8) -> Column:
    """Processing grades by default; evaluation uses 0.8 and 0.7."""
    return F.when(purity >= excellent, "EXCELLENT").when(purity >= good, "GOOD").otherwise("ACCEPTABLE")


def gauge(value: Column, low: float, high: float, inverted: bool = False) -> Column:
    """Position of a value between two ends, clipped to 0..1; 0 for an empty range."""
    if high <= low:
        return F.lit(0.0)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
    return 1 - share if inverted else share


def flag(value: Column) -> Column:
    """A number or text as boolean; null where it is neither true nor false."""
    return value.try_cast("boolean")


def capitalised(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def looked_up(key: Column, values: Mapping[int, str], default: str) -> Column:
    """A literal map with a default."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def unified(df: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Projection to fixed fields (name, type); absent ones are null."""
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


# HTML as its tokenizer reads it: comments, elements whose content is text, and tags whose attributes may hold ">" within quotes
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_ATTRIBUTES = r"(?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+" + _VALUE + r")?+)*+"
HTML_TOKEN = r"(?is)<!--.*?(?:--!?>|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])" + _ATTRIBUTES + r">.*?(?:</\1(?=[\s/>])|\z)|<[a-z!/?]" + _ATTRIBUTES + ">"
HTML_ATTRIBUTE = r"(?s)([^\s/>=]++)(?:\s*+=\s*+(" + _VALUE + "))?"


def unescaped():
    """A pandas UDF: texts with their HTML character references replaced."""

    @F.pandas_udf("string")
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(html.unescape, na_action="ignore")

    return work


def image_tags(page: Column) -> Column:
    """Attributes of every ``<img>`` of a page, in page order: arrays of (name, value), names in lower case, values without quotes but with character references.

    Tags in comments, scripts, styles and other elements whose content is text are no tags.
    """
    tokens = F.regexp_extract_all(page, F.lit(HTML_TOKEN), F.lit(0))
    tags = F.filter(tokens, lambda t: t.rlike(r"(?i)^<img[\s/>]"))
    name = lambda a: F.lower(F.regexp_extract(a, HTML_ATTRIBUTE, 1))
    raw = lambda a: F.regexp_extract(a, HTML_ATTRIBUTE, 2)
    value = lambda a: F.when(raw(a).rlike("^[\"']"), F.substr(raw(a), F.lit(2), F.length(raw(a)) - 2)).otherwise(raw(a))
    parts = lambda t: F.regexp_extract_all(F.substr(t, F.lit(5)), F.lit(HTML_ATTRIBUTE), F.lit(0))
    return F.transform(tags, lambda t: F.transform(parts(t), lambda a: F.struct(name(a).alias("name"), value(a).alias("value"))))


def image_sources(page: Column, least: int = 100) -> Column:
    """``src`` of the ``<img>`` tags of a page that are no GIFs and whose size is unknown or at least ``least`` x ``least``; the first of equal attributes counts.

    Values that hold a character reference are decoded by ``unescaped`` afterwards.
    """
    of = lambda t, n: F.get(F.filter(t, lambda a: a["name"] == n), F.lit(0))["value"]
    size = lambda t, n: F.regexp_extract(F.coalesce(of(t, n), F.lit("")), r"^\s*(\d+)", 1).try_cast("int")
    src = lambda t: F.trim(F.coalesce(of(t, "src"), F.lit("")))
    keep = lambda t: (src(t) != "") & ~F.lower(src(t)).contains(".gif") & ~F.lower(src(t)).startswith("data:image/gif") & (size(t, "width").isNull() | size(t, "height").isNull() | ((size(t, "width") >= least) & (size(t, "height") >= least)))
    return F.transform(F.filter(image_tags(page), keep), src)


def page_images(pages: DataFrame, *keep: str, column: str = "html") -> DataFrame:
    """``keep``, ``place`` and ``source`` of every image of ``image_sources``, a row each, with character references decoded."""
    each = pages.select(*keep, F.posexplode(image_sources(F.col(column))).alias("place", "source"))
    plain, coded = each.where(~F.col("source").contains("&")), each.where(F.col("source").contains("&"))
    return plain.unionByName(coded.withColumn("source", unescaped()("source")))

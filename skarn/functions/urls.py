"""URL canonical forms as native expressions (RFC 3986 split by regular expressions, no look-ahead)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generic URI pattern, and a path with the parameters of its last segment.
URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
PATH = r"^((?:.*/)?[^/;]*)(?:;([^/]*))?$"


def _parts(url: Column) -> tuple[Column, ...]:
    scheme, authority, path, query = (F.regexp_extract(url, URI, k) for k in (1, 2, 3, 4))
    tail = F.regexp_extract(path, PATH, 2)
    bare = F.rtrim(F.regexp_extract(path, PATH, 1), F.lit("/"))
    return F.when(scheme == "", "http").otherwise(F.lower(scheme)), F.lower(authority), bare, tail, query


def _lead(authority: Column, path: Column) -> Column:
    """``//authority`` where there is one or the path is absolute."""
    return F.when((authority != "") | path.startswith("/"), F.concat(F.lit("//"), authority)).otherwise("")


def _rooted(authority: Column, path: Column) -> Column:
    return F.when((authority != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)


def normal_url(url: Column) -> Column:
    """Scheme (http by default), lower-case authority, path without trailing slashes, parameters and query; no fragment.  Null gives ``''``."""
    scheme, authority, path, params, query = _parts(url)
    full = _rooted(authority, F.concat(path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise("")))
    made = F.concat(scheme, F.lit(":"), _lead(authority, full), full, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(made)


def url_base(url: Column) -> Column:
    """Scheme, authority and path alone."""
    scheme, authority, path, _, _ = _parts(url)
    path = _rooted(authority, path)
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(scheme, F.lit(":"), _lead(authority, path), path))

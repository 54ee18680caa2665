"""URL allow and block rules with redirect equivalence, with DataFrame operations only.

A rule is ``host/path``.  It fits its host and all subdomains if the path of the URL starts with its own; the longest one that fits
decides.  URLs that no rule fits take the verdict of their aliases: redirects (``<meta http-equiv=refresh>`` and any given table) and
canonical links, all of a page and each resolved against its URL, are undirected edges between URLs (host, path and query; scheme and fragment do not count), connected
components over them are computed as tables, and a component with a blocked member is blocked.  An explicit allow rule comes
first: it is never overruled by an alias.  All else is allowed.

Rules may be a mapping or a table (``rule``, ``verdict``) of any size.  Up to ``CASE_RULES`` of them become one CASE expression; more are joined: every
distinct host and path gives the rules that would fit it (host suffixes with path beginnings of the lengths that rules have), an
equi-join finds those there are, and the longest is kept.  Both ways give the same rule.  Edges are looked for in all pages, but not in
comments, scripts and styles; only their ends are joined, and a run without edges joins nothing.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; null html has no links;
repeated rows give equal rows; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Rules of a mapping that become one expression; more, or a table of rules, are joined.
CASE_RULES = 200
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]+)?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)"
CANONICAL = r"(?is)<link\b[^>]*\srel\s*=\s*(?:canonical(?=[\s/>])|\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?')[^>]*>?"
HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[\"'\s][^>]*>"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"

#: Scheme, path and query of a link.
LINK = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*:)?([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def key(url: Column) -> Column:
    """What aliases are told apart by; null without ``://``."""
    return F.when(url.contains("://"), F.concat(F.lit("://"), host(url), path(url), F.regexp_extract(url, URL, 3)))


def matched(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule that fits, else null (ties: the first in alphabetical order)."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if found is None else found


def decision(rule: Column, rules: Mapping[str, str]) -> Column:
    blocks = [r for r, v in rules.items() if v == "block"]
    return F.when(rule.isNull(), None).when(rule.isin(blocks), "block").otherwise("allow")


def fitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and ``path`` of ``urls`` that a rule of a table fits, once each, with the longest such ``rule`` and its ``own`` verdict."""
    known = rules.groupBy("rule").agg(F.max("verdict").alias("own"))  # a rule that is given twice blocks if one of them does
    lengths = [r.n for r in known.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().collect()]  # as long as a path at most
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    begins = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    each = urls.select("host", "path").distinct().where("host <> '' AND path <> ''")
    asked = each.select("host", "path", F.explode(suffixes).alias("suffix"), begins.alias("begins")).select("host", "path", F.explode(F.transform("begins", lambda b: F.concat("suffix", b))).alias("rule"))
    best = asked.join(known, "rule").groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "own")).alias("best"))
    return best.select("host", "path", "best.rule", "best.own")


def decided(urls: DataFrame, rules: Mapping[str, str] | DataFrame, case_rules: int = CASE_RULES) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) with the ``rule`` that fits and its verdict ``own``, else nulls."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= case_rules:
            ruled = urls.withColumn("rule", matched(F.col("host"), F.col("path"), rules))
            return ruled.withColumn("own", decision(F.col("rule"), rules))
        rules = urls.sparkSession.createDataFrame(list(rules.items()), "rule string, verdict string")
    return urls.join(fitted(urls, rules), ["host", "path"], "left")


def resolved(path: Column) -> Column:
    """An absolute path without its dot segments."""
    parts = F.slice(F.split(path, "/"), 2, F.length(path) + 1)
    dots = F.element_at(parts, -1).isin(".", "..")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~path.rlike(r"/\.\.?(/|$)"), path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dots & (F.size(kept) > 0), "/").otherwise("")))


def _target(found: Column, base: Column) -> Column:
    """Key of a link's target, resolved against the URL of its page; null for schemes without a host and empty links."""
    link = F.replace(found, F.lit("&amp;"), F.lit("&"))
    own, rest = F.regexp_extract(link, LINK, 1), F.regexp_extract(link, LINK, 2)
    query = F.regexp_extract(link, LINK, 3)
    folder = F.regexp_extract(path(base), "(?s)^(.*/)", 1)
    start = F.when(folder == "", "/").otherwise(folder)
    local = F.when(rest.startswith("/"), resolved(rest)).when(rest != "", resolved(F.concat(start, rest))).otherwise(path(base))
    asked = F.when((rest == "") & (query == ""), F.regexp_extract(base, URL, 3)).when(query == "?", "").otherwise(query)
    full = F.concat(F.lit("://"), host(base), local, asked)
    return F.when(link == "", None).when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), key(link)).when(own != "", None).when(link.startswith("//"), key(F.concat(F.lit(":"), link))).otherwise(full)


def page_edges(pages: DataFrame) -> DataFrame:
    """``a`` and ``b``: keys of a page and of each of its canonical and redirect targets."""
    url, html = F.col("url"), F.col("html")
    found = lambda tag, at: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, at, 1))
    near = pages.where(html.rlike(r"(?i)canonical|http-equiv") & url.contains("://")).select("url", F.regexp_replace(html, UNSEEN, " ").alias("html"))
    links = near.select(url.alias("url"), F.explode(F.array_distinct(F.concat(found(CANONICAL, HREF), found(REFRESH, TARGET)))).alias("link"))
    return links.select(key(url).alias("a"), _target(F.col("link"), url).alias("b")).where("b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: Mapping[str, str] | DataFrame = RULES, redirects: DataFrame | None = None, case_rules: int = CASE_RULES) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` and ``verdict`` of every page; ``redirects`` may give more edges (``source``, ``target`` URLs)."""
    scratch = Scratch(pages.sparkSession, "urls")
    judged = decided(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules, case_rules)
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(key(F.col("source")).alias("a"), key(F.col("target")).alias("b")).where("a <> b"))
    edges = scratch.write(edges, "edges")
    columns = ["page_id", "url", "host", "path", "rule"]
    if edges.isEmpty():
        return judged.select(*columns, F.coalesce("own", F.lit("allow")).alias("verdict"))
    known = scratch.write(connected_components(edges, scratch, "aliases", local=False), "known")
    named = known.select("component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
    blocked = scratch.write(decided(named, rules, case_rules).where("own = 'block'").select("component").distinct(), "blocked")
    tainted = scratch.write(known.join(blocked, "component").select(F.col("node").alias("alias")), "tainted")
    out = judged.withColumn("alias", key(F.col("url"))).join(tainted.withColumn("hit", F.lit(True)), "alias", "left")
    return out.select(*columns, F.coalesce("own", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))

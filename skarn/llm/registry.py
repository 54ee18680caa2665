"""Queries of this package and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


#: Target shares; the other sources share the rest in proportion to their rows.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), WEIGHTS)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import cascade

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_filter_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter where every page is redirected to the first of its ten: components decide."""
    from pyspark.sql import functions as F

    from .url_filter import judge

    pages = _table(spark, sf_dir, "pages")
    ten = pages.select(F.floor(F.col("page_id") / 10).alias("ten"), "page_id", "url")
    first = ten.groupBy("ten").agg(F.min_by("url", "page_id").alias("target"))
    redirects = ten.join(first, "ten").select(F.col("url").alias("source"), "target")
    return judge(pages, redirects=redirects).select("page_id", "host", "path", "rule", "verdict")


def url_filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter where pages redirect in chains of eight, every third chain is a cycle, and canonical links in the pages join every fifth chain to the next."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from .url_filter import judge

    pages = _table(spark, sf_dir, "pages").withColumn("chain", F.floor(F.col("page_id") / 8))
    near = pages.select("page_id", "url", "chain").withColumn("target", F.lead("url").over(W.partitionBy("chain").orderBy("page_id")))  # eight rows each
    ends = pages.groupBy("chain").agg(F.max_by("url", "page_id").alias("source"), F.min_by("url", "page_id").alias("target"), F.min("page_id").alias("page_id"))
    redirects = near.select(F.col("url").alias("source"), "target").unionByName(ends.where("chain % 3 = 0").select("source", "target"))
    links = ends.select((F.col("chain") - 1).alias("from"), F.col("target").alias("href")).join(ends.where("chain % 5 = 1").select(F.col("chain").alias("from"), "page_id"), "from").select("page_id", "href")
    linked = pages.join(links, "page_id", "left")
    tag = F.concat(F.lit('<link rel="canonical" href="'), F.replace("href", F.lit("&"), F.lit("&amp;")), F.lit('">'))
    html = F.concat(F.coalesce(tag, F.lit("")), F.coalesce("html", F.lit("")))
    return judge(linked.select("page_id", "url", html.alias("html")), redirects=redirects.where("source IS NOT NULL AND target IS NOT NULL")).select("page_id", "host", "path", "rule", "verdict")


def boxed(pages: DataFrame) -> DataFrame:
    """``pages`` with a box at the end of the article of three in four: one of two for a host, a frequent and a rare one, under a class that no list names."""
    from pyspark.sql import functions as F

    box = F.concat(F.lit('<section class="zq"><p>Offer '), F.least(F.col("page_id") % 7, F.lit(1)).cast("string"), F.lit("</p><p>See <b>more</b></p></section></article>"))
    html = F.when(F.col("page_id") % 4 == 0, F.col("html")).otherwise(F.replace("html", F.lit("</article>"), box))
    return pages.withColumn("html", html)


def html_text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of the same pages with boxes: those that recur on a host are its templates, others stay."""
    from .html_text import extract

    return extract(boxed(_table(spark, sf_dir, "pages")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests, encode

    return digests(encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import rank

    return rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digests, scan

    return digests(scan(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_media_columns": op2_media_columns,
    "op3_minhash_near_dup": op3_minhash_near_dup,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "url_filter_redirects": url_filter_redirects,
    "url_filter_chains": url_filter_chains,
    "html_text_boxes": html_text_boxes,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_html_text": op8_html_text,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_secret_scan": op13_secret_scan,
}

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]+)?"
_HOST = "translate(coalesce(regexp_extract({0}, '" + _URL + "', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({0}, '" + _URL + "', 2), '')"
_RULE = """CASE WHEN (h = 'example.net' OR ends_with(h, '.example.net')) AND starts_with(p, '/en/') THEN 'example.net/en/'
  WHEN (h = 'example.com' OR ends_with(h, '.example.com')) AND starts_with(p, '/de/') THEN 'example.com/de/'
  WHEN (h = 'org' OR ends_with(h, '.org')) AND starts_with(p, '/fr/') THEN 'org/fr/'
  WHEN (h = 'net' OR ends_with(h, '.net')) AND starts_with(p, '/') THEN 'net/' END"""
_KEY = "CASE WHEN contains({0}, '://') THEN '://' || " + _HOST + " || " + _PATH + " || regexp_extract({0}, '" + _URL + "', 3) END"
_LINK = "CASE WHEN contains({0}, '://') THEN {0} WHEN starts_with({0}, '//') THEN ':' || {0} WHEN starts_with({0}, '/') THEN '://' || " + _HOST.format("url") + " || {0} END"

_ALIASES = f"""
WITH RECURSIVE l AS (SELECT page_id, url, {_HOST.format("url")} AS h, {_PATH.format("url")} AS p, {_KEY.format("url")} AS k,
  replace(regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical["''\\s/>][^>]*>?', 0), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), '&amp;', '&') AS can,
  replace(regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh["''\\s][^>]*>', 0), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1), '&amp;', '&') AS red FROM pages),
@EDGES,
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
ends AS (SELECT a, b, {_HOST.format("b")} AS h, {_PATH.format("b")} AS p FROM reach),
tainted AS (SELECT DISTINCT a FROM ends WHERE {_RULE} IN ('net/', 'example.com/de/')),
j AS (SELECT page_id, k, h, p, {_RULE} AS rule FROM l)
SELECT page_id, h AS host, p AS path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN tainted.a IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM j LEFT JOIN tainted ON j.k = tainted.a"""

_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
_ORDERS = (
    "SELECT " + " || ".join(f"l{i}.l" for i in range(5)) + " AS o, " + ", ".join(f"l{i}.b AS b{i}" for i in range(5)) + " FROM " + ", ".join(f"{_LETTERS} l{i}(l, b)" for i in range(5))
    + " WHERE " + " + ".join(f"l{i}.b" for i in range(5)) + " = 31 AND (" + " | ".join(f"l{i}.b" for i in range(5)) + ") = 31"
)

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
t AS (SELECT (count(*) FILTER (len(ts) > 0))::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p SEMI JOIN q USING (term) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, t GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term), t GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op11_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
y AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END) + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN y USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
o AS ({_ORDERS}),
s AS (SELECT o, step, CASE step WHEN 1 THEN b0 WHEN 2 THEN b1 WHEN 3 THEN b2 WHEN 4 THEN b3 ELSE b4 END AS own,
  CASE step WHEN 1 THEN 0 WHEN 2 THEN b0 WHEN 3 THEN b0 + b1 WHEN 4 THEN b0 + b1 + b2 ELSE b0 + b1 + b2 + b3 END AS earlier FROM o, range(1, 6) g(step)),
r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY part, o, step, own)
SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op1_source_mixing": """
WITH w(source, weight) AS (VALUES ('src0', 0.2::DOUBLE), ('src1', 0.1::DOUBLE), ('src2', 0.1::DOUBLE)),
k AS (SELECT s.source, s.n, weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) s LEFT JOIN w ON s.source = w.source),
t AS (SELECT sum(n) AS n_all, sum(weight) AS w_all, sum(n) FILTER (weight IS NULL) AS n_free FROM k),
r AS (SELECT source, CASE WHEN weight IS NULL THEN greatest(0, 1 - coalesce(w_all, 0)) * n_all / n_free ELSE weight * (CASE WHEN n_free IS NULL THEN 1 / w_all ELSE 1 END) * n_all / n END AS rate FROM k, t),
c AS (SELECT source, sum(exp(-rate) * pow(rate, i) / gamma(i + 1)) OVER (PARTITION BY source ORDER BY i) AS c FROM r, range(0, 161) g(i)),
l AS (SELECT source, list(c) AS cdf FROM c GROUP BY source),
d AS (SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS nm FROM documents d),
u AS (SELECT d.*, ('0x' || substr(md5('count17|0|' || nm), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS x FROM d),
n AS (SELECT u.*, len(list_filter(cdf, lambda v: v <= x)) AS copies FROM u JOIN l ON u.source IS NOT DISTINCT FROM l.source),
e AS (SELECT *, unnest(range(copies)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copies::INTEGER AS copies, copy::INTEGER AS copy, ('0x' || substr(md5('place17|' || copy || '|' || nm), 1, 15))::BIGINT AS place FROM e""",
    "op6_url_filter": _ALIASES.replace("@EDGES", f"""t AS (SELECT k AS a, {_LINK.format("can")} AS b FROM l UNION SELECT k, {_LINK.format("red")} FROM l),
e AS (SELECT a, {_KEY.format("b")} AS b FROM t WHERE a IS NOT NULL AND b IS NOT NULL)"""),
    "url_filter_redirects": _ALIASES.replace("@EDGES", f"""t AS (SELECT k AS a, arg_min(url, page_id) OVER (PARTITION BY page_id // 10) AS b FROM l),
e AS (SELECT DISTINCT a, {_KEY.format("b")} AS b FROM t WHERE a IS NOT NULL AND b IS NOT NULL)"""),
    "url_filter_chains": _ALIASES.replace("@EDGES", f"""n AS (SELECT page_id // 8 AS c, arg_max(k, page_id) AS k_last, arg_min(k, page_id) AS k_first, arg_min(url, page_id) AS u_first FROM l GROUP BY 1),
t AS (SELECT k AS a, lead(url) OVER (PARTITION BY page_id // 8 ORDER BY page_id) AS b FROM l UNION SELECT k_last, u_first FROM n WHERE c % 3 = 0 UNION SELECT x.k_first, y.u_first FROM n x JOIN n y ON y.c = x.c + 1 WHERE x.c % 5 = 1),
e AS (SELECT DISTINCT a, {_KEY.format("b")} AS b FROM t WHERE a IS NOT NULL AND b IS NOT NULL)"""),
    "op4_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
s AS (SELECT *, CASE WHEN i + 4 <= n THEN array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') END AS k FROM w),
r AS (SELECT doc_id, i, k IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k) > 1 AS again FROM s),
c AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM r),
g AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM c GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(g.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals FROM d LEFT JOIN g USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_capitals > 50 * word_chars OR word_chars > 20 * n_words) AS kept
FROM b""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
s AS (SELECT *, CASE WHEN i + 19 <= n THEN array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ' ') END AS k FROM w),
r AS (SELECT doc_id, word, i, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT doc_id, word, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
}

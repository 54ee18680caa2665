"""Crawling a photo API: pages, their photos, downloads, and new rows of the raw stage.

Progress lives in tables, in the same commit as what was read, so a crawl that stops anywhere goes on from there:
``crawl_pages`` has every page that was read (and with it the next one of each keyword), ``crawl_attempts`` every photo that was tried.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import stated_size
from ..functions.scalar import MIN_SIDE, big_enough_to_crawl, described, large_url, padded_name
from ..operators.cleaning import first_of_each, not_yet
from ..operators.integration import next_ids
from ..sources.catalog import Store
from ..sources.sinks import append, insert_if_absent, put_objects
from ..sources.staging import Staging
from ..sources.web import PhotoApi, fetched

PAGES, ATTEMPTS, RAW = "crawl_pages", "crawl_attempts", "images_raw"
#: What is read of a photo of each API: sizes of the image, and its text.
PHOTO = {
    "pexels": "id string, width int, height int, alt string, src struct<large:string,large2x:string,original:string>",
    "unsplash": "id string, width int, height int, description string, urls struct<raw:string,full:string,regular:string>",
}


def photo_rows(pages: DataFrame, kind: str) -> DataFrame:
    """The photos of API pages (``keyword``, ``page``, ``photos``), one row each: keyword, page, place, url, description, width and height."""
    each = pages.select("keyword", "page", F.posexplode("photos").alias("place", "payload"))
    photo = F.from_json("payload", PHOTO[kind])
    rows = each.select("keyword", "page", "place", photo.alias("p"))
    sizes, text = (F.col("p.src"), F.col("p.alt")) if kind == "pexels" else (F.col("p.urls"), F.col("p.description"))
    number = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0)).alias(c)
    return rows.select("keyword", "page", "place", large_url(kind, sizes).alias("url"), described(kind, text, F.col("keyword")).alias("description"), number("width"), number("height"))


def progress(store: Store, kind: str) -> dict[str, tuple[int, int]]:
    """Next page and photos so far, by keyword (one row each)."""
    if not store.exists(PAGES):
        return {}
    rows = store.read(PAGES).where(F.col("source") == kind).groupBy("keyword").agg(F.max("page").alias("page"), F.sum("n").alias("n"))
    return {r.keyword: (r.page + 1, r.n) for r in rows.collect()}


def crawl_pages(store: Store, kind: str, options: dict[str, str], keywords: list[str], target: int, pages_at_once: int = 5, now: Column | None = None) -> int:
    """Reads pages of all keywords, ``pages_at_once`` of each and round by round, until ``target`` photos are known or there are no more; the photos known.

    A round is one commit of the pages that have photos; none of them is asked for again.  At an empty page, or one with an error status, a keyword rests until the
    next crawl, which asks for that page first.
    """
    spark = store.spark
    spark.dataSource.register(PhotoApi)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if now is None else now
    resting: set[str] = set()
    while True:
        at = progress(store, kind)
        known = sum(n for _, n in at.values())
        left = [k for k in keywords if k not in resting]
        if known >= target or not left:
            return known
        start = {k: at[k][0] if k in at else 1 for k in left}
        reader = spark.read.format("photo_api").options(**options).options(kind=kind, keywords=json.dumps(left), start=json.dumps(start), pages=str(pages_at_once))
        with Staging(spark, "pages") as staging:
            got = staging.write(reader.load(), "pages")
            resting |= {r.keyword for r in got.where("n = 0").select("keyword").distinct().collect()}
            fresh = got.where("n > 0").withColumns({"source": F.lit(kind), "crawled_at": now})
            if store.exists(PAGES):
                fresh = not_yet(fresh, store.read(PAGES), "source", "keyword", "page")
            if not fresh.isEmpty():
                append(store, PAGES, fresh)


def pending(store: Store, kind: str, again: bool = False) -> DataFrame:
    """Photos of the pages read so far that are neither stored nor tried (or, with ``again``, were tried in vain); the first of each address."""
    rows = photo_rows(store.read(PAGES).where(F.col("source") == kind), kind).where("url IS NOT NULL AND url <> ''").withColumn("source", F.lit(kind))
    if store.exists(RAW):
        rows = not_yet(rows, store.table(RAW).candidates(rows), "url", "source")
    if store.exists(ATTEMPTS):
        tried = store.read(ATTEMPTS)
        rows = not_yet(rows, tried.where("outcome = 'stored'") if again else tried, "url", "source")
    return first_of_each(rows, ["url", "source"], ["keyword", "page", "place"])


def store_photos(store: Store, kind: str, again: bool = False, **how) -> dict[str, int]:
    """Downloads pending photos and stores those that are large enough: object, then row; counts by outcome.

    A photo gets the next number of its source, in the order of keyword, page and place.  What is downloaded is staged, so it is downloaded once; if the
    job stops in between, the next one starts with the photos that have no row.  ``how`` goes to ``fetched``.
    """
    with Staging(store.spark, "photos") as staging:
        wanted = staging.write(pending(store, kind, again), "wanted")
        got = staging.write(fetched(wanted.drop("width", "height"), **how).withColumn("size", stated_size()("content")), "got")
        outcome = F.when(F.col("content").isNull(), "failed").when(F.col("size.width").isNull(), "no_image").when(~big_enough_to_crawl(F.col("size.width"), F.col("size.height"), MIN_SIDE), "too_small").otherwise("stored")
        got = got.withColumn("outcome", outcome)
        good = got.where("outcome = 'stored'")
        own = store.read(RAW).where(F.col("source") == kind) if store.exists(RAW) else store.spark.createDataFrame([], "filename string")
        used = own.select(F.regexp_extract("filename", r"_(\d+)\.[^.]*$", 1).try_cast("long").alias("number"))
        named = next_ids(good.select("url", "keyword", "page", "place"), used, "number", "keyword", "page", "place")
        named = named.select("url", padded_name(f"{kind}_", F.col("id")).alias("filename")).withColumn("object_name", F.concat(F.lit("raw/images/"), "filename"))
        named = staging.write(named, "named")
        sent = staging.write(put_objects(good.join(named, "url").select(F.col("object_name").alias("key"), "content"), store.root), "sent")
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        sizes = got.select("url", F.col("size.width").alias("width"), F.col("size.height").alias("height"))
        rows = named.join(sent.where("ok").select(F.col("key").alias("object_name")), "object_name").join(wanted.drop("width", "height"), "url").join(sizes, "url")
        rows = rows.select("filename", "object_name", "source", "url", "description", "keyword", "width", "height", stamp.alias("crawled_at"))
        insert_if_absent(store, RAW, rows, "url", "source")
        tries = got.select("url", "source", "outcome", "status", "attempts").withColumn("tried_at", stamp)
        append(store, ATTEMPTS, tries)
        found = {r.outcome: r["count"] for r in tries.groupBy("outcome").count().collect()}
    return {o: found.get(o, 0) for o in ("stored", "failed", "no_image", "too_small")}


def crawl(store: Store, kind: str, options: dict[str, str], keywords: list[str], target: int, pages_at_once: int = 5, **how) -> dict[str, int]:
    """Pages, then photos; also goes on with a crawl that stopped."""
    crawl_pages(store, kind, options, keywords, target, pages_at_once)
    return store_photos(store, kind, **how) if store.exists(PAGES) else dict.fromkeys(("stored", "failed", "no_image", "too_small"), 0)

"""Paged photo APIs as a data source, and concurrent downloads as an operator.

Requests are made in tasks, with Python's own HTTP client; the driver only plans.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode, urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Names of the photos and of the total in a page, for the APIs that are known.
FIELDS = {"pexels": ("photos", "total_results"), "unsplash": ("results", "total")}
PAGE_SCHEMA = "keyword string, page int, status int, total long, n int, photos array<string>"
#: Status of a request that got no answer.
NO_ANSWER = 0
TOO_MANY = 429


def request(url: str, headers: dict[str, str] | None = None, timeout: float = 20.0) -> tuple[int, bytes]:
    """Status and body of a GET; an error status has no body, and ``NO_ANSWER`` stands for a connection that failed."""
    try:
        with urlopen(Request(url, headers=headers or {}), timeout=timeout) as r:  # noqa: S310
            return r.status, r.read()
    except HTTPError as e:
        return e.code, b""
    except (URLError, OSError, ValueError):
        return NO_ANSWER, b""


class Api:
    """Options of a paged search API (all are texts, as options of a reader are)."""

    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.url, self.items, self.total = o["url"], *FIELDS[o.get("kind", "pexels")]
        self.keywords: list[str] = json.loads(o["keywords"])
        self.per_page, self.most = int(o.get("per_page", 80)), int(o.get("pages", 1 << 30))
        self.start: dict[str, int] = json.loads(o.get("start", "{}"))
        self.headers, self.params = json.loads(o.get("headers", "{}")), json.loads(o.get("params", "{}"))
        self.tries, self.backoff = int(o.get("tries", 3)), float(o.get("backoff", 1.0))
        self.wait, self.delay, self.timeout = float(o.get("wait", 60)), float(o.get("delay", 1.0)), float(o.get("timeout", 15))
        self.chunk = int(o.get("pages_per_task", 5))

    def page(self, keyword: str, page: int, per_page: int | None = None) -> tuple[int, int, list[str]]:
        """Status, total and photos (as JSON) of one page.

        Where the API says that there are too many requests it is asked again after ``wait`` seconds; a missing answer is tried again with a growing pause.
        """
        query = urlencode({"query": keyword, "page": page, "per_page": per_page or self.per_page, **self.params})
        pause, failed = self.backoff, 0
        while True:
            status, body = request(f"{self.url}?{query}", self.headers, self.timeout)
            if status == TOO_MANY:
                time.sleep(self.wait)
                continue
            if status != NO_ANSWER:
                break
            failed += 1
            if failed >= self.tries:
                return NO_ANSWER, 0, []
            time.sleep(pause)
            pause *= 2
        if status != 200:
            return status, 0, []
        data = json.loads(body)
        return status, int(data.get(self.total) or 0), [json.dumps(p, sort_keys=True) for p in data.get(self.items) or []]


class _Batch(DataSourceReader):
    """One partition for each keyword, read page by page up to the first that is empty or fails, or up to ``pages`` of them."""

    def __init__(self, api: Api):
        self.api = api

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.api.keywords] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        keyword = partition.value
        if keyword is None:
            return
        first = self.api.start.get(keyword, 1)
        for page in range(first, first + self.api.most):
            status, total, photos = self.api.page(keyword, page)
            yield keyword, page, status, total, len(photos), photos
            if not photos:
                return
            time.sleep(self.api.delay)


class _Stream(DataSourceStreamReader):
    """Offsets are the next page of each keyword.

    The end is what the API's totals say now, so it doesn't depend on what this process has seen: after a restart Spark goes on from the
    offsets in its checkpoint.  A page that fails fails its task, so no page is passed over.
    """

    def __init__(self, api: Api):
        self.api = api

    def initialOffset(self) -> dict:  # noqa: N802
        return {k: self.api.start.get(k, 1) for k in self.api.keywords}

    def latestOffset(self) -> dict:  # noqa: N802
        end = {}
        for k in self.api.keywords:
            _, total, _ = self.api.page(k, 1, per_page=1)
            end[k] = max(self.api.start.get(k, 1), min(self.api.most, -(-total // self.api.per_page)) + 1)
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = self.api.chunk
        return [InputPartition((k, p, min(p + step, end[k]))) for k in self.api.keywords for p in range(start.get(k, 1), end[k], step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        keyword, first, stop = partition.value
        for page in range(first, stop):
            status, total, photos = self.api.page(keyword, page)
            if status != 200:
                raise OSError(f"{keyword}, page {page}: status {status}")
            yield keyword, page, status, total, len(photos), photos
            time.sleep(self.api.delay)

    def commit(self, end: dict) -> None:
        pass


class PhotoApi(DataSource):
    """``photo_api``: a row for each page of a search API, with its photos as JSON.

    Options: ``url``, ``keywords`` (JSON list), ``kind`` (a key of ``FIELDS``), ``per_page``, ``pages`` (most pages of a keyword), ``start`` (JSON: next page of
    keywords), ``headers`` and ``params`` (JSON), ``tries``, ``backoff``, ``wait`` (after 429), ``delay`` (between pages), ``timeout``.
    """

    @classmethod
    def name(cls) -> str:
        return "photo_api"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(Api(dict(self.options)))

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(Api(dict(self.options)))


FETCHED = (("content", "binary"), ("status", "int"), ("attempts", "int"))
#: Bytes of content that a task gathers before it passes them on.
PIECE = 16 << 20


def fetched(rows: DataFrame, url: str = "url", tries: int = 3, backoff: float = 1.0, growth: float = 2.0, concurrency: int = 8, per_host: float | None = None, hosts_at_once: int = 1, timeout: float = 20.0, headers: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``content`` (null if it failed), ``status`` of the last try and ``attempts``.

    A try succeeds with status 200 and a body.  Each task keeps ``concurrency`` downloads going, in the order of its rows, and holds the bodies of these and of one
    piece.  With ``per_host`` (requests a second) rows are dealt by host, each host to ``hosts_at_once`` tasks that share its rate, so the limit
    holds for the whole job; without it rows stay where they are.  Null addresses are not tried (0 attempts).  Columns that are replaced are those named as above.
    """
    own = [c for c in rows.columns if c not in {n for n, _ in FETCHED}]
    kept = rows.select(*own)
    if per_host:
        host = F.lower(F.regexp_extract(F.col(url), "^[^:/]+://([^/?#]*)", 1))
        kept = kept.repartition(host, F.pmod(F.xxhash64(url), F.lit(hosts_at_once)))
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in FETCHED)).fields])  # noqa: SLF001
    gap = hosts_at_once / per_host if per_host else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_at: dict[str, float] = {}
        turn = Lock()

        def slot(address: str) -> None:
            """Waits for the host's turn; turns are given out one after the other."""
            if gap:
                host = urlsplit(address).netloc.lower()
                with turn:
                    now = time.monotonic()
                    at = next_at[host] = max(now, next_at.get(host, now - gap) + gap)
                time.sleep(at - now)

        def fetch(address: str | None) -> tuple[bytes | None, int, int]:
            if address is None:
                return None, NO_ANSWER, 0
            pause, status = backoff, NO_ANSWER
            for k in range(1, tries + 1):
                slot(address)
                status, body = request(address, headers, timeout)
                if status == 200 and body:
                    return body, status, k
                if k < tries:
                    time.sleep(pause)
                    pause *= growth
            return None, status, tries

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                addresses = batch.column(url).to_pylist()
                ahead = [pool.submit(fetch, a) for a in addresses[:concurrency]]
                done: list[tuple[bytes | None, int, int]] = []
                lo = size = 0
                for i in range(len(addresses)):
                    done.append(ahead[i].result())
                    ahead[i] = None
                    if i + concurrency < len(addresses):
                        ahead.append(pool.submit(fetch, addresses[i + concurrency]))
                    size += len(done[-1][0] or b"")
                    if size >= PIECE or i + 1 == len(addresses):
                        content, status, attempts = zip(*done, strict=True)
                        part = batch.slice(lo, i + 1 - lo)
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary()), pa.array(status, pa.int32()), pa.array(attempts, pa.int32())], [*part.schema.names, *[n for n, _ in FETCHED]])
                        lo, size, done = i + 1, 0, []

    return kept.mapInArrow(run, schema)

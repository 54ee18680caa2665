import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions.images import encode_png, image_size
from skarn.plans import crawling
from skarn.sources.catalog import Store
from skarn.sources.web import PhotoApi, fetched
from tests.test_functions import picture


class Site:
    """A photo API on this machine: ``photos`` of each keyword, pages by ``per_page``; it counts what it is asked."""

    def __init__(self):
        self.photos: dict[str, list[dict]] = {}
        self.pages, self.images = Counter(), Counter()
        self.busy: Counter = Counter()  # pages that answer 429 so many times
        self.broken: set = set()  # pages that answer 500
        self.fails: dict[str, int] = {}  # images that fail so many times
        self.big, self.small = encode_png(picture(3, 210, 230)), encode_png(np.zeros((20, 30, 3), np.uint8))
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                at = urlsplit(self.path)
                if at.path == "/search":
                    q = {k: v[0] for k, v in parse_qs(at.query).items()}
                    key = q["query"], int(q["page"])
                    n = int(q["per_page"])
                    if n > 1:
                        site.pages[key] += 1
                    if site.busy[key] > 0:
                        site.busy[key] -= 1
                        return self.answer(429)
                    if key in site.broken:
                        return self.answer(500)
                    every = site.photos.get(key[0], [])
                    some = every[(key[1] - 1) * n : key[1] * n]
                    return self.answer(200, json.dumps({"total_results": len(every), "total": len(every), "photos": some, "results": some}).encode())
                site.images[at.path] += 1
                if site.fails.get(at.path, 0) >= site.images[at.path]:
                    if "drop" in at.path:
                        return self.connection.close()
                    return self.answer(200 if "empty" in at.path else 503)
                return self.answer(200, b"text" if "text" in at.path else site.small if "small" in at.path else site.big)

            def answer(self, status, body=b""):
                self.send_response(status)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def fill(self, keyword, n, first=0, name="img"):
        for i in range(first, first + n):
            self.photos.setdefault(keyword, []).append({"id": i, "width": 9, "alt": None if i % 2 else f"text {i}", "src": {"large": f"{self.url}/{keyword}/{name}{i}", "original": "x"}})


@pytest.fixture
def site():
    s = Site()
    yield s
    s.server.shutdown()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def options(site, **more):
    return {"url": f"{site.url}/search", "per_page": "4", "delay": "0", "wait": "0.01", "backoff": "0.01", "headers": json.dumps({"Authorization": "key"})} | {k: str(v) for k, v in more.items()}


def test_pages_end_at_the_empty_one(spark, site):
    site.fill("sea", 10)
    site.fill("snow", 4)
    site.busy["sea", 2] = 3
    site.broken.add(("lake", 1))
    spark.dataSource.register(PhotoApi)
    read = spark.read.format("photo_api").options(**options(site, keywords=json.dumps(["sea", "snow", "lake", "none"]))).load
    got = {(r.keyword, r.page): (r.status, r.total, r.n, len(r.photos)) for r in read().collect()}
    assert got == {
        ("sea", 1): (200, 10, 4, 4), ("sea", 2): (200, 10, 4, 4), ("sea", 3): (200, 10, 2, 2), ("sea", 4): (200, 10, 0, 0), ("snow", 1): (200, 4, 4, 4), ("snow", 2): (200, 4, 0, 0),
        ("lake", 1): (500, 0, 0, 0), ("none", 1): (200, 0, 0, 0),
    }
    assert site.pages["sea", 2] == 4 and site.pages["sea", 5] == 0
    some = spark.read.format("photo_api").options(**options(site, keywords='["sea"]', start='{"sea": 2}', pages=1)).load()
    assert [(r.keyword, r.page) for r in some.collect()] == [("sea", 2)]


def test_crawl_stops_fails_and_goes_on(store, site):
    """No page that was read is asked for again after a restart, failures are counted, and nothing is stored twice."""
    site.fill("sea", 10)
    site.fill("snow", 9)
    site.broken.add(("snow", 3))
    done = crawling.crawl_pages(store, "pexels", options(site), ["sea", "snow"], 100, pages_at_once=2)
    assert done == 18 and crawling.progress(store, "pexels") == {"sea": (4, 10), "snow": (3, 8)}
    before = site.pages.copy()
    assert max(n for k, n in before.items()) == 1
    site.broken.clear()
    assert crawling.crawl_pages(store, "pexels", options(site), ["sea", "snow"], 100) == 19
    asked = site.pages - before
    assert asked == {("sea", 4): 1, ("snow", 3): 1, ("snow", 4): 1}  # the end of each keyword, and the page that failed
    pages = store.read("crawl_pages")
    assert pages.groupBy("source", "keyword", "page").count().where("count > 1").isEmpty()
    site.fill("sea", 3, 10)  # new photos appear behind the last page
    site.photos["sea"].append(site.photos["sea"][0])
    assert crawling.crawl_pages(store, "pexels", options(site), ["sea", "snow"], 100) == 21


def test_target_ends_the_crawl(store, site):
    site.fill("sea", 40)
    assert crawling.crawl_pages(store, "pexels", options(site), ["sea"], 10, pages_at_once=1) == 12
    assert sum(site.pages.values()) == 3


def test_photos_are_stored_once(store, site):
    site.fill("sea", 6)
    site.fill("sea", 2, 6, "small")
    site.fill("sea", 1, 8, "text")
    site.fill("snow", 3, 0, "drop")
    site.photos["snow"] += [site.photos["sea"][2], {"id": 99, "src": {"large": ""}}]
    site.fails = {"/sea/img1": 2, "/sea/img2": 3, "/snow/drop0": 1, "/snow/drop1": 9}
    how = {"tries": 3, "backoff": 0.01}
    got = crawling.crawl(store, "pexels", options(site), ["sea", "snow"], 100, **how)
    assert got == {"stored": 7, "failed": 2, "no_image": 1, "too_small": 2}
    assert {k: n for k, n in site.images.items() if n > 1} == {"/sea/img1": 3, "/sea/img2": 3, "/snow/drop0": 2, "/snow/drop1": 3}
    tried = {r.url.removeprefix(site.url): (r.outcome, r.status, r.attempts) for r in store.read("crawl_attempts").collect()}
    assert tried["/sea/img1"] == ("stored", 200, 3) and tried["/sea/img2"] == ("failed", 503, 3) and tried["/snow/drop1"] == ("failed", 0, 3)
    rows = store.stage("raw").orderBy("filename").collect()
    assert [r.filename for r in rows] == [f"pexels_{i:06d}.jpg" for i in range(1, 8)]
    assert [r.url.removeprefix(site.url) for r in rows] == ["/sea/img0", "/sea/img1", "/sea/img3", "/sea/img4", "/sea/img5", "/snow/drop0", "/snow/drop2"]
    assert rows[0].description == "text 0" and rows[1].description == "sea" and (rows[0].width, rows[0].height) == (230, 210)
    with open(f"{store.root}/{rows[0].object_name}", "rb") as f:
        assert f.read() == site.big
    before = site.images.copy()
    assert set(crawling.crawl(store, "pexels", options(site), ["sea", "snow"], 100, **how).values()) == {0}
    assert site.images == before
    again = crawling.store_photos(store, "pexels", again=True, **how)
    assert again == {"stored": 1, "failed": 1, "no_image": 1, "too_small": 2}
    assert store.stage("raw").orderBy(F.desc("filename")).first().url == f"{site.url}/sea/img2" and store.stage("raw").count() == 8


def test_stream_goes_on_after_a_restart(spark, site, tmp_path):
    site.fill("sea", 9)
    spark.dataSource.register(PhotoApi)

    def run():
        stream = spark.readStream.format("photo_api").options(**options(site, keywords='["sea", "snow"]', pages_per_task=2)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.keyword, r.page, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("sea", 1, 4), ("sea", 2, 4), ("sea", 3, 1)]
    site.fill("snow", 6)
    site.fill("sea", 4, 9)
    assert run() == [("sea", 1, 4), ("sea", 2, 4), ("sea", 3, 1), ("sea", 4, 1), ("snow", 1, 4), ("snow", 2, 2)]
    assert max(site.pages.values()) == 1


def test_downloads_keep_rows_and_rates(spark, site):
    import time

    rows = [(i, f"{site.url}/a/{i}", "own") for i in range(8)] + [(8, None, "own"), (9, "http://127.0.0.1:1/x", "own"), (10, "no address", "own")]
    df = spark.createDataFrame(rows, "k int, url string, content string").repartition(3)
    site.fails = {"/a/3": 1, "/a/4": 9, "/a/empty": 9}
    got = {r.k: r for r in fetched(df, backoff=0.01, concurrency=3).collect()}
    assert sorted(got) == list(range(11)) and {k: r.attempts for k, r in got.items() if r.attempts != 1} == {3: 2, 4: 3, 8: 0, 9: 3, 10: 3}
    assert all((r.content is None) == (k in (4, 8, 9, 10)) for k, r in got.items())
    began = time.monotonic()
    assert fetched(df.where("k < 8"), tries=1, per_host=10.0).where("status > 0").count() == 8
    assert time.monotonic() - began > 0.7


def test_sizes_by_header():
    assert image_size(encode_png(np.zeros((4, 7, 3), np.uint8))) == (7, 4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03x\xff\xc2\x00\x11\x08\x01\x02\x03\x04"
    assert image_size(jpeg) == (0x304, 0x102) and image_size(jpeg[:-2]) is None
    assert image_size(b"GIF89a\x05\x00\x06\x00") == (5, 6) and image_size(b"") is None and image_size(b"text") is None
    assert image_size(b"BM" + b"\x00" * 16 + (8).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True)) == (8, 9)

from datetime import datetime
from urllib.parse import urlparse, urlunparse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.functions import images as im
from skarn.functions import scalar as S
from skarn.functions import vectors as V
from skarn.functions.urls import normal_url, url_base


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_labels(spark):
    rows = [("Sea", None), ("", "Forest "), (None, None), (" \t", "x"), (None, "")]
    assert values(spark, "a string, b string", rows, S.normal_label(F.col("a"), F.col("b"))) == [("sea",), ("forest",), ("unknown",), ("",), ("unknown",)]


def test_to_int(spark):
    rows = [("640", None), ("640.5", None), ("", "7"), (None, None), ("0", "9"), ("x", "9"), (" 12 ", None)]
    assert values(spark, "a string, b string", rows, S.to_int(F.col("a"), F.col("b"))) == [(640,), (0,), (7,), (0,), (9,), (0,), (12,)]
    assert values(spark, "a double", [(640.9,), (-3.7,), (None,), (float("nan"),)], S.number_to_int(F.col("a"))) == [(640,), (-3,), (0,), (0,)]


def test_times(spark):
    rows = [("2024-01-02T03:04:05.5",), ("2024-01-02 03:04:05",), ("2024-01-02",), ("soon",), (None,)]
    found = [r[0] for r in values(spark, "a string", rows, S.parsed_time(F.col("a")))]
    assert found == [datetime(2024, 1, 2, 3, 4, 5, 500000), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), None, None]


def test_names_and_ids(spark):
    rows = [("pexels_000012.jpg",), ("a.b.png",), (".hidden",), ("plain",)]
    assert values(spark, "a string", rows, S.stem(F.col("a")), S.id_in_name(F.col("a"), F.lit(5))) == [("pexels_000012", 12), ("a.b", 5), (".hidden", 5), ("plain", 5)]


def test_reject_category_and_null(spark):
    rows = [("download_failed",), ("too_small_10x9",), (None,), ("duplicate_phash_of_small.jpg",)]
    assert values(spark, "a string", rows, S.reject_category(F.col("a"))) == [("corrupt",), ("too_small",), ("other",), ("too_small",)]


def test_image_tags(spark):
    html = '<img src="a.jpg"><IMG src=b.gif><img width="50" height="200" src="c.png"><img width=100 height=100 src=\'d.png\'><img alt="x">'
    assert values(spark, "a string", [(html,)], S.image_sources(F.col("a"))) == [(["a.jpg", "d.png"],)]


def test_inline_bytes(spark):
    rows = [("data:image/png;base64,aGk=",), ("data:image/png;base64,***",), ("http://x",), (None,)]
    assert [r[0] and bytes(r[0]) for r in values(spark, "a string", rows, S.inline_bytes(F.col("a")))] == [b"hi", None, None, None]


def expected_url(url):
    if not url:
        return "", ""
    p = urlparse(url)
    path = p.path.rstrip("/")
    full = urlunparse((p.scheme or "http", p.netloc.lower(), path, p.params, p.query, ""))
    return full, f"{p.scheme or 'http'}://{p.netloc.lower()}{path}"


def test_urls_equal_urllib(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(800):
        scheme, host = rng.choice(["http://", "HTTPS://", "ftp://"]), rng.choice(["A.com", "b.Org:80", "x"])
        path = "".join(rng.choice(["/", "a", "/b", ";p", "/c/", "//"]) for _ in range(rng.integers(0, 5)))
        if path and not path.startswith(("/", ";")):
            path = "/" + path
        rows.append((scheme + host + path + rng.choice(["", "?q=1", "?"]) + rng.choice(["", "#f"]),))
    rows = sorted(set(rows))
    for (url,), (norm, base) in zip(rows, values(spark, "a string", rows, normal_url(F.col("a")), url_base(F.col("a"))), strict=True):
        want = expected_url(url)
        assert norm == want[0], url
        assert base == want[1], url
    again = values(spark, "a string", [(expected_url(u)[0],) for (u,) in rows], normal_url(F.col("a")))
    assert [a[0] for a in again] == [expected_url(expected_url(u)[0])[0] for (u,) in rows]


def test_urls_without_value(spark):
    assert values(spark, "a string", [(None,), ("",)], normal_url(F.col("a")), url_base(F.col("a"))) == [("", ""), ("", "")]


def test_vectors(spark):
    rows = [([1.0, 2.0, 3.0],), ([5.0, 5.0, 5.0],), ([0.0, 0.0, 0.0],)]
    z = [r[0] for r in values(spark, "v array<double>", rows, V.row_zscore(F.col("v")))]
    assert z[0] == pytest.approx([-1.2247449, 0, 1.2247449]) and z[1] == [0, 0, 0]
    unit = [r[0] for r in values(spark, "v array<double>", rows, V.row_l2(F.col("v")))]
    assert np.linalg.norm(unit[0]) == pytest.approx(1) and unit[2] == [0, 0, 0]
    assert values(spark, "a string", [("ffffffffffffffff",), ("bad",)], V.hash_bits(F.col("a"))) == [(-1,), (None,)]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**31))
def test_png_round_trip(h, w, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)
    assert (im.decode_png(im.encode_png(image)) == image).all()


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    flat, n, rows = image.reshape(5, 21).astype(int), 3, b""
    for y in range(5):
        left = np.concatenate([np.zeros(n, int), flat[y, :-n]])
        up = flat[y - 1] if y else np.zeros(21, int)
        corner = np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - corner
        d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, up, corner])
        guess = [np.zeros(21, int), left, up, (left + up) // 2, paeth][y]
        rows += bytes([y]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = im.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (im.decode_png(data) == image).all()
    assert im.decode_png(data[:40]) is None and im.decode_png(b"GIF89a") is None


def picture(seed=0, h=240, w=320):
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(seed)
    a, b, c = rng.uniform(0.5, 3, 3)
    return np.stack([127 + 120 * np.sin(a * x / 40 + b), 127 + 120 * np.cos(b * y / 30), 127 + 120 * np.sin(c * (x + y) / 50)], 2).astype(np.uint8)


def test_image_measures():
    flat = np.full((200, 300, 3), 90, np.uint8)
    assert im.gray_std(flat) == 0 and im.gray_std(picture()) > 8
    assert im.norm_stats(flat)["norm_brightness"] == 90 and im.norm_stats(flat)["norm_std_r"] == 0


def test_letterbox_pads_the_short_side():
    out = im.letterbox(np.zeros((100, 200, 3), np.uint8), 64)
    assert out.shape == (64, 64, 3) and (out[:16] == 114).all() and (out[16:48] == 0).all() and (out[48:] == 114).all()


def test_phash_distances():
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    one, other = picture(1), picture(2)
    near = one.copy()
    near[10, 10] = 255
    assert im.phash(one) == im.phash(one) and far(im.phash(one), im.phash(near)) <= 2 < far(im.phash(one), im.phash(other))


def test_augment_is_seeded_and_keeps_size():
    image = picture()
    outs = [im.augment(image, f"f{i}") for i in range(8)]
    assert all(o.shape == image.shape for o in outs)
    assert (im.augment(image, "f1") == outs[1]).all() and len({o.tobytes() for o in outs}) > 4


def test_standard_and_tensor():
    out = im.standard(picture(), 160)
    assert out.shape == (160, 160, 3)
    assert im.tensor(out).shape == (3, 160, 160)


def test_image_tags_equal_html_parser(spark):
    """Pages put together at random from tags, comments, scripts, quotes, marks and character references."""
    import random
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            if tag == "img":
                first = {}
                for k, v in attrs:
                    first.setdefault(k, v)
                size = lambda n: (lambda m: int(m[0]) if m else None)(__import__("re").match(r"\s*(\d+)", first.get(n) or ""))
                src, w, h = (first.get("src") or "").strip(), size("width"), size("height")
                if src and ".gif" not in src.lower() and not src.lower().startswith("data:image/gif") and (w is None or h is None or (w >= 100 and h >= 100)):
                    self.found.append(src)

    pieces = [
        "<img src=a.jpg>", "<IMG SRC='b > c.png' alt=x>", '<img alt="src=\'no\'" src="d&amp;e.png?a=1&b=2">', "<img width=90 height=200 src=f.jpg>", "<img width='150' height=120 src = g.jpg />", "<img src=h.gif>", "<img src='' data-src=no>",
        "<img src=i.jpg src=j.jpg>", "<img/src=k.jpg>", "<image src=no>", "<p title=don't>", "<!-- <img src=no> -->", "<!-- > <img src=no>-->", "<script>if (a < b) '<img src=no>'</script>", "<style>a{b:'<img src=no>'}</style>", "text & &lt;img src=no&gt;", "<a href='x>y'>",
        "<br/>", "</p>", "<img\nsrc=l&#233;.jpg\n>", "<img alt src=m.jpg>", "<img src=\"n.jpg\"width=200 height=200>", "<img width=100px height=100.5 src=o.jpg>", "é", "\n",
    ]
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "<img src=a.jpg" + " x=1" * 400 + "><img src=z.jpg>")]
    got = {}
    for r in S.page_images(spark.createDataFrame(rows, "i int, html string"), "i").orderBy("i", "place").collect():
        got.setdefault(r.i, []).append(r.source)
    for i, page in rows:
        plain = Plain()
        plain.feed(page or "")
        assert got.get(i, []) == plain.found, page

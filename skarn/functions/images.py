"""Image kernels in numpy, and pandas UDFs over them.

Arrays are ``uint8[height, width, 3]`` in RGB.  PNG (8-bit grey, RGB, palette, with or without alpha, not interlaced) is decoded and
encoded here; other formats go through a decoder that the caller injects.  Results follow the published definitions of each step;
bit-for-bit parity with a given imaging library is not claimed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 640
PAD = 114
# Luma weights, and the channel means and deviations of ImageNet.
LUMA = np.array([0.299, 0.587, 0.114])
IMAGENET_MEAN = np.array([0.485, 0.456, 0.406], np.float32)
IMAGENET_STD = np.array([0.229, 0.224, 0.225], np.float32)
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray) -> bytes:
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = image.reshape(h, 3 * w)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray | None:
    """RGB array, or None where the bytes are no complete PNG of the supported kinds."""
    try:
        if data[:8] != PNG:
            return None
        at, body, palette, head = 8, b"", None, None
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + n]
            if len(part) != n:
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += part
            at += 12 + n
        w, h, depth, colour, _, _, interlaced = head
        if depth != 8 or interlaced:
            return None
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + n * w)
        out = np.zeros((h, n * w), np.uint8)
        before = np.zeros(n * w, np.uint8)
        for y in range(h):
            out[y] = before = _unfiltered(int(rows[y, 0]), rows[y, 1:], before, n)
        image = out.reshape(h, w, n)
        if colour == 3:
            return palette[image[:, :, 0]]
        return np.repeat(image[:, :, :1], 3, 2) if n < 3 else image[:, :, :3].copy()
    except (KeyError, TypeError, ValueError, IndexError, struct.error, zlib.error):
        return None


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n).astype(np.uint64), 0).astype(np.uint8).ravel()
    out, raw, up = [0] * len(row), row.tolist(), above.tolist()
    for i, x in enumerate(raw):
        a, b, c = (out[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((a, b, c), key=lambda v: abs(p - v))
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


#: Mark of pixels that Spark's own reader has decoded: height, width and channels (4 bytes each), then rows of BGR, BGRA or grey.
PIXELS = b"SKARNPIX"


def pixel_bytes(image: Column) -> Column:
    """A decoded image of Spark's ``image`` source as bytes that ``decode`` takes."""
    number = lambda name: F.unhex(F.lpad(F.hex(image.getField(name).cast("long")), 8, "0"))
    return F.concat(F.lit(bytearray(PIXELS)), number("height"), number("width"), number("nChannels"), image.getField("data"))


def decode(data: bytes) -> np.ndarray | None:
    """RGB array of a PNG or of ``pixel_bytes``, or None."""
    if data[: len(PIXELS)] != PIXELS:
        return decode_png(data)
    try:
        h, w, n = struct.unpack(">III", data[len(PIXELS) : len(PIXELS) + 12])
        x = np.frombuffer(data, np.uint8, h * w * n, len(PIXELS) + 12).reshape(h, w, n)
    except (ValueError, struct.error):
        return None
    return np.repeat(x, 3, 2) if n == 1 else np.ascontiguousarray(x[:, :, 2::-1])


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height that the header of a PNG, JPEG, GIF or BMP states, or None."""
    try:
        if data[:8] == PNG and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        at = 2
        while data[:2] == b"\xff\xd8" and data[at] == 0xFF:
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            alone = kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8
            at += 1 if kind == 0xFF else 2 if alone else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (IndexError, struct.error):
        pass
    return None


def stated_size():
    """A pandas UDF: size of encoded images by their headers; nulls for other bytes."""

    @F.pandas_udf("width int, height int")
    def size(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = [(data is not None and image_size(bytes(data))) or (None, None) for data in part]
            yield pd.DataFrame(sizes, columns=["width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return size


def gray(image: np.ndarray) -> np.ndarray:
    return np.rint(image @ LUMA).astype(np.uint8)


def gray_std(image: np.ndarray) -> float:
    """Population standard deviation of the grey values."""
    return float(gray(image).std())


def norm_stats(image: np.ndarray) -> dict[str, float]:
    """Mean and population deviation of each channel and the mean grey value, rounded to four digits."""
    x = image.reshape(-1, 3).astype(np.float64)
    names = ["norm_mean_r", "norm_mean_g", "norm_mean_b", "norm_std_r", "norm_std_g", "norm_std_b"]
    return dict(zip(names, [round(float(v), 4) for v in [*x.mean(0), *x.std(0)]], strict=True)) | {"norm_brightness": round(float(gray(image).mean()), 4)}


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means where the image shrinks, bilinear where it grows."""
    out = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        old = out.shape[axis]
        if size < old:
            edge = np.linspace(0, old, size + 1)
            sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
            lo = np.floor(edge).astype(int)
            part = (edge - lo).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
            at = np.take(sums, lo, axis) + part * (np.take(sums, np.minimum(lo + 1, old), axis) - np.take(sums, lo, axis))
            out = np.diff(at, axis=axis) / (old / size)
        elif size > old:
            at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
            lo = np.floor(at).astype(int)
            part = (at - lo).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
            out = np.take(out, lo, axis) * (1 - part) + np.take(out, np.minimum(lo + 1, old - 1), axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def letterbox(image: np.ndarray, side: int = SIDE, pad: int = PAD) -> np.ndarray:
    """Longest side to ``side``, centred on a square of value ``pad``."""
    h, w = image.shape[:2]
    scale = side / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    out = np.full((side, side, 3), pad, np.uint8)
    y, x = (side - nh) // 2, (side - nw) // 2
    out[y : y + nh, x : x + nw] = resize(image, nh, nw)
    return out


def clahe(image: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of the luma, tables interpolated between tiles; chroma differences are kept."""
    luma = gray(image)
    h, w = luma.shape
    ys, xs = np.linspace(0, h, grid + 1).astype(int), np.linspace(0, w, grid + 1).astype(int)
    tables = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            tile = luma[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist = np.bincount(tile.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * tile.size / 256)
            over = np.maximum(hist - most, 0).sum()
            hist = np.minimum(hist, most) + over / 256
            tables[i, j] = np.cumsum(hist) * 255 / max(tile.size, 1)

    def between(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * grid / n - 0.5, 0, grid - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, grid - 1), at - lo

    y0, y1, fy = between(h)
    x0, x1, fx = between(w)
    fy, fx = fy[:, None], fx[None, :]
    pick = lambda a, b: tables[a[:, None], b[None, :], luma]
    new = (1 - fy) * ((1 - fx) * pick(y0, x0) + fx * pick(y0, x1)) + fy * ((1 - fx) * pick(y1, x0) + fx * pick(y1, x1))
    return np.clip(image.astype(float) + (new - luma)[:, :, None], 0, 255).round().astype(np.uint8)


def standard(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The standard transformation: letterbox, then local contrast."""
    return clahe(letterbox(image, side))


def blur(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with an odd kernel size, edges mirrored."""
    half = size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma**2))
    kernel /= kernel.sum()
    out = image.astype(float)
    for axis in (0, 1):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in range(3)], mode="reflect" if min(image.shape[:2]) > half else "edge")
        out = sum(k * np.take(wide, np.arange(i, i + image.shape[axis]), axis) for i, k in enumerate(kernel))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _hsv_shift(image: np.ndarray, hue: float, saturation: float, value: float) -> np.ndarray:
    x = image.astype(float) / 255
    top, low = x.max(2), x.min(2)
    span = top - low
    safe = np.where(span == 0, 1, span)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    h = (np.where(span == 0, 0, h) + hue) % 1
    s = np.clip(np.where(top == 0, 0, span / np.where(top == 0, 1, top)) + saturation, 0, 1)
    v = np.clip(top + value, 0, 1)
    part = lambda n: v - v * s * np.clip(np.minimum((n + h * 6) % 6, 4 - (n + h * 6) % 6), 0, 1)
    return np.clip(np.rint(np.stack([part(5), part(3), part(1)], 2) * 255), 0, 255).astype(np.uint8)


def augment(image: np.ndarray, key: str) -> np.ndarray:
    """Blur, flip, brightness and contrast, hue and saturation, random crop; each by chance, all from a seed made of ``key``."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big"))
    h, w = image.shape[:2]
    if rng.random() < 0.8:
        image = blur(image, int(rng.choice([3, 5, 7])))
    if rng.random() < 0.5:
        image = image[:, ::-1]
    if rng.random() < 0.6:
        gain, shift = 1 + rng.uniform(-0.25, 0.25), rng.uniform(-0.25, 0.25) * 255
        image = np.clip(np.rint(image * gain + shift), 0, 255).astype(np.uint8)
    if rng.random() < 0.4:
        # fixed values: hue by 10 of 180, saturation by 20 and value by 10 of 255
        image = _hsv_shift(image, rng.uniform(-10, 10) / 180, rng.uniform(-20, 20) / 255, rng.uniform(-10, 10) / 255)
    if rng.random() < 0.4:
        # fixed values: 0.8 to 1.0 of the area, at 0.9 to 1.1 times the ratio of the sides
        area, ratio = h * w * rng.uniform(0.8, 1.0), w / h * rng.uniform(0.9, 1.1)
        ch, cw = min(h, max(1, round(np.sqrt(area / ratio)))), min(w, max(1, round(np.sqrt(area * ratio))))
        y, x = int(rng.integers(0, h - ch + 1)), int(rng.integers(0, w - cw + 1))
        image = resize(image[y : y + ch, x : x + cw], h, w)
    return np.ascontiguousarray(image)


def tensor(image: np.ndarray) -> np.ndarray:
    """Channel-first float tensor, normalised with the ImageNet moments."""
    return np.ascontiguousarray(((image.astype(np.float32) / 255 - IMAGENET_MEAN) / IMAGENET_STD).transpose(2, 0, 1))


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def phash(image: np.ndarray) -> str:
    """64-bit perceptual hash: grey, 32 x 32, DCT, 8 x 8 lowest frequencies above their median; 16 hexadecimal digits."""
    small = resize(np.rint(image @ LUMA).astype(np.uint8)[:, :, None], 32, 32)[:, :, 0].astype(float)
    d = _dct(32)
    low = (d @ small @ d.T)[:8, :8]
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


INSPECTED = "width int, height int, gray_std double, phash string"


def inspector(decode: Callable[[bytes], np.ndarray | None] = decode):
    """A pandas UDF: size, grey deviation and perceptual hash of encoded images; all null where they can't be decoded."""

    @F.pandas_udf(INSPECTED)
    def inspect(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part:
                image = decode(bytes(data)) if data is not None else None
                rows.append((None, None, None, None) if image is None else (image.shape[1], image.shape[0], gray_std(image), phash(image)))
            yield pd.DataFrame(rows, columns=["width", "height", "gray_std", "phash"]).astype({"width": "Int32", "height": "Int32"})

    return inspect


TRANSFORMED = "png binary, norm_mean_r double, norm_mean_g double, norm_mean_b double, norm_std_r double, norm_std_g double, norm_std_b double, norm_brightness double"


def transformer(decode: Callable[[bytes], np.ndarray | None] = decode, side: int = SIDE):
    """A pandas UDF over (bytes, key, index): the standard image (null index) or its augmented variant, as PNG with statistics."""

    @F.pandas_udf(TRANSFORMED)
    def transform(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TRANSFORMED.split(", ")]
        for data, keys, indexes in parts:
            rows = []
            for raw, key, index in zip(data, keys, indexes, strict=True):
                image = decode(bytes(raw)) if raw is not None else None
                if image is None:
                    rows.append([None] * len(names))
                    continue
                image = standard(image, side)
                if not pd.isna(index):
                    image = augment(image, f"{key}:{int(index)}")
                rows.append([encode_png(image), *norm_stats(image).values()])
            yield pd.DataFrame(rows, columns=names)

    return transform

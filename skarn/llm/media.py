"""Media columns: texts stored losslessly as 8-bit grey images in archives, and a Spark data source that reads them back.

``store`` pads the UTF-8 bytes of a text with spaces to a positive multiple of 192, makes them the samples of a PNG 192 wide, and
writes the images of a task into ZIP archives of bounded size in the shared folder.  Only archives of finished task attempts
are in the manifest, which is a table; files of failed attempts are never read.

The data source ``skarn_media`` plans byte ranges of the archives' *directories* (the central directory at the end of each file) from a
manifest or a listing alone: the driver opens no archive.  An archive gets a range for every ``RANGE_BYTES`` of its size; beyond
``MOST_PARTITIONS`` ranges, neighbours share a partition.  A task reads the end record, walks its range of the directory, fetches each
member by its offset, and streams payloads through Arrow in batches of about ``BATCH_BYTES``.  A member that can't be read or fails its
checksum is tried again by itself, after a pause and from a newly opened file, up to ``TRIES`` times; then its row has an ``error``
instead of ``media``, and the other members are unaffected.

Paths are opened with ``pyarrow.fs`` (local or mounted folders, and the remote stores it supports).

Defined cases: null text is empty (one row of 192 spaces); null ``doc_id`` stays null; repeated rows are stored again; tables
without rows make no archive; other columns are not stored.  Memory: one batch and one text.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import Scratch

WIDTH = 192
TAIL = 16
ARCHIVE_BYTES = 64 << 20
#: Without the 64-bit extension an archive has 65,535 members at most.
ARCHIVE_MEMBERS = 20_000
BATCH_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
TRIES = 3
PAUSE = 0.05
MOST_PARTITIONS = 100_000

# PNG and ZIP records.
PNG = b"\x89PNG\r\n\x1a\n"
LOCAL = struct.Struct("<4s5H3I2H")
ENTRY = struct.Struct("<4s6H3I5H2I")
END = struct.Struct("<4s4H2IH")
LOCAL_MARK, ENTRY_MARK, END_MARK = b"PK\3\4", b"PK\1\2", b"PK\5\6"
DATE = (1 << 5) | 1  # 1980-01-01


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes) -> bytes:
    """The padded bytes as a grey image; the text chunk ``Length`` has their number before padding."""
    size = max(1, -(-len(raw) // WIDTH)) * WIDTH
    rows = np.zeros((size // WIDTH, WIDTH + 1), np.uint8)  # column 0: filter "none"
    rows[:, 1:] = np.frombuffer(raw.ljust(size, b" "), np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, size // WIDTH, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Samples and ``Length`` of an image made by ``to_png``."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, width, length, data = 8, 0, 0, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes(), length


def feature(samples: bytes) -> str:
    """A 64-bit average hash of the image: 8 x 8 block means against the mean of all blocks."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    rows = len(image)
    cut = (np.arange(8) * rows) // 8
    strips = image.reshape(rows, 8, WIDTH // 8).mean(2)
    if rows >= 8:
        blocks = np.add.reduceat(strips, cut, axis=0) / np.diff(np.append(cut, rows))[:, None]
    else:
        blocks = strips[cut]
    return np.packbits(blocks > blocks.mean()).tobytes().hex()


class _Archive:
    """A ZIP file under construction."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        system, path = pfs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.entries = system.open_output_stream(path), 0, []

    def add(self, name: bytes, data: bytes) -> None:
        crc = zlib.crc32(data)
        self.entries.append(ENTRY.pack(ENTRY_MARK, 20, 20, 0x800, 0, 0, DATE, crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, self.at) + name)
        record = LOCAL.pack(LOCAL_MARK, 20, 0x800, 0, 0, DATE, crc, len(data), len(data), len(name), 0) + name + data
        self.out.write(record)
        self.at += len(record)

    def close(self) -> tuple[str, int, int, int]:
        directory = b"".join(self.entries)
        n = len(self.entries)
        self.out.write(directory + END.pack(END_MARK, 0, 0, n, n, len(directory), self.at, 0))
        self.out.close()
        return self.path, n, self.at, len(directory)


MANIFEST = "archive string, members long, directory_at long, directory_bytes long"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes ``docs`` (``doc_id``, ``text``) to archives below ``folder``; returns the manifest, which must be written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("archive", "members", "directory_at", "directory_bytes"), archive.close(), strict=True))])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer() if text.is_valid else None
                archive = archive or _Archive(folder)
                archive.add(b"%s.png" % str(doc).encode(), to_png(raw.to_pybytes() if raw is not None else b""))
                if archive.at >= ARCHIVE_BYTES or len(archive.entries) >= ARCHIVE_MEMBERS:
                    yield done()
                    archive = None
        if archive:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(run, MANIFEST)


@dataclass
class DirectoryRanges(InputPartition):
    """(archive, k, n): the k-th of n byte ranges of an archive's directory; an entry belongs to the range it begins in."""

    ranges: list[tuple[str, int, int]]


def _end_record(f) -> tuple[int, int]:
    """Where the directory of an open archive begins, and its size."""
    size = f.size()
    tail = f.read_at(min(size, END.size + 65535), max(0, size - END.size - 65535))
    at = tail.rfind(END_MARK)
    if at < 0:
        raise ValueError("no end record")
    _, _, _, _, n, length, begin, _ = END.unpack(tail[at : at + END.size])
    if n == 0xFFFF or begin == 0xFFFFFFFF:
        raise ValueError("64-bit archives are not read")
    return begin, length


class _File:
    """An archive that is opened when it is read and again after a failure."""

    def __init__(self, path: str):
        self.path, self.handle = path, None

    def open(self):
        if self.handle is None:
            system, path = pfs.FileSystem.from_uri(self.path)
            self.handle = system.open_input_file(path)
        return self.handle

    def close(self) -> None:
        handle, self.handle = self.handle, None
        if handle is not None:
            try:
                handle.close()
            except OSError:
                pass  # it is opened anew


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.path = options.get("manifest"), options.get("path")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))
        self.most = int(options.get("partitions", MOST_PARTITIONS))

    def _archives(self) -> Iterator[tuple[str, int]]:
        """Path and size of every archive."""
        if self.manifest:
            system, path = pfs.FileSystem.from_uri(self.manifest)
            files = [f.path for f in system.get_file_info(pfs.FileSelector(path)) if f.path.endswith(".parquet") and f.size]
            for f in sorted(files):
                with system.open_input_file(f) as handle:
                    for batch in pq.ParquetFile(handle).iter_batches(columns=["archive", "directory_at"]):
                        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        else:
            system, path = pfs.FileSystem.from_uri(self.path)
            scheme = self.path[: self.path.index(":") + 3] if "://" in self.path else ""
            for f in sorted(system.get_file_info(pfs.FileSelector(path, recursive=True)), key=lambda x: x.path):
                if f.path.endswith(".zip"):
                    yield scheme + f.path, f.size

    def partitions(self) -> list[DirectoryRanges]:
        ranges = []
        for archive, size in self._archives():
            n = max(1, -(-size // self.range_bytes))
            ranges += [(archive, k, n) for k in range(n)]
        many = -(-len(ranges) // self.most)
        return [DirectoryRanges(ranges[i : i + many]) for i in range(0, len(ranges), many or 1)] or [DirectoryRanges([])]

    def _tried(self, file: _File, work):
        """What ``work`` reads from a file, or what went wrong last."""
        wrong = None
        for turn in range(self.tries):
            try:
                return work(file.open()), None
            except (OSError, ValueError, struct.error) as e:
                wrong = f"{type(e).__name__}: {e}"
                file.close()
                time.sleep(PAUSE * 2**turn)
        return None, wrong

    def _member(self, file: _File, offset: int, size: int, crc: int):
        """Bytes of a member, or what went wrong last; tried by itself."""

        def work(handle) -> bytes:
            head = LOCAL.unpack(handle.read_at(LOCAL.size, offset))
            if head[0] != LOCAL_MARK or head[3]:
                raise ValueError("no stored member at this offset")
            data = handle.read_at(size, offset + LOCAL.size + head[9] + head[10])
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError("checksum")
            return data

        return self._tried(file, work)

    def _entries(self, file: _File, k: int, n: int) -> Iterator[tuple[str, int, int, int]]:
        """Name, offset, size and checksum of the members of a range of a directory."""

        def work(handle):
            at, size = _end_record(handle)
            begin = size * k // n
            return begin, size * (k + 1) // n, handle.read_at(min(size * (k + 1) // n + 65535 + ENTRY.size, size), at)

        found, wrong = self._tried(file, work)
        if found is None:
            raise OSError(f"{file.path}: {wrong}")  # without a directory no member has a row, so the task must fail
        start, stop, directory = found
        at = 0
        while at < stop:
            entry = ENTRY.unpack(directory[at : at + ENTRY.size])
            if at >= start:
                yield directory[at + ENTRY.size : at + ENTRY.size + entry[10]].decode(), entry[16], entry[8], entry[7]
            at += ENTRY.size + entry[10] + entry[11] + entry[12]

    def read(self, partition: DirectoryRanges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for archive, k, n in partition.ranges:
            file = _File(archive)
            for name, offset, length, crc in self._entries(file, k, n):
                data, wrong = self._member(file, offset, length, crc)
                rows.append((archive, offset, name, data, wrong))
                size += len(data or b"")
                if size >= self.batch_bytes:
                    yield _rows(rows)
                    rows, size = [], 0
            file.close()
        if rows:
            yield _rows(rows)


COLUMNS = ("archive", "position", "name", "media", "error")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(COLUMNS))


class MediaSource(DataSource):
    """``spark.read.format("skarn_media")`` with ``manifest`` (a table of ``store``) or ``path`` (a folder of ZIP archives)."""

    @classmethod
    def name(cls) -> str:
        return "skarn_media"

    def schema(self) -> str:
        return "archive string, position long, name string, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


DESCRIBED = "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _describe(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [c.split() for c in DESCRIBED.split(", ")]
        for batch in batches:
            rows = []
            for name, media, error in zip(batch.column("name").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True):
                if error is not None:
                    if strict:
                        raise ValueError(f"member {name}: {error}")
                    rows.append((name, *[None] * 7, error))
                    continue
                stored = media.as_buffer().to_pybytes()
                samples, n = from_png(stored)
                rows.append((name, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if k == "long" else pa.string()) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def describe(media: DataFrame, strict: bool = False) -> DataFrame:
    """Sizes, digests and a feature of every member, from the bytes read back; ``strict`` fails on a member that could not be read."""
    return media.select("name", "media", "error").mapInArrow(_describe(strict), DESCRIBED)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores the texts of ``docs``, reads them back through the data source and describes them; the task that loses a member fails."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    scratch.write(store(docs, scratch.path("archives")), "manifest")
    spark.dataSource.register(MediaSource)
    out = describe(spark.read.format(MediaSource.name()).option("manifest", scratch.path("manifest")).load(), strict=True)
    stem = F.regexp_replace("name", r"\.png$", "")
    return out.withColumn("doc_id", F.when(stem != "None", stem.cast("long"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

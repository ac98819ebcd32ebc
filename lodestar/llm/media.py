"""Media columns: texts stored as 8-bit grey images in archives, read by a Spark data source.

Stored form of a text: its UTF-8 bytes, padded with spaces to a positive multiple of 192,
are the samples of a PNG image 192 wide, one row for each 192 bytes, 8 bits grey, with a
``tEXt`` chunk that tells the unpadded length.  PNG is lossless, so the samples read back
are the payload.

An archive is one file of members laid end to end, then a directory of (offset, length,
CRC-32, key), then a trailer.  ``ArchiveSource`` (data source ``lodestar_archive``)
writes one archive for each task and commits by a manifest, so files of failed attempts
are never seen; reading plans byte ranges of the archives from the manifest alone (a range
owns the members that begin in it).  A range is read a batch of members at a time through
Arrow; a member that can't be read or fails its CRC is tried again by its own offset with
the file opened anew, without touching the others.

Defined cases: null text is empty (one row of spaces); null ``doc_id`` is kept; repeated
rows are members of their own; an empty table makes no archive and gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import filesystem, fresh_dir, ship, text_or_empty, utf8

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MAGIC = b"LARC0001"
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("crc", "<u4"), ("null", "<u4"), ("key", "<i8")])
TRAILER = struct.Struct("<QQI8s")  # members, place of the directory, its CRC, magic
RANGE, BATCH, TRIES = 32 << 20, 8 << 20, 4


# ---- the image format


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int, level: int = 2) -> bytes:
    """A PNG whose samples are ``payload``, a positive multiple of 192 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """(samples, unpadded length) of a PNG that ``to_png`` made."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, n, height, packed = 8, 0, 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            height = int.from_bytes(body[4:8], "big")
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    return rows[:, 1:].tobytes(), n


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def feature(payload: bytes) -> str:
    """mean, spread, entropy in bits, sharpness and an 8 x 8 difference hash of the image."""
    img = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    counts = np.bincount(img.ravel(), minlength=256)
    p, level = counts / img.size, np.arange(256)
    mean = float((p * level).sum())
    spread = float(np.sqrt((p * (level - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    sharp = float(np.abs(np.diff(img.astype(np.int16), axis=1)).sum(dtype=np.int64)) / img.size
    edges = np.linspace(0, len(img), 9).astype(int)
    lines = np.minimum(np.linspace(0, len(img), 9).astype(int)[:-1], len(img) - 1)  # eight bands of rows
    bands = np.add.reduceat(img.astype(np.int64), lines, axis=0) if len(img) >= 8 else img[lines].astype(np.int64)
    sums = bands[:, : 9 * (WIDTH // 9)].reshape(8, 9, -1).sum(axis=2)
    bits = np.packbits((sums[:, 1:] > sums[:, :-1]).ravel()).tobytes().hex()
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};sharp={sharp:.4f};dhash={bits}"


# ---- archives


class ArchiveWriter:
    """Members one after another, then their directory."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, len(MAGIC), []
        out.write(MAGIC)

    def add(self, key: int | None, data: bytes) -> None:
        self.out.write(data)
        self.entries.append((self.at, len(data), zlib.crc32(data), key is None, key or 0))
        self.at += len(data)

    def close(self) -> int:
        table = np.array(self.entries, ENTRY).tobytes()
        self.out.write(table + TRAILER.pack(len(self.entries), self.at, zlib.crc32(table), MAGIC))
        self.out.close()
        return self.at + len(table) + TRAILER.size


def directory(f, size: int) -> np.ndarray:
    f.seek(size - TRAILER.size)
    _, at, crc, magic = TRAILER.unpack(f.read(TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not an archive")
    f.seek(at)
    raw = f.read(size - TRAILER.size - at)
    if zlib.crc32(raw) != crc:
        raise ValueError("the directory is damaged")
    return np.frombuffer(raw, ENTRY)


def read_member(open_file, entry, first: bytes | None = None, tries: int = TRIES) -> bytes:
    """A member's bytes; a failed try opens the archive anew at the member's own offset."""
    for k in range(tries):
        try:
            if k or first is None:
                with open_file() as f:
                    f.seek(int(entry["offset"]))
                    first = f.read(int(entry["length"]))
            if len(first) == entry["length"] and zlib.crc32(first) == entry["crc"]:
                return first
            error: Exception = ValueError(f"member at {entry['offset']} fails its CRC")
        except OSError as e:
            error = e
        if k:
            time.sleep(0.05 * 2**k)
    raise error


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    size: int
    members: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, span: int):
        self.folder, self.span = folder, span

    def partitions(self) -> list[Range]:
        fs, base = filesystem(self.folder)
        with fs.open_input_file(f"{base}/manifest.json") as f:
            files = json.loads(f.read())
        return [Range(f"{self.folder}/{x['path']}", x["size"], at, at + self.span) for x in files for at in range(0, x["size"], self.span)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no archives, so no ranges
            return
        fs, name = filesystem(part.path)
        names = ["doc_id", "media"]

        def made(ids, data):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=names)

        with fs.open_input_file(name) as f:
            table = directory(f, part.size)
            table = table[np.searchsorted(table["offset"], part.start) : np.searchsorted(table["offset"], part.end)]
            k = 0
            while k < len(table):
                ends = (table["offset"][k:] + table["length"][k:]) - table["offset"][k]
                n = max(1, int(np.searchsorted(ends, BATCH)))
                rows, k = table[k : k + n], k + n
                try:
                    f.seek(int(rows["offset"][0]))
                    raw = f.read(int(ends[n - 1]))
                except OSError:
                    raw = b""
                ids, data = [], []
                for r in rows:
                    at = int(r["offset"] - rows["offset"][0])
                    data.append(read_member(lambda: fs.open_input_file(name), r, raw[at : at + int(r["length"])]))
                    ids.append(None if r["null"] else int(r["key"]))
                yield made(ids, data)


class ArchiveSink(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = filesystem(self.folder)
        writer, name = None, f"archive-{uuid.uuid4().hex}.larc"
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = ArchiveWriter(fs.open_output_stream(f"{base}/{name}"))
                writer.add(key, to_png(payload_of(text), len(text)))
        return Written(name, writer.close(), len(writer.entries)) if writer else Written("", 0, 0)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/manifest.json") as f:
            f.write(json.dumps([{"path": m.path, "size": m.size, "members": m.members} for m in messages if m and m.members]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.folder)
        for m in messages:
            if m and m.path:
                fs.delete_file(f"{base}/{m.path}")


class ArchiveSource(DataSource):
    """``spark.read/df.write.format("lodestar_archive")``: (doc_id long, media binary); writing takes (doc_id, text)."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_archive"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> ArchiveSink:
        return ArchiveSink(self.options["path"])


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (doc_id, media) in, features of the samples out."""
    for b in batches:
        rows = []
        for doc_id, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            payload, n = from_png(media)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(FEATURES), FEATURES)], schema=FEATURES)


def write_archives(docs: DataFrame, folder: str) -> None:
    spark = docs.sparkSession
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).write.format("lodestar_archive").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, span: int = RANGE) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("lodestar_archive").option("range", span).load(folder)


def media_columns(docs: DataFrame, span: int = RANGE) -> DataFrame:
    """Store every text of ``docs`` as media in the shared folder, read it back, compute features."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "archives")
    write_archives(docs, folder)
    return read_archives(spark, folder, span).mapInArrow(media_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Token-id files in ascending document order, coded by ``idcoder``.

Writing: texts are range-partitioned and sorted by (doc_id, text digest), encoded, and
each partition writes one file of independently decodable blocks to the shared folder,
a block at a time.  A file gets a name of its own for each attempt; only the
files that the finished tasks name are ever read, so a lost executor costs a retry.

A file: magic, blocks, a table of documents (ids, null flags, lengths), a table of
blocks (place, ids, bytes, CRC-32), a trailer with the places and a CRC-32 of both tables.

Reading: one task for each file decodes it block by block and checks each.  The
driver holds one row for each file and adds up where it starts.

Defined cases: null or empty texts hold the end id only; null ``doc_id`` sorts first;
rows that repeat a ``doc_id`` follow one another by text; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idcoder
from .common import batch, filesystem, fresh_dir, materialize, ship, text_or_empty
from .tokens import default_path, encoder

MAGIC, END_ID = b"LCMX0002", 2
TRAILER = struct.Struct("<QQQQQQI8s")  # documents, blocks, ids, document table place and length, block table place, CRC, magic
MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class FileWriter:
    """Collects documents and writes blocks as they fill."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.docs, self.lens, self.blocks = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lens.append(len(ids))
        self.n_ids += len(ids)
        while len(ids):
            part, ids = ids[: idcoder.BLOCK - self.n_held], ids[idcoder.BLOCK - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == idcoder.BLOCK:
                self._flush()

    def _flush(self) -> None:
        if not self.n_held:
            return
        ids = np.concatenate(self.held)
        data = idcoder.encode(ids)
        self.blocks.append((self.at, len(ids), len(data), idcoder.checksum(ids)))
        self.out.write(data)
        self.at += len(data)
        self.held, self.n_held = [], 0

    def close(self) -> int:
        self._flush()
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = zlib.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lens, "<u8").tobytes() + null.tobytes(), 1)
        table = np.array(self.blocks, "<u8").tobytes()
        self.out.write(docs + table + TRAILER.pack(len(self.docs), len(self.blocks), self.n_ids, self.at, len(docs), self.at + len(docs), zlib.crc32(docs + table), MAGIC))
        return self.at + len(docs) + len(table) + TRAILER.size


class FileReader:
    """Documents of a file, in order, with blocks checked as they are decoded."""

    def __init__(self, f, size: int):
        f.seek(size - TRAILER.size)
        self.n_docs, self.n_blocks, self.n_ids, at, length, table, crc, magic = TRAILER.unpack(f.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        f.seek(at)
        raw = f.read(size - TRAILER.size - at)
        if zlib.crc32(raw) != crc:
            raise ValueError("the file's tables are damaged")
        docs, n = zlib.decompress(raw[:length]), self.n_docs
        self.ids, self.lens = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "<u8", n, 8 * n).astype(np.int64)
        self.null = np.frombuffer(docs, np.uint8, n, 16 * n)
        self.blocks = np.frombuffer(raw[table - at :], "<u8").reshape(-1, 4).astype(np.int64)
        self.f = f

    def _blocks(self) -> Iterator[np.ndarray]:
        for at, n, size, crc in self.blocks.tolist():
            self.f.seek(at)
            try:
                ids = idcoder.decode(self.f.read(size), n)
            except (ValueError, IndexError, zlib.error) as e:
                raise ValueError("a block is damaged") from e
            if idcoder.checksum(ids) != crc:
                raise ValueError("a block is damaged")
            yield ids

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """(doc_id, its ids in parts) of every document."""
        parts, now = self._blocks(), np.zeros(0, "<u2")

        def ids_of(n):
            nonlocal now
            while n:
                if not len(now):
                    now = next(parts)
                yield now[:n]
                got = min(n, len(now))
                now, n = now[got:], n - got

        for doc_id, null, n in zip(self.ids.tolist(), self.null.tolist(), self.lens.tolist()):
            yield (None if null else doc_id), ids_of(n)


def write_part(folder: str, path: str, end_id: int):
    """A mapInArrow function: sorted (doc_id, text) in, one manifest row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(path), np.array([end_id], "<u2"), TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        name, writer, out = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.lcm", None, None
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1))):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(name)
                    writer = FileWriter(out)
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer:
            size = writer.close()
            out.close()
            yield batch({"part": [part], "path": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [size]}, MANIFEST)

    return run


def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, first, size) of files in, a row for each document out."""
    for b in batches:
        for path, at, size in zip(*(b.column(c).to_pylist() for c in ("path", "first", "n_bytes"))):
            fs, name = filesystem(path)
            with fs.open_input_file(name) as f:
                out = {c.name: [] for c in READ}
                for doc_id, parts in FileReader(f, size).documents():
                    n = crc = 0
                    for ids in parts:
                        n, crc = n + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    out["doc_id"].append(doc_id)
                    out["start"].append(at)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(crc)
                    at += n
                    if len(out["start"]) == 10_000:
                        yield batch(out, READ)
                        out = {c.name: [] for c in READ}
                yield batch(out, READ)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder``; returns the written manifest, a row for each file."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keys = ["doc_id", F.xxhash64("text"), "text"]
    ordered = source.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)
    return materialize(ordered.mapInArrow(write_part(folder, path or default_path(), end_id), "part long, path string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    ship(spark)
    files, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # one row for each file
        files.append((len(files), r["path"], at, r["n_bytes"]))
        at += r["n_ids"]
    rows = spark.createDataFrame(files, "place long, path string, first long, n_bytes long")
    return rows.repartitionByRange(max(1, len(files)), "place").mapInArrow(read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token-id files in the shared folder and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, fresh_dir(spark, "ids"), path))

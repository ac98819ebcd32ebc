"""Best-fit packing with bounded space.

Documents become ids with an end id; only those longer than a sequence are cut, into
full pieces and a rest.  The pieces are written once and fall into groups of about
``GROUP`` by a hash of what they are, so groups are even whatever the sources are; rows
alike beyond ``GROUP`` are dealt out by number.  Each group is packed
online, piece after piece in the order of that hash.  At most ``open_bins`` bins are open.
A bitset has bit f set while a bin with f free places is open, so the best fit for a
piece of n is the lowest set bit at or over n.  When a bin must stay open and all are
taken, the fullest closes.  A full piece is a sequence of its own and closes none.  State
is bounded by the open bins, whatever a group holds; sequence numbers are
``group * 2**40 + n``, so reruns agree (but where one row is repeated ``GROUP`` times over).

Defined cases: a null or empty text is one piece that holds the end id only; repeated
rows are packed once each; null ``doc_id`` stays null; an empty table gives no pieces;
extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, ship, slices, text_or_empty
from .tokens import default_path, encoder

CAPACITY, GROUP, OPEN_BINS, END_ID = 4096, 65_536, 4096, 1
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long"


def cut(path: str, capacity: int, end_id: int, keep_ids: bool):
    """A mapInArrow function: (doc_id, text) in, pieces out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4")
        for b in slices(batches):
            out = {f.name: [] for f in PIECES}
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1))):
                ids = np.concatenate([ids.astype("<u4"), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["ids"].append(part.tobytes() if keep_ids else None)
            yield batch(out, PIECES)

    return run


class Packer:
    """Online best fit over at most ``open_bins`` bins."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            del self.bins[free]
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def _put(self, free: int, number: int) -> None:
        if free:
            self.bins.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.open += 1

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``n``."""
        if fits := self.bits >> n:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most and n < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.made
            self.made += 1
        self._put(free - n, number)
        return number, self.capacity - free


def pack_groups(capacity: int, open_bins: int):
    """A mapInArrow function over pieces in group order: adds where each piece lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for b in batches:
            seqs, offs = [], []
            for group, n in zip(b.column("grp").to_pylist(), b.column("length").to_pylist()):
                if group != now:
                    now, packer = group, Packer(capacity, open_bins)
                number, at = packer.place(n)
                seqs.append((group << 40) + number)
                offs.append(at)
            columns = [b.column(f.name) for f in list(PLACED)[:5]] + [pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, PLACED)], schema=PLACED)

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs``; ``ids`` (unsigned 32-bit little-endian) only if asked for."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(cut(path or default_path(), capacity, end_id, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """Places for a written table of pieces with a number ``alike`` for each."""
    groups = max(1, math.ceil(pieces.count() / group))
    keyed = pieces.withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32"))
    # rows that are alike beyond a group's size are dealt out by their number; at most `groups` such keys (8 bytes each)
    often = keyed.groupBy("key").count().where(F.col("count") > group).select("key", F.lit(True).alias("often"))
    key = F.when(F.col("often"), F.xxhash64("key", "alike")).otherwise(F.col("key"))
    keyed = keyed.join(F.broadcast(often), "key", "left").withColumn("key", key).withColumn("grp", F.pmod("key", F.lit(groups)))
    ordered = keyed.repartition(max(1, min(groups, 1 << 15)), "grp").sortWithinPartitions("grp", "key", "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(pack_groups(capacity, open_bins), PLACED_DDL)


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = token_pieces(docs, path, capacity).drop("ids").withColumn("alike", F.monotonically_increasing_id())
    return pack_pieces(materialize(pieces, "pieces"), capacity, open_bins)

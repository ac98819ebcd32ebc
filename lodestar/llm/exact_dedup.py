"""Exact deduplication with a heavy-hitter split.

1. Every text becomes a SHA-256 digest beside its row (JVM side); the table of digests,
   about 60 bytes a row, is written to the shared folder, so texts are read once.
2. Misra-Gries summaries of at most ``counters`` digests a partition find candidates for
   frequent digests.  Adding the summaries of all partitions leaves every digest with
   more than ``rows / (counters + 1)`` rows in the sum; the ``counters`` largest go on.
3. A second pass verifies the candidates: their exact row count and winner.  That table
   has ``counters`` rows at most and is broadcast, so rows of frequent digests are settled
   on the map side and never meet in one task.
4. All other digests take an ordinary shuffle: partial aggregation, then a join back.

Defined cases: a null text equals the empty text; the row with the largest ``doc_id``
stays (null is smallest); of rows that repeat that ``doc_id`` exactly one stays, the last
read.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, ship, text_or_empty

COUNTERS = 1024


def misra_gries(counters: int):
    """A mapInArrow function: digests in, at most ``counters`` (digest, weight) rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict[bytes, int] = {}
        for b in batches:
            for x in pc.value_counts(b.column(0)).to_pylist():
                summary[x["values"]] = summary.get(x["values"], 0) + x["counts"]
            if len(summary) > counters:  # merging, then taking off the first weight that has no counter
                cut = sorted(summary.values(), reverse=True)[counters]
                summary = {k: v - cut for k, v in summary.items() if v > cut}
        if summary:
            yield pa.RecordBatch.from_arrays([pa.array(summary.keys(), pa.binary()), pa.array(summary.values(), pa.int64())], names=["digest", "weight"])

    return run


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row_id, doc_id, digest) of every row; ``row`` names its number, else one is given that holds for this table."""
    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest"))


def _winners(keys: DataFrame) -> DataFrame:
    # max of a struct: nulls are smallest, so a null doc_id only wins among nulls
    return keys.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("win"), F.count(F.lit(1)).alias("group_size"))


def settle(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``keys`` (row_id, doc_id, digest): keep_id, group_size and kept.

    ``keys`` is read several times and must be a written table.
    """
    found = keys.select("digest").mapInArrow(misra_gries(counters), "digest binary, weight long").groupBy("digest").agg(F.sum("weight").alias("weight"))
    candidates = found.orderBy(F.desc("weight"), "digest").limit(counters).where("weight > 1").select("digest")
    # at most `counters` rows of 32 bytes: safe to broadcast at any input size
    heavy = _winners(keys.join(F.broadcast(candidates), "digest", "left_semi"))
    heavy = materialize(heavy, "heavy")
    rest = keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    both = keys.join(F.broadcast(heavy), "digest").unionByName(rest.join(_winners(rest), "digest"))
    return both.select("row_id", "doc_id", F.col("win.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("win.row_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    ship(docs.sparkSession)
    return settle(materialize(digests(docs), "digests"), counters).drop("row_id")


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that lose; every column stays."""
    ship(docs.sparkSession)
    placed, row = numbered(docs)
    lost = settle(materialize(digests(placed, row), "digests"), counters).where("not kept").select(F.col("row_id").alias(row))
    lost = materialize(lost, "lost")  # written, so that Spark knows its size: broadcast only if it is small
    return placed.join(lost, row, "left_anti").drop(row)

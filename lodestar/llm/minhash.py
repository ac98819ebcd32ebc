"""Near copies at a similarity: SimHash components and min-hash bands propose, shingle sets confirm.

Words, lower-cased A-Z, in shingles of five; two texts are near copies where the Jaccard
similarity of their shingle sets is 0.8 or more.

1. The SimHash operator (``simhash.near_duplicates``, fingerprints of the same five-word
   shingles, Gray-order index) gives components of fingerprints within 2 bits.
2. Pairs near 0.8 lie a median of 7 bits apart, beyond any exact index of 64 bits, so 192
   min-hashes in 64 bands of six (drawn from them once) complete it: a pair at 0.8 shares
   a band but for a chance of some 3 in 10^6, more similar pairs more surely, and texts
   that only share a passage rarely do.
3. In each bucket (a component or a band's value) every member is held against one leader,
   exactly.
4. Buckets whose members are then still in different components are compared in full.
5. Confirmed pairs only make components; one row of each stays.

Defined cases: null text is empty; texts without words are copies of each other; fewer
than five words are one shingle; rows are apart whatever their ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, ship, slices, splitmix, text_or_empty, utf8
from .components import components
from .simhash import majority, near_duplicates, shingle_hashes

SHINGLE, BANDS, DEPTH, HASHES = 5, 64, 6, 192
U = np.uint64
TURN = splitmix(np.arange(2 * HASHES, dtype=U)).reshape(2, -1, 1)
BAND = splitmix(np.arange(1000, 1000 + BANDS, dtype=U))
#: The min-hashes of each band: the DEPTH least by a mix of band and hash.
DRAWN = np.argsort(splitmix(np.arange(5000, 5000 + BANDS * HASHES, dtype=U)).reshape(BANDS, HASHES), axis=1)[:, :DEPTH]


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band; texts without words share all."""
    least = np.full(HASHES, ~U(0))
    for at in range(0, len(h), 512):
        least = np.minimum(least, (h[at : at + 512] * (TURN[0] | U(1)) + TURN[1]).min(axis=1))
    key = BAND
    for m in least[DRAWN].T:
        key = splitmix(key ^ m)
    return key


def _hashes(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, U), *shingle_hashes(text, SHINGLE)]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        hashes = [list(shingle_hashes(t, SHINGLE)) for t in utf8(b.column("text"))]
        fps = np.array([majority(h) for h in hashes], U).view(np.int64)
        sets = [np.unique(np.concatenate([np.zeros(0, U), *h])) for h in hashes]
        keys = [bands(h).view(np.int64) for h in sets]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["node", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([_hashes(t).view(np.int64) for t in utf8(b.column("text"))], pa.list_(pa.int64()))], names=["node", "hashes"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b, na, nb) the edges (a, b) whose sets have a similarity of 0.8 or more: 9 times the overlap is 4 times both sizes."""
    fit = pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").distinct()
    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = fit.join(one, "a").join(two, "b")
    return both.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def near_components(rows: DataFrame, row: str) -> DataFrame:
    """(node, root) of every row of a written table (its number in ``row``, text) that has a near copy."""
    source = rows.select(F.col(row).alias("node"), text_or_empty().alias("text"))
    keys = materialize(source.mapInArrow(_keys, "node long, n long, fp long, bands array<long>"), "bands")
    close = near_duplicates(keys.select(F.col("node").alias("doc_id"), "fp")).select("fp", F.xxhash64("root").alias("key"))
    keyed = keys.select("node", "n", F.explode("bands").alias("key")).unionByName(keys.select("node", "n", "fp").join(close, "fp").drop("fp"))
    lead = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("r"), "node", "n")).alias("l"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = materialize(keyed.join(lead.drop("rows"), "key"), "buckets")
    # shingles of rows in a shared bucket only; as a written table Spark knows how many rows they are, and so how to join them
    asked = materialize(shared.select("node").distinct(), "asked")
    sets = materialize(source.join(asked, "node", "left_semi").mapInArrow(_sets, "node long, hashes array<long>"), "shingles")
    star = shared.where("node <> l.node").select(F.greatest("node", "l.node").alias("a"), F.least("node", "l.node").alias("b"), F.when(F.col("node") > F.col("l.node"), F.col("n")).otherwise(F.col("l.n")).alias("na"), F.when(F.col("node") > F.col("l.node"), F.col("l.n")).otherwise(F.col("n")).alias("nb"))
    edges = materialize(_confirmed(star, sets), "near")
    named = shared.select("key", "node", "n").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    # what is left of a bucket that is not one component: its members from different components, all with all
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y and rows > 2").select("key")
    left = named.join(mixed, "key", "left_semi")
    a, b = (left.select("key", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
    rest = a.join(b, "key").where("a > b and ra <> rb").select("a", "b", "na", "nb")
    return components(edges.unionByName(_confirmed(rest, sets)))


def drop_shingle_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component (the smallest ``doc_id``, nulls last, the first such row)."""
    ship(docs.sparkSession)
    placed, row = numbered(docs)
    labels = materialize(near_components(placed, row).withColumnRenamed("node", row), "labels")
    member = placed.select(row, F.col("doc_id").cast("long").alias("doc_id")).join(labels, row)
    lead = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))).alias("lead")).select(F.col("lead.row").alias(row))
    lost = materialize(labels.select(row).join(lead, row, "left_anti"), "lost")  # written: broadcast only if it is small
    return placed.join(lost, row, "left_anti").drop(row)

"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: words, lower-cased A-Z, in shingles of three; bit i of the fingerprint is
set where it is set in over half of the shingles' XXH64 values (seed 42).

Links at 2 or fewer differing bits, exactly and without comparing all with all, by one
hierarchical index over all distinct fingerprints in the order of their Gray rank (the
fingerprint seen as a Gray code), in which neighbours share long patterns:

1. The ranks are cut into partitions of about ``PART`` fingerprints (at most ``MOST``
   partitions).  A partition is a node that holds the mask and the pattern its members
   share.  Sixteen neighbours make an upper node, and so on up to one root; each node
   keeps the mask its members share less what its parent has already.  The tasks get the
   partitions' nodes (16 bytes each, ``MOST`` at most), never all fingerprints.
2. A fingerprint goes from the root down; differences from the nodes' patterns add up and
   a whole group is dropped as soon as they pass 2.  It is sent to the partitions left
   that aren't after its own, so any pair within 2 bits meets exactly once.
3. A partition builds the same index over its members and searches it for all that was
   sent.  A partition that is sent more than ``SPLIT`` is dealt to several tasks, each
   with all its members.
4. A task yields a spanning forest of the links it found (each fingerprint to the first of
   its local component), never all pairs; components follow by star contraction.

Defined cases: null text is empty; a text without words has fingerprint 0, linked like
any other; fewer than three words are one shingle; rows that repeat a ``doc_id`` are
separate rows with the same id; null ``doc_id`` never becomes a component's id unless all
are null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, ship, text_or_empty, utf8
from .components import components

BITS, FANOUT, PART, MOST, SPLIT = 2, 16, 8192, 8192, 1 << 18
#: Pairs of query and node that a search holds at once (some 50 bytes each).
HELD = 1 << 20
U = np.uint64


# ---- fingerprints


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles in order, 65,536 at a time."""
    ws = text.lower().split()  # bytes: lowers A-Z only, splits at the six ASCII spaces
    if not ws:
        return
    size = min(size, len(ws))
    buf = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(ws) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        yield np.array([hash_of(buf[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")


def majority(hashes: Iterator[np.ndarray]) -> int:
    """Bit i is set where it is set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, size, seed))


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(fps, pa.int64())], names=["row_id", "doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, row: str | None = None, size: int = 3) -> DataFrame:
    """(row_id, doc_id, fp) of every row; fp holds the 64 bits as a signed long, ``row`` names a row's number."""
    source = docs.select((F.col(row) if row else F.lit(None).cast("long")).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(_fingerprints(size), "row_id long, doc_id long, fp long")


# ---- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each value in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class GrayIndex:
    """A hierarchical index over fingerprints, or over nodes (and, or of their members), in Gray order."""

    def __init__(self, every: np.ndarray, some: np.ndarray | None = None, fanout: int = FANOUT):
        both = every, every if some is None else some
        self.n, self.fanout, self.levels = len(every), fanout, [(~(both[0] ^ both[1]), both[0])]  # shared mask, pattern
        while len(both[0]) > 1:
            cuts = np.arange(0, len(both[0]), fanout)
            both = np.bitwise_and.reduceat(both[0], cuts), np.bitwise_or.reduceat(both[1], cuts)
            self.levels.append((~(both[0] ^ both[1]), both[0]))
        self.levels.reverse()
        for k in range(len(self.levels) - 1, 0, -1):  # a node keeps what its parent doesn't share
            mask, pattern = self.levels[k]
            self.levels[k] = mask & ~np.repeat(self.levels[k - 1][0], fanout)[: len(mask)], pattern

    def search(self, queries: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) index pairs at ``bits`` or fewer differing bits, some queries at a time."""
        todo = [(a, min(a + 2048, len(queries))) for a in range(0, len(queries), 2048)][::-1]
        while todo:
            a, b = todo.pop()
            q, node, spent = np.arange(a, b), np.zeros(b - a, np.int64), np.zeros(b - a, np.uint8)
            for k, (mask, pattern) in enumerate(self.levels):
                if k:
                    child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    q, spent = np.repeat(q, self.fanout), np.repeat(spent, self.fanout)
                    real = child < len(mask)
                    q, node, spent = (q, child, spent) if real.all() else (q[real], child[real], spent[real])
                spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
                keep = np.flatnonzero(spent <= bits)
                q, node, spent = q[keep], node[keep], spent[keep]
                if len(q) * self.fanout > HELD and b - a > 1 and k < len(self.levels) - 1:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                    break
            else:
                yield q, node


def forest(members: np.ndarray, queries: np.ndarray, asks: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of ``members`` (in Gray order) and then ``queries`` the place of the first of its component.

    ``asks``: the members that are searched for too.
    """
    n = len(members)
    root = np.arange(n + len(queries))
    place = np.concatenate([np.flatnonzero(asks), np.arange(n, len(root))])

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q, m in GrayIndex(members).search(np.concatenate([members[asks], queries]), bits):
        a, b = root[place[q]], root[m]
        apart = a != b
        for x, y in np.unique(np.stack([a[apart], b[apart]]), axis=1).T.tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
    return root


def link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function over (part, slice, role, fp), whole groups, members in Gray order first: edges a, b."""
    kept: list[pa.RecordBatch] = []

    def made():
        role, fps = (np.concatenate([b.column(c).to_numpy() for b in kept]) for c in ("role", "fp"))
        fps = fps.view(np.uint64)
        member = role != SENT
        order = np.concatenate([fps[member], fps[~member]])
        root = forest(fps[member], fps[~member], role[member] == OWN)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(order[own].view(np.int64)), pa.array(order[root[own]].view(np.int64))], names=["a", "b"])

    def key(b, i):
        return b.column("part")[i].as_py(), b.column("slice")[i].as_py()

    for b in batches:
        if not b.num_rows:
            continue
        part, piece = b.column("part").to_numpy(), b.column("slice").to_numpy()
        cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (piece[1:] != piece[:-1])) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if kept and key(kept[-1], 0) != key(b, x):
                yield made()
                kept = []
            kept.append(b.slice(x, y - x))
    if kept:
        yield made()


#: What a row is to a group: a member that is searched for, a fingerprint of another partition, a member only.
OWN, SENT, HERE = 0, 1, 2


def part_of(fps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, gray_rank(fps), side="right")


def nodes(bounds: np.ndarray):
    """A mapInArrow function: fingerprints in, (part, and, or) of those of each partition out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            part = part_of(fps, bounds)
            order = np.argsort(part, kind="stable")
            if len(order):
                found, cuts = np.unique(part[order], return_index=True)
                every, some = np.bitwise_and.reduceat(fps[order], cuts), np.bitwise_or.reduceat(fps[order], cuts)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(every.view(np.int64)), pa.array(some.view(np.int64))], names=["part", "every", "some"])

    return run


def route(bounds: np.ndarray, present: np.ndarray, index: GrayIndex, bits: int):
    """A mapInArrow function: a fingerprint in, a row for each partition up to its own that may hold a link of it out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            own = part_of(fps, bounds)
            for q, m in index.search(fps, bits):
                part = present[m]
                keep = part <= own[q]
                q, part = q[keep], part[keep]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.where(part == own[q], OWN, SENT).astype(np.int32)), pa.array(fps[q].view(np.int64))], names=["part", "role", "fp"])

    return run


def _gray(col="fp"):
    x = F.col(col)
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))  # signed order is the unsigned rank's


def index_links(fps: DataFrame, bits: int = BITS, size: int = PART, most: int = MOST, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) whose components are those of all links of ``bits`` among the distinct ``fp`` of a written table."""
    parts = min(most, -(-fps.count() // size))
    bounds = np.zeros(0, np.uint64)
    if parts > 1:  # `parts` - 1 quantiles of the ranks, not fingerprints
        cuts = fps.agg(F.percentile_approx(_gray(), [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
        bounds = np.unique(np.array(cuts, np.int64)).view(np.uint64) ^ U(1 << 63)
    top = fps.select("fp").mapInArrow(nodes(bounds), "part int, every long, some long").groupBy("part").agg(F.expr("bit_and(every)").alias("every"), F.expr("bit_or(some)").alias("some"))
    top = sorted(map(tuple, top.collect()))  # one row for each partition, `most` at most
    if not top:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    part, every, some = (np.array(c, np.int64) for c in zip(*top))
    routed = fps.select("fp").mapInArrow(route(bounds, part, GrayIndex(every.view(np.uint64), some.view(np.uint64)), bits), "part int, role int, fp long")
    routed = materialize(routed, "routed")
    slices = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / split).cast("int").alias("slices"))  # a row for each partition
    mine = F.pmod(F.xxhash64("fp"), F.col("slices"))
    every = F.when(F.col("role") == SENT, F.array(mine)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    dealt = routed.join(F.broadcast(slices), "part").withColumn("mine", mine).withColumn("slice", F.explode(every))
    role = F.when((F.col("role") == OWN) & (F.col("slice") != F.col("mine")), HERE).otherwise(F.col("role"))
    dealt = dealt.select("part", F.col("slice").cast("int").alias("slice"), role.alias("role"), "fp")
    ordered = dealt.repartition("part", "slice").sortWithinPartitions("part", "slice", F.col("role") == SENT, _gray())
    return ordered.mapInArrow(link_groups, "a long, b long")


def near_duplicates(keys: DataFrame, bits: int = BITS, size: int = PART) -> DataFrame:
    """(fp, root, component_id) for every distinct fp of a written table (doc_id, fp); root is the component's own, a ``doc_id`` may be null or repeat."""
    distinct = materialize(keys.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    labels = components(index_links(distinct.select("fp"), bits, size)).withColumnRenamed("node", "fp")
    rooted = distinct.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(best, "root").select("fp", "root", "component_id"), "components")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    ship(docs.sparkSession)
    keys = materialize(fingerprints(docs), "fingerprints")
    return keys.join(near_duplicates(keys), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, size: int = 3, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component (the smallest ``doc_id``, nulls last, the first such row)."""
    ship(docs.sparkSession)
    placed, row = numbered(docs)
    keys = materialize(fingerprints(placed, row, size), "fingerprints")
    labelled = keys.join(near_duplicates(keys, bits), "fp")
    lead = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("lead")).select(F.col("lead.row_id").alias(row))
    return placed.join(lead, row, "left_semi").drop(row)

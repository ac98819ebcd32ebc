"""Mixing sources to target weights by balanced (cube) sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all
sizes; a target stops at ``cap`` times its source's size and the excess is shared again
by weight.  A document of a source with ratio r = target / size is taken floor(r) times
for certain and once more with probability r - floor(r).

Those probabilities are settled by the cube method: a flight walks through the null space
of the two balancing equations (tokens and documents of the source), each step making at
least one probability 0 or 1 while both totals stay exactly what they were.  A step needs
three open documents only, so a flight is one pass with constant memory.  Sources are cut
into blocks of about ``BLOCK`` documents by a hash of the document, however large a
source is; each block leaves at most two open documents.  Those of all blocks fly again,
level by level, until one block a source is left; then the landing drops the document
equation, flies on along the token equation's remainder and settles the last one or two.

The driver holds one row for each source (its size and count), nothing for a document.
Random numbers are seeded by source and block, so reruns agree.

Defined cases: a null text has size 0; null sources are one source; where a source has no
words its target is 0 and nothing is taken; repeated rows are drawn each on their own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, numbered, ship

WEIGHTS, CAP, BLOCK, SEED = (5.0, 2.0, 1.0), 3.0, 2_000, 17
#: Sources up to which the table of targets (some 100 bytes a row) is broadcast; a shuffle join beyond.
BROADCAST_SOURCES = 20_000
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, none over ``cap`` times its size."""
    total, fixed, active = float(sum(sizes)), {}, set(range(len(sizes)))
    while active:
        rest, weight = total - sum(fixed.values()), sum(weights[i] for i in active)
        over = [i for i in sorted(active) if rest * weights[i] / weight > cap * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else rest * weights[i] / weight for i in range(len(sizes))]
        for i in over:
            fixed[i] = cap * sizes[i]
            active.discard(i)
    return [fixed[i] for i in range(len(sizes))]


class Flight:
    """The flight phase over documents of one block; ``emit`` gets (row, 0 or 1)."""

    def __init__(self, seed: str, emit):
        self.rng, self.emit, self.open = random.Random(seed), emit, []

    def add(self, row, size: float, p: float) -> None:
        if p <= EPS or p >= 1 - EPS:
            self.emit(row, float(p > 0.5))
            return
        self.open.append([row, float(size), p])
        if len(self.open) == 3:
            self._step()

    def _direction(self) -> list[float] | None:
        s = [x[1] for x in self.open]
        if len(s) == 3:
            u = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
            return u if any(u) else [1.0, -1.0, 0.0]
        return [1.0, -1.0] if len(s) == 2 and s[0] == s[1] else None

    def _move(self, u: list[float]) -> None:
        up = min((1 - x[2]) / v if v > 0 else x[2] / -v for x, v in zip(self.open, u) if v)
        down = min(x[2] / v if v > 0 else (1 - x[2]) / -v for x, v in zip(self.open, u) if v)
        by = up if self.rng.random() * (up + down) < down else -down
        still = []
        for x, v in zip(self.open, u):
            x[2] += by * v
            if x[2] <= EPS or x[2] >= 1 - EPS:
                self.emit(x[0], float(x[2] > 0.5))
            else:
                still.append(x)
        self.open = still

    def _step(self) -> None:
        while len(self.open) == 3:
            self._move(self._direction())

    def finish(self) -> list:
        """The documents still open (two at most, of different sizes)."""
        while self.open and (u := self._direction()):
            self._move(u)
        left, self.open = self.open, []
        return left

    def land(self) -> None:
        """Settle all: keep the token total while two are open, then draw the last."""
        self.open = self.finish()
        if len(self.open) == 2:
            a, b = self.open[0][1], self.open[1][1]
            self._move([b, -a] if a and b else [1.0, 0.0] if b else [0.0, 1.0])
        for row, _, p in self.open:
            self.emit(row, float(self.rng.random() < p))
        self.open = []


COLUMNS = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("src", pa.string()), ("size", pa.int64()), ("base", pa.int64()), ("p", pa.float64())])
DDL = "row_id long, doc_id long, src string, size long, base long, p double"


def fly(level: int, last: bool, seed: int):
    """A mapInArrow function over rows in (source, block) order: p becomes 0 or 1, but for at most two rows a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit(row, p):
            out.append((*row, p))

        def close(flight):
            if flight and last:
                flight.land()
            elif flight:
                for row, _, p in flight.finish():
                    emit(row, p)

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), COLUMNS)], schema=COLUMNS)
            out.clear()
            return made

        now, flight = None, None
        for b in batches:
            data = b.to_pydict()
            for row_id, doc_id, src, size, base, p, block in zip(*(data[c] for c in ("row_id", "doc_id", "src", "size", "base", "p", "block"))):
                if (src, block) != now:
                    close(flight)
                    now, flight = (src, block), Flight(f"{seed}/{level}/{src}/{block}", emit)
                flight.add((row_id, doc_id, src, size, base), size, p)
            if len(out) >= 10_000:
                yield flush()
        close(flight)
        if out:
            yield flush()

    return run


def _blocks(rows: DataFrame, counts: dict[str, int], lookup: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One level of flights over ``rows`` joined with the block count of their source."""
    # rows without an id have nothing but their number to part them
    blocks = F.pmod(F.xxhash64("doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("row_id")), F.lit(seed + level)), F.col("n_blocks"))
    keyed = rows.join(lookup, "src").withColumn("block", blocks).select(*COLUMNS.names, "block")
    ordered = keyed.repartition("src", "block").sortWithinPartitions("src", "block", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size", "row_id")
    return ordered.mapInArrow(fly(level, last, seed), DDL)


def _small(spark, rows: list[tuple], ddl: str) -> DataFrame:
    df = spark.createDataFrame(rows, ddl)
    return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df


def draw(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = SEED, row: str | None = None) -> DataFrame:
    """row_id, doc_id, size, source_size, target, times, taken for every row of ``docs`` (doc_id, text, source)."""
    spark = docs.sparkSession
    ship(spark)
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))  # sorts null last
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = materialize(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("src"), size.alias("size")), "sizes")
    stats = sorted((r["src"], r["size"], r["n"]) for r in rows.groupBy("src").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect())
    goal = targets([s for _, s, _ in stats], [weights[i % len(weights)] for i in range(len(stats))], cap)
    ratio = [min(cap, g / s) if s else 0.0 for g, (_, s, _) in zip(goal, stats)]
    base = [math.floor(r + EPS) for r in ratio]
    table = _small(spark, [(k, s, g, b, max(0.0, r - b)) for (k, s, _), g, r, b in zip(stats, goal, ratio, base)], "src string, source_size long, target double, base long, p double")
    start = rows.join(table.select("src", "base", "p"), "src").select(*COLUMNS.names)
    counts = {k: n for k, _, n in stats}
    level, done = 0, None
    while True:
        n_blocks = {k: math.ceil(n / block) for k, n in counts.items()}
        last = all(n <= 1 for n in n_blocks.values())
        flown = materialize(_blocks(start, counts, _small(spark, list(n_blocks.items()), "src string, n_blocks long"), level, last, seed), "flight")
        settled = flown if last else flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        start, counts, level = flown.where("p > 0 and p < 1"), {k: 2 * n for k, n in n_blocks.items()}, level + 1
    times = (F.col("base") + F.col("p")).cast("long")
    return done.join(table.select("src", "source_size", "target"), "src").select("row_id", "doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (and times) for every row of ``docs``."""
    return draw(docs, **options).drop("row_id")


def take(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: every row as often as the mix takes it."""
    placed, row = numbered(docs)
    times, copy = free_name(placed, "lodestar_times"), free_name(placed, "lodestar_copy")
    taken = draw(placed, row=row, **options).where("times > 0").select(F.col("row_id").alias(row), F.col("times").alias(times))
    return placed.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])

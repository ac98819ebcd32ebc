"""Substring dedup: seed and extend over winnowed anchors, exact at the threshold.

A window is ``LENGTH`` (20) consecutive words; one that starts with the same words as an
earlier window (smaller doc_id, or the same document, earlier start) is a repeat, and
every word under a repeat goes.

Seeds.  Winnowing picks, in every window, the 5-word gram with the least hash (the first
of equals).  The pick depends on the window's words alone, so equal windows share their
anchor at the same place in them: documents that share 20 words always meet at an anchor,
and one word in eight or nine is one.

Extension.  Windows that pick one anchor follow one another, so an anchor answers for a
stretch of words that reaches from its first window's start to its last window's end on
both sides of it.  An occurrence is the anchor's hash, a hash of that stretch, and where
it is.  Of occurrences with equal stretches all but the earliest are repeats whole.  An
anchor met once is no repeat.  Where one anchor has several stretches (the ends of a
repeated passage, places where near copies differ) its earliest occurrences per stretch
go on to the second step, which compares their single windows by two 64-bit hashes.
Repeats that touch merge into maximal ones when words are removed.

Scale.  Both steps first sort what one task has and send on only the earliest occurrence
of each stretch (or window); the rest are settled there.  An anchor with very many
stretches in a task sends two of them and passes the others to the second step directly.
So one passage in a third of all documents costs each task a few rows, and no pairs are
ever made.  Words meet their removal by a join on the document.

Defined cases: null text has no words; texts under 20 words keep all; rows equal in
doc_id and text are one document and get the same result; rows that share only the
doc_id, and null ids (before all others), are ordered by a hash of their text; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, splitmix, text_or_empty, utf8

LENGTH, GRAM = 20, 5
#: Bytes of text worked on at once; occurrences sorted at once; stretches an anchor may send on from a task.
CHUNK, HELD, SPREAD = 2 << 20, 1 << 20, 64
KEYED, REPEAT, OPEN = 1, 2, 3
U = np.uint64
NAMES = ["kind", "k1", "k2", "d", "th", "at", "n"]
DDL = "kind int, k1 long, k2 long, d long, th long, at long, n long"
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse mod 2**64 for i below n, or more."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        base = BASES[which]
        inverse = U(pow(int(base), -1, 1 << 64))
        have = _POWERS[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (base, inverse))
    return have


class Hashes:
    """Hashes of any stretch of a run of words, two ways."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.h = splitmix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n))
        self.sums = {}

    def span(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """The hash of words a to b (exclusive), for arrays of places."""
        up, down = powers(which, self.n + 1)
        if which not in self.sums:
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * up[: self.n])])
        s = self.sums[which]
        return splitmix((s[b] - s[a]) * down[a])


def anchors(h: Hashes, doc: np.ndarray, length: int = LENGTH):
    """(anchor hash, stretch hash, first window, windows) of a run of documents' words; ``doc``: the document of each word."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if h.n < length:
        return empty
    places = np.arange(h.n - GRAM + 1)
    gram = h.span(places, places + GRAM)
    value, place, width, wide = gram, places, 1, length - GRAM + 1
    while width < wide:
        step = min(width, wide - width)
        right = value[step:] < value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    ok = np.flatnonzero(doc[: h.n - length + 1] == doc[length - 1 :])  # windows within one document
    if not len(ok):
        return empty
    pick = place[ok]
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    a, p = ok[first], pick[first]
    n = np.diff(np.append(first, len(ok)))
    stretch = h.span(a, a + n + length - 1)
    return gram[p], splitmix(stretch ^ splitmix(((p - a) | (n << 8)).astype(np.uint64))), a, n


def made(kind, k1, k2, d, th, at, n) -> pa.RecordBatch:
    size = len(at)
    columns = [np.full(size, kind, np.int32), k1, k2, d, th, at, n]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c if c.dtype != np.uint64 else c.view(np.int64))) for c in columns], names=NAMES)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row of sorted columns lies in."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def earliest(k1, k2, d, th, at, n):
    """Sort by key and place; rows, which are earliest of their (k1, k2), which repeat another place."""
    order = np.lexsort((at, th, d, k2, k1))
    rows = [x[order] for x in (k1, k2, d, th, at, n)]
    key = runs(rows[0], rows[1])
    lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[key]  # each row's earliest
    own = lead == np.arange(len(key))
    other = (rows[2] != rows[2][lead]) | (rows[3] != rows[3][lead]) | (rows[4] != rows[4][lead])
    return rows, own, other


class Sender:
    """Holds a task's occurrences, settles what it can and sends the rest on."""

    def __init__(self, spread: int | None):
        self.spread, self.held, self.n = spread, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.n = [], 0
        by = np.argsort(columns[0], kind="stable")
        k = columns[0][by]
        alone = np.ones(len(k), bool)
        alone[1:] &= k[1:] != k[:-1]
        alone[:-1] &= k[1:] != k[:-1]
        yield made(KEYED, *(c[by[alone]] for c in columns))
        rows, own, other = earliest(*(c[by[~alone]] for c in columns))
        if not len(own):
            return
        yield made(REPEAT, *(c[~own & other] for c in rows))
        rows = [c[own] for c in rows]
        send = np.ones(len(rows[0]), bool)
        if self.spread:
            key = runs(rows[0])
            size = np.bincount(key)
            rank = np.arange(len(key)) - np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[key]
            send = (size[key] <= self.spread) | (rank < 2)
            yield made(OPEN, *(c[~send] for c in rows))
        yield made(KEYED, *(c[send] for c in rows))


def chunks(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows of a batch and their words, about CHUNK bytes at a time."""
    rows, ws, size = [], [], 0
    for i, text in enumerate(utf8(b.column("text"))):
        rows.append(i)
        ws.append(text.split())
        size += len(text)
        if size >= CHUNK:
            yield rows, ws
            rows, ws, size = [], [], 0
    if rows:
        yield rows, ws


def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in; occurrences of anchors, whole repeats and open stretches out."""
    sender = Sender(SPREAD)
    for b in batches:
        ids, hashes = b.column("d").to_numpy(), b.column("th").to_numpy()
        for rows, ws in chunks(b):
            sizes = np.array([len(w) for w in ws])
            doc = np.repeat(np.arange(len(rows)), sizes)
            k1, k2, at, n = anchors(Hashes([w for x in ws for w in x]), doc)
            own, start = doc[at], np.cumsum(sizes) - sizes
            yield from sender.add(k1, k2, ids[rows][own], hashes[rows][own], at - start[own], n)
    yield from sender.flush()


def settle(second: bool):
    """A mapInArrow function over rows in key order: repeats and, in the first step, open stretches."""

    def close(parts):
        k1, k2, d, th, at, n = (np.concatenate([p[i] for p in parts]) for i in range(6))
        rows, own, other = earliest(k1, k2, d, th, at, n)
        yield made(REPEAT, *(c[~own & other] for c in rows))
        if not second:
            key = runs(rows[0])
            several = np.bincount(key, weights=own)[key] > 1
            yield made(OPEN, *(c[own & several] for c in rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            columns = [b.column(c).to_numpy() for c in NAMES[1:]]
            for k in (REPEAT, OPEN):
                if (kind == k).any():
                    yield made(k, *(c[kind == k] for c in columns))
            new = [c[kind == KEYED] for c in columns]
            if not len(new[0]):
                continue
            end = np.flatnonzero(new[0] != new[0][-1])
            end = int(end[-1]) + 1 if len(end) else 0
            if kept and (end or kept[-1][0][-1] != new[0][0]):
                yield from close([*kept, [c[:end] for c in new]])
                kept = []
            elif end:
                yield from close([[c[:end] for c in new]])
            kept.append([c[end:] for c in new])
        if kept:
            yield from close(kept)

    return run


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with open stretches in; their windows by two hashes out."""
    sender = Sender(None)
    for b in batches:
        ids, hashes, spans = b.column("d").to_numpy(), b.column("th").to_numpy(), b.column("spans")
        for rows, ws in chunks(b):
            for i, w in zip(rows, ws):
                span = spans[i].values
                a = np.unique(np.concatenate([np.arange(x, x + n) for x, n in zip(span.field("at").to_pylist(), span.field("n").to_pylist())]))
                h, one = Hashes(w), np.ones(len(a), np.int64)
                yield from sender.add(h.span(a, a + LENGTH), h.span(a, a + LENGTH, 1), one * ids[i], one * hashes[i], a, one)
    yield from sender.flush()


def _meet(rows: DataFrame, second: bool) -> DataFrame:
    route = F.when(F.col("kind") == KEYED, F.col("k1")).otherwise(F.xxhash64("d", "th", "at"))
    return rows.withColumn("route", route).repartition("route").sortWithinPartitions("k1").select(*NAMES).mapInArrow(settle(second), DDL)


def _keyed(docs: DataFrame, *more) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("d", "th").agg(F.collect_list(F.struct("at", "n")).alias("spans"))  # one document's own places


def repeats(docs: DataFrame) -> DataFrame:
    """(d, th, at, n): n repeated windows from word ``at`` of a document; a written table."""
    ship(docs.sparkSession)
    source = _keyed(docs).select("d", "th", "text")
    first = materialize(_meet(source.mapInArrow(seed, DDL), False).select("kind", "d", "th", "at", "n"), "repeats")
    opened = source.join(_spans(first.where(f"kind = {OPEN}")), ["d", "th"])
    second = materialize(_meet(opened.mapInArrow(windows, DDL), True).select("kind", "d", "th", "at", "n"), "windows")
    return first.where(f"kind = {REPEAT}").unionByName(second).drop("kind")


def covered(n_words: int, at: np.ndarray, n: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which words lie under a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove(keep_text: bool):
    """A mapInArrow function: documents with their repeats in, what is left of them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digest, texts = [], [], [], []
            for text, spans in zip(utf8(b.column("text")), b.column("spans")):
                ws = text.split()
                n_words.append(len(ws))
                if spans.is_valid:
                    v = spans.values
                    gone = covered(len(ws), v.field("at").to_numpy(), v.field("n").to_numpy())
                    ws = [w for w, g in zip(ws, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(ws))
                kept = b" ".join(ws)
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept (the words left, joined by a space) if asked for."""
    joined = _keyed(docs).join(_spans(repeats(docs)), ["d", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove(keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, keep_text=False).drop("kept")

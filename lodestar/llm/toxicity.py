"""Toxicity scores by a factorization machine over hashed terms.

Terms are runs of letters and digits of the lower-cased whole text, hashed (XXH64) into
``SPACE`` slots; a document is the set of its slots.  The model is
``b + sum w_i + sum_{i<j} <v_i, v_j>``: beside a weight, each term has a vector of
``RANK`` numbers, so pairs that only mean something together (an insult and the mention
of a group) get a weight of their own where additive weights would miss them.

Training: at most ``SAMPLE`` labelled rows, the first by a hash of doc_id, among rows
whose crc32(doc_id as text) mod 3 isn't 1.  Equal texts count once.  Terms of those rows
are screened first (in at least ``LEAST`` of them, and ``Z`` deviations more or less
frequent in toxic ones than chance), so a few hundred rows aren't learnt by heart.  Pairs
among the ``PAIRED`` most frequent other terms are screened too (``PAIR_Z`` deviations),
so terms that tell something together only stay.  The machine is then fitted by AdaGrad
in a fixed order.  Only doc_id (for the split), text and
labels.toxic are read.  The driver sees the sample's slots and nothing else; the fitted
model holds some thousand terms and goes to the tasks in their closure.

Scoring: one narrow pass, no shuffle.

Defined cases: null text is empty, an empty text gets the score of no terms; labels that
are null are ignored, a doc_id labelled twice counts as toxic if either says so; without
labels of both kinds every score is the smoothed share of toxic rows; null doc_id isn't
held out; repeated rows repeat their score; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, text_or_empty, utf8

SPACE, RANK, SAMPLE, LEAST, Z, PAIRED, PAIR_Z = 1 << 18, 8, 12_000, 3, 3.0, 1024, 6.0
EPOCHS, RATE, DECAY, SEED = 30, 0.2, 1e-3, 7
THRESHOLD = 0.7
TERM = re.compile(r"[^\W_]+")
CACHE = 300_000


def slot(term: str) -> int:
    return xxhash.xxh64_intdigest(term) % SPACE


def slots(text: str) -> list[int]:
    """The slots of a text's terms, sorted."""
    return sorted({slot(t) for t in set(TERM.findall(text.lower()))})


@dataclass
class Model:
    bias: float
    places: dict[int, int]  # slot to row of w and v
    w: np.ndarray
    v: np.ndarray

    def logit(self, rows: list[int]) -> float:
        if not rows:
            return self.bias
        v = self.v[rows]
        s = v.sum(axis=0)
        return float(self.bias + self.w[rows].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, rows: list[int]) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.logit(rows)))))


def deviations(toxic: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """How many deviations ``toxic`` of ``n`` rows lie over chance."""
    return (toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))


def screen(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Slots that tell something of the label, alone or together with another."""
    share, df = float(y.mean()), np.zeros((2, SPACE))
    for r, t in zip(rows, y.astype(int).tolist()):
        df[t, r] += 1
    n = df.sum(axis=0)
    alone = (n >= LEAST) & (np.abs(deviations(df[1], n, share)) >= Z)
    rest = np.flatnonzero((n >= LEAST) & ~alone)
    rest = np.sort(rest[np.argsort(-n[rest], kind="stable")[:PAIRED]])
    place = np.full(SPACE, -1)
    place[rest] = np.arange(len(rest))
    x = np.zeros((len(rows), len(rest)), np.float32)
    for k, r in enumerate(rows):
        p = place[r]
        x[k, p[p >= 0]] = 1
    both, bad = x.T @ x, x[y > 0.5].T @ x[y > 0.5]  # whole numbers below 2**24: exact
    told = (both >= 2 * LEAST) & (np.abs(deviations(bad, both, share)) >= PAIR_Z)
    np.fill_diagonal(told, False)
    alone[rest[told.any(axis=1)]] = True
    return np.flatnonzero(alone)


def fit(rows: list[np.ndarray], toxic: list[int], rank: int = RANK) -> Model:
    """A model from the slots and labels of some rows, in the order given; ``rank`` 0 is a linear model."""
    y, n1 = np.array(toxic, float), sum(toxic)
    flat = Model(math.log((n1 + 1) / (len(toxic) - n1 + 1)), {}, np.zeros(0), np.zeros((0, rank)))
    if not 0 < n1 < len(toxic):
        return flat
    chosen = screen(rows, y)
    places = np.full(SPACE, -1)
    places[chosen] = np.arange(len(chosen))
    data = [p[p >= 0] for p in (places[r] for r in rows)]
    rng = np.random.default_rng(SEED)
    w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), rank)), flat.bias
    gw, gv, gb = np.full(len(chosen), 1e-2), np.full((len(chosen), rank), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for j in rng.permutation(len(data)):
            i = data[j]
            vi = v[i]
            s = vi.sum(axis=0)
            logit = b + w[i].sum() + 0.5 * (s @ s - (vi * vi).sum())
            g = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, logit)))) - y[j]
            gb += g * g
            b -= RATE * g / math.sqrt(gb)
            if len(i):
                dw, dv = g + DECAY * w[i], g * (s - vi) + DECAY * vi
                gw[i] += dw * dw
                gv[i] += dv * dv
                w[i] -= RATE * dw / np.sqrt(gw[i])
                v[i] -= 0.1 * RATE * dv / np.sqrt(gv[i])
    return Model(float(b), dict(zip(chosen.tolist(), range(len(chosen)))), w, v)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.array(slots(t.decode()), "<i4").tobytes() for t in utf8(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("th"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "th", "slots"])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of ``docs`` that aren't held out."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    rows = texts.select("doc_id", "toxic", F.xxhash64("text").alias("th"), "text").mapInArrow(_slots, "doc_id long, toxic int, th long, slots binary").collect()
    once = {r["th"]: r for r in sorted(rows, key=lambda r: (r["th"], r["doc_id"]), reverse=True)}
    kept = [once[k] for k in sorted(once)]
    return fit([np.frombuffer(r["slots"], "<i4") for r in kept], [min(1, r["toxic"]) for r in kept])


def scorer(model: Model, text: str = "text", keep: bool = False):
    """A mapInArrow function: the columns given, with a score of ``text`` in its place, or last to ``keep`` it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, int] = {}

        def row(term):
            r = rows.get(term)
            if r is None:
                r = model.places.get(slot(term), -1)
                if len(rows) < CACHE:
                    rows[term] = r
            return r

        for b in slices(batches, text):
            scores = []
            for doc in utf8(b.column(text)):
                found = {row(t) for t in set(TERM.findall(doc.decode().lower()))}
                found.discard(-1)
                scores.append(model.score(sorted(found)))
            columns = dict(zip(b.schema.names, b.columns))
            if not keep:
                columns = {"score" if n == text else n: c for n, c in columns.items()}
            columns["score"] = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels, sample)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; every column stays."""
    model = train(docs, labels, sample)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")]
    flat = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    ddl = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes)) + ", score double"
    kept = flat.mapInArrow(scorer(model, text, keep=True), ddl).where(F.col("score") < threshold)
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])

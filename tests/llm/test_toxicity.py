import zlib

import numpy as np

from lodestar.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in T.score(docs, labels).collect() if r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    test = sorted((r["score"], y[r["doc_id"]]) for r in rows if r["held_out"])
    pos = [i for i, (_, t) in enumerate(test, 1) if t]
    auc = (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(test) - len(pos)))
    flagged = [t for s, t in test if s >= 0.7]
    assert auc > 0.95 and sum(flagged) / len(flagged) > 0.95 and sum(flagged) / len(pos) > 0.7


def test_pairs_are_learnt():
    """Toxic only if an insult meets a group: additive weights can't part these."""
    rng, a, b = np.random.default_rng(0), 11, 22
    rows, y = [], []
    for i in range(600):
        ia, ib = i % 2, i // 2 % 2
        rows.append(np.array(sorted({*([a] if ia else []), *([b] if ib else []), *rng.integers(100, 130, 3).tolist()})))
        y.append(int(ia and ib))
    m = T.fit(rows, y)
    at = lambda *s: m.score([m.places[x] for x in s if x in m.places])
    assert a in m.places and b in m.places and at(a, b) > 0.7 > at(a) and at(b) < 0.7
    assert (m.v[m.places[a]] @ m.v[m.places[b]]) > 0


def test_logit_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = T.Model(0.3, {k: k for k in range(30)}, rng.normal(size=30), rng.normal(size=(30, T.RANK)))
    for n in (0, 1, 2, 7, 30):
        rows = sorted(rng.choice(30, n, replace=False).tolist())
        want = m.bias + sum(m.w[i] for i in rows) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(rows) for j in rows[:k])
        assert abs(m.logit(rows) - want) < 1e-9


def accuracy(m, rows, y):
    return np.mean([(m.score([m.places[s] for s in r.tolist() if s in m.places]) >= 0.5) == bool(t) for r, t in zip(rows, y)])


def test_terms_that_tell_only_together_stay_and_beat_a_linear_model():
    """Toxic if exactly one of two terms is there: alone neither tells anything."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(1200):
        ia, ib = i % 2, i // 2 % 2
        rows.append(np.array(sorted({*([11] if ia else []), *([22] if ib else []), *rng.integers(100, 160, 3).tolist()})))
        y.append(ia ^ ib)
    pairs, linear = T.fit(rows[:900], y[:900]), T.fit(rows[:900], y[:900], rank=0)
    assert {11, 22} <= set(pairs.places)
    assert accuracy(pairs, rows[900:], y[900:]) > 0.95 > 0.8 > accuracy(linear, rows[900:], y[900:])


def test_odd_empty_and_unlabelled(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = T.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 < r["score"] < 1 for r in got)
    assert T.score(empty, labels).collect() == []
    assert {r["score"] for r in T.score(odd, labels.limit(0)).collect()} == {0.5}
    kept = T.drop_toxic(odd, labels)
    assert kept.columns == odd.columns


def test_labels_of_held_out_rows_dont_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted((r["doc_id"], r["score"]) for r in T.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b

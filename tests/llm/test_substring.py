import hashlib
import random

import numpy as np

from lodestar.llm import substring as S


def brute(rows, length=20):
    """doc_id -> (n_words, n_removed, kept_sha256) by a dictionary of all windows."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ws = (text or "").encode().split()
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = [w for w, g in zip(ws, gone) if not g]
        out.append((doc_id, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def result(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.substring_dedup(df).collect())


def test_on_documents(spark, sf, docs):
    want = brute([(d["doc_id"], d["text"]) for d in docs])
    assert result(spark.read.parquet(f"{sf}/documents.parquet")) == want
    assert sum(w[2] for w in want) > 1000


def passages(seed):
    rng = random.Random(seed)
    word = lambda n=400: f"w{rng.randrange(n)}"
    shared = [[word() for _ in range(rng.randint(15, 60))] for _ in range(6)]
    common = [word() for _ in range(rng.choice([8, 20, 30]))]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice([*shared, common, common, [word(3) for _ in range(rng.randint(1, 50))], ["a"] * rng.randint(1, 60)])
            p = [word() if rng.random() < 0.02 else w for w in p]
            parts += p + [word() for _ in range(rng.randint(0, 25))]
        docs.append((d, " ".join(parts)))
    rng.shuffle(docs)
    return docs


def test_on_planted_passages(spark, monkeypatch):
    for seed in range(3):
        docs = passages(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert result(df) == brute(docs)


def test_hot_anchor_within_a_task(spark):
    rng = random.Random(9)
    line = " ".join(f"c{i}" for i in range(12))
    docs = [(d, " ".join(f"u{rng.randrange(10**9)}" for _ in range(25)) + f" {line} " + (" ".join(f"x{i}" for i in range(20)) if d % 3 == 0 else f"y{d} " * 15)) for d in range(400)]
    assert result(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)) == brute(docs)


def test_odd_and_empty(odd, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in S.remove_repeats(odd).collect()}
    assert len(S.substring_dedup(odd).collect()) == odd.count()
    assert got[(3, 1)]["n_removed"] == 0 and got[(None, 2)]["kept"] == "one two" and got[(1, 0)]["kept"] == ""
    assert got[(4, 30_000)]["n_removed"] == 30_000 - 1  # all but what the first window doesn't repeat
    assert S.substring_dedup(empty).collect() == []


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [(d, n) for d, _, n, _ in result(df)] == [(1, 0), (1, 0), (2, 30)]


def test_anchors_are_shared_by_equal_windows():
    rng = random.Random(2)
    ws = [b"w%d" % rng.randrange(5) for _ in range(500)]
    h = S.Hashes(ws)
    _, _, at, n = S.anchors(h, np.zeros(500, int))
    assert at[0] == 0 and (at[1:] == at[:-1] + n[:-1]).all() and at[-1] + n[-1] == 481

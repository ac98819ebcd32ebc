import random
from collections import defaultdict

import pytest

from lodestar.llm import mixing as M


def brute_targets(sizes, weights):
    """Fill up by small steps of a common level until all is shared."""
    total, low, high = sum(sizes), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < total:
            low = mid
        else:
            high = mid
    return [min(3 * s, low * w) for s, w in zip(sizes, weights)]


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(1, 9) for _ in range(rng.randint(1, 25))]
        weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
        assert M.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights), rel=1e-6, abs=1e-6)
    assert M.targets([], []) == []


def held(df, near):
    rows = [(r["doc_id"], len((r["text"] or "").encode().split()), r["source"]) for r in df.collect()]
    got = M.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), n) for d, n, _ in rows)
    sums = defaultdict(int)
    for _, n, s in rows:
        sums[s] += n
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, brute_targets([sums[n] for n in names], [M.WEIGHTS[i % 3] for i in range(len(names))])))
    targets = {round(r["target"], 3) for r in got}
    assert targets == {round(g, 3) for g in goal.values()} or all(any(abs(t - g) < 0.01 for g in goal.values()) for t in targets)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    taken = defaultdict(int)
    largest = max([n for _, n, _ in rows], default=0)
    for r in got:
        taken[round(r["target"], 2)] += r["taken"]
    for t, n in taken.items():
        share = sum(1 for g in goal.values() if abs(g - t) < 0.02)
        assert abs(n - t * share) <= near * largest * share, (t, n)
    return got


def test_on_documents(spark, sf, odd, empty):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    a = held(df, 1)
    b = M.mix(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in a) == sorted((r["doc_id"], r["taken"]) for r in b)
    held(odd, 1)
    assert M.mix(empty).collect() == []


def test_levels_of_blocks_keep_totals(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 60), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df, block=20).collect()
    sums = defaultdict(lambda: [0, 0.0])
    for r in got:
        sums[r["target"], r["source_size"]][0] += r["taken"]
    for (target, _), (taken, _) in sums.items():
        assert abs(taken - target) <= 60


def test_flight_keeps_both_totals():
    out = []
    f = M.Flight("x", lambda row, p: out.append((row, p)))
    rng = random.Random(8)
    sizes = [rng.randint(1, 500) for _ in range(400)]
    for i, s in enumerate(sizes):
        f.add(i, s, 0.37)
    left = f.finish()
    assert len(left) <= 2
    words = sum(sizes[i] * p for i, p in out) + sum(x[1] * x[2] for x in left)
    assert words == pytest.approx(0.37 * sum(sizes)) and sum(p for _, p in out) + sum(x[2] for x in left) == pytest.approx(0.37 * 400)


def test_take_repeats_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    times = {r["doc_id"]: r["times"] for r in M.mix(df).collect()}
    got = M.take(df)
    assert got.columns == df.columns
    counts = defaultdict(int)
    for r in got.select("doc_id").collect():
        counts[r["doc_id"]] += 1
    assert counts == {d: n for d, n in times.items() if n}

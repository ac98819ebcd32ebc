import hashlib
import random

import numpy as np
import pytest
from tests_llm_helpers import brute_components, brute_fp

from lodestar.llm import components as C
from lodestar.llm import exact_dedup as X
from lodestar.llm import simhash as S
from lodestar.llm.common import materialize


def held(rows, texts):
    """Rows (doc_id, fingerprint, component_id) against brute force over (doc_id, text)."""
    fps = [brute_fp(t) for _, t in texts]
    roots = brute_components(fps)
    least = {}
    for r, (d, _) in zip(roots, texts):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(texts, fps, roots)), key=key)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=key) == want


def test_simhash_on_documents(spark, sf, docs):
    held(S.simhash_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect(), [(d["doc_id"], d["text"]) for d in docs])


def test_simhash_odd_and_empty(odd, empty):
    held(S.simhash_dedup(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert S.simhash_dedup(empty).collect() == []


def near(rng, n, centres):
    """Fingerprints in chains and clusters around a few centres."""
    out = {0}
    for c in (rng.getrandbits(64) for _ in range(centres)):
        for _ in range(n // centres):
            f = c
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    return sorted(out)


def test_gray_index_finds_every_pair():
    rng = random.Random(3)
    fps = np.array(near(rng, 1500, 3), np.uint64)
    fps = fps[np.argsort(S.gray_rank(fps))]
    q, m = (np.concatenate(x) for x in zip(*S.GrayIndex(fps).search(fps)))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert set(zip(q.tolist(), m.tolist())) == want and len(q) == len(want)


def test_gray_rank_inverts_gray_code():
    x = np.arange(1000, dtype=np.uint64)
    assert (S.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_search_in_parts_finds_the_same(monkeypatch):
    fps = np.array(near(random.Random(8), 1200, 1), np.uint64)
    fps = fps[np.argsort(S.gray_rank(fps))]
    whole = {(a, b) for q, m in S.GrayIndex(fps).search(fps) for a, b in zip(q.tolist(), m.tolist())}
    monkeypatch.setattr(S, "HELD", 2000)
    parts = list(S.GrayIndex(fps).search(fps))
    assert len(parts) > 3 and {(a, b) for q, m in parts for a, b in zip(q.tolist(), m.tolist())} == whole


@pytest.mark.parametrize("split", [1 << 18, 100])
def test_partitions_of_the_index_keep_all_links(spark, split):
    """Many partitions, and hot ones dealt to several tasks, against brute force."""
    fps = near(random.Random(5), 3000, 2)
    roots = brute_components(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    table = materialize(spark.createDataFrame([(f,) for f in signed], "fp long"), "t")
    links = S.index_links(table, size=60, split=split)
    assert links.count() > 0
    got = {r["node"]: r["root"] for r in C.components(links).collect()}
    first = {}
    for f, r in zip(signed, roots):
        first.setdefault(r, set()).add(got.get(f, f))
    assert all(len(x) == 1 for x in first.values()) and len({min(x) for x in first.values()}) == len(first)


def test_all_links_come_from_the_index(spark, sf, docs, monkeypatch):
    """Far fewer places are visited than there are pairs, and the links are those of brute force."""
    fps = np.unique(np.array([brute_fp(d["text"]) for d in docs], np.uint64))
    fps = fps[np.argsort(S.gray_rank(fps))]
    root = S.forest(fps, fps[:0], np.ones(len(fps), bool))
    assert root.tolist() == brute_components(fps.tolist())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 700), (700, 600), (9, 9)], "a long, b long")
    got = {r["node"]: r["root"] for r in C.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 600: 500, 700: 500}


def test_pipeline_form_keeps_one_of_each(odd):
    kept = S.drop_near_copies(odd)
    assert kept.columns == odd.columns
    got = {r["component_id"] for r in S.simhash_dedup(odd).collect()}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted(x for x in got if x)


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    return [(d, max(groups[t or ""], key=lambda x: -1 if x is None else x), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]


def test_exact_against_brute_force(spark, sf, docs, odd, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        for counters in (1, 3, 1024):
            got = X.exact_dedup(df, counters).collect()
            assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == sorted(brute_exact(rows), key=str)
            assert sum(r["kept"] for r in got) == len({t or "" for _, t in rows})
            assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert X.exact_dedup(empty).collect() == []
    assert sorted(r["text"] or "" for r in X.drop_exact_copies(odd).collect()) == sorted({r["text"] or "" for r in odd.collect()})


def test_misra_gries_keeps_the_frequent():
    import pyarrow as pa

    rng = random.Random(1)
    rows = [b"hot"] * 400 + [b"%d" % rng.randrange(2000) for _ in range(800)]
    rng.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 100], pa.binary())], names=["digest"]) for i in range(0, 1200, 100)]
    (out,) = X.misra_gries(5)(batches)
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert len(got) <= 5 and 400 - 1200 // 6 <= got[b"hot"] <= 400


def test_components_without_an_id_of_their_own_stay_apart(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(5)), (None, text(5)), (9, text(1))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/t")
    kept = S.drop_near_copies(spark.read.parquet(f"file://{tmp_path}/t")).collect()
    assert sorted((r["text"], r["doc_id"] or 0) for r in kept) == sorted([(text(1), 9), (text(2), 0), (text(3), 0), (text(4), 7), (text(5), 7)])

"""The pipeline's near-copy stage: five-word shingles, similarity 0.8."""

import random

import corpus_pipeline as P
from tests_llm_helpers import alike


def test_edited_copies_go_and_others_stay(spark, tmp_path):
    rng, texts = random.Random(3), []
    for k in range(12):
        ws = [f"w{rng.randrange(4000)}" for _ in range(200)]
        texts.append(" ".join(ws))
        for edits in (1, 3, 4, 6, 12):
            other = list(ws)
            for at in rng.sample(range(200), edits):
                other[at] = f"new{k}x{at}"
            texts.append(" ".join(other))
    texts += ["", None, " \t", "two words", "Two  words"]
    rows = [(None if i % 7 == 3 else 1000 - i, t) for i, t in enumerate(texts)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(texts[i], texts[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    want = sorted(min(((d is None, d or 0) for r, (d, _) in zip(root, rows) if r == c)) for c in set(root))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"file://{tmp_path}/t")
    got = P.near_copies(spark, spark.read.parquet(f"file://{tmp_path}/t"), "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == want and len(want) < len(rows)

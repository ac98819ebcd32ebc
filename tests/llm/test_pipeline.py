import numpy as np

import corpus_pipeline as P
from lodestar.llm import toxicity as T
from lodestar.llm.common import materialize
from tests_llm_helpers import alike_roots, ids_of


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r["doc_id"] for r in T.score(docs, labels).where("predicted = 1").collect()}
    rows = [r.asDict() for r in docs.collect()]
    now = docs
    outs = []
    for name, stage in P.STAGES:
        now = materialize(stage(spark, now, sf), name.replace(" ", "-"))
        outs.append([r.asDict() for r in now.collect()])
        if name != P.STAGES[-1][0]:
            assert now.columns == columns
    ids = lambda rs: sorted(r["doc_id"] for r in rs)
    rows = [r for r in rows if r["doc_id"] not in bad]
    assert ids(outs[0]) == ids(rows)
    last = {}
    for r in rows:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    rows = [r for r in rows if last[r["text"]] == r["doc_id"]]
    assert ids(outs[1]) == ids(rows)
    rows.sort(key=lambda r: r["doc_id"])
    roots = alike_roots([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    assert ids(outs[2]) == ids(rows)
    assert set(ids(outs[3])) <= set(ids(rows)) and max(np.bincount(ids(outs[3]))) <= 3
    total, taken = (sum(len(r["text"].split()) for r in rs) for rs in (rows, outs[3]))
    assert abs(taken - total) < 0.05 * total
    want = sum(-(-(len(ids_of(r["text"])) + 1) // 4096) for r in outs[3])
    assert len(outs[4]) == want
    fill = {}
    for r in outs[4]:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096


def test_run_is_the_stages(spark, sf):
    assert P.run(spark, sf).count() > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "packing"]


def test_stages_on_odd_and_empty_tables(spark, sf, odd, empty):
    """Extra columns come through unchanged whatever they are called; nothing crashes."""
    for table in (odd, empty):
        now = table
        for name, stage in P.STAGES[:-1]:
            now = materialize(stage(spark, now, sf), "odd")
            assert now.columns == table.columns and now.dtypes == table.dtypes
            rows = now.collect()
            assert {r[c] for r in rows for c in table.columns[5:]} <= {"x"}, name
        texts = [r["text"] for r in rows]
        assert len(P.packing(spark, now, sf).collect()) >= len(texts) > 0 or table is empty

"""What a Python worker holds at once."""

import random
import tracemalloc

import pyarrow as pa

from lodestar.llm import common as C
from lodestar.llm import minhash as M
from lodestar.llm import packing as P
from lodestar.llm import toxicity as T
from lodestar.llm.tokens import default_path


def rows(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["node", "text"])


def test_slices_keep_every_row_in_order(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 100)
    texts = ["ü" * 20, None, "", "x" * 500, *["word " * 7] * 9, None, "y" * 100, ""]
    got = list(C.slices(iter([rows(texts), rows([]), rows([None, None]), rows(texts).slice(3, 4)])))
    assert [t for b in got for t in b.column("text").to_pylist()] == [*texts, None, None, *texts[3:7]]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= 100 for b in got) and len(got) > 6


def test_workers_never_hold_what_they_make_of_a_whole_batch(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 1 << 17)
    rng = random.Random(2)
    whole = rows([" ".join(f"w{rng.randrange(10_000)}" for _ in range(7_000)) for _ in range(100)])
    for run in (M._keys, M._sets):
        tracemalloc.start()
        n = sum(b.num_rows for b in run(iter([whole])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 100 and peak < 6 << 20, (run.__name__, peak)


def test_slices_change_no_result(monkeypatch):
    texts = ["", None, "one two three four five six", "a b " * 300, "Ä ö", "x" * 4000, *[f"t{i} " * i for i in range(40)]]
    model = T.Model(0.1, {}, *(T.np.zeros(0), T.np.zeros((0, T.RANK))))
    runs = [M._keys, M._sets, P.cut(default_path(), 64, 1, True), T.scorer(model), T.scorer(model, keep=True)]
    made = lambda run: [r for b in run(iter([rows(texts)])) for r in b.to_pylist()]
    want = [made(r) for r in runs]
    monkeypatch.setattr(C, "SLICE", 64)
    assert [made(r) for r in runs] == want
    assert [list(w[0]) for w in want[3:]] == [["node", "score"], ["node", "text", "score"]]


def test_toxicity_sends_each_column_once(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    kept = T.drop_toxic(odd, labels, threshold=2.0)
    node = kept._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    assert node.children().head().output().size() == len(odd.columns)
    key = lambda r: str(r)
    assert sorted(kept.collect(), key=key) == sorted(odd.collect(), key=key)

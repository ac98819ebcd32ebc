"""Per-commit shape: rows dealt out by their count, and file rows that are there twice."""

import math

from lodestar import session
from lodestar.operators import history as H


def test_rows_are_dealt_out_by_their_count(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    changes = spark.range(10_000).selectExpr("id % 2000 AS commit_id", "'f' || id AS file_path")
    files = spark.range(10_000).selectExpr("'f' || id AS path", "'m' || id % 3 AS module_name")
    assert session.tasks_for(changes) == 20 and session.tasks_for(changes.limit(7)) == 4
    shapes = H.commit_shape(changes, files)
    held = [len(p) for p in shapes.rdd.glom().collect()]
    assert sum(held) == 2_000 and max(held) < 200  # a hundred a task; merged ones hold hundreds
    assert {(r["files"], r["modules"]) for r in shapes.collect()} == {(5, 3)}
    sizes = H.commit_sizes(changes)
    assert max(len(p) for p in sizes.rdd.glom().collect()) < 200 and {r["files"] for r in sizes.collect()} == {5}


def test_a_commit_without_a_path_has_no_files(spark):
    changes = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None), (None, "b")], "commit_id int, file_path string")
    assert {r["commit_id"]: r["files"] for r in H.commit_sizes(changes).collect()} == {1: 1, 2: 0, None: 1}


def test_a_file_counts_once_in_each_of_its_modules(spark):
    changes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "gone"), (2, "a"), (3, "gone"), (None, "b")], "commit_id int, file_path string")
    files = spark.createDataFrame([("a", "m"), ("a", "m"), ("a", "n"), ("b", "m")], "path string, module_name string")
    got = {r["commit_id"]: (r["files"], r["modules"], round(r["spread"], 6)) for r in H.commit_shape(changes, files).collect()}
    third = -(math.log(1 / 3) / 3 + 2 * math.log(2 / 3) / 3) / math.log(2)
    assert got == {1: (3, 2, round(third, 6)), 2: (2, 2, 1.0), None: (1, 1, 0.0)}

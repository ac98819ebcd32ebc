"""Rows keep their numbers when a later scan is split in another way."""

from collections import Counter

import pytest

from lodestar.llm import exact_dedup as X
from lodestar.llm import mixing as M
from lodestar.llm import simhash as S


@pytest.fixture
def table(spark, tmp_path):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(i, body(i % 40), "ab"[i % 2]) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9, "doc_id").write.parquet(f"file://{tmp_path}/t")
    return spark.read.parquet(f"file://{tmp_path}/t")


def resplit(spark, df):
    """``df``'s rows, planned with every file in a partition of its own."""
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        return df.collect()
    finally:
        spark.conf.set(key, was)


def test_copies_go_whatever_the_split(spark, table):
    assert sorted(r["doc_id"] for r in resplit(spark, X.drop_exact_copies(table))) == list(range(40, 80))
    assert sorted(r["doc_id"] for r in resplit(spark, S.drop_near_copies(table))) == list(range(40))


def test_mix_takes_the_same_rows_whatever_the_split(spark, table):
    times = {r["doc_id"]: r["times"] for r in M.mix(table).collect()}
    assert Counter(r["doc_id"] for r in resplit(spark, M.take(table))) == {d: n for d, n in times.items() if n}

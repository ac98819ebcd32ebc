"""The corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns
a DataFrame.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import materialize, read_table
from lodestar.llm.exact_dedup import drop_exact_copies
from lodestar.llm.minhash import drop_shingle_copies
from lodestar.llm.mixing import take
from lodestar.llm.packing import best_fit_pack
from lodestar.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the scorer learns from ``labels``."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return drop_shingle_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 times."""
    return take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left and their places in sequences of 4,096 tokens."""
    return best_fit_pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing", mixture),
    ("packing", packing),
]

#: Toxicity is a trained model and mixing a seeded draw; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(Path(__file__).parent)]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


ODD = [
    (1, "", "en", "a", 0),
    (2, None, "en", None, 0),
    (3, "one", None, "a", 3),
    (3, "one", None, "a", 3),
    (None, "one two", "de", "b", 7),
    (4, "word " * 30_000, "en", "b", 150_000),
    (5, "a\x0b\x0cb\xa0c d e <|im_end|> ́x ñ", "es", "c", 9),
    (6, " \t\n", "es", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, ties, repeated rows, empty and very long texts, and extra columns whose names clash with ours."""
    from pyspark.sql import functions as F

    path = f"file://{tmp_path_factory.mktemp('odd')}/t"
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("size", "fp", "row_id", "digest", "grp", "block", "group_size", "score", "kind", "key", "times", "__row", "__copy", "lodestar_row", "Lodestar_Times", "root", "node", "n", "part", "slice", "role"):
        df = df.withColumn(c, F.lit("x"))
    df.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

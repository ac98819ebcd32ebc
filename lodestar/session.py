"""Session defaults and iteration storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_A_TASK = 2**18


def build(app: str = "lodestar", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again.

    Iterations call this once a round: the plan stays small and a lost executor costs no
    more than the round.  The folder is ``spark.checkpoint.dir``; one of our own is set
    only where that is unset.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/round-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame) -> int:
    """Partitions that leave a task ``ROWS_A_TASK`` rows of ``df``, or one a core where that is more.  Counts ``df``.

    Adaptive execution merges shuffled partitions into one a core up to 64 MB, in which a
    task's hash tables are many times that; a number given to ``repartition`` stays.
    """
    spark = df.sparkSession
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, -(-df.count() // ROWS_A_TASK))

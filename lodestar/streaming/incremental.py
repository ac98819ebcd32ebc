"""Incremental re-indexing as a stream: new or changed files flow into the table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.tables import append_new, read, replace


def upsert(folder: str, key: str = "id", order: str = "last_indexed_at"):
    """A foreachBatch function: of a key's rows the latest by ``order`` stays.  Replayed batches change nothing."""

    def batch(df: DataFrame, _: int) -> None:
        old = read(df.sparkSession, folder)
        rows = df if old is None else old.unionByName(df)
        latest = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("r")).select("r.*")
        replace(latest, folder, key)

    return batch


def follow(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, key: str = "id", once: bool = True):
    """Start a query that upserts Parquet rows landing in ``source`` into the table at ``folder``."""
    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(upsert(folder, key)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def churn_stream(changes: DataFrame, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """Commits of each path by week from a stream (committed_at, commit_id, file_path), late rows up to ``late``."""
    return changes.withWatermark("committed_at", late).groupBy(F.window("committed_at", window), "file_path").agg(F.approx_count_distinct("commit_id").alias("commits"))


__all__ = ["append_new", "churn_stream", "follow", "upsert"]

"""Helpers that the operators of this subpackage share.

Shared storage: whatever one stage leaves for the next goes to the folder named by
``spark.checkpoint.dir`` (a folder of our own is set only where that is unset, as in
tests).  Tables are written there as Parquet and read again, which cuts lineage and
survives the loss of any executor.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\x20\x09-\x0D"
#: Bytes of text that a Python worker takes up at once.
SLICE = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        d = sc._jsc.sc().getCheckpointDir().get()
    return d.rstrip("/") if "://" in d or d.startswith("file:") else f"file://{d.rstrip('/')}"


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodestar-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once: however a later scan is split, a row keeps it.  Second: its column."""
    name = free_name(docs, "lodestar_row")
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; executors and driver open shared files by it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="lodestar-zip-"), "lodestar_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._lodestar_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def words(text: str | bytes) -> list[bytes]:
    """The runs ``[^\\x20\\x09-\\x0D]+`` of a text, in UTF-8."""
    return (text.encode() if isinstance(text, str) else text).split()


def utf8(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value of a string column, nulls as empty."""
    return [b if b is not None else b"" for b in array.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Give freed memory back to the system; Spark keeps its Python workers, and they what they have."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches of at most ``SLICE`` bytes of ``column`` or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            yield b.slice(at, end - at)
            at = end
        release()


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of an unsigned array (wraps around)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Files to facts: a registry of extractors by language, and the fact tables that come of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import lexer, python
from .model import DDL, NAMES, Facts

#: language to a function of the text; register more to read further languages.
EXTRACTORS = {"python": python.extract} | {x: (lambda text, x=x: lexer.extract(text, x)) for x in ("typescript", "javascript", "go", "rust", "cpp")}


def one(text: str, language: str) -> Facts:
    try:
        return EXTRACTORS[language](text)
    except Exception:  # noqa: BLE001  a file that can't be read must not end the job; it is marked
        return Facts(parse_errors=True)


def facts(files: DataFrame) -> DataFrame:
    """A row of fact lists for every file (path, language, content, content_hash)."""
    schema = to_arrow_schema(StructType.fromDDL(DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, content, digest in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content", "content_hash"))):
                f = one((content or b"").decode("utf-8", "replace"), language)
                lists = {k: [dict(zip(n, x)) for x in getattr(f, k)] for k, n in NAMES.items()}
                rows.append({"path": path, "content_hash": digest, "parse_errors": f.parse_errors, **lists})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    known = files.where(F.col("language").isin(*EXTRACTORS))
    return known.select("path", "language", "content", "content_hash").mapInArrow(run, DDL)


def table(rows: DataFrame, name: str) -> DataFrame:
    """One fact list as a table, beside its file."""
    return rows.select(F.col("path").alias("file_path"), F.explode(name).alias("r")).select("file_path", "r.*")


def token_stream(files: DataFrame) -> DataFrame:
    """(file, at, token, line) for clone detection."""

    def run(batches):
        for b in batches:
            out = {"file": [], "at": [], "token": [], "line": []}
            for path, language, content in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content"))):
                for i, (token, line) in enumerate(lexer.tokens((content or b"").decode("utf-8", "replace"), language)):
                    for k, v in zip(out, (path, i, token, line)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("token", pa.string()), ("line", pa.int32())]))

    return files.select("path", "language", "content").mapInArrow(run, "file string, at long, token string, line int")


def keep_imports(now: DataFrame, before: DataFrame) -> DataFrame:
    """Facts in which a file that no longer parses keeps its former imports."""
    old = before.select("path", F.col("imports").alias("__old"))
    rows = now.join(old, "path", "left")
    return rows.withColumn("imports", F.when(F.col("parse_errors"), F.coalesce("__old", "imports")).otherwise(F.col("imports"))).drop("__old")

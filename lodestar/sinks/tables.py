"""Sinks: differential and wholesale table writes, snapshots, exports.

A table lives in versions below its folder (``v=<n>``); a reader takes the newest version
whose ``_SUCCESS`` marker exists, so a write that dies leaves the old one in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import differ


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/v={versions[-1]}") if versions else None


def replace(df: DataFrame, folder: str, key: str = "id") -> None:
    """Write a whole new version, one row a key."""
    spark = df.sparkSession
    versions = _versions(spark, folder)
    df.dropDuplicates([key]).write.mode("overwrite").parquet(f"{folder}/v={(versions or [0])[-1] + 1}")


def sync(df: DataFrame, folder: str, key: str = "id", state: str = "content_hash") -> dict[str, int]:
    """Bring a table to ``df``; says how many rows were added, updated and removed.  Nothing is written if nothing changed."""
    old = read(df.sparkSession, folder)
    if old is None:
        replace(df, folder, key)
        return {"add": df.select(key).distinct().count(), "update": 0, "remove": 0}
    counts = {"add": 0, "update": 0, "remove": 0} | {r["action"]: r["count"] for r in differ(old, df, key, state).groupBy("action").count().collect()}
    if any(counts.values()):
        replace(df, folder, key)
    return counts


def append_new(df: DataFrame, folder: str, key: str = "id") -> None:
    """Append rows whose key the table lacks (an idempotent ingest)."""
    old = read(df.sparkSession, folder)
    replace(df if old is None else old.unionByName(df.join(old.select(key), key, "left_anti"), allowMissingColumns=True), folder, key)


def append_snapshot(df: DataFrame, folder: str, snapshot_id: str) -> None:
    df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(folder)


def backfill_fixes(commits: DataFrame) -> DataFrame:
    """Classify commits that have no verdict yet; others keep theirs."""
    from ..functions.text import fix_confidence

    score = fix_confidence(F.col("message"))
    return commits.withColumn("fix_confidence", F.when(F.col("is_fix").isNull(), score).otherwise(F.col("fix_confidence"))).withColumn("is_fix", F.when(F.col("is_fix").isNull(), score >= 0.5).otherwise(F.col("is_fix")))


def envelope(command: str, data, **meta) -> str:
    """A report in the JSON envelope."""
    return json.dumps({"schema_version": 1, "tool": "lodestar", "command": command, "meta": meta, "data": data}, sort_keys=True, default=str)


def rows(df: DataFrame) -> list[dict]:
    """The rows of a report (bounded by the caller) as plain data."""
    return [json.loads(x) for x in df.toJSON().collect()]


def ndjson(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
CLIMATE = {"critical": "critical", "high": "major", "medium": "minor", "low": "info"}


def sarif(findings: DataFrame) -> str:
    """All findings (id, rule_name, severity, title, file_path, line) as SARIF 2.1.0."""
    found = [r.asDict() for r in findings.orderBy("rule_name", "file_path", "line").collect()]
    place = lambda r: dict(physicalLocation=dict(artifactLocation=dict(uri=r["file_path"]), region=dict(startLine=r["line"] or 1)))
    results = [dict(ruleId=r["rule_name"], level=LEVEL[r["severity"]], message=dict(text=r["title"]), locations=[place(r)], partialFingerprints=dict(id=str(r["id"]))) for r in found]
    driver = dict(name="lodestar", rules=[dict(id=n) for n in sorted({r["rule_name"] for r in found})])
    return json.dumps(dict(version="2.1.0", runs=[dict(tool=dict(driver=driver), results=results)]))


def code_climate(findings: DataFrame) -> str:
    found = findings.orderBy("rule_name", "file_path", "line").collect()
    return json.dumps([{"type": "issue", "check_name": r["rule_name"], "description": r["title"], "severity": CLIMATE[r["severity"]], "fingerprint": str(r["id"]), "location": {"path": r["file_path"], "lines": {"begin": r["line"] or 1}}} for r in found])


def graph_export(deps: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Module and file edges, deduplicated and sorted; targets that aren't indexed are dropped, packages are listed apart."""
    known = files.select(F.col("path").alias("target_file_path"))
    inner = deps.where("NOT is_external")
    return {
        "modules": inner.where("source_module <> target_module").select("source_module", "target_module").distinct().orderBy("source_module", "target_module"),
        "files": inner.join(known, "target_file_path", "left_semi").select("source_file_path", "target_file_path").distinct().orderBy("source_file_path", "target_file_path"),
        "externals": deps.where(F.startswith("target_module", F.lit("external:"))).select("source_module", "target_module").distinct().orderBy("source_module", "target_module"),
    }


def graph_html(edges: list[tuple[str, str]], title: str) -> str:
    """A page that lists the edges and carries them as JSON; ``<`` is escaped in data."""
    data = json.dumps(edges).replace("<", "\\u003c")
    body = "".join(f"<li>{a} → {b}</li>" for a, b in ((x.replace("<", "&lt;"), y.replace("<", "&lt;")) for x, y in edges))
    return f"<!doctype html><meta charset=utf-8><title>{title}</title><ul>{body}</ul><script type='application/json' id='graph'>{data}</script>"


def graph_tables(files: DataFrame, deps: DataFrame, symbols: DataFrame, calls: DataFrame, apis: DataFrame, accesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the property graph as views over the fact tables; nothing is stored twice."""
    node = lambda df, i, kind, label: df.select(F.col(i).alias("id"), F.lit(kind).alias("node_kind"), F.col(label).alias("label"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("edge_kind"), F.lit(1.0).alias("weight"))
    modules = files.select("module_name").distinct()
    nodes = node(modules, "module_name", "module", "module_name").unionByName(node(files, "path", "file", "path")).unionByName(node(symbols, "id", "symbol", "qualified_name")).unionByName(node(apis, "id", "api", "name")).unionByName(node(accesses.select("table").distinct(), "table", "schema_object", "table"))
    inner = deps.where("NOT is_external")
    edges = [edge(files, "module_name", "path", "contains"), edge(inner.where("source_module <> target_module").select("source_module", "target_module").distinct(), "source_module", "target_module", "depends_on"), edge(inner.where("target_file_path IS NOT NULL"), "source_file_path", "target_file_path", "depends_on"), edge(symbols, "file_path", "id", "declares"), edge(calls.where("callee_symbol_id IS NOT NULL"), "caller_symbol_id", "callee_symbol_id", "calls"), edge(apis, "file_path", "id", "exposes"), edge(apis.where("handler_symbol_id IS NOT NULL"), "id", "handler_symbol_id", "handles")]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    for kind in ("reads", "writes"):
        out = out.unionByName(edge(accesses.where(F.col("access") == kind), "symbol_id", "table", kind))
    return nodes, out.distinct()

"""Indexing end to end: files to facts, facts to resolved tables, tables to findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import run as X
from ..functions.text import stable_id
from ..operators import graph as G
from ..operators import rules as R
from ..session import settle
from ..sources.config import Config
from ..sources.files import configured_module, discover, module_of
from . import resolve


@dataclass
class Index:
    """The tables of one repository at one moment."""

    files: DataFrame
    facts: DataFrame
    dependencies: DataFrame
    symbols: DataFrame
    calls: DataFrame
    apis: DataFrame
    accesses: DataFrame
    complexity: DataFrame
    exports: DataFrame

    def modules(self) -> DataFrame:
        return self.files.select(F.col("module_name").alias("name")).distinct()

    def imports(self) -> DataFrame:
        d = self.dependencies.where("NOT is_external AND source_module <> target_module")
        return d.select("source_module", "target_module", F.col("source_file_path").alias("source_file"), F.col("target_file_path").alias("target_file"), F.col("evidence_line").alias("line"))


def index(spark: SparkSession, root: str, config: Config | None = None, cache: DataFrame | None = None) -> Index:
    """Read ``root``; files whose content ``cache`` (facts of an earlier run) holds aren't parsed again."""
    config = config or Config()
    found = discover(spark, root, config.include, config.exclude, config.max_file_bytes)
    module = configured_module(F.col("path"), config.modules, module_of(F.col("path"), config.module_depth))
    if cache is None:
        facts = X.facts(found)
    else:
        known = cache.drop("path").dropDuplicates(["content_hash"])
        hit = found.select("path", "content_hash").join(known, "content_hash")
        facts = X.facts(found.join(cache.select("content_hash").distinct(), "content_hash", "left_anti")).unionByName(hit)
    facts = settle(facts)
    files = settle(found.select("path", "language", "size_bytes", "content_hash", module.alias("module_name")).withColumn("id", stable_id("file", F.col("path"))))
    deps = settle(resolve.dependencies(X.table(facts, "imports"), files))
    own = X.table(facts, "symbols")
    synthetic = files.select(F.col("path").alias("file_path"), F.lit("module").alias("kind"), F.lit("<module>").alias("name"), F.lit("<module>").alias("qualified_name"), F.lit(1).alias("start_line"), F.lit(0).alias("end_line"), F.lit("public").alias("visibility"))
    symbols = own.unionByName(synthetic).join(files.select(F.col("path").alias("file_path"), F.col("module_name").alias("module_id")), "file_path")
    symbols = settle(symbols.withColumn("id", stable_id("symbol", F.col("file_path"), F.col("qualified_name"), F.col("start_line"))))
    raw = X.table(facts, "calls")
    real = symbols.where("kind <> 'module'")
    calls = settle(resolve.calls(raw, real, deps).join(symbols.where("kind = 'module'").select("file_path", F.col("id").alias("m")), "file_path", "left").withColumn("caller_symbol_id", F.coalesce("caller_symbol_id", "m")).drop("m"))
    key = real.select("file_path", F.col("qualified_name").alias("handler"), F.col("id").alias("handler_symbol_id"))
    apis = X.table(facts, "apis").join(key, ["file_path", "handler"], "left").withColumn("name", F.concat_ws(" ", "method", "path")).withColumn("id", stable_id("api", F.col("file_path"), F.col("name")))
    by = symbols.select("file_path", F.col("qualified_name").alias("symbol"), F.col("id").alias("symbol_id"))
    accesses = X.table(facts, "schema_refs").join(by, ["file_path", "symbol"], "left")
    return Index(files, facts, deps, symbols, calls, apis, accesses, X.table(facts, "complexity"), X.table(facts, "exports"))


def taint(ix: Index) -> DataFrame:
    """Flows from API handlers to reads, writes, eval and commands."""
    key = lambda t, c: X.table(ix.facts, t).join(ix.symbols.select("file_path", F.col("qualified_name").alias("symbol"), F.col("id").alias("sid")), ["file_path", "symbol"]).select(F.col("sid").alias("symbol"), *c)
    danger = key("security", [F.when(F.col("rule") == "security/eval", "eval").when(F.col("rule") == "security/command-exec", "command").alias("kind"), F.col("rule").alias("label")]).where("kind IS NOT NULL")
    sinks = ix.accesses.where("symbol_id IS NOT NULL").select(F.col("symbol_id").alias("symbol"), F.col("access").alias("kind"), F.col("table").alias("label")).unionByName(danger)
    apis = ix.apis.where("handler_symbol_id IS NOT NULL").select(F.col("id").alias("api"), F.col("handler_symbol_id").alias("handler"))
    flow = ix.calls.where("callee_symbol_id IS NOT NULL AND NOT is_reference").select(F.col("caller_symbol_id").alias("source"), F.col("callee_symbol_id").alias("target"))
    return G.taint_flows(apis, flow, key("inputs", []), sinks)


def dead_files(ix: Index, entries: DataFrame | None = None) -> DataFrame:
    """unused-file and possibly-unused-file findings."""
    entry = entries if entries is not None else resolve.entry_points(ix.files)
    edges = ix.dependencies.where("target_file_path IS NOT NULL").select(F.col("source_file_path").alias("source"), F.col("target_file_path").alias("target"))
    unreached = settle(G.unreachable(ix.files.select(F.col("path").alias("node")), edges, entry.select(F.col("path").alias("node"))))
    literals = X.table(ix.facts, "literals").select(F.col("file_path").alias("file"), F.col("value").alias("literal"))
    return R.unused_files(unreached, literals)


def dead_exports(ix: Index, entries: DataFrame | None = None) -> DataFrame:
    """unused-export and unused-type findings; an import without names credits all of its target's exports."""
    entry = entries if entries is not None else resolve.entry_points(ix.files)
    inner = ix.dependencies.where("target_file_path IS NOT NULL AND dependency_kind <> 're_export'")
    named = inner.where(F.size("names") > 0).select(F.col("target_file_path").alias("file"), F.explode("names").alias("name"))
    whole = inner.where(F.size("names") == 0).select(F.col("target_file_path").alias("file_path")).distinct().join(ix.exports, "file_path").select(F.col("file_path").alias("file"), "name")
    target = ix.dependencies.where("dependency_kind = 're_export'").select(F.col("source_file_path").alias("file_path"), F.col("specifier").alias("re_export_source"), F.col("target_file_path").alias("source_file")).distinct()
    forwards = ix.exports.where("re_export_source IS NOT NULL").join(target, ["file_path", "re_export_source"]).select(F.col("file_path").alias("file"), F.when(F.col("name") == "*", None).otherwise(F.col("name")).alias("name"), "source_file", F.col("re_export_name").alias("source_name"))
    used = G.used_exports(named.unionByName(whole), forwards)
    own = ix.exports.where("re_export_source IS NULL").select(F.col("file_path").alias("file"), "name", "is_type_only")
    return R.unused_exports(own, used, entry.select(F.col("path").alias("file")))


def findings(ix: Index, config: Config | None = None) -> DataFrame:
    """All rule findings: rule_name, severity, file_path, line, title, id."""
    config = config or Config()
    row = lambda df, rule, severity, path, line, title: df.select(F.lit(rule).alias("rule_name") if isinstance(rule, str) else rule.alias("rule_name"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(path).alias("file_path"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"), F.concat_ws(" ", *title).alias("title"))
    security = X.table(ix.facts, "security")
    out = [
        row(security, F.col("rule"), F.col("severity"), "file_path", "line", ["rule", "symbol"]),
        row(R.complexity_findings(ix.complexity), F.col("rule_name"), F.col("severity"), "file_path", "line", ["rule_name", "qualified_name"]),
        row(R.unresolved_imports(ix.dependencies), "unresolved-import", "medium", "source_file_path", "line", [F.lit("unresolved import"), F.col("specifier")]),
        row(R.large_classes(ix.symbols), "large-class", F.col("severity"), "file_path", None, [F.lit("large class"), F.col("owner")]),
        row(R.feature_envy(ix.symbols, ix.calls.where("NOT is_reference")), "feature-envy", F.col("severity"), "file_path", None, ["qualified_name", "foreign_module"]),
        row(dead_files(ix), F.col("rule_name"), "low", "node", None, ["rule_name", "node"]),
        row(dead_exports(ix), F.col("rule_name"), "low", "file", None, ["rule_name", "name"]),
    ]
    if config.banned_imports:
        banned = R.banned_imports(ix.dependencies.withColumn("source_module", F.col("source_file_path")), config.banned_imports)
        out.append(row(banned, F.col("rule_name"), "medium", "source_module", None, ["rule_name", "specifier"]))
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    rows = R.downrank_tests(rows, ["complexity", "security/secret", "security/eval", "security/command-exec", "security/weak-hash", "security/cors"])
    kept, stale = R.suppress(rows.withColumn("line", F.coalesce("line", F.lit(0))), X.table(ix.facts, "suppressed"))
    kept = kept.unionByName(stale.select("rule_name", "severity", "file_path", "line", F.lit("suppression covers nothing").alias("title")))
    return kept.withColumn("id", stable_id("finding", F.col("rule_name"), F.col("file_path"), F.col("title"), F.col("line")))

"""Coupling, complexity and scoring operators over the dependency and fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTERNAL, UNRESOLVED, UNINDEXED = "external:", "unresolved:", "unindexed:"
HOTSPOT_WEIGHTS = {"churn": 0.25, "coupling": 0.20, "complexity": 0.20, "fan_in": 0.12, "fan_out": 0.13}
SEVERITY = ("low", "medium", "high", "critical")


def severity_rank(col: str | Column = "severity") -> Column:
    """Severities in order, as numbers (the names don't sort that way)."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("int")
    for rank, name in enumerate(SEVERITY):
        out = F.when(F.lower(c) == name, F.lit(rank)).otherwise(out)
    return out


def local_edges(deps: DataFrame, runtime_only: bool = False) -> DataFrame:
    """Distinct internal edges between different modules."""
    rows = deps.where(~F.col("is_external") & (F.col("source_module") != F.col("target_module")))
    rows = rows.where("dependency_kind <> 'type_import'") if runtime_only else rows
    return rows.select(F.col("source_module").alias("source"), F.col("target_module").alias("target")).distinct()


def fans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Every module with its fan-in, fan-out and instability (0 when isolated)."""
    out = edges.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("fan_in"))
    joined = modules.select("name").join(out, "name", "left").join(into, "name", "left").na.fill(0, ["fan_in", "fan_out"])
    return joined.withColumn("instability", F.coalesce(F.try_divide(F.col("fan_out").cast("double"), F.col("fan_in") + F.col("fan_out")), F.lit(0.0)))


def density(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modules, edges, and edges over n(n-1), 0 when undefined."""
    one = modules.agg(F.count(F.lit(1)).alias("modules")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    return one.withColumn("density", F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("modules") * (F.col("modules") - 1)), F.lit(0.0)))


def top_hotspots(fan: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` modules of greatest 2 fan-in + 3 fan-out."""
    return fan.select("name", (2 * F.col("fan_in") + 3 * F.col("fan_out")).alias("score")).orderBy(F.desc("score"), "name").limit(n)


def summary(modules: DataFrame, deps: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row: sizes, density, cycles, top score and the risk band they give."""
    edges = local_edges(deps)
    top = top_hotspots(fans(modules, edges), 1).agg(F.coalesce(F.max("score"), F.lit(0)).alias("top_score"))
    outside = deps.where(F.col("is_external")).agg(F.count(F.lit(1)).alias("external_dependencies"))
    row = density(modules, edges).crossJoin(top).crossJoin(cycles.agg(F.count(F.lit(1)).alias("cycles"))).crossJoin(outside)
    return row.withColumn("risk", F.when(F.col("cycles") >= 3, "critical").when((F.col("cycles") > 0) | (F.col("density") >= 0.35), "high").when((F.col("density") >= 0.15) | (F.col("top_score") >= 10), "medium").otherwise("low"))


def scored_hotspots(fan: DataFrame, churn: DataFrame, complexity: DataFrame, fragmentation: DataFrame, violations: DataFrame, limit: int | None = None) -> DataFrame:
    """Modules by the weighted score: each measure over its greatest (1 at least), fragmentation as it is, times 100."""
    rows = fan.join(churn, "name", "left").join(complexity, "name", "left").join(fragmentation, "name", "left").join(violations, "name", "left").na.fill(0)
    rows = rows.withColumn("coupling", F.col("fan_in") + F.col("fan_out"))
    measures = [*HOTSPOT_WEIGHTS, "violations"]
    most = rows.agg(*[F.greatest(F.max(m).cast("double"), F.lit(1.0)).alias(f"max_{m}") for m in measures])
    score = sum((F.col(m) / F.col(f"max_{m}") * w for m, w in HOTSPOT_WEIGHTS.items()), F.lit(0.0))
    score = (score + F.col("fragmentation") * 0.07 + F.col("violations") / F.col("max_violations") * 0.03) * 100
    out = rows.crossJoin(F.broadcast(most)).withColumn("score", score).where("score > 0").select("name", "score", "churn", "fan_in", "fan_out", "coupling", "complexity", "fragmentation", "violations")
    return out.orderBy(F.desc("score"), "name").limit(limit) if limit else out


def fragmentation(owners: DataFrame, files: DataFrame) -> DataFrame:
    """Share of each module's files whose main author has under half."""
    rows = files.select(F.col("path").alias("file_path"), "module_name").join(owners, "file_path")
    return rows.groupBy(F.col("module_name").alias("name")).agg(F.avg(F.when(F.col("ownership") < 0.5, 1.0).otherwise(0.0)).alias("fragmentation"))


def cognitive_totals(complexity: DataFrame, files: DataFrame, by: str = "module_name") -> DataFrame:
    """Sum of cognitive complexity by module or by path."""
    rows = complexity.join(files.select(F.col("path").alias("file_path"), "path", "module_name"), "file_path")
    return rows.groupBy(by).agg(F.sum("cognitive").alias("cognitive"))


def abstractness(symbols: DataFrame) -> DataFrame:
    """Per file: interfaces and traits, and all types."""
    types = symbols.where(F.col("kind").isin("class", "interface", "trait", "struct", "enum", "type_alias"))
    return types.groupBy("file_path").agg(F.count_if(F.col("kind").isin("interface", "trait")).alias("abstract_types"), F.count(F.lit(1)).alias("types"))


def nearest_rank(values: DataFrame, col: str, p: float) -> DataFrame:
    """One row: the value at index round(p (n-1)) among values over 0, and 0 of none.

    A count for each distinct value is kept, so the single-partition window sees values,
    not rows.
    """
    counts = values.where(F.col(col) > 0).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.round(F.lit(p) * (F.sum("n") - 1)) + 1).alias("place"))
    reached = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).crossJoin(F.broadcast(total)).where("upto >= place")
    return reached.agg(F.coalesce(F.min("v"), F.lit(0.0)).alias("value"))


def component_metrics(fan: DataFrame, files: DataFrame, types: DataFrame, complexity: DataFrame, churn: DataFrame) -> DataFrame:
    """Per module: files, fans, instability, abstractness, distance |A+I-1|, complexity, churn."""
    sizes = files.groupBy(F.col("module_name").alias("name")).agg(F.count(F.lit(1)).alias("files"))
    kinds = types.join(files.select(F.col("path").alias("file_path"), F.col("module_name").alias("name")), "file_path").groupBy("name").agg(F.sum("abstract_types").alias("abstract_types"), F.sum("types").alias("types"))
    rows = fan.join(sizes, "name", "left").join(kinds, "name", "left").join(complexity, "name", "left").join(churn, "name", "left").na.fill(0)
    a = F.coalesce(F.try_divide(F.col("abstract_types").cast("double"), F.col("types")), F.lit(0.0))
    return rows.withColumn("abstractness", a).withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def coverage_rollup(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """Lines found and hit by module; the rate is 1 where there is nothing to cover."""
    rows = coverage.join(files.select(F.col("path").alias("file_path"), "module_name"), "file_path").groupBy("module_name").agg(F.sum("lines_found").alias("lines_found"), F.sum("lines_hit").alias("lines_hit"))
    return rows.withColumn("line_rate", F.coalesce(F.try_divide(F.col("lines_hit").cast("double"), F.col("lines_found")), F.lit(1.0)))


def tally(findings: DataFrame, by: str) -> DataFrame:
    """Findings by rule or severity."""
    return findings.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def self_check(findings: DataFrame, files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per rule: files it flags, their KiB, fix mass, mass a KiB, and lift over all files' rate (0 if that is 0)."""
    sized = files.select("path", "size_bytes").join(fixes.select("path", "mass"), "path", "left").na.fill(0.0, ["mass"])
    base = sized.agg((F.sum(F.col("mass").cast("decimal(28,9)")).cast("double") * 1024 / F.sum("size_bytes")).alias("base"))
    flagged = findings.select("rule_name", F.col("file_path").alias("path")).distinct().join(sized, "path")
    rows = flagged.groupBy("rule_name").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.sum(F.col("mass").cast("decimal(28,9)")).cast("double").alias("mass"))
    rate = F.coalesce(F.try_divide(F.col("mass") * 1024, F.col("bytes")), F.lit(0.0))
    return rows.crossJoin(F.broadcast(base)).select("rule_name", "files", "bytes", "mass", rate.alias("rate"), F.coalesce(F.try_divide(rate, "base"), F.lit(0.0)).alias("lift"))


ROLES = tuple("controller resolver route handler middleware service usecase repository dao model entity".split())  # high layers first


def role_of(path: Column) -> Column:
    """The first architectural role named in a path."""
    out = F.lit(None).cast("string")
    for role in reversed(ROLES):
        out = F.when(F.lower(path).contains(role), role).otherwise(out)
    return out


def conventions(deps: DataFrame, least: int = 3, report: float = 0.70, violation: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(conventions, deviations): the dominant direction between two roles, and the edges against it."""
    rows = deps.select("source", "target", role_of(F.col("source")).alias("a"), role_of(F.col("target")).alias("b")).where("a <> b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    counts = rows.groupBy(low.alias("lo"), high.alias("hi")).agg(F.count_if(F.col("a") == low).alias("forward"), F.count_if(F.col("a") == high).alias("backward"))
    ahead = F.col("forward") >= F.col("backward")
    total = F.col("forward") + F.col("backward")
    found = counts.select(F.when(ahead, F.col("lo")).otherwise(F.col("hi")).alias("from_role"), F.when(ahead, F.col("hi")).otherwise(F.col("lo")).alias("to_role"), F.greatest("forward", "backward").alias("matching"), total.alias("total"))
    found = found.withColumn("confidence", F.col("matching").cast("double") / F.col("total")).where((F.col("total") >= least) & (F.col("confidence") >= report))
    against = rows.join(F.broadcast(found), (F.col("a") == F.col("to_role")) & (F.col("b") == F.col("from_role")))  # roles: 55 pairs at most
    return found, against.select("source", "target", "from_role", "to_role", F.when(F.col("confidence") > violation, "violation").otherwise("warning").alias("severity"))


def database_convention(paths: DataFrame, least: int = 3, report: float = 0.70) -> DataFrame:
    """The role that accesses the database, if one does in most files; files without a role count in the total."""
    counts = paths.select(role_of(F.col("path")).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("matching"))
    total = counts.agg(F.sum("matching").alias("total"))
    best = counts.where("role IS NOT NULL").orderBy(F.desc("matching"), "role").limit(1)
    return best.crossJoin(total).withColumn("confidence", F.col("matching") / F.col("total")).where((F.col("total") >= least) & (F.col("confidence") >= report))


def snapshot_metrics(modules: DataFrame, deps: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The structural metrics of a snapshot in long form."""
    edges = local_edges(deps)
    wide = density(modules, edges).crossJoin(files.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))).crossJoin(symbols.agg(F.count(F.lit(1)).alias("symbols"))).crossJoin(deps.agg(F.count(F.lit(1)).alias("dependencies"), F.count_if(F.col("is_external")).alias("external_dependencies")))
    names = [c for c in wide.columns]
    return wide.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("metric_name", "value"))


def first_import_sites(deps: DataFrame) -> DataFrame:
    """The first (file, line) that imports each specifier."""
    return deps.groupBy("specifier").agg(F.min(F.struct(F.col("source_module").alias("site"), F.col("evidence_line").alias("line"))).alias("s")).select("specifier", "s.site", "s.line")

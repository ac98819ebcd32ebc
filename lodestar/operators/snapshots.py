"""Set operations and windows over snapshots and other versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACKED = ("modules", "dependencies", "external_dependencies", "cycles", "coupling_density", "files", "symbols", "findings", "hotspots", "violations", "complexity")


def added_removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys only the new side has (added) and only the old side has (removed)."""
    a, b = new.select(*keys).distinct(), old.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, keys, "left_anti").withColumn("change", F.lit("removed")))


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added and removed edges by all key fields; edges within a module don't count."""
    keys = ["source_module", "target_module", "specifier"]
    apart = "source_module <> target_module"
    return added_removed(old.where(apart), new.where(apart), keys)


def diff_risk(diff: DataFrame) -> DataFrame:
    """One row: added and removed, and the band (ten added: high, any change: medium)."""
    row = diff.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    return row.withColumn("risk", F.when(F.col("added") >= 10, "high").when(F.col("added") + F.col("removed") > 0, "medium").otherwise("low"))


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed by content hash."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def split_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identities that are new and those that are resolved."""
    return added_removed(old, new, ["identity"]).select("identity", F.when(F.col("change") == "added", "new").otherwise("resolved").alias("state"))


def with_ordinals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number repeats of a key from 0, so that equal findings or calls keep apart."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def metric_history(metrics: DataFrame) -> DataFrame:
    """Each metric of each snapshot with its change from the snapshot before."""
    w = Window.partitionBy("metric_name").orderBy("place")
    return metrics.select("metric_name", "place", "value", (F.col("value") - F.lag("value").over(w)).alias("delta"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """First, last, change, least and greatest value of each metric."""
    rows = metrics.groupBy("metric_name").agg(F.min(F.struct("place", "value")).alias("f"), F.max(F.struct("place", "value")).alias("l"), F.min("value").alias("least"), F.max("value").alias("most"))
    return rows.select("metric_name", F.col("f.value").alias("first"), F.col("l.value").alias("last"), (F.col("l.value") - F.col("f.value")).alias("change"), "least", "most")


def drift(metrics: DataFrame, base: int, head: int) -> DataFrame:
    """Metrics that differ between two snapshots; one that is missing counts as 0."""
    rows = metrics.where(F.col("place").isin(base, head)).groupBy("metric_name").agg(F.coalesce(F.sum(F.when(F.col("place") == base, F.col("value"))), F.lit(0)).alias("base"), F.coalesce(F.sum(F.when(F.col("place") == head, F.col("value"))), F.lit(0)).alias("head"))
    percent = F.when(F.col("base") == 0, F.when(F.col("head") == 0, 0.0).otherwise(100.0)).otherwise(F.try_divide((F.col("head") - F.col("base")).cast("double") * 100, F.col("base").cast("double")))
    return rows.where("base <> 0 OR head <> 0").withColumn("delta", F.col("head") - F.col("base")).withColumn("percent", percent)


def trend(cycles: int, percent: float, dependencies: int) -> str:
    """stable, worsening or improving, from the deltas of cycles, coupling (%) and dependencies."""
    if cycles == 0 and dependencies == 0 and abs(percent) < 1:
        return "stable"
    if cycles > 0 or percent > 10 or dependencies > 10:
        return "worsening"
    return "improving" if cycles < 0 or percent < -10 or dependencies < -10 else "stable"


def regressions(metrics: DataFrame, base: int, head: int, gated: list[str]) -> DataFrame:
    """Gated metrics that rose."""
    return drift(metrics, base, head).where(F.col("metric_name").isin(gated) & (F.col("delta") > 0))


def gate(metrics: DataFrame, base: int, head: int, gated: list[str], new_cycles: DataFrame) -> bool:
    """Does the change pass: no new cycle and no gated metric that rose?"""
    return new_cycles.isEmpty() and regressions(metrics, base, head, gated).isEmpty()


def latest(snapshots: DataFrame, back: int = 0) -> DataFrame:
    """The snapshot ``back`` places before the newest."""
    return snapshots.orderBy(F.desc("created_at"), F.desc("id")).offset(back).limit(1)


def last_points(metrics: DataFrame, metric: str, n: int) -> DataFrame:
    """The last ``n`` values of a metric, oldest first."""
    return metrics.where(F.col("metric_name") == metric).orderBy(F.desc("place")).limit(n).orderBy("place")


def new_cycles(cycles: DataFrame, base_edges: DataFrame) -> DataFrame:
    """Cycles with a hop that the base edges don't hold."""
    hops = cycles.withColumn("id", F.array_join("cycle", " > ")).select("id", F.explode(F.expr("transform(cycle, (x, i) -> struct(x AS source, cycle[(i + 1) % size(cycle)] AS target))")).alias("h")).select("id", "h.source", "h.target")
    return hops.join(base_edges.select("source", "target").distinct(), ["source", "target"], "left_anti").select("id").distinct()


def ratchet(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """What of the stored debt is still owed."""
    return stored.select(*keys).intersect(current.select(*keys))


def differ(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """(key, action): add, update or remove, for a differential write."""
    a, b = old.select(key, F.col(state).alias("__was")), new.select(key, F.col(state).alias("__is"))
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full_outer")
    action = F.when(F.col("__a").isNull(), "add").when(F.col("__b").isNull(), "remove").when(~F.col("__was").eqNullSafe(F.col("__is")), "update")
    return both.select(key, action.alias("action")).where("action IS NOT NULL")


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of rows; a limit of 0 means all."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def capped(rows: DataFrame, key: str, order: list[str], each: int, most: int) -> DataFrame:
    """At most ``each`` rows a key and ``most`` in all."""
    kept = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= each).drop("__r")
    return kept.orderBy(key, *order).limit(most)

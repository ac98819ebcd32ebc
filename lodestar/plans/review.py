"""Reviewing a change: what is new, what it touches, and whether it passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coupling import severity_rank

FAIL_ON = {"any": 0, "medium": 1, "high": 2}


def holds_changed_token(clones: DataFrame, tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Clone instances (file, start_line, end_line) with a token on a changed line.

    tokens (file, line) carry only lines that hold code; ranges (path, start, end).  Changed
    token lines come first, so instances meet few rows.
    """
    r = ranges.select(F.col("path").alias("rp"), F.col("start").alias("rs"), F.col("end").alias("re"))
    touched = tokens.select(F.col("file").alias("tf"), F.col("line").alias("tl")).distinct().join(r, (F.col("tf") == F.col("rp")) & F.col("tl").between(F.col("rs"), F.col("re")), "left_semi")
    return clones.join(touched, (F.col("file") == F.col("tf")) & F.col("tl").between(F.col("start_line"), F.col("end_line")), "left_semi")


def leaf_changes(changes: DataFrame) -> DataFrame:
    """Changes without the folders that some commit rows name beside their files.

    A folder is a proper ancestor of another path of its commit, found by an equi-join on
    ancestors.
    """
    parts = F.split("file_path", "/")
    above = changes.select("commit_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"), "file_path").where("folder <> file_path").select("commit_id", F.col("folder").alias("file_path")).distinct()
    return changes.join(above, ["commit_id", "file_path"], "left_anti")


def risk(worst: str | None, cycles: int, clones: int) -> str:
    """critical, high, medium or low from the gravest new finding, new cycles and new clones."""
    if worst == "critical":
        return "critical"
    if cycles or worst == "high":
        return "high"
    return "medium" if worst == "medium" or clones else "low"


def fails(fail_on: str, findings: int, cycles: int, clones: int, worst_rank: int) -> bool:
    """New cycles always fail; findings by their gravest; clones under ``any`` only."""
    if fail_on == "any":
        return bool(findings or cycles or clones)
    return bool(cycles) or worst_rank >= FAIL_ON[fail_on]


def review(new_findings: DataFrame, new_cycles: DataFrame, new_clones: DataFrame, fail_on: str = "high") -> dict:
    """The verdict on a change."""
    row = new_findings.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(severity_rank()), F.lit(-1)).alias("worst")).first()
    cycles, clones = new_cycles.count(), new_clones.count()
    worst = (None, "low", "medium", "high", "critical")[row["worst"] + 1]
    by_rule = {r["rule_name"]: r["n"] for r in new_findings.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"findings": row["n"], "cycles": cycles, "clones": clones, "risk": risk(worst, cycles, clones), "fails": fails(fail_on, row["n"], cycles, clones, row["worst"]), "rationale": [f"{n} new {r} finding(s)" for r, n in sorted(by_rule.items())] + [f"{cycles} new dependency cycle(s)"] * bool(cycles)}

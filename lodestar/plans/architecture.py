"""Contract commands: drafts, suggested components, template fit, freezing and checking."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent
from ..operators import rules as R
from ..sources.config import Contract


def declared_edges(deps: DataFrame) -> DataFrame:
    """Module edges with how many imports stand behind each."""
    inner = deps.where("NOT is_external AND source_module <> target_module")
    return inner.groupBy("source_module", "target_module").agg(F.count(F.lit(1)).alias("imports"))


def common_folder(files: DataFrame) -> DataFrame:
    """(module, glob): the deepest folder that holds all of a module's files."""
    parts = files.select("module_name", F.split(parent(F.col("path")), "/").alias("d"))
    # the least and the greatest path of a module share what all its paths share
    ends = parts.groupBy("module_name").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    same = F.expr("filter(transform(sequence(1, greatest(1, least(size(a), size(b)))), i -> CASE WHEN slice(a, 1, i) = slice(b, 1, i) THEN array_join(slice(a, 1, i), '/') END), x -> x IS NOT NULL AND x <> '')")
    return ends.select("module_name", F.when(F.size(same) > 0, F.concat(F.element_at(same, -1), F.lit("/**"))).otherwise("*").alias("glob"))


def interface_hints(deps: DataFrame, files: DataFrame, share: float = 0.8) -> DataFrame:
    """(module, path): the file that takes 80 % or more of a module's imports from outside; modules of one file have none."""
    inner = deps.where("target_file_path IS NOT NULL AND source_module <> target_module")
    counts = inner.groupBy(F.col("target_module").alias("module_name"), F.col("target_file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("module_name")
    many = files.groupBy("module_name").count().where("count > 1").select("module_name")
    best = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).where(F.col("share") >= share)
    return best.join(many, "module_name", "left_semi").select("module_name", "path", "share")


def draft(files: DataFrame, deps: DataFrame) -> DataFrame:
    """A component for each module: its glob, what it depends on, and the file that looks like its interface."""
    uses = declared_edges(deps).groupBy(F.col("source_module").alias("module_name")).agg(F.sort_array(F.collect_list("target_module")).alias("depends_on"))
    out = common_folder(files).join(uses, "module_name", "left").join(interface_hints(deps, files).select("module_name", F.col("path").alias("interface")), "module_name", "left")
    return out.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))


def template_fit(contract: Contract, canonical: str, files: DataFrame, edges: DataFrame) -> tuple[str, float] | None:
    """(root, score) of the best place for a template: share of files it covers times share of edges it allows.

    Candidate roots are folders that hold a folder which the template's globs name; there
    are as many as such folders, and each is one pass of aggregates.
    """
    anchors = {g.removeprefix(canonical).split("/")[0] for _, g in contract.globs() if g.startswith(canonical)} - {"", "*", "**"}
    parts = F.split("path", "/")
    found = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(F.get(parts, i).isin(*anchors), F.array_join(F.slice(parts, 1, i), "/")))).alias("root")).where("root IS NOT NULL").distinct()
    allowed = set(contract.depends)
    best = None
    for root in sorted(r["root"] for r in found.collect()):
        at = f"{root}/" if root else ""
        globs = [(n, at + g.removeprefix(canonical)) for n, g in contract.globs()]
        comps = R.assign_components(files, globs).where("component IS NOT NULL").select("path", "component")
        a, b = comps.select(F.col("path").alias("source"), F.col("component").alias("ca")), comps.select(F.col("path").alias("target"), F.col("component").alias("cb"))
        ok = F.col("ca") == F.col("cb")
        for s, t in allowed:
            ok = ok | ((F.col("ca") == s) & (F.col("cb") == t))
        e = edges.join(a, "source").join(b, "target").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok")).first()
        c = comps.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("k")).first()
        if c["n"] >= 2 and c["k"] >= 2 and e["n"]:
            score = c["n"] / files.count() * e["ok"] / e["n"]
            if best is None or (score, -len(root)) > (best[1], -len(best[0])):
                best = (root, score)
    return best


def freeze(findings: DataFrame) -> str:
    """The ids of today's debt, as a baseline file."""
    return json.dumps(sorted(r["id"] for r in findings.select("id").distinct().collect()), indent=0)


def tighten(stored: DataFrame, current: DataFrame) -> str:
    """The baseline without what has been paid off; it never grows."""
    return freeze(stored.select("id").intersect(current.select("id")))


def check(contract: Contract, verdicts: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Findings of a contract under its mode: every verdict but ``declared``."""
    from ..functions.text import stable_id

    rows = verdicts.where("verdict <> 'declared'").withColumn("severity", F.lit("high")).withColumn("id", stable_id("contract", F.col("verdict"), F.col("source_file_path"), F.col("target_file_path")))
    return R.by_mode(rows, contract.mode, frozen if frozen is not None else rows.limit(0))


def template(contract: Contract, canonical: str, root: str) -> Contract:
    """A template bound to another root."""
    return replace(contract, components={n: [root + g.removeprefix(canonical) for g in gs] for n, gs in contract.components.items()})

"""Finding rules and the architecture contract.

Each rule is a filter, a join or an aggregate that ends in rows of (rule_name, severity,
file_path or target, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import glob_regex, is_test_path
from .coupling import nearest_rank, severity_rank

COMPLEX_COGNITIVE, COMPLEX_CYCLOMATIC = (25, 15), 10
IDIOMS = tuple(tuple(x.split()) for x in ("req res next err", "req res next error", "request response next error", "event context callback"))


def complexity_findings(complexity: DataFrame) -> DataFrame:
    """complexity (cognitive 25 high; 15 or cyclomatic 10 medium), long-function (150 medium, 75 low), long-parameter-list (10 medium, 7 low)."""
    c = F.col("cognitive")
    rules = [
        ("complexity", F.when(c >= 25, "high").when((c >= 15) | (F.col("cyclomatic") >= 10), "medium")),
        ("long-function", F.when(F.col("line_count") >= 150, "medium").when(F.col("line_count") >= 75, "low")),
        ("long-parameter-list", F.when(F.col("param_count") >= 10, "medium").when(F.col("param_count") >= 7, "low")),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("rule_name"), s.alias("severity")) for n, s in rules])
    return complexity.select("file_path", "qualified_name", "line", F.explode(F.filter(each, lambda x: x["severity"].isNotNull())).alias("r")).select("r.rule_name", "r.severity", "file_path", "qualified_name", "line")


def severity_floor(findings: DataFrame, least: int) -> DataFrame:
    """Findings at or over a severity rank, gravest first, then by title."""
    return findings.where(severity_rank() >= least).orderBy(severity_rank().desc(), "title", "id")


def downrank_tests(findings: DataFrame, rules: list[str]) -> DataFrame:
    """Findings of ``rules`` in test code become low."""
    return findings.withColumn("severity", F.when(F.col("rule_name").isin(rules) & is_test_path(F.col("file_path")), "low").otherwise(F.col("severity")))


def suppress(findings: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that no marker covers, markers that cover none); a marker covers its line and the one after it."""
    m = markers.select(F.col("file_path").alias("mf"), F.col("line").alias("ml"))
    covered = (F.col("file_path") == F.col("mf")) & F.col("line").between(F.col("ml"), F.col("ml") + 1)
    kept = findings.join(m, covered, "left_anti")
    stale = m.join(findings.select("file_path", "line"), covered, "left_anti").select(F.col("mf").alias("file_path"), F.col("ml").alias("line"), F.lit("stale-suppression").alias("rule_name"), F.lit("low").alias("severity"))
    return kept, stale


def changed_since(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings with evidence in a changed file."""
    return findings.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


def touching(findings: DataFrame, text: str) -> DataFrame:
    """Findings whose title or file holds ``text``, whatever its case."""
    return findings.where(F.lower("title").contains(text.lower()) | F.lower("file_path").contains(text.lower()))


def in_ranges(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings whose lines meet a changed range of their file."""
    r = ranges.select(F.col("path").alias("rp"), F.col("start").alias("rs"), F.col("end").alias("re"))
    return findings.join(r, (F.col("file_path") == F.col("rp")) & (F.col("line") <= F.col("re")) & (F.coalesce("end_line", "line") >= F.col("rs")), "left_semi")


def enclosing_symbol(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The innermost symbol around each (file_path, line)."""
    s = symbols.select(F.col("file_path").alias("sf"), "qualified_name", "start_line", "end_line")
    hit = lines.join(s, (F.col("file_path") == F.col("sf")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.groupBy("file_path", "line").agg(F.min(F.struct(F.col("end_line") - F.col("start_line"), F.col("qualified_name"))).alias("m")).select("file_path", "line", F.col("m.qualified_name").alias("symbol"))


def specifier_matches(spec: Column, pattern: str) -> Column:
    """exact, ``prefix*``, ``*suffix`` or ``*infix*``."""
    body = pattern.strip("*")
    if pattern.startswith("*") and pattern.endswith("*") and len(pattern) > 1:
        return spec.contains(body)
    if pattern.endswith("*"):
        return spec.startswith(body)
    return spec.endswith(body) if pattern.startswith("*") else spec == pattern


def banned_imports(deps: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``patterns``: name to pattern; a finding for each import it matches."""
    rules = F.array(*[F.when(specifier_matches(F.col("specifier"), p), F.lit(f"banned-import/{n}")) for n, p in patterns.items()])
    return deps.select("source_module", "specifier", F.explode(F.array_compact(rules)).alias("rule_name"))


def boundary_violations(deps: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rules``: (name, from, to) modules that mustn't depend on one another, whatever their case."""
    table = deps.sparkSession.createDataFrame(rules, "rule_name string, f string, t string")  # configuration
    on = (F.lower("source_module") == F.lower("f")) & (F.lower("target_module") == F.lower("t"))
    return deps.join(F.broadcast(table), on).groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"))


def unresolved_imports(deps: DataFrame) -> DataFrame:
    """One finding for each (file, specifier) with nothing on disk, at its first line."""
    return deps.where(F.startswith("target_module", F.lit("unresolved:"))).groupBy("source_file_path", "specifier").agg(F.min("evidence_line").alias("line"))


def feature_envy(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions with 5 or more calls into one other module, three times their own and half of all."""
    s = symbols.where("module_id IS NOT NULL")
    callee = s.select(F.col("id").alias("callee_symbol_id"), F.col("module_id").alias("to_module"))
    counts = calls.join(callee, "callee_symbol_id").groupBy("caller_symbol_id", "to_module").agg(F.count(F.lit(1)).alias("n"))
    caller = s.where(F.col("kind").isin("function", "method") & ~is_test_path(F.col("file_path"))).select(F.col("id").alias("caller_symbol_id"), "qualified_name", "file_path", "module_id")
    rows = counts.join(caller, "caller_symbol_id").groupBy("caller_symbol_id", "qualified_name", "file_path", "module_id").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("to_module") == F.col("module_id"), F.col("n"))), F.lit(0)).alias("own"),
        F.max_by("to_module", F.when(F.col("to_module") != F.col("module_id"), F.struct("n", F.col("to_module")))).alias("foreign_module"),
        F.max(F.when(F.col("to_module") != F.col("module_id"), F.col("n"))).alias("foreign_calls"),
    )
    envious = (F.col("foreign_calls") >= 5) & (F.col("foreign_calls") >= 3 * F.greatest("own", F.lit(1))) & (F.col("foreign_calls") * 2 >= F.col("total"))
    return rows.where(envious).withColumn("severity", F.when((F.col("own") == 0) & (F.col("foreign_calls") >= 10), "medium").otherwise("low"))


def large_classes(symbols: DataFrame, low: int = 20, medium: int = 30) -> DataFrame:
    """Types with 20 or more methods (30: medium)."""
    owner = F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1)
    methods = symbols.where("kind = 'method'").withColumn("owner", owner).where("owner <> ''").groupBy("file_path", "owner").agg(F.count(F.lit(1)).alias("methods"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    types = symbols.where(F.col("kind").isin("class", "struct", "enum") & ~is_test_path(F.col("file_path"))).select("file_path", F.col("qualified_name").alias("owner"))
    return types.join(methods, ["file_path", "owner"]).where(F.col("methods") >= low).withColumn("severity", F.when(F.col("methods") >= medium, "medium").otherwise("low"))


def data_clumps(functions: DataFrame, least: int = 3) -> DataFrame:
    """Groups of three or more parameter names that three or more functions share.

    ``functions``: (function, names).  Names are sorted, distinct and cut at twelve, so a
    signature gives at most 220 triples; triples with one set of members make one group.
    """
    rows = functions.select("function", F.slice(F.array_sort(F.array_distinct("names")), 1, 12).alias("names"))
    triple = "flatten(flatten(transform(names, (a, i) -> transform(slice(names, i + 2, 12), (b, j) -> transform(slice(names, i + j + 3, 12), c -> array(a, b, c))))))"
    triples = rows.select("function", F.explode(F.expr(triple)).alias("triple"))
    shared = triples.groupBy("triple").agg(F.sort_array(F.collect_set("function")).alias("functions")).where(F.size("functions") >= least)
    groups = shared.groupBy("functions").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("triple")))).alias("names"))
    idiom = reduce(lambda a, b: a | b, (F.size(F.array_except("names", F.array(*map(F.lit, i)))) == 0 for i in IDIOMS))
    return groups.where(~idiom).withColumn("severity", F.when((F.size("names") >= 4) & (F.size("functions") >= 4), "medium").otherwise("low"))


def unused_exports(exports: DataFrame, used: DataFrame, entries: DataFrame) -> DataFrame:
    """unused-export and unused-type: exports of files that aren't entry points which nothing uses."""
    rows = exports.join(used, ["file", "name"], "left_anti").join(entries.select("file"), "file", "left_anti")
    return rows.select("file", "name", F.when(F.col("is_type_only"), "unused-type").otherwise("unused-export").alias("rule_name"))


def unused_files(unreached: DataFrame, literals: DataFrame) -> DataFrame:
    """unused-file; possibly-unused-file where a string elsewhere ends in the file's path (joined by base name)."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    named = literals.select("literal", F.col("file").alias("by"), base(F.col("literal")).alias("b"))
    hit = unreached.withColumn("b", base(F.col("node"))).join(named, "b").where("by <> node").where(F.endswith("node", F.regexp_replace("literal", r"^(\./|\.\./)+", ""))).select("node").distinct().withColumn("named", F.lit(True))
    return unreached.select("node").join(hit, "node", "left").select("node", F.when(F.col("named"), "possibly-unused-file").otherwise("unused-file").alias("rule_name"))


def unused_dependencies(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """Declared packages that nothing imports; the rule tells dev and optional ones apart."""
    rule = F.when(F.col("scope") == "dev", "unused-dev-dependency").when(F.col("scope") == "optional", "unused-optional-dependency").otherwise("unused-dependency")
    return declared.join(imported.select("name").distinct(), "name", "left_anti").withColumn("rule_name", rule)


def unlisted_dependencies(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported packages that no manifest lists, at their first site."""
    return imported.join(declared.select("name").distinct(), "name", "left_anti").groupBy("name").agg(F.min(F.struct("file_path", "line")).alias("first")).select("name", "first.file_path", "first.line")


# ---- the contract


def assign_components(files: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """(path, component) by the most specific glob: longest literal prefix, then longest glob.

    A tie between two components marks the file ``contested``.  Globs are configuration, so
    they become expressions and nothing is joined.
    """
    def row(component, glob):
        literal = len(glob.split("*")[0])
        return F.when(F.col("path").rlike(glob_regex(glob)), F.struct(F.lit(literal).alias("prefix"), F.lit(len(glob)).alias("length"), F.lit(component).alias("component")))

    hits = F.array_compact(F.array(*[row(c, g) for c, g in globs]))
    best = F.struct(F.array_max("hits")["prefix"].alias("prefix"), F.array_max("hits")["length"].alias("length"))
    rows = files.withColumn("hits", hits).where(F.size("hits") > 0).withColumn("best", best)
    names = F.array_distinct(F.transform(F.filter("hits", lambda h: (h["prefix"] == F.col("best.prefix")) & (h["length"] == F.col("best.length"))), lambda h: h["component"]))
    return rows.select("path", F.when(F.size(names) == 1, names[0]).alias("component"), (F.size(names) > 1).alias("contested"))


def component_edges(deps: DataFrame, components: DataFrame) -> DataFrame:
    a, b = components.select(F.col("path").alias("source_file_path"), F.col("component").alias("source")), components.select(F.col("path").alias("target_file_path"), F.col("component").alias("target"))
    return deps.join(a, "source_file_path").join(b, "target_file_path").where("source <> target")


def contract_verdicts(edges: DataFrame, declared: DataFrame, forbidden: DataFrame, restricted: DataFrame, interfaces: DataFrame) -> DataFrame:
    """A verdict for every component edge: restricted-access, forbidden-dependency, interface-bypass, declared or divergence.

    restricted: (target, source allowed); interfaces: (target, target_file_path) files that
    may be imported from outside.  The contract is configuration; edges may be large.
    """
    allow = restricted.withColumn("ok", F.lit(True))
    guarded = restricted.select("target").distinct().withColumn("guarded", F.lit(True))
    faced = interfaces.select("target").distinct().withColumn("faced", F.lit(True))
    rows = edges.join(guarded, "target", "left").join(allow, ["target", "source"], "left")
    rows = rows.join(forbidden.select("source", "target").distinct().withColumn("forbidden", F.lit(True)), ["source", "target"], "left")
    rows = rows.join(declared.select("source", "target").distinct().withColumn("declared", F.lit(True)), ["source", "target"], "left")
    rows = rows.join(faced, "target", "left").join(interfaces.withColumn("inner_ok", F.lit(True)), ["target", "target_file_path"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = F.when(yes("guarded") & ~yes("ok"), "restricted-access").when(yes("forbidden"), "forbidden-dependency").when(yes("faced") & ~yes("inner_ok"), "interface-bypass").when(yes("declared"), "declared").otherwise("divergence")
    return rows.select("source", "target", "source_file_path", "target_file_path", verdict.alias("verdict"))


def absences(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared edges that nothing uses."""
    return declared.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti")


def required_missing(files: DataFrame, required: DataFrame, deps: DataFrame) -> DataFrame:
    """Files of a component that must import something they don't: required (component, specifier)."""
    wanted = files.join(required, "component")
    return wanted.join(deps.select(F.col("source_file_path").alias("path"), "specifier").distinct(), ["path", "specifier"], "left_anti")


def slice_violations(edges: DataFrame) -> DataFrame:
    """Edges between slices of one layer (component ``layer/slice``), but through ``@x`` paths."""
    layer, slice_ = (lambda c: F.split(c, "/")[0]), (lambda c: F.split(c, "/")[1])
    return edges.where((layer(F.col("source")) == layer(F.col("target"))) & (slice_(F.col("source")) != slice_(F.col("target"))) & ~F.col("target_file_path").contains("/@x/"))


def budget_findings(per_file: DataFrame, budgets: DataFrame) -> DataFrame:
    """Components whose cognitive total is over budget."""
    return per_file.groupBy("component").agg(F.sum("cognitive").alias("cognitive")).join(budgets, "component").where("cognitive > budget")


def coverage_floor(per_file: DataFrame, floors: DataFrame) -> DataFrame:
    """Components with measured lines whose rate is strictly under their floor."""
    rows = per_file.groupBy("component").agg(F.sum("lines_found").alias("found"), F.sum("lines_hit").alias("hit")).where("found > 0")
    return rows.join(floors, "component").withColumn("rate", F.col("hit") / F.col("found")).where("rate < floor")


def behavioral_coupling(pairs: DataFrame, components: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Components with two or more co-changing file pairs and no edge either way."""
    a, b = components.select(F.col("path").alias("left_path"), F.col("component").alias("ca")), components.select(F.col("path").alias("right_path"), F.col("component").alias("cb"))
    rows = pairs.join(a, "left_path").join(b, "right_path").where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") >= least)
    known = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return rows.join(known, ["a", "b"], "left_anti")


def by_mode(findings: DataFrame, mode: str, frozen: DataFrame) -> DataFrame:
    """off: none; warn: all, low; new-violations: those that aren't frozen; strict: all."""
    if mode == "off":
        return findings.limit(0)
    if mode == "warn":
        return findings.withColumn("severity", F.lit("low"))
    return findings.join(frozen.select("id"), "id", "left_anti") if mode == "new-violations" else findings


# ---- diagnosis of components


def hubs(fan: DataFrame) -> DataFrame:
    """Both fans at or over max(3, p90)."""
    tin = nearest_rank(fan, "fan_in", 0.9).select(F.greatest("value", F.lit(3.0)).alias("tin"))
    tout = nearest_rank(fan, "fan_out", 0.9).select(F.greatest("value", F.lit(3.0)).alias("tout"))
    rows = fan.crossJoin(F.broadcast(tin)).crossJoin(F.broadcast(tout)).where("fan_in >= tin AND fan_out >= tout")
    return rows.select("name", "fan_in", "fan_out", F.greatest(F.lit(0.5), F.least(F.lit(0.99), (F.col("fan_in") / F.col("tin") + F.col("fan_out") / F.col("tout")) / 4)).alias("confidence"))


def unstable_dependencies(fan: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules with 30 % or more of their edges to less stable ones."""
    a, b = fan.select(F.col("name").alias("source"), F.col("instability").alias("si")), fan.select(F.col("name").alias("target"), F.col("instability").alias("ti"))
    rows = edges.join(a, "source").join(b, "target").groupBy("source").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("ti") > F.col("si") + F.lit(1e-9)).alias("uphill"))
    share = F.col("uphill").cast("double") / F.col("edges")
    return rows.withColumn("share", share).where("share >= 0.30D").withColumn("confidence", F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.5 + F.col("share") / 2)))


def zone_of_pain(metrics: DataFrame, p90_churn: float) -> DataFrame:
    """Concrete, stable, used components with many types (distance 0.7 or more); often changed and far: high."""
    rows = metrics.where("distance >= 0.7D AND abstractness < 0.3D AND instability < 0.5D AND fan_in >= 3 AND types >= 5")
    often = F.col("churn") >= max(p90_churn, 1.0)
    return rows.select("name", "distance", F.when(often & (F.col("distance") >= 0.85) & (F.col("fan_in") >= 6), "high").when(often, "medium").otherwise("low").alias("severity"), F.greatest(F.lit(0.5), F.least(F.lit(0.9), 0.5 + (F.col("distance") - 0.7) * 1.5)).alias("confidence"))


def god_components(sizes: DataFrame) -> DataFrame:
    """More files than max(8, p90); twice that is high."""
    bar = nearest_rank(sizes, "files", 0.9).select(F.greatest("value", F.lit(8.0)).alias("bar"))
    ratio = F.col("files") / F.col("bar")
    return sizes.crossJoin(F.broadcast(bar)).where("files > bar").select("name", "files", F.when(ratio >= 2, "high").otherwise("medium").alias("severity"), F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.5 + (ratio - 1) / 4)).alias("confidence"))


def dense_structure(row: DataFrame) -> DataFrame:
    """Ten components or more with a density of 0.15 (high: 0.35)."""
    return row.where("modules >= 10 AND density >= 0.15D").withColumn("severity", F.when(F.col("density") >= 0.35, "high").otherwise("medium"))


def component_hotspots(metrics: DataFrame, n: int = 10) -> DataFrame:
    """Half churn, half complexity over their greatest, times 100; churn 3, complexity 10 and score 10 at least."""
    most = metrics.agg(F.greatest(F.max("churn"), F.lit(1)).alias("mc"), F.greatest(F.max("cognitive"), F.lit(1)).alias("mx"))
    score = (F.col("churn") / F.col("mc") * 0.5 + F.col("cognitive") / F.col("mx") * 0.5) * 100
    return metrics.crossJoin(F.broadcast(most)).withColumn("score", score).where("churn >= 3 AND cognitive >= 10 AND score >= 10").select("name", "score").orderBy(F.desc("score"), "name").limit(n)


def unstable_interfaces(metrics: DataFrame) -> DataFrame:
    """Fan-in and churn both at or over their 90th percentile (3 at least)."""
    a = nearest_rank(metrics, "fan_in", 0.9).select(F.greatest("value", F.lit(3.0)).alias("a"))
    b = nearest_rank(metrics, "churn", 0.9).select(F.greatest("value", F.lit(3.0)).alias("b"))
    return metrics.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).where("fan_in >= a AND churn >= b").select("name", "fan_in", "churn")


def change_couplings(pairs: DataFrame, edges: DataFrame, least: int = 4) -> DataFrame:
    """change_coupling where co-changing components also have an edge, modularity_violation where they don't (high at twice the least)."""
    known = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().withColumn("edge", F.lit(True))
    rows = pairs.where(F.col("n") >= least).join(known, ["a", "b"], "left")
    kind = F.when(F.col("edge"), "change_coupling").otherwise("modularity_violation")
    confidence = F.when(F.col("edge"), 0.6).otherwise(F.greatest(F.lit(0.6), F.least(F.lit(0.95), 0.6 + F.col("n") / (4.0 * least))))
    return rows.select("a", "b", "n", kind.alias("kind"), F.when(F.col("edge"), "low").when(F.col("n") >= 2 * least, "high").otherwise("medium").alias("severity"), confidence.alias("confidence"))


def diagnosis_order(rows: DataFrame) -> DataFrame:
    """Gravest, surest, then by detector and target."""
    return rows.orderBy(severity_rank().desc(), F.desc("confidence"), "detector", "target")


def group_diagnoses(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("detector")).alias("detectors"))


def capability_findings(uses: DataFrame, components: DataFrame, denied: DataFrame) -> DataFrame:
    """Uses of capabilities that a component's contract denies: denied (component, capability)."""
    return uses.join(components.select(F.col("path").alias("file_path"), "component"), "file_path").join(denied, ["component", "capability"])


def audit(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages in an advisory's affected range, once for each (package, advisory).

    ``advisories``: id, ecosystem, name, severity, events array<struct<introduced,fixed,last_affected>>.
    """
    from ..functions.versions import affected

    rows = packages.join(advisories.withColumnRenamed("id", "advisory"), ["ecosystem", "name"])
    return rows.where(affected(F.col("version"), F.col("events"))).select("ecosystem", "name", "version", "advisory", F.coalesce("severity", F.lit("high")).alias("severity")).distinct()


def numbered(findings: DataFrame) -> DataFrame:
    """Identity across snapshots: kind, severity, first path, locator and rule, numbered where they repeat; lines don't count."""
    first = F.col("evidence")[0]
    locator = F.coalesce(first["symbol"], first["detail"], first["line"].cast("string"))
    key = F.concat_ws("\0", "finding_kind", "severity", first["file_path"], locator, "rule_name")
    rows = findings.withColumn("__k", key).withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(first["line"], "id")) - 1)
    return rows.withColumn("identity", F.concat(F.lit("finding:"), F.substring(F.sha2(F.concat_ws("\0", "__k", F.col("__n").cast("string")), 256), 1, 24))).drop("__k", "__n")

"""Resolution: imports to files, calls to symbols, entry points.

Imports become candidate path suffixes and meet files by an equi-join on suffixes, so no
file is ever held against all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import join, parent
from ..functions.text import package_root

SCRIPT_ENDINGS = ("", *".ts .tsx .d.ts .mts .cts .js .jsx .mjs .cjs /index.ts /index.tsx /index.js /index.jsx".split())


def candidates(language: Column, path: Column, spec: Column) -> Column:
    """Candidate targets of an import, best first: paths from the root, or suffixes marked with ``*/``."""
    here = parent(path)
    relative = join(here, spec)
    bare = F.regexp_replace(relative, r"\.[cm]?js$", "")
    script = F.when(spec.rlike(r"^\.{1,2}(/|$)"), F.concat(F.array(*[F.concat(relative, F.lit(e)) for e in SCRIPT_ENDINGS]), F.array(*[F.concat(bare, F.lit(e)) for e in SCRIPT_ENDINGS[1:4]])))
    script = F.coalesce(script, F.when(spec.rlike(r"^[@~]/"), F.array(*[F.concat(F.lit("*/"), F.regexp_replace(spec, r"^[@~]/", ""), F.lit(e)) for e in SCRIPT_ENDINGS])))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    tail = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    base = F.when(dots > 0, join(here, F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), tail))).otherwise(F.concat(F.lit("*/"), tail))
    python = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    segments = F.filter(F.split(spec, "::"), lambda x: ~x.isin("crate", "self", "super", ""))
    up = F.size(F.filter(F.split(spec, "::"), lambda x: x == "super"))
    own = F.regexp_replace(path, r"(/mod|/lib|/main)?\.rs$", "")
    rust_base = F.when(spec.startswith("self::"), F.concat(F.when(path.rlike(r"(^|/)(mod|lib|main)\.rs$"), parent(path)).otherwise(own), F.lit("/"))).when(up > 0, F.concat(parent(own), F.lit("/"))).otherwise("*/")
    lengths = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))))
    rust = F.flatten(F.transform(lengths, lambda n: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda e: F.concat(rust_base, F.array_join(F.slice(segments, 1, n), "/"), e))))
    cpp = F.array(join(here, spec), F.concat(F.lit("*/"), spec))
    go = F.transform(F.sequence(F.lit(1), F.size(F.split(spec, "/"))), lambda n: F.concat(F.lit("*/"), F.array_join(F.slice(F.split(spec, "/"), n, 64), "/"), F.lit("/*.go")))
    return F.when(language.isin("typescript", "javascript"), script).when(language == "python", python).when(language == "rust", rust).when(language == "go", go).otherwise(cpp)


def suffixes(files: DataFrame) -> DataFrame:
    """(suffix, path): every path from its root as it is, and each of its tails as ``*/tail``; Go packages as ``*/dir/*.go``."""
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("*/"), F.array_join(F.slice(parts, n, 256), "/")))
    rows = files.select("path", F.explode(F.concat(F.array("path"), tails)).alias("suffix"))
    go = files.where("language = 'go'").withColumn("d", parent(F.col("path"))).groupBy("d").agg(F.min("path").alias("path"))
    dirs = F.split("d", "/")
    go = go.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda n: F.concat(F.lit("*/"), F.array_join(F.slice(dirs, n, 256), "/"), F.lit("/*.go")))).alias("suffix"))
    return rows.unionByName(go)


def dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved imports (file_path, specifier, kind, line) of files (path, language, module_name).

    The best candidate with exactly one file wins; a suffix that several files share
    resolves nothing.  What is left is external (a package) or unresolved (a relative path).
    """
    source = imports.join(files.select(F.col("path").alias("file_path"), "language", F.col("module_name").alias("source_module")), "file_path").withColumn("id", F.monotonically_increasing_id())
    index = suffixes(files).groupBy("suffix").agg(F.min("path").alias("target_file_path"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    tried = source.select("id", F.posexplode(F.coalesce(candidates(F.col("language"), F.col("file_path"), F.col("specifier")), F.array().cast("array<string>"))).alias("rank", "suffix"))
    hit = tried.join(index, "suffix").groupBy("id").agg(F.min_by("target_file_path", "rank").alias("target_file_path"))
    target = files.select(F.col("path").alias("target_file_path"), F.col("module_name").alias("__m"))
    rows = source.join(hit, "id", "left").join(target, "target_file_path", "left")
    relative = F.col("specifier").rlike(r"^\.|^(crate|self|super)::") | ((F.col("language") == "cpp") & (F.col("kind") != "system_include"))
    package = F.coalesce(F.when(F.col("language").isin("typescript", "javascript"), package_root(F.col("specifier"))), F.regexp_extract("specifier", r"^([\w@-]+)", 1))
    module = F.when(F.col("target_file_path").isNotNull(), F.col("__m")).when(relative, F.concat(F.lit("unresolved:"), "specifier")).otherwise(F.concat(F.lit("external:"), package))
    return rows.select(F.col("file_path").alias("source_file_path"), "target_file_path", "source_module", module.alias("target_module"), "specifier", F.col("kind").alias("dependency_kind"), F.col("target_file_path").isNull().alias("is_external"), F.col("line").alias("evidence_line"), "names")


def calls(raw: DataFrame, symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """Calls (file_path, caller, callee, receiver, line) with caller and callee symbols.

    A cascade, each step only where one symbol fits: same file, imported name's file, the
    receiver's type, the only symbol of that name in the repository.
    """
    s = symbols.select("id", F.col("file_path").alias("sf"), "name", "qualified_name", F.when(F.col("kind") == "method", F.regexp_extract("qualified_name", r"([^.]+)\.[^.]+$", 1)).alias("owner"))
    rows = raw.withColumn("rid", F.monotonically_increasing_id())

    def unique(joined: DataFrame, name: str) -> DataFrame:
        return joined.groupBy("rid").agg(F.min("id").alias(name), F.count_distinct("id").alias("n")).where("n = 1").drop("n")

    local = unique(rows.join(s, (F.col("file_path") == F.col("sf")) & (F.col("callee") == F.col("name"))), "c1")
    bound = deps.where("target_file_path IS NOT NULL").select(F.col("source_file_path").alias("df"), F.col("target_file_path").alias("tf"), F.explode_outer("names").alias("bound"))
    imported = unique(rows.join(bound, (F.col("file_path") == F.col("df")) & ((F.col("bound") == F.col("callee")) | F.col("bound").isNull())).join(s, (F.col("tf") == F.col("sf")) & (F.col("name") == F.col("callee"))), "c2")
    typed = unique(rows.where("receiver IS NOT NULL").join(s, (F.lower("receiver") == F.lower("owner")) & (F.col("callee") == F.col("name"))), "c3")
    only = s.groupBy("name").agg(F.min("id").alias("c4"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("name").alias("callee"), "c4")
    caller = symbols.select(F.col("file_path"), F.col("qualified_name").alias("caller"), F.col("id").alias("caller_symbol_id"))
    out = rows.join(local, "rid", "left").join(imported, "rid", "left").join(typed, "rid", "left").join(only, "callee", "left").join(caller, ["file_path", "caller"], "left")
    numbered = out.withColumn("callee_symbol_id", F.coalesce("c1", "c2", "c3", "c4"))
    w = Window.partitionBy("file_path", "caller", "callee", "line").orderBy("rid")
    return numbered.withColumn("ordinal", F.row_number().over(w) - 1).select("file_path", "caller", "caller_symbol_id", "callee", "callee_symbol_id", "line", "is_reference", "ordinal")


def entry_points(files: DataFrame, manifest_paths: DataFrame | None = None, scripts: DataFrame | None = None) -> DataFrame:
    """Files that run on their own: mains, indexes, tests, configuration, and what manifests or pages name."""
    named = F.col("path").rlike(r"(^|/)(main|__main__|index|cli|app|server|setup|manage|conftest|wsgi|asgi|lib|build)\.[a-z]+$") | F.col("path").rlike(r"(\.config\.[cm]?[jt]s|\.stories\.[jt]sx?|\.worker\.[jt]s)$") | F.col("path").rlike(r"(?i)(^|/)(tests?|__tests__|spec|examples|bin|scripts|migrations)/|\.(test|spec)\.[jt]sx?$|(^|/)test_[^/]*\.py$|_test\.go$")
    out = files.where(named).select("path")
    for extra in (manifest_paths, scripts):
        if extra is not None:
            out = out.unionByName(files.join(extra.select(F.regexp_replace("path", r"^\./", "").alias("path")), "path", "left_semi").select("path"))
    return out.distinct()

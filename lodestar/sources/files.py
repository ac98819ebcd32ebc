"""File sources: the source walk, the parse cache, manifests, lockfiles, coverage, advisories, pages.

Everything opens files through Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import glob_regex

LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "hh": "cpp"}
PRUNED = ("node_modules", "target", "dist", "build", "out", "vendor", ".git", ".venv", "venv", "__pycache__", ".next", "coverage", "third_party")
MAX_BYTES = 5 << 20


def language_of(path: Column) -> Column:
    table = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def pruned(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, PRUNED)))


def looks_generated(path: Column, content: Column) -> Column:
    """A name marker, a line over 5000 bytes in the first 8 KiB, or a banner in the first KiB."""
    head = F.substring(content, 1, 8192).cast("string")
    banner = F.lower(F.substring(content, 1, 1024).cast("string"))
    return path.rlike(r"(?i)(\.min\.|\.bundle\.|\.generated\.|_pb2\.py$|\.pb\.go$|\.d\.ts$)") | F.exists(F.split(head, "\n"), lambda x: F.octet_length(x) > 5000) | banner.contains("@generated") | banner.rlike(r"code generated .* do not edit|auto-?generated")


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(regex, negated) of the root's .gitignore, in order."""
    jvm = spark.sparkContext._jvm  # Spark's own readers skip files whose name begins with a dot
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    try:
        lines = [x.strip() for x in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()]
    finally:
        stream.close()
    out = []
    for line in lines:
        if line and not line.startswith("#"):
            negated, body = line.startswith("!"), line.lstrip("!")
            anchored, body = body.startswith("/") or "/" in body.rstrip("/"), body.strip("/")
            pattern = glob_regex(body)[1:-1]
            out.append(("^" + ("" if anchored else "(?:.*/)?") + pattern + "(?:/.*)?$", negated))
    return out


def discover(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, content, size_bytes, content_hash) of the sources below ``root``.

    Path filters come before the content column is touched, so pruned files cost a listing
    entry only.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].removeprefix("file:").rstrip("/")
    rows = rows.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^.*?" + base.lstrip("/") + "/", "")).withColumn("language", language_of(F.col("path")))
    rows = rows.where(F.col("language").isNotNull() & ~pruned(F.col("path")) & (F.col("length") <= max_bytes))
    for pattern, negated in ignore_rules(spark, root):
        rows = rows if negated else rows.where(~F.col("path").rlike(pattern))
    if include:
        rows = rows.where(F.array_contains(F.array(*[F.col("path").rlike(glob_regex(g)) for g in include]), True))
    for g in exclude:
        rows = rows.where(~F.col("path").rlike(glob_regex(g)))
    rows = rows.where(~looks_generated(F.col("path"), F.col("content")))
    return rows.select("path", "language", "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content the parse cache lacks."""
    return files.join(cache.select("content_hash").distinct(), "content_hash", "left_anti")


def module_of(path: Column, depth: int = 1) -> Column:
    """The module a path lies in: container directories are skipped, then ``depth`` segments; ``root`` for files at the top."""
    dirs = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: ~d.isin("src", "lib", "packages", "apps", "crates", "cmd", "internal", "pkg"))
    name = F.array_join(F.slice(dirs, 1, depth), "/")
    return F.when(name == "", "root").otherwise(name)


def configured_module(path: Column, prefixes: dict[str, str], fallback: Column) -> Column:
    """The module of the longest configured prefix."""
    out = fallback
    for prefix, name in sorted(prefixes.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(path.startswith(prefix.rstrip("/") + "/"), name).otherwise(out)
    return out


def read_lcov(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(file_path, lines_found, lines_hit, functions_found, functions_hit) of an LCOV report.

    Sections of one file merge by the most hits of each line; totals count only where a
    section has no detail.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy("report").orderBy("n")
    rows = lines.withColumn("file", F.last(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 4096)), ignorenulls=True).over(w)).where(F.col("file").isNotNull())
    rows = rows.withColumn("file", F.regexp_replace("file", "^" + root.rstrip("/") + "/", "") if root else F.col("file"))
    kind, rest = F.split_part("line", F.lit(":"), F.lit(1)), F.regexp_replace("line", "^[A-Z]+:", "")
    item = F.when(kind == "DA", F.split_part(rest, F.lit(","), F.lit(1))).when(kind == "FN", F.regexp_extract(rest, r"([^,]+)$", 1)).when(kind == "FNDA", F.regexp_extract(rest, r"^\d+,(.*)$", 1))
    hits = F.when(kind == "DA", F.split_part(rest, F.lit(","), F.lit(2)).cast("long")).when(kind == "FNDA", F.split_part(rest, F.lit(","), F.lit(1)).cast("long")).when(kind.isin("LF", "LH", "FNF", "FNH"), rest.cast("long")).otherwise(F.lit(0))
    items = rows.where(kind.isin("DA", "FN", "FNDA", "LF", "LH", "FNF", "FNH")).select("file", F.when(kind == "FNDA", "FN").otherwise(kind).alias("kind"), item.alias("item"), hits.alias("hits"))
    best = items.groupBy("file", "kind", "item").agg(F.max("hits").alias("hits"))
    count = lambda k, c: F.count_if((F.col("kind") == k) & c)
    total = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("hits"))), F.lit(0))
    out = best.groupBy(F.col("file").alias("file_path")).agg(count("DA", F.lit(True)).alias("lf"), count("DA", F.col("hits") > 0).alias("lh"), count("FN", F.lit(True)).alias("ff"), count("FN", F.col("hits") > 0).alias("fh"), total("LF").alias("s_lf"), total("LH").alias("s_lh"), total("FNF").alias("s_ff"), total("FNH").alias("s_fh"))
    pick = lambda a, d, s, name: F.when(F.col(a) > 0, F.col(d)).otherwise(F.col(s)).alias(name)
    return out.select("file_path", pick("lf", "lf", "s_lf", "lines_found"), pick("lf", "lh", "s_lh", "lines_hit"), pick("ff", "ff", "s_ff", "functions_found"), pick("ff", "fh", "s_fh", "functions_hit"))


def read_npm_lockfile(spark: SparkSession, path: str) -> DataFrame:
    """(ecosystem, name, version, manifest_path, is_direct): one ``node_modules/`` in the key is direct."""
    doc = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("manifest_path"), F.from_json("value", "packages map<string,struct<version:string>>").alias("j"))
    rows = doc.select("manifest_path", F.explode("j.packages").alias("key", "p")).where(F.col("key").contains("node_modules/") & F.col("p.version").isNotNull())
    return rows.select(F.lit("npm").alias("ecosystem"), F.regexp_extract("key", r".*node_modules/(.+)$", 1).alias("name"), F.col("p.version").alias("version"), "manifest_path", (F.size(F.split("key", "node_modules/")) == 2).alias("is_direct"))


OSV = "id string, database_specific struct<severity:string>, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"


def read_osv(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ecosystem, name, severity, events) of a directory of advisories; bad files are skipped."""
    docs = spark.read.schema(OSV).json(folder, multiLine=True, mode="DROPMALFORMED", pathGlobFilter="*.json")
    rows = docs.where("id IS NOT NULL").select("id", F.lower("database_specific.severity").alias("severity"), F.explode("affected").alias("a")).select("id", "severity", F.lower("a.package.ecosystem").alias("ecosystem"), "a.package.name", F.explode("a.ranges").alias("r"))
    return rows.where(F.coalesce("r.type", F.lit("SEMVER")) != "GIT").select("id", "ecosystem", "name", F.when(F.col("severity") == "moderate", "medium").otherwise(F.col("severity")).alias("severity"), "r.events")


def read_manifests(spark: SparkSession, root: str, depth: int = 6) -> DataFrame:
    """(manifest_path, name, scope) of every package.json within ``depth`` directories."""
    spec = "dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>, peerDependencies map<string,string>"
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "package.json").text(root, wholetext=True).withColumn("manifest_path", F.input_file_name()).where(~F.col("manifest_path").contains("/node_modules/"))
    docs = docs.where(F.size(F.split("manifest_path", "/")) - len(root.rstrip("/").split("/")) <= depth + 3).withColumn("j", F.from_json("value", spec))
    scopes = {"dependencies": "runtime", "devDependencies": "dev", "optionalDependencies": "optional", "peerDependencies": "peer"}
    each = F.concat(*[F.transform(F.coalesce(F.map_keys(f"j.{k}"), F.array().cast("array<string>")), lambda n, s=s: F.struct(n.alias("name"), F.lit(s).alias("scope"))) for k, s in scopes.items()])
    return docs.select("manifest_path", F.explode(each).alias("d")).select("manifest_path", "d.name", "d.scope")


def cargo_roots(spark: SparkSession, root: str) -> DataFrame:
    """(manifest_path, crate, folder) of every Cargo.toml with a package; dashes become underscores as in code."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "Cargo.toml").text(root, wholetext=True).withColumn("manifest_path", F.input_file_name()).where(~F.col("manifest_path").contains("/target/"))
    name = F.regexp_extract("value", r'(?s)\[package\][^\[]*?\bname\s*=\s*"([^"]+)"', 1)
    return docs.select("manifest_path", F.translate(name, "-", "_").alias("crate"), F.regexp_replace("manifest_path", "/Cargo.toml$", "").alias("folder")).where("crate <> ''")


def html_scripts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The local ``src`` of every script tag of a page."""
    src = F.regexp_extract_all(html, F.lit(r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""), 1)
    return pages.withColumn("src", F.explode(src)).where(~F.col("src").rlike("^(https?:)?//"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a baseline: a JSON list, or a folder of text files by component."""
    if path.endswith(".json"):
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id"))
    return spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'").select(F.trim("value").alias("id"))

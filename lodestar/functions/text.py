"""Text expressions: identity, secrets, commit messages, SQL tables, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and 24 hex digits of SHA-256 over each part followed by a NUL."""
    joined = F.concat(*[x for p in parts for x in (p.cast("string"), F.char(F.lit(0)))])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 24))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


PROVIDERS = {
    "aws-access-key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "github-token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    "google-api-key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}",
    "slack-token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe-key": r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}",
    "posthog-key": r"(?<![A-Za-z0-9])ph[cx]_[A-Za-z0-9]{32,}",
    "private-key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
}
FILLER = r"(?i)example|dummy|placeholder|changeme|your[_-]|xxxx|(.)\1{7,}"
SECRET_NAME = r"(?i)(?:secret|token|passw(?:or)?d|api_?key|credential)s?(?![a-z])"


def provider_secret(text: Column) -> Column:
    """The first provider whose key pattern the text holds, filler aside."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PROVIDERS.items()):
        out = F.when((F.regexp_substr(text, F.lit(pattern)).isNotNull()) & ~F.regexp_substr(text, F.lit(pattern)).rlike(FILLER), name).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.split(text, "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.when(F.length(text) > 0, F.aggregate(counts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))).otherwise(F.lit(0.0))


def high_entropy_secret(value: Column) -> Column:
    """20 or more ASCII characters without spaces: 3.0 bits if all hex, else 4.5."""
    return (F.length(value) >= 20) & value.rlike(r"^[!-~]+$") & (entropy(value) >= F.when(value.rlike(r"^[0-9a-fA-F]+$"), 3.0).otherwise(4.5))


def weak_hash(name: Column) -> Column:
    return F.lower(name).isin("md5", "sha1", "sha-1")


FIX_TYPES = ("fix", "bugfix", "hotfix", "patch")
OTHER_TYPES = tuple("ci doc wip deps docs feat perf test build chore style tests feature release refactor".split())
CORRECTION = tuple("fix fixed fixes patch fixing repair correct patched repairs resolve corrects repaired resolved resolves corrected workaround".split())
DEFECT = tuple("bug bugs hang leak race crash fault leaks panic defect freeze panics crashes defects deadlock misparse overflow segfault exception underflow corruption regression regressions".split())
HOUSEKEEPING = tuple("ci doc fmt bump deps docs lint test typo build flaky tests typos clippy format readme comment grammar release version warning wording comments spelling warnings changelog dependency formatting whitespace indentation dependencies documentation".split())


def fix_confidence(message: Column) -> Column:
    """How likely a commit message tells of a fix; 0.5 and more counts as one."""
    subject = F.lower(F.trim(F.split(message, "\n")[0]))
    words = F.filter(F.split(subject, "[^a-z0-9]+"), lambda w: w != "")
    has = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    kind = F.regexp_extract(subject, r"^\s*([a-z]+)\s*(?:\([^:]*)?!*\s*:", 1)
    anchor = F.array_position(F.transform(words, lambda w: w.isin(*CORRECTION)), True)
    anchor = F.when(anchor == 0, 1).otherwise(anchor)
    after = F.slice(words, anchor + 1, 3)
    base = (
        F.when(kind.isin(*FIX_TYPES), 0.9).when(kind.isin(*OTHER_TYPES), 0.0)
        .when(has(CORRECTION) & has(DEFECT), 0.8).when(has(CORRECTION), 0.6).when(has(DEFECT), 0.4).otherwise(0.0)
    )
    tidy = ~has(DEFECT) & F.arrays_overlap(after, F.array(*map(F.lit, HOUSEKEEPING)))
    score = F.when(tidy, F.greatest(F.round(base - 0.5, 6), F.lit(0.0))).otherwise(base)
    return F.when((F.size(words) == 0) | words[0].isin("revert", "merge"), 0.0).otherwise(score)


SQL_SHAPES = (r"\bselect\b.*?\bfrom\s+([\w.\"`]+)", r"\binsert\s+into\s+([\w.\"`]+)", r"\bupdate\s+([\w.\"`]+)\s+set\b", r"\bdelete\s+from\s+([\w.\"`]+)", r"\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)", r"\balter\s+table\s+([\w.\"`]+)", r"\btruncate\s+(?:table\s+)?([\w.\"`]+)")


def sql_table(text: Column) -> Column:
    """The table that a statement reads or writes, by seven statement shapes."""
    found = [F.nullif(F.regexp_extract(text, f"(?is){s}", 1), F.lit("")) for s in SQL_SHAPES]
    return F.lower(F.translate(F.coalesce(*found), "\"`", ""))


def sql_access(text: Column) -> Column:
    return F.when(text.rlike(r"(?is)^\s*(with\b.*\b)?select\b"), "reads").when(text.rlike(r"(?is)\b(insert\s+into|update|delete\s+from|create\s+table|alter\s+table|truncate)\b"), "writes")


BUILTINS = tuple("fs os v8 vm dns net sys tls tty url http path repl util wasi zlib dgram http2 https assert buffer crypto domain events module stream timers cluster console process punycode readline constants inspector perf_hooks async_hooks querystring trace_events child_process string_decoder worker_threads diagnostics_channel".split())


def package_root(specifier: Column) -> Column:
    """The package of an external import; none for built-ins, relative paths and alias shapes."""
    bare = F.regexp_replace(specifier, "^node:", "")
    root = F.regexp_extract(bare, r"^(@[a-z0-9~-][\w.~-]*/[\w.~-]+|[a-zA-Z0-9][\w.~-]*)", 1)
    return F.when((root != "") & ~root.isin(*BUILTINS) & ~specifier.startswith("node:") & ~bare.rlike(r"^(@/|~|#|\.)"), root)


def label_distance(label: Column, text: str) -> Column:
    leaf = F.regexp_extract(label, r"([^/:]+)$", 1)
    return F.least(F.levenshtein(F.lower(label), F.lit(text.lower())), F.levenshtein(F.lower(leaf), F.lit(text.lower())))


def smart_case(pattern: str) -> str:
    """A pattern without capitals matches either case."""
    return pattern if any(c.isupper() for c in pattern) else f"(?i){pattern}"


def grep(files, pattern: str, key: str = "path", text: str = "text", each: int = 5, most: int = 50, width: int = 160):
    """Matching lines, clipped, at most ``each`` a file and ``most`` in all; binary files are skipped."""
    from pyspark.sql import Window

    lines = files.where(~F.col(text).contains("\0")).select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.col("line").rlike(smart_case(pattern)))
    rows = lines.select(key, (F.col("n") + 1).alias("line_number"), F.substring("line", 1, width).alias("line"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("line_number"))).where(F.col("r") <= each).drop("r")
    return ranked.orderBy(key, "line_number").limit(most)


def symbol_lookup(symbols, text: str):
    """Symbols of the best tier met: exact, any case, qualified suffix, substring."""
    q, low = F.col("qualified_name"), text.lower()
    tier = F.when(q == text, 0).when(F.lower(q) == low, 1).when(F.lower(q).endswith("." + low) | F.lower(q).endswith("::" + low), 2).when(F.lower(q).contains(low), 3)
    rows = symbols.withColumn("tier", tier).where("tier IS NOT NULL")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("tier"))), "tier")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""Git history, read by the git command on the driver and handed to Spark.

A history is bounded by ``max_commits`` and ``window_days``; larger ones come as Parquet
``commits`` and ``file_changes`` tables.
"""

from __future__ import annotations

import re
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fix_confidence, stable_id

MAX_COMMITS, WINDOW_DAYS = 5000, 365


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def history(spark: SparkSession, root: str, window_days: int = WINDOW_DAYS, max_commits: int = MAX_COMMITS) -> tuple[DataFrame, DataFrame]:
    """(commits, file_changes) along first-parent diffs, renames followed."""
    raw = git(root, "log", f"-n{max_commits}", f"--since={window_days}.days", "-M", "-C", "--name-status", "--diff-merges=first-parent", "--format=%x01%H%x02%P%x02%ae%x02%ct%x02%B%x03")
    commits, changes = [], []
    for block in raw.split("\x01")[1:]:
        head, _, files = block.partition("\x03")
        sha, parents, email, at, message = head.split("\x02", 4)
        commits.append((sha, parents.split(), email, datetime.fromtimestamp(int(at), timezone.utc), message.strip()))
        for line in files.strip().splitlines():
            kind, *paths = line.split("\t")
            changes.append((sha, paths[-1], {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied"}.get(kind[0], "modified"), paths[0] if len(paths) == 2 else None))
    c = spark.createDataFrame(commits, "sha string, parent_shas array<string>, author_email string, committed_at timestamp, message string")
    c = c.withColumn("id", stable_id("commit", F.col("sha"))).withColumn("fix_confidence", fix_confidence(F.col("message"))).withColumn("is_fix", F.col("fix_confidence") >= 0.5)
    f = spark.createDataFrame(changes, "sha string, file_path string, change_kind string, previous_path string").withColumn("commit_id", stable_id("commit", F.col("sha")))
    return c, f.drop("sha")


def changed_since(spark: SparkSession, root: str, ref: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in git(root, "diff", "--name-only", f"{ref}...HEAD").splitlines()], "path string")


def changed_ranges(spark: SparkSession, root: str, ref: str, worktree: bool = False) -> DataFrame:
    """(path, start, end) of the head's changed lines."""
    rows, path = [], None
    for line in git(root, "diff", "-U0", *([ref] if worktree else [f"{ref}...HEAD"])).splitlines():
        if line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else None
        elif path and (m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)) and m[2] != "0":
            rows.append((path, int(m[1]), int(m[1]) + int(m[2] or 1) - 1))
    return spark.createDataFrame(rows, "path string, start int, end int")


def tracked(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in git(root, "ls-files").splitlines()], "path string")


def resolve(root: str, ref: str) -> str:
    return git(root, "rev-parse", ref).strip()

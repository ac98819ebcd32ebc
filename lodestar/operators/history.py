"""Commit-history operators: renames, churn, ownership, fixes, co-change, change shape.

Inputs: commits (id, sha, author_email, committed_at, is_fix), file_changes (commit_id,
file_path, previous_path), files (path, module_name, size_bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, tasks_for

RENAME_DEPTH, HALF_LIFE_DAYS = 20, 180.0
MIN_FILES, MAX_FILES, WITNESSES = 2, 30, 5
MINOR_SHARE = 0.05


def epoch(col: str | Column) -> Column:
    """Seconds since 1970 with fractions, as a double."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col).cast("double") / F.lit(1e6)


def canonical_paths(changes: DataFrame, depth: int = RENAME_DEPTH) -> DataFrame:
    """(path, current_path): each path's name after following renames at most ``depth`` steps.

    The deepest name wins and the greatest of equals, so loops and splits are settled alike
    on every run.  Only renamed paths are walked: one join a step, over names still moving.
    """
    renames = settle(changes.where("previous_path IS NOT NULL AND previous_path <> file_path").select("previous_path", F.col("file_path").alias("next")).distinct())
    names = changes.select(F.col("file_path").alias("path")).distinct()
    front = names.join(renames.select(F.col("previous_path").alias("path")).distinct(), "path", "left_semi").select("path", F.col("path").alias("current"))
    best = None
    for step in range(1, depth + 1):
        front = settle(front.join(renames, front.current == renames.previous_path).select("path", F.col("next").alias("current")).distinct())
        if front.isEmpty():
            break
        # per path only the last step's greatest name can win; keep it with its depth
        found = front.groupBy("path").agg(F.max("current").alias("current")).select("path", F.struct(F.lit(step).alias("depth"), "current").alias("b"))
        best = found if best is None else best.unionByName(found)
    if best is None:
        return names.select("path", F.col("path").alias("current_path"))
    walked = best.groupBy("path").agg(F.max("b").alias("b")).select("path", F.col("b.current").alias("current_path"))
    return names.join(walked, "path", "left").select("path", F.coalesce("current_path", "path").alias("current_path"))


def ownership(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Per file: share of its main author, authors under and over 5 %, commits.  Renames aren't followed."""
    per_author = changes.join(commits, changes.commit_id == commits.id).groupBy("file_path", "author_email").count()
    share = F.col("count").cast("double") / F.sum("count").over(Window.partitionBy("file_path"))
    shares = per_author.withColumn("share", share)
    return shares.groupBy("file_path").agg(F.max("share").alias("ownership"), F.count_if(F.col("share") < MINOR_SHARE).alias("minor_contributors"), F.count_if(F.col("share") >= MINOR_SHARE).alias("major_contributors"), F.sum("count").alias("total_commits"))


def churn(files: DataFrame, changes: DataFrame, by: str = "path") -> DataFrame:
    """Distinct commits of every file (or module), renames followed; files without any count 0."""
    current = canonical_paths(changes)
    touched = changes.join(current, changes.file_path == current.path).select(F.col("current_path").alias("path"), "commit_id").distinct()
    return files.join(touched, "path", "left").groupBy(by).agg(F.countDistinct("commit_id").alias("commits"))


def _fixes(changes: DataFrame, commits: DataFrame) -> DataFrame:
    current = canonical_paths(changes)
    return changes.join(commits.where("is_fix"), changes.commit_id == commits.id).join(current, changes.file_path == current.path).select("commit_id", F.col("current_path").alias("path"), "committed_at").distinct()


def _decay(commits: DataFrame, half_life_days: float):
    newest = commits.agg(F.max(epoch("committed_at")).alias("newest"))  # one row: broadcast whatever the history's size
    seconds = max(half_life_days, 1.0) * 86_400.0
    return newest, F.pow(F.lit(0.5), (F.col("newest") - epoch("committed_at")) / F.lit(seconds)).cast("decimal(18,9)")


def fix_history(changes: DataFrame, commits: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Per file: fixes, their age-weighted mass (age from the newest commit) and the last one.  Files without fixes are absent."""
    newest, weight = _decay(commits, half_life_days)
    return _fixes(changes, commits).crossJoin(F.broadcast(newest)).groupBy("path").agg(F.count(F.lit(1)).alias("fixes"), F.sum(weight).cast("double").alias("mass"), F.max("committed_at").alias("last_fix_at"))


def module_fix_history(files: DataFrame, changes: DataFrame, commits: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """The same by module; a commit that fixes several files of a module weighs once."""
    newest, weight = _decay(commits, half_life_days)
    fixes = _fixes(changes, commits).join(files.select("path", "module_name"), "path").select("module_name", "commit_id", "committed_at").distinct()
    return fixes.crossJoin(F.broadcast(newest)).groupBy("module_name").agg(F.count(F.lit(1)).alias("fixes"), F.sum(weight).cast("double").alias("mass"), F.max("committed_at").alias("last_fix_at"))


def file_age_days(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Days between a file's last change and the newest commit."""
    newest = commits.agg(F.max(epoch("committed_at")).alias("newest"))
    last = changes.join(commits, changes.commit_id == commits.id).groupBy("file_path").agg(F.max(epoch("committed_at")).alias("at"))
    return last.crossJoin(F.broadcast(newest)).select("file_path", ((F.col("newest") - F.col("at")) / F.lit(86_400.0)).alias("age_days"))


def days_since_previous(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Days from a file's previous commit to each of its commits; the first has none.  Ties go by sha."""
    rows = changes.join(commits, changes.commit_id == commits.id).select("file_path", "sha", epoch("committed_at").alias("at")).distinct()
    w = Window.partitionBy("file_path").orderBy("at", "sha")
    return rows.select("file_path", "sha", ((F.col("at") - F.lag("at").over(w)) / F.lit(86_400.0)).alias("days"))


def sized_commits(changes: DataFrame, low: int = MIN_FILES, high: int = MAX_FILES, distinct: bool = True) -> DataFrame:
    """(commit_id, file_path) of commits of ``low`` to ``high`` files; bounds every pair join below."""
    rows = changes.select("commit_id", "file_path")
    rows = rows.distinct() if distinct else rows
    inside = rows.groupBy("commit_id").count().where(F.col("count").between(low, high)).select("commit_id")
    return rows.join(inside, "commit_id", "left_semi")


def commit_file_sets(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """The sorted files of each commit, beside its sha and time."""
    rows = changes.join(commits, changes.commit_id == commits.id).groupBy("sha", "committed_at")
    return rows.agg(F.sort_array(F.collect_set("file_path")).alias("files"))


def raw_co_changes(changes: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of paths by the commits rows that hold both, as written (no renames)."""
    rows = sized_commits(changes, distinct=False)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.commit_id") == F.col("b.commit_id")) & (F.col("a.file_path") < F.col("b.file_path")))
    return pairs.groupBy(F.col("a.file_path").alias("left_path"), F.col("b.file_path").alias("right_path")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def co_changes(changes: DataFrame, commits: DataFrame, min_support: int = 3, min_jaccard: float = 0.35) -> DataFrame:
    """Associated pairs: support, Jaccard, lift (over 1), both confidences, newest five witnesses."""
    rows = sized_commits(changes)
    touched = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    window = rows.agg(F.countDistinct("commit_id").alias("window"))
    dated = rows.join(commits.select(F.col("id").alias("commit_id"), "sha", "committed_at"), "commit_id")
    a, b = rows.alias("a"), dated.alias("b")
    pairs = a.join(b, (F.col("a.commit_id") == F.col("b.commit_id")) & (F.col("a.file_path") < F.col("b.file_path")))
    newest = F.sort_array(F.collect_list(F.struct("b.committed_at", "b.sha")), asc=False)
    counted = pairs.groupBy(F.col("a.file_path").alias("left_path"), F.col("b.file_path").alias("right_path")).agg(F.count(F.lit(1)).alias("support"), newest.alias("w")).where(F.col("support") >= min_support)
    left, right = touched.select(F.col("file_path").alias("left_path"), F.col("n").alias("nl")), touched.select(F.col("file_path").alias("right_path"), F.col("n").alias("nr"))
    both = F.col("support").cast("double")
    measured = counted.join(left, "left_path").join(right, "right_path").crossJoin(F.broadcast(window)).select(
        "left_path", "right_path", "support",
        (both / (F.col("nl") + F.col("nr") - F.col("support"))).alias("jaccard"),
        (both * F.col("window") / (F.col("nl") * F.col("nr"))).alias("lift"),
        (both / F.col("nl")).alias("confidence_left"), (both / F.col("nr")).alias("confidence_right"),
        F.transform(F.slice("w", 1, WITNESSES), lambda x: x["sha"]).alias("commit_shas"),
    )
    return measured.where((F.col("jaccard") >= min_jaccard) & (F.col("lift") > 1))


def confident(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose greater confidence reaches ``least``."""
    return pairs.where(F.greatest("confidence_left", "confidence_right") >= least)


def _files_by_commit(rows: DataFrame, n: int) -> DataFrame:
    """Distinct ``rows`` (commit_id, path and more), a commit's in one of ``n`` partitions.

    They are dealt out by commit and path, then by commit, so that with ``n`` by their count
    the sums a task holds don't grow with the history.  A commit of many files is one task's
    only when its rows are distinct, and then takes no more than a sum a group.
    """
    return rows.repartition(n, "commit_id", "path").distinct().repartition(n, "commit_id")


def commit_sizes(changes: DataFrame) -> DataFrame:
    """Per commit: its distinct files."""
    rows = changes.select("commit_id", F.col("file_path").alias("path"))
    return _files_by_commit(rows, tasks_for(changes)).groupBy("commit_id").agg(F.count("path").alias("files"))


def commit_shape(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Per commit: files, modules, and spread: entropy of its files over modules by ln(modules)."""
    rows = changes.select("commit_id", F.col("file_path").alias("path")).join(files.select("path", "module_name"), "path")
    per = _files_by_commit(rows, tasks_for(changes)).groupBy("commit_id", "module_name").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("commit_id"))
    return per.withColumn("p", p).groupBy("commit_id").agg(
        F.sum("n").alias("files"), F.count(F.lit(1)).alias("modules"),
        F.when(F.count(F.lit(1)) > 1, F.sum(-F.col("p") * F.log("p")) / F.log(F.count(F.lit(1)))).otherwise(F.lit(0.0)).alias("spread"),
    )


def change_shape(paths: DataFrame, files: DataFrame, fixes: DataFrame, ages: DataFrame, hotspots: DataFrame) -> DataFrame:
    """One row for a set of changed paths: files, modules, spread, hot modules met, share of all fix mass, mean age."""
    rows = paths.select("path").distinct().join(files.select("path", "module_name"), "path")
    per = rows.groupBy("module_name").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    spread = per.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total")).agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("modules"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    hot = per.join(hotspots.select("module_name").distinct(), "module_name", "left_semi").agg(F.count(F.lit(1)).alias("hotspots"))
    mass = fixes.join(rows.select("path"), "path", "left_semi").agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("own")).crossJoin(fixes.agg(F.sum("mass").alias("all")))
    age = ages.join(rows.select(F.col("path").alias("file_path")), "file_path", "left_semi").agg(F.avg("age_days").alias("mean_age_days"))
    joined = spread.crossJoin(hot).crossJoin(mass).crossJoin(age)  # one row each
    return joined.select("files", "modules", F.when(F.col("modules") > 1, F.col("h") / F.log("modules")).otherwise(F.lit(0.0)).alias("spread"), "hotspots", F.coalesce(F.try_divide("own", "all"), F.lit(0.0)).alias("fix_mass_share"), "mean_age_days")


def percentile_of_change(shapes: DataFrame, value: str = "files", least: int = 100) -> DataFrame:
    """For every commit the share of commits with a value at or below its own; none below ``least`` commits."""
    counts = shapes.groupBy(value).agg(F.count(F.lit(1)).alias("n"))  # a row for each value, not each commit
    total = counts.agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    ranked = counts.withColumn("below", F.sum("n").over(Window.orderBy(value))).crossJoin(F.broadcast(total))
    return shapes.join(ranked.select(value, (F.col("below") / F.col("total")).alias("share_at_or_below")), value)

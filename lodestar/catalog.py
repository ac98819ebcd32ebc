"""Every registered query of the engine, and its SQL where SQL can express it.

A query takes roles (see ``adapters``) through an operator.  Doubles are rounded to six
places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import oracle, roles
from .functions import text as T
from .operators import coupling as C
from .operators import graph as G
from .operators import history as H
from .operators import rules as R
from .operators import snapshots as S
from .plans import architecture as A
from .plans import review as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CANONICAL = """, moves AS (SELECT previous_path AS was, file_path AS now FROM file_changes WHERE file_path <> previous_path GROUP BY ALL),
trail(origin, name, hops) AS (SELECT f, f, 0 FROM (SELECT file_path AS f FROM file_changes GROUP BY 1) UNION ALL SELECT t.origin, m.now, t.hops + 1 FROM moves m, trail t WHERE m.was = t.name AND t.hops < 20),
canonical AS (SELECT origin AS path, (max((hops, name)))[2] AS current_path FROM trail GROUP BY origin)"""
FIXES = CANONICAL + """, fixes AS (SELECT k.current_path AS path, c.id AS commit_id, c.committed_at, epoch(c.committed_at) AS fixed_at
  FROM canonical k, commits c, file_changes f WHERE f.file_path = k.path AND f.commit_id = c.id AND c.is_fix GROUP BY ALL),
newest AS (SELECT epoch(max(committed_at)) AS now_at FROM commits),
file_fixes AS (SELECT path, count(*) AS fixes, sum((0.5 ** ((now_at - fixed_at) / 15552000))::DECIMAL(18,9))::DOUBLE AS mass, max(committed_at) AS last_fix_at FROM fixes, newest GROUP BY path)"""
OWNERS = """, per_author AS (SELECT file_path, author_email, count(*) AS n FROM commits c, file_changes f WHERE c.id = f.commit_id GROUP BY ALL),
shares AS (SELECT file_path, n, n / sum(n) OVER (PARTITION BY file_path) AS share FROM per_author),
owners AS (SELECT file_path, max(share) AS ownership, count_if(share < 0.05) AS minor_contributors, count_if(share >= 0.05) AS major_contributors, CAST(sum(n) AS BIGINT) AS total_commits FROM shares GROUP BY file_path)"""
EDGES = ", edges AS (SELECT DISTINCT source_module AS source, target_module AS target FROM dependencies WHERE NOT is_external AND source_module <> target_module)"
FANS = EDGES + """, fans AS (SELECT name, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out, CASE WHEN coalesce(i, 0) + coalesce(o, 0) = 0 THEN 0 ELSE coalesce(o, 0) / (coalesce(i, 0) + coalesce(o, 0)) END AS instability
  FROM modules LEFT JOIN (SELECT target AS t, count(*) AS i FROM edges GROUP BY 1) ON t = name LEFT JOIN (SELECT source AS s, count(*) AS o FROM edges GROUP BY 1) ON s = name)"""
# a file's churn in module terms, for the scores: 'm<n>' modules of files
CHURN = CANONICAL + """, touched AS (SELECT DISTINCT k.current_path AS path, f.commit_id FROM file_changes f JOIN canonical k ON k.path = f.file_path),
file_churn AS (SELECT files.path, files.module_name, commit_id FROM files LEFT JOIN touched USING (path))"""


def query(names: str, sql: str | None = None, raw: bool = False):
    """Register a function of the named roles; ``sql`` follows the roles' CTEs in the oracle."""

    def register(build):
        key = build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(*roles(spark, sf_dir, *names.split()))
            return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        run.__doc__ = build.__doc__
        QUERIES[key] = run
        if sql:
            ORACLE[key] = oracle(names, sql)
        return build

    return register


# ---- coupling


@query("modules dependencies", FANS + " SELECT name, fan_in, fan_out, round(instability, 6) AS instability FROM fans")
def module_coupling(modules, deps):
    """Fan-in, fan-out and instability of every module."""
    return C.fans(modules, C.local_edges(deps))


@query("modules dependencies", EDGES + " SELECT m AS modules, e AS edges, round(CASE WHEN m < 2 THEN 0 ELSE e / (m * (m - 1)) END, 6) AS density FROM (SELECT count(*) AS m FROM modules), (SELECT count(*) AS e FROM edges)")
def coupling_density(modules, deps):
    """A13."""
    return C.density(modules, C.local_edges(deps))


@query("dependencies", " SELECT DISTINCT source_module AS source, target_module AS target FROM dependencies WHERE NOT is_external AND source_module <> target_module AND dependency_kind <> 'type_import'")
def runtime_edges(deps):
    """F3."""
    return C.local_edges(deps, runtime_only=True)


@query("modules dependencies", FANS + " SELECT name, 2 * fan_in + 3 * fan_out AS score FROM fans ORDER BY score DESC, name LIMIT 10")
def top_hotspots(modules, deps):
    """T1."""
    return C.top_hotspots(C.fans(modules, C.local_edges(deps)))


@query("modules dependencies sparse_dependencies", FANS + """, z AS (SELECT (SELECT count(*) FROM modules) AS modules, (SELECT count(*) FROM edges) AS edges,
  (SELECT coalesce(max(2 * fan_in + 3 * fan_out), 0) FROM fans) AS top_score, (SELECT count(*) FROM sparse_dependencies WHERE source_module = target_module) AS cycles, (SELECT count(*) FROM dependencies WHERE is_external) AS external_dependencies)
  SELECT modules, edges, round(edges / (modules * (modules - 1)), 6) AS density, top_score, cycles, external_dependencies,
  CASE WHEN cycles >= 3 THEN 'critical' WHEN cycles > 0 OR edges / (modules * (modules - 1)) >= 0.35 THEN 'high' WHEN edges / (modules * (modules - 1)) >= 0.15 OR top_score >= 10 THEN 'medium' ELSE 'low' END AS risk FROM z""")  # fmt: skip
def summary_report(modules, deps, sparse):
    """A14; modules that depend on themselves stand for cycles here."""
    return C.summary(modules, deps, sparse.where("source_module = target_module"))


@query("files symbols", ", t AS (SELECT file_path, count(*) FILTER (kind = 'interface') AS abstract_types, count(*) AS types FROM symbols WHERE kind IN ('class', 'interface') GROUP BY file_path) SELECT * FROM t")
def file_abstractness(files, symbols):
    """A8, J2."""
    return C.abstractness(symbols)


@query("complexity files", " SELECT module_name, CAST(sum(cognitive) AS BIGINT) AS cognitive FROM complexity JOIN files ON path = file_path GROUP BY 1")
def module_complexity(complexity, files):
    """A7, J1."""
    return C.cognitive_totals(complexity, files)


@query("complexity files", " SELECT path, CAST(sum(cognitive) AS BIGINT) AS cognitive FROM complexity JOIN files ON path = file_path GROUP BY 1")
def file_complexity(complexity, files):
    """A7."""
    return C.cognitive_totals(complexity, files, "path")


@query("coverage files", " SELECT module_name, CAST(sum(lines_found) AS BIGINT) AS lines_found, CAST(sum(lines_hit) AS BIGINT) AS lines_hit, round(CASE WHEN sum(lines_found) = 0 THEN 1 ELSE sum(lines_hit) / sum(lines_found) END, 6) AS line_rate FROM coverage JOIN files ON path = file_path GROUP BY 1")
def coverage_rollup(coverage, files):
    """A21."""
    return C.coverage_rollup(coverage, files)


@query("complexity", ", v AS (SELECT cognitive AS v, row_number() OVER (ORDER BY cognitive) AS r, count(*) OVER () AS n FROM complexity WHERE cognitive > 0) SELECT round(CAST(v AS DOUBLE), 6) AS value FROM v WHERE r = round(0.9 * (n - 1)) + 1")
def nearest_rank_p90(complexity):
    """A18."""
    return C.nearest_rank(complexity, "cognitive", 0.9)


@query("findings", " SELECT rule_name, count(*) AS n FROM findings GROUP BY 1")
def rule_tally(findings):
    """A19."""
    return C.tally(findings, "rule_name")


@query("findings", " SELECT severity, count(*) AS n FROM findings GROUP BY 1")
def severity_tally(findings):
    """A19."""
    return C.tally(findings, "severity")


@query("role_dependencies", """, t AS (SELECT source, target, CASE WHEN source LIKE '%controller%' THEN 'controller' WHEN source LIKE '%service%' THEN 'service' WHEN source LIKE '%repository%' THEN 'repository' END AS a,
  CASE WHEN target LIKE '%controller%' THEN 'controller' WHEN target LIKE '%service%' THEN 'service' WHEN target LIKE '%model%' THEN 'model' END AS b FROM role_dependencies),
  k AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) FILTER (a < b) AS fw, count(*) FILTER (a > b) AS bw FROM t WHERE a <> b GROUP BY 1, 2)
  SELECT CASE WHEN fw >= bw THEN lo ELSE hi END AS from_role, CASE WHEN fw >= bw THEN hi ELSE lo END AS to_role, greatest(fw, bw) AS matching, fw + bw AS total, round(greatest(fw, bw) / (fw + bw), 6) AS confidence
  FROM k WHERE fw + bw >= 3 AND greatest(fw, bw) / (fw + bw) >= 0.7""")  # fmt: skip
def dependency_conventions(deps):
    """A25, X13."""
    return C.conventions(deps)[0]


@query("role_dependencies", """, t AS (SELECT CASE WHEN source LIKE '%controller%' THEN 'controller' WHEN source LIKE '%service%' THEN 'service' WHEN source LIKE '%repository%' THEN 'repository' END AS a,
  CASE WHEN target LIKE '%controller%' THEN 'controller' WHEN target LIKE '%service%' THEN 'service' WHEN target LIKE '%model%' THEN 'model' END AS b, source, target FROM role_dependencies),
  k AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) FILTER (a < b) AS fw, count(*) FILTER (a > b) AS bw FROM t WHERE a <> b GROUP BY 1, 2),
  c AS (SELECT CASE WHEN fw >= bw THEN lo ELSE hi END AS f, CASE WHEN fw >= bw THEN hi ELSE lo END AS t, greatest(fw, bw) / (fw + bw) AS p FROM k WHERE fw + bw >= 3 AND greatest(fw, bw) / (fw + bw) >= 0.7)
  SELECT severity, count(*) AS n FROM (SELECT CASE WHEN p > 0.85 THEN 'violation' ELSE 'warning' END AS severity FROM t JOIN c ON a = c.t AND b = c.f) GROUP BY 1""")  # fmt: skip
def convention_deviations(deps):
    """R34."""
    return C.tally(C.conventions(deps)[1], "severity")


# ---- history


@query("file_changes commits", OWNERS + " SELECT file_path, round(ownership, 6) AS ownership, minor_contributors, major_contributors, total_commits FROM owners")
def ownership(changes, commits):
    """A1."""
    return H.ownership(changes, commits)


@query("file_changes commits files", OWNERS + " SELECT module_name AS name, round(avg(CASE WHEN ownership < 0.5 THEN 1 ELSE 0 END), 6) AS fragmentation FROM owners JOIN files ON path = file_path GROUP BY 1")
def ownership_fragmentation(changes, commits, files):
    """A16."""
    return C.fragmentation(H.ownership(changes, commits), files)


@query("file_changes", CANONICAL + " SELECT path, current_path FROM canonical")
def rename_closure(changes):
    """J5, A6."""
    return H.canonical_paths(changes)


@query("file_changes files", CHURN + " SELECT path, count(DISTINCT commit_id) AS commits FROM file_churn GROUP BY 1")
def file_churn(changes, files):
    """Zero kept."""
    return H.churn(files, changes)


@query("file_changes files", CHURN + " SELECT module_name, count(DISTINCT commit_id) AS commits FROM file_churn GROUP BY 1")
def module_churn(changes, files):
    """A2."""
    return H.churn(files, changes, "module_name")


@query("file_changes commits", FIXES + " SELECT path, fixes, round(mass, 6) AS mass, last_fix_at FROM file_fixes")
def file_fix_history(changes, commits):
    """A3, J6, X20."""
    return H.fix_history(changes, commits)


@query("file_changes commits files", FIXES + """, m AS (SELECT DISTINCT module_name, commit_id, committed_at, fixed_at FROM fixes JOIN files USING (path))
  SELECT module_name, count(*) AS fixes, round(sum((0.5 ** ((now_at - fixed_at) / 15552000))::DECIMAL(18,9))::DOUBLE, 6) AS mass, max(committed_at) AS last_fix_at FROM m, newest GROUP BY 1""")  # fmt: skip
def module_fix_history(changes, commits, files):
    """A4."""
    return H.module_fix_history(files, changes, commits)


@query("file_changes commits", ", n AS (SELECT max(epoch(committed_at)) AS at FROM commits) SELECT file_path, round((n.at - max(epoch(committed_at))) / 86400, 6) AS age_days FROM file_changes f JOIN commits c ON f.commit_id = c.id, n GROUP BY file_path, n.at")
def file_age(changes, commits):
    """A5."""
    return H.file_age_days(changes, commits)


@query("file_changes commits", ", r AS (SELECT DISTINCT file_path, sha, epoch(committed_at) AS s FROM file_changes f JOIN commits c ON f.commit_id = c.id) SELECT file_path, sha, round((s - lag(s) OVER (PARTITION BY file_path ORDER BY s, sha)) / 86400, 6) AS days FROM r")
def days_since_previous_commit(changes, commits):
    """W1."""
    return H.days_since_previous(changes, commits)


@query("brand_changes commits", " SELECT sha, committed_at, list_sort(list(DISTINCT file_path)) AS files FROM brand_changes f JOIN commits c ON f.commit_id = c.id GROUP BY 1, 2")
def commit_file_sets(changes, commits):
    """A11."""
    return H.commit_file_sets(changes, commits)


@query("brand_changes", ", s AS (SELECT commit_id FROM brand_changes GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), r AS (SELECT * FROM brand_changes SEMI JOIN s USING (commit_id)) SELECT a.file_path AS left_path, b.file_path AS right_path, count(*) AS n FROM r a JOIN r b ON a.commit_id = b.commit_id AND a.file_path < b.file_path GROUP BY 1, 2 HAVING count(*) >= 3")
def co_change_pairs_raw(changes):
    """A9, J7, J8."""
    return H.raw_co_changes(changes)


def _co_changes(role: str, jaccard: float) -> str:
    return f""", d AS (SELECT DISTINCT commit_id, file_path FROM {role}), s AS (SELECT commit_id FROM d GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), r AS (SELECT * FROM d SEMI JOIN s USING (commit_id)),
  t AS (SELECT file_path, count(*) AS n FROM r GROUP BY 1), w AS (SELECT count(DISTINCT commit_id) AS w FROM r),
  p AS (SELECT a.file_path AS l, b.file_path AS r, count(*) AS support, list_slice(list(c.sha ORDER BY c.committed_at DESC, c.sha DESC), 1, 5) AS commit_shas FROM r a JOIN r b ON a.commit_id = b.commit_id AND a.file_path < b.file_path JOIN commits c ON c.id = a.commit_id GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT l AS left_path, p.r AS right_path, support, round(support / (x.n + y.n - support), 6) AS jaccard, round(support * w / (x.n * y.n), 6) AS lift, round(support / x.n, 6) AS confidence_left, round(support / y.n, 6) AS confidence_right, commit_shas
  FROM p JOIN t x ON x.file_path = l JOIN t y ON y.file_path = p.r, w WHERE support / (x.n + y.n - support) >= {jaccard} AND support * w / (x.n * y.n) > 1"""


@query("brand_changes commits", _co_changes("brand_changes", 0.0))
def co_change_association(changes, commits):
    """A10."""
    return H.co_changes(changes, commits, 3, 0.0)


@query("supplier_changes commits", _co_changes("supplier_changes", 0.02) + " AND greatest(support / x.n, support / y.n) >= 0.04")
def co_change_suppliers(changes, commits):
    """A10 at a finer grain, F16."""
    return H.confident(H.co_changes(changes, commits, 3, 0.02), 0.04)


@query("file_changes files", """, r AS (SELECT DISTINCT commit_id, file_path, module_name FROM file_changes JOIN files ON path = file_path), k AS (SELECT commit_id, module_name, count(*) AS n FROM r GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY commit_id) AS p FROM k)
  SELECT commit_id, CAST(sum(n) AS BIGINT) AS files, count(*) AS modules, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS spread FROM p GROUP BY 1""")  # fmt: skip
def commit_shape(changes, files):
    """A24, A23."""
    return H.commit_shape(changes, files)


@query("file_changes", ", s AS (SELECT commit_id, count(DISTINCT file_path) AS files FROM file_changes GROUP BY 1) SELECT commit_id, files, round(cume_dist() OVER (ORDER BY files), 6) AS share_at_or_below FROM s")
def percentile_of_change(changes):
    """W3."""
    return H.percentile_of_change(H.commit_sizes(changes))


@query("findings files file_changes commits", FIXES + """, z AS (SELECT files.path, size_bytes, coalesce(mass, 0) AS mass FROM files LEFT JOIN file_fixes f ON f.path = files.path), b AS (SELECT sum(mass) * 1024 / sum(size_bytes) AS base FROM z),
  g AS (SELECT DISTINCT rule_name, file_path FROM findings), r AS (SELECT rule_name, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, sum(mass) AS mass FROM g JOIN z ON path = file_path GROUP BY 1)
  SELECT rule_name, files, bytes, round(mass, 6) AS mass, round(mass * 1024 / bytes, 6) AS rate, round(mass * 1024 / bytes / base, 6) AS lift FROM r, b""")  # fmt: skip
def rule_self_check(findings, files, changes, commits):
    """A22."""
    return C.self_check(findings, files, H.fix_history(changes, commits))


# ---- scores and rules


@query("complexity", """ SELECT 'complexity' AS rule_name, CASE WHEN cognitive >= 25 THEN 'high' ELSE 'medium' END AS severity, file_path, qualified_name, line FROM complexity WHERE cognitive >= 15 OR cyclomatic >= 10
  UNION ALL SELECT 'long-function', CASE WHEN line_count >= 150 THEN 'medium' ELSE 'low' END, file_path, qualified_name, line FROM complexity WHERE line_count >= 75
  UNION ALL SELECT 'long-parameter-list', CASE WHEN param_count >= 10 THEN 'medium' ELSE 'low' END, file_path, qualified_name, line FROM complexity WHERE param_count >= 7""")  # fmt: skip
def complexity_rules(complexity):
    """R6, R7, R8."""
    return R.complexity_findings(complexity)


@query("findings", " SELECT * FROM findings WHERE severity IN ('high', 'critical')")
def severity_floor(findings):
    """F1."""
    return R.severity_floor(findings, 2)


@query("symbols calls", """, s AS (SELECT * FROM symbols), k AS (SELECT caller_symbol_id AS caller, t.module_id AS m, count(*) AS n FROM calls JOIN s t ON t.id = callee_symbol_id GROUP BY 1, 2),
  r AS (SELECT c.id AS caller_symbol_id, c.qualified_name, c.file_path, c.module_id, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (m = c.module_id), 0) AS BIGINT) AS own, (max((n, m)) FILTER (m <> c.module_id))[2] AS foreign_module, max(n) FILTER (m <> c.module_id) AS foreign_calls
  FROM k JOIN s c ON c.id = caller WHERE c.kind IN ('function', 'method') GROUP BY 1, 2, 3, 4)
  SELECT *, CASE WHEN own = 0 AND foreign_calls >= 10 THEN 'medium' ELSE 'low' END AS severity FROM r WHERE foreign_calls >= 5 AND foreign_calls >= 3 * greatest(own, 1) AND foreign_calls * 2 >= total""")  # fmt: skip
def feature_envy(symbols, calls):
    """R9, A27."""
    return R.feature_envy(symbols, calls)


@query("modules dependencies", FANS + """, e AS (SELECT source, count(*) AS edges, count(*) FILTER (t.instability > s.instability + 1e-9) AS uphill FROM edges JOIN fans s ON s.name = source JOIN fans t ON t.name = target GROUP BY 1)
  SELECT source, edges, uphill, round(uphill / edges, 6) AS share, round(greatest(0.5, least(0.95, 0.5 + uphill / edges / 2)), 6) AS confidence FROM e WHERE uphill / edges >= 0.3""")  # fmt: skip
def unstable_dependencies(modules, deps):
    """R27."""
    edges = C.local_edges(deps)
    return R.unstable_dependencies(C.fans(modules, edges), edges)


def _rank(col: str, floor: int) -> str:
    return f"(SELECT greatest({floor}, coalesce(max(v), 0)) FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS r, count(*) OVER () AS n FROM fans WHERE {col} > 0) WHERE r <= round(0.9 * (n - 1)) + 1)"


@query("modules dependencies", FANS + f" SELECT name, fan_in, fan_out, round(greatest(0.5, least(0.99, (fan_in / i + fan_out / o) / 4)), 6) AS confidence FROM fans, (SELECT {_rank('fan_in', 3)} AS i, {_rank('fan_out', 3)} AS o) WHERE fan_in >= i AND fan_out >= o")
def hub_like(modules, deps):
    """R26."""
    return R.hubs(C.fans(modules, C.local_edges(deps)))


@query("files complexity file_changes", CHURN + """, c AS (SELECT module_name AS name, count(DISTINCT commit_id) AS churn FROM file_churn GROUP BY 1), x AS (SELECT module_name AS name, sum(cognitive) AS cognitive FROM complexity JOIN files ON path = file_path GROUP BY 1),
  z AS (SELECT name, churn, cognitive, (churn / greatest(1, max(churn) OVER ()) * 0.5 + cognitive / greatest(1, max(cognitive) OVER ()) * 0.5) * 100 AS score FROM c JOIN x USING (name))
  SELECT name, round(score, 6) AS score FROM z WHERE churn >= 3 AND cognitive >= 10 AND score >= 10 ORDER BY score DESC, name LIMIT 10""")  # fmt: skip
def component_hotspots(files, complexity, changes):
    """R31."""
    m = H.churn(files, changes, "module_name").select(F.col("module_name").alias("name"), F.col("commits").alias("churn"))
    return R.component_hotspots(m.join(C.cognitive_totals(complexity, files).withColumnRenamed("module_name", "name"), "name"))


@query("modules dependencies findings", FANS + """, r AS (SELECT name, fan_in, fan_out, fan_in + fan_out AS coupling, length(name) AS churn, fan_in * 3 AS complexity, 0.25 AS fragmentation, fan_out % 3 AS violations FROM fans)
  , s AS (SELECT *, (churn / greatest(1, max(churn) OVER ()) * 0.25 + coupling / greatest(1, max(coupling) OVER ()) * 0.2 + complexity / greatest(1, max(complexity) OVER ()) * 0.2 + fan_in / greatest(1, max(fan_in) OVER ()) * 0.12 + fan_out / greatest(1, max(fan_out) OVER ()) * 0.13 + fragmentation * 0.07 + violations / greatest(1, max(violations) OVER ()) * 0.03) * 100 AS score FROM r)
  SELECT name, round(score, 6) AS score, churn, fan_in, fan_out, coupling, complexity, round(CAST(fragmentation AS DOUBLE), 6) AS fragmentation, violations FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 15""")  # fmt: skip
def weighted_hotspots(modules, deps, findings):
    """A15, T2; measures that the star schema lacks are simple functions of the fans."""
    f = C.fans(modules, C.local_edges(deps)).drop("instability")
    one = lambda e, n: f.select("name", F.expr(e).alias(n))
    return C.scored_hotspots(f, one("CAST(length(name) AS BIGINT)", "churn"), one("fan_in * 3", "complexity"), one("0.25D", "fragmentation"), one("fan_out % 3", "violations"), 15)


# ---- graph


@query("sparse_dependencies", """, e AS (SELECT DISTINCT target_module AS s, source_module AS t FROM sparse_dependencies WHERE source_module <> target_module), w(node, depth) AS (SELECT (SELECT min(s) FROM e), 0 UNION SELECT t, depth + 1 FROM w JOIN e ON s = node WHERE depth < 3)
  SELECT node, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")  # fmt: skip
def blast_radius(deps):
    """Who depends on the first target, within three hops."""
    edges = C.local_edges(deps)
    return G.blast_radius(edges, edges.agg(F.min("target").alias("node")))


@query("sparse_dependencies", """, e AS (SELECT DISTINCT source_module AS s, target_module AS t FROM sparse_dependencies WHERE source_module <> target_module), w(node) AS (SELECT (SELECT min(s) FROM e) UNION SELECT t FROM w JOIN e ON s = node)
  SELECT DISTINCT n AS node FROM (SELECT s AS n FROM e UNION SELECT t FROM e) WHERE n NOT IN (SELECT node FROM w)""")  # fmt: skip
def unreachable_nodes(deps):
    """G16."""
    edges = C.local_edges(deps)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return G.unreachable(nodes, edges, edges.agg(F.min("source").alias("node")))


REACH = ", e AS (SELECT DISTINCT source_module AS s, target_module AS t FROM {d} WHERE source_module <> target_module), w(a, b) AS (SELECT s, t FROM e UNION SELECT a, t FROM w JOIN e ON s = b)"


@query("dependencies", REACH.format(d="(SELECT * FROM dependencies WHERE NOT is_external) d") + ", p AS (SELECT x.a AS node, x.b AS peer FROM w x JOIN w y ON x.a = y.b AND x.b = y.a) SELECT node, min(least(node, peer)) AS component FROM p GROUP BY 1 HAVING count(*) FILTER (peer <> node) > 0")
def strong_components(deps):
    """G4, G5, R25."""
    return G.strong_components(C.local_edges(deps))


@query("cyclic_dependencies", """, e AS (SELECT DISTINCT source_module AS s, target_module AS t FROM cyclic_dependencies), w(path) AS (SELECT [s, t] FROM e WHERE s < t UNION ALL SELECT list_append(path, t) FROM w JOIN e ON s = path[-1] WHERE t > path[1] AND NOT list_contains(path, t) AND len(path) < 12)
  SELECT path[1] AS first, len(path) AS length, array_to_string(path, ' > ') AS cycle FROM w WHERE EXISTS (SELECT 1 FROM e WHERE s = path[-1] AND t = path[1])""")  # fmt: skip
def elementary_cycles(deps):
    """G6, G7."""
    return G.elementary_cycles(C.local_edges(deps), per_component=1000).select(F.col("cycle")[0].alias("first"), F.col("length").cast("long").alias("length"), F.array_join("cycle", " > ").alias("cycle"))


@query("dependencies", EDGES + " SELECT target AS node, count(*) AS users FROM edges GROUP BY 1 HAVING count(*) > 4")
def support_library(deps):
    """G12."""
    return G.support_library(C.local_edges(deps), 4)


@query("sparse_dependencies")
def subsystem_clusters(deps):
    """Grouped function, no SQL form."""
    return G.subsystems(C.local_edges(deps), threshold=6).select("node", "subsystem", "role")


@query("texts", """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS token, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts), w AS (SELECT doc_id, k, list(token) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM l),
  p AS (SELECT doc_id, k, run FROM w WHERE len(run) = 3), f AS (SELECT run, min((doc_id, k)) AS f FROM p GROUP BY 1 HAVING count(*) > 1), d AS (SELECT f[1] AS first_file, f[2] AS first_at, doc_id AS file, k FROM p JOIN f USING (run) WHERE f[1] <> doc_id OR abs(k - f[2]) >= 3),
  i AS (SELECT *, k - first_at AS shift, k - row_number() OVER (PARTITION BY first_file, file, k - first_at ORDER BY k) AS island FROM d)
  SELECT first_file, min(first_at) - 1 AS first_at, file, min(k) - 1 AS "at", count(*) + 2 AS length FROM i GROUP BY first_file, file, shift, island""")  # fmt: skip
def clone_runs(texts):
    """Duplicate runs of three lines or more."""
    lines = texts.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "token"))
    return G.clone_runs(lines.select("file", F.col("at").cast("long").alias("at"), "token"), 3)


# ---- sets, snapshots, windows


DIFF = ", o AS (SELECT DISTINCT * FROM snapshot_old WHERE source_module <> target_module), n AS (SELECT DISTINCT * FROM snapshot_new WHERE source_module <> target_module), diff AS (SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n))"


@query("snapshot_old snapshot_new", DIFF + " SELECT * FROM diff")
def snapshot_dependency_diff(old, new):
    """P1, P2."""
    return S.dependency_diff(old, new)


@query("snapshot_old snapshot_new", DIFF + " SELECT a AS added, r AS removed, CASE WHEN a >= 10 THEN 'high' WHEN a + r > 0 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'removed') AS r FROM diff)")
def snapshot_diff_risk(old, new):
    """The band."""
    return S.diff_risk(S.dependency_diff(old, new))


@query("snapshot_old snapshot_new", " SELECT DISTINCT * FROM snapshot_old INTERSECT SELECT DISTINCT * FROM snapshot_new")
def ratchet(old, new):
    """P5."""
    return S.ratchet(old, new, ["source_module", "target_module", "specifier"])


@query("old_files new_files", " SELECT path, CASE WHEN o.content_hash IS NULL THEN 'added' WHEN n.content_hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old_files o FULL JOIN new_files n USING (path) WHERE o.content_hash IS DISTINCT FROM n.content_hash")
def snapshot_file_diff(old, new):
    """J11."""
    return S.file_diff(old, new)


@query("old_files new_files", " SELECT path, CASE WHEN o.content_hash IS NULL THEN 'add' WHEN n.content_hash IS NULL THEN 'remove' ELSE 'update' END AS action FROM old_files o FULL JOIN new_files n USING (path) WHERE o.content_hash IS DISTINCT FROM n.content_hash")
def differential_sync(old, new):
    """K1, K2."""
    return S.differ(old, new, "path", "content_hash")


@query("old_files new_files", " SELECT path AS identity, 'new' AS state FROM new_files ANTI JOIN old_files USING (path) UNION ALL SELECT path, 'resolved' FROM old_files ANTI JOIN new_files USING (path)")
def findings_new_resolved(old, new):
    """J9, J10."""
    return S.split_findings(old.select(F.col("path").alias("identity")), new.select(F.col("path").alias("identity")))


@query("snapshot_metrics", " SELECT metric_name, place, value, value - lag(value) OVER (PARTITION BY metric_name ORDER BY place) AS delta FROM snapshot_metrics")
def metric_history(metrics):
    """W2."""
    return S.metric_history(metrics)


@query("snapshot_metrics", " SELECT metric_name, arg_min(value, place) AS first, arg_max(value, place) AS last, arg_max(value, place) - arg_min(value, place) AS change, min(value) AS least, max(value) AS most FROM snapshot_metrics GROUP BY 1")
def metric_summary(metrics):
    """W2."""
    return S.metric_summary(metrics)


@query("snapshot_metrics", """, p AS (SELECT metric_name, coalesce(sum(value) FILTER (place = 3), 0) AS base, coalesce(sum(value) FILTER (place = 5), 0) AS head FROM snapshot_metrics WHERE place IN (3, 5) GROUP BY 1)
  SELECT metric_name, round(base::DOUBLE, 6) AS base, round(head::DOUBLE, 6) AS head, round((head - base)::DOUBLE, 6) AS delta, round(CASE WHEN base = 0 THEN CASE WHEN head = 0 THEN 0 ELSE 100 END ELSE (head - base)::DOUBLE * 100 / base::DOUBLE END, 6) AS percent FROM p WHERE base <> 0 OR head <> 0""")  # fmt: skip
def metric_drift(metrics):
    """P6, W7."""
    return S.drift(metrics.withColumn("value", F.col("value").cast("double")), 3, 5)


@query("snapshot_metrics", " SELECT * FROM (SELECT snapshot_id, place, metric_name, value FROM snapshot_metrics WHERE metric_name = 'click' ORDER BY place DESC LIMIT 12) ORDER BY place")
def last_metric_points(metrics):
    """T6."""
    return S.last_points(metrics, "click", 12)


@query("user_events", " SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS ordinal FROM user_events")
def repeat_ordinals(events):
    """W4, W5."""
    return S.with_ordinals(events, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("findings", ", r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS r FROM findings) SELECT id, title FROM r WHERE r <= 2 ORDER BY title, id LIMIT 40")
def capped_matches(findings):
    """T4."""
    return S.capped(findings.select("id", "title"), "title", ["id"], 2, 40)


@query("findings", " SELECT id, title, severity FROM findings ORDER BY title, id LIMIT 25 OFFSET 10")
def finding_page(findings):
    """T3."""
    return S.page(findings.select("id", "title", "severity"), ["title", "id"], 10, 25)


# ---- text


@query("texts", ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) SELECT doc_id, regexp_extract(line, 'token = \"([0-9a-f]{20,})\"', 1) AS value FROM l WHERE regexp_matches(line, 'token = \"[0-9a-f]{20,}\"')")
def high_entropy_tokens(texts):
    """Values bound to a secret's name; hex needs 3 bits a character."""
    lines = texts.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.regexp_extract("line", 'token = "([0-9a-f]{20,})"', 1).alias("value"))
    return lines.where(F.col("value") != "").where(T.high_entropy_secret(F.col("value")))


@query("pages", " SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def html_links(pages):
    """S21."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("link"))


@query("messages", """, l AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS place, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM messages),
  m AS (SELECT place, n AS line_number, line[1:160] AS line, row_number() OVER (PARTITION BY place ORDER BY n) AS r FROM l WHERE regexp_matches(line, '(?i)the [a-z]+'))
  SELECT place, line_number, line FROM m WHERE r <= 5 ORDER BY place, line_number LIMIT 50""")  # fmt: skip
def text_search(messages):
    """Every turn of a conversation is a file."""
    placed = messages.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("place"), "text")
    return T.grep(placed, "the [a-z]+", key="place").select("place", F.col("line_number").cast("long").alias("line_number"), "line")


@query("files", " SELECT path, 'file:' || left(sha256(path || chr(0) || module_name || chr(0)), 24) AS id FROM files")
def stable_ids(files):
    """X1."""
    return files.select("path", T.stable_id("file", F.col("path"), F.col("module_name")).alias("id"))


@query("modules", " SELECT name, levenshtein(lower(name), 'nation_41') AS distance FROM modules WHERE levenshtein(lower(name), 'nation_41') <= 2 ORDER BY 2, 1 LIMIT 5")
def did_you_mean(modules):
    """T9, X6."""
    d = T.label_distance(F.col("name"), "nation_41")
    return modules.select("name", d.cast("long").alias("distance")).where("distance <= 2").orderBy("distance", "name").limit(5)


@query("symbols complexity", " SELECT c.file_path, c.line, arg_min(s.qualified_name, (s.end_line - s.start_line, s.qualified_name)) AS symbol FROM complexity c JOIN symbols s ON s.file_path = c.file_path AND c.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2")
def enclosing_symbols(symbols, complexity):
    """J17."""
    return R.enclosing_symbol(complexity.select("file_path", "line").distinct(), symbols)


# ---- further joins, rules and contract forms


@query("symbols", """, m AS (SELECT file_path, regexp_extract(qualified_name, '^(.*)\\.[^.]*$', 1) AS owner, end_line - start_line + 1 AS n FROM symbols WHERE kind = 'method'), k AS (SELECT owner, count(*) AS methods, CAST(sum(n) AS BIGINT) AS lines FROM m GROUP BY 1)
  SELECT owner, methods, lines, CASE WHEN methods >= 14 THEN 'medium' ELSE 'low' END AS severity FROM k WHERE methods >= 10""")  # fmt: skip
def large_classes(symbols):
    """Brands stand for classes, all in one file."""
    flat = symbols.withColumn("file_path", F.lit("src/x.ts")).withColumn("end_line", F.col("end_line").cast("long"))
    types = flat.where("kind = 'method'").select("file_path", F.lit("class").alias("kind"), F.regexp_extract("qualified_name", r"^(.*)\.", 1).alias("qualified_name")).distinct()
    return R.large_classes(flat.where("kind = 'method'").select("file_path", "kind", "qualified_name", "start_line", "end_line").unionByName(types, allowMissingColumns=True), 10, 14).select("owner", "methods", "lines", "severity")


@query("user_events", """, f AS (SELECT user_id AS function, list_sort(list(DISTINCT event_type || CAST(event_id % 4 AS STRING))) AS names FROM user_events GROUP BY 1), n AS (SELECT function, list_slice(names, 1, 12) AS names FROM f),
  e AS (SELECT function, unnest(names) AS a FROM n), t AS (SELECT x.function, [x.a, y.a, z.a] AS triple FROM e x JOIN e y ON x.function = y.function AND x.a < y.a JOIN e z ON z.function = y.function AND y.a < z.a),
  s AS (SELECT triple, list_sort(list(DISTINCT function)) AS functions FROM t GROUP BY 1 HAVING count(DISTINCT function) >= 3), g AS (SELECT functions, list_sort(list_distinct(flatten(list(triple)))) AS names FROM s GROUP BY 1)
  SELECT functions, names, CASE WHEN len(names) >= 4 AND len(functions) >= 4 THEN 'medium' ELSE 'low' END AS severity FROM g""")  # fmt: skip
def data_clumps(events):
    """Users stand for functions, event kinds for parameter names."""
    names = events.groupBy(F.col("user_id").alias("function")).agg(F.collect_set(F.concat("event_type", (F.col("event_id") % 4).cast("string"))).alias("names"))
    return R.data_clumps(names)


@query("files complexity", """, v AS (SELECT DISTINCT module_name AS name, CAST(line % 9 AS STRING) || '.' || CAST(cyclomatic AS STRING) || '.0' AS version, [line % 9, cyclomatic, 0] AS v FROM files JOIN complexity ON file_path = path)
  SELECT 'x' AS ecosystem, name, version, 'A-' || name AS advisory, 'high' AS severity FROM v WHERE (v >= [1, 4, 0] AND v < [3, 10, 0]) OR (v >= [5, 0, 0] AND v <= [5, 11, 0])""")  # fmt: skip
def version_audit(files, complexity):
    """Two affected ranges, one closed by a fix, one by its last affected version."""
    packages = files.join(complexity, files.path == complexity.file_path).select(F.lit("x").alias("ecosystem"), F.col("module_name").alias("name"), F.concat_ws(".", (F.col("line") % 9).cast("string"), F.col("cyclomatic").cast("string"), F.lit("0")).alias("version")).distinct()
    event = lambda **k: F.struct(*[F.lit(k.get(c)).cast("string").alias(c) for c in ("introduced", "fixed", "last_affected")])
    events = F.array(event(introduced="1.4"), event(fixed="3.10.0"), event(introduced="5.0.0"), event(last_affected="5.11.0"))
    advisories = files.select(F.lit("x").alias("ecosystem"), F.col("module_name").alias("name")).distinct().select(F.concat(F.lit("A-"), "name").alias("id"), "ecosystem", "name", F.lit(None).cast("string").alias("severity"), events.alias("events"))
    return R.audit(packages, advisories)


@query("files", " SELECT path, CASE WHEN path LIKE 'src/m1/%' THEN 'one' WHEN path LIKE 'src/m1%' THEN 'teens' WHEN path LIKE 'src/%' THEN 'rest' END AS component FROM files")
def component_assignment(files):
    """The most specific glob wins."""
    return R.assign_components(files, [("rest", "src/**"), ("teens", "src/m1*/**"), ("one", "src/m1/**")]).select("path", "component")


@query("files", """, t AS (SELECT path, unnest([array_to_string(string_split(path, '/')[i:], '/') for i in range(1, len(string_split(path, '/')) + 1)]) AS suffix FROM files), k AS (SELECT suffix, min(path) AS path FROM t GROUP BY 1 HAVING count(*) = 1)
  SELECT path, count(*) AS unique_suffixes FROM k GROUP BY 1""")  # fmt: skip
def suffix_index(files):
    """Suffixes that name one file."""
    from .plans.resolve import suffixes

    tails = suffixes(files.withColumn("language", F.lit("python"))).where("suffix LIKE '*/%'")
    once = tails.groupBy("suffix").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.groupBy("path").agg(F.count(F.lit(1)).alias("unique_suffixes"))


@query("file_changes", """, c AS (SELECT commit_id, file_path FROM file_changes UNION ALL SELECT commit_id, regexp_replace(file_path, '/[^/]*$', '') FROM file_changes WHERE commit_id % 5 = 0)
  SELECT commit_id, file_path FROM c WHERE NOT EXISTS (SELECT 1 FROM file_changes d WHERE d.commit_id = c.commit_id AND starts_with(d.file_path, c.file_path || '/'))""")  # fmt: skip
def leaf_changes(changes):
    """Rows that name a folder go."""
    from .functions.paths import parent

    folders = changes.where("commit_id % 5 = 0").select("commit_id", parent(F.col("file_path")).alias("file_path"))
    return V.leaf_changes(changes.select("commit_id", "file_path").unionByName(folders))


@query("complexity symbols coverage", """, t AS (SELECT DISTINCT file_path AS f, line AS l FROM complexity), r AS (SELECT file_path AS p, lines_hit AS a, lines_found AS b FROM coverage)
  SELECT s.id, s.file_path AS file FROM symbols s WHERE EXISTS (SELECT 1 FROM t JOIN r ON f = p AND l BETWEEN a AND b WHERE f = s.file_path AND l BETWEEN s.start_line AND s.end_line)""")  # fmt: skip
def changed_clone_tokens(complexity, symbols, coverage):
    """Symbols stand for clone instances, coverage counts for changed ranges."""
    clones = symbols.select("id", F.col("file_path").alias("file"), "start_line", "end_line")
    tokens = complexity.select(F.col("file_path").alias("file"), "line")
    return V.holds_changed_token(clones, tokens, coverage.select(F.col("file_path").alias("path"), F.col("lines_hit").alias("start"), F.col("lines_found").alias("end"))).select("id", "file")


@query("dependencies", " SELECT source_module, target_module, count(*) AS imports FROM dependencies WHERE NOT is_external AND source_module <> target_module GROUP BY 1, 2")
def declared_edges(deps):
    """A31."""
    return A.declared_edges(deps)


@query("files", " SELECT module_name, 'src/' || module_name || '/**' AS glob FROM (SELECT DISTINCT module_name FROM files)")
def draft_globs(files):
    """The folder that holds a module."""
    return A.common_folder(files)


@query("brand_changes files", """, s AS (SELECT commit_id FROM brand_changes GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), r AS (SELECT * FROM brand_changes SEMI JOIN s USING (commit_id)), p AS (SELECT a.file_path AS a, b.file_path AS b, count(*) AS n FROM r a JOIN r b ON a.commit_id = b.commit_id AND a.file_path < b.file_path GROUP BY 1, 2 HAVING count(*) >= 4)
  SELECT a, b, n, CASE WHEN right(a, 1) = right(b, 1) THEN 'change_coupling' ELSE 'modularity_violation' END AS kind,
  CASE WHEN right(a, 1) = right(b, 1) THEN 'low' WHEN n >= 8 THEN 'high' ELSE 'medium' END AS severity, round(CASE WHEN right(a, 1) = right(b, 1) THEN 0.6 ELSE greatest(0.6, least(0.95, 0.6 + n / 16)) END, 6) AS confidence FROM p""")  # fmt: skip
def change_couplings(changes, files):
    """An edge stands between brands that end in the same digit."""
    brands = changes.select("file_path").distinct()
    x, y = brands.select(F.col("file_path").alias("source")), brands.select(F.col("file_path").alias("target"))
    edges = x.join(y, (F.substring("source", -1, 1) == F.substring("target", -1, 1)) & (F.col("source") < F.col("target")))
    pairs = H.raw_co_changes(changes, 4).select(F.col("left_path").alias("a"), F.col("right_path").alias("b"), "n")
    return R.change_couplings(pairs, edges)


@query("dependencies", " SELECT source_module, specifier, 'banned-import/ones' AS rule_name FROM dependencies WHERE specifier LIKE 'pkg/nation_1%' UNION ALL SELECT source_module, specifier, 'banned-import/nines' FROM dependencies WHERE specifier LIKE '%9'")
def banned_imports(deps):
    """R2, F4."""
    return R.banned_imports(deps, {"ones": "pkg/nation_1*", "nines": "*9"})


@query("dependencies modules", " SELECT specifier, min((source_module, evidence_line))[1] AS site, min((source_module, evidence_line))[2] AS line FROM dependencies GROUP BY 1")
def first_import_sites(deps, modules):
    """A30, R4."""
    return C.first_import_sites(deps)


@query("old_files new_files", " SELECT path, 'unused-dependency' AS rule_name FROM old_files ANTI JOIN new_files USING (path)")
def unused_dependencies(old, new):
    """Declared paths that nothing imports."""
    declared = old.select(F.col("path").alias("name"), F.lit("runtime").alias("scope"))
    return R.unused_dependencies(declared, new.select(F.col("path").alias("name"))).select(F.col("name").alias("path"), "rule_name")


@query("findings", " SELECT id, severity FROM findings WHERE lower(title) LIKE '%f1%' OR lower(file_path) LIKE '%f1%'")
def scoped_findings(findings):
    """F10."""
    return R.touching(findings, "F1").select("id", "severity")


# ---- components of files: metrics and their detectors

LINKS = ", modules AS (SELECT name FROM file_modules), dependencies AS (SELECT * FROM module_links)" + FANS
METRICS = LINKS + CHURN + """, sizes AS (SELECT module_name AS name, count(*) AS files FROM files GROUP BY 1),
kinds AS (SELECT f.module_name AS name, count(*) FILTER (s.kind = 'interface') AS abstract_types, count(*) AS types FROM symbols s JOIN files f ON f.path = s.file_path WHERE s.kind IN ('class', 'interface') GROUP BY 1),
totals AS (SELECT module_name AS name, CAST(sum(cognitive) AS BIGINT) AS cognitive FROM complexity JOIN files ON path = file_path GROUP BY 1),
changed AS (SELECT module_name AS name, count(DISTINCT commit_id) AS churn FROM file_churn GROUP BY 1),
metrics AS (SELECT name, fan_in, fan_out, instability, coalesce(files, 0) AS files, coalesce(abstract_types, 0) AS abstract_types, coalesce(types, 0) AS types, coalesce(cognitive, 0) AS cognitive, coalesce(churn, 0) AS churn, coalesce(abstract_types / types, 0) AS abstractness
  FROM fans LEFT JOIN sizes USING (name) LEFT JOIN kinds USING (name) LEFT JOIN totals USING (name) LEFT JOIN changed USING (name))"""


def _metrics(modules, links, files, symbols, complexity, changes) -> DataFrame:
    churn = H.churn(files, changes, "module_name").select(F.col("module_name").alias("name"), F.col("commits").alias("churn"))
    return C.component_metrics(C.fans(modules, C.local_edges(links)), files, C.abstractness(symbols), C.cognitive_totals(complexity, files).withColumnRenamed("module_name", "name"), churn)


@query("file_modules module_links files symbols complexity file_changes", METRICS + """ SELECT name, fan_in, fan_out, round(CAST(instability AS DOUBLE), 6) AS instability, files, abstract_types, types, cognitive, churn,
  round(CAST(abstractness AS DOUBLE), 6) AS abstractness, round(abs(abstractness + instability - 1), 6) AS distance FROM metrics""")  # fmt: skip
def component_metrics(modules, links, files, symbols, complexity, changes):
    """A17."""
    return _metrics(modules, links, files, symbols, complexity, changes)


def _over(table: str, col: str, floor: int) -> str:
    return _rank(col, floor).replace("FROM fans", f"FROM {table}")


@query("file_modules module_links files symbols complexity file_changes", METRICS + f" SELECT name, fan_in, churn FROM metrics WHERE fan_in >= {_over('metrics', 'fan_in', 3)} AND churn >= {_over('metrics', 'churn', 3)}")
def unstable_interfaces(modules, links, files, symbols, complexity, changes):
    """R32."""
    return R.unstable_interfaces(_metrics(modules, links, files, symbols, complexity, changes))


@query("brand_sizes", f", b AS (SELECT {_over('brand_sizes', 'files', 8)} AS bar) SELECT name, files, CASE WHEN files / bar >= 2 THEN 'high' ELSE 'medium' END AS severity, round(greatest(0.5, least(0.95, 0.5 + (files / bar - 1) / 4)), 6) AS confidence FROM brand_sizes, b WHERE files > bar")
def god_components(sizes):
    """Brands stand for components."""
    return R.god_components(sizes)


@query("modules dependencies", EDGES + ", d AS (SELECT (SELECT count(*) FROM modules) AS modules, (SELECT count(*) FROM edges) AS edges) SELECT modules, edges, round(edges / (modules * (modules - 1)), 6) AS density, CASE WHEN edges / (modules * (modules - 1)) >= 0.35 THEN 'high' ELSE 'medium' END AS severity FROM d WHERE modules >= 10 AND edges / (modules * (modules - 1)) >= 0.15")
def dense_structure(modules, deps):
    """R28."""
    return R.dense_structure(C.density(modules, C.local_edges(deps))).select("modules", "edges", "density", "severity")


@query("files complexity", " SELECT module_name AS component, CAST(sum(cognitive) AS BIGINT) AS cognitive, CAST(count(*) * 13 AS BIGINT) AS budget FROM complexity JOIN files ON path = file_path GROUP BY 1 HAVING sum(cognitive) > count(*) * 13")
def budget_findings(files, complexity):
    """A budget of 13 a function."""
    rows = complexity.join(files.select(F.col("path").alias("file_path"), F.col("module_name").alias("component")), "file_path")
    return R.budget_findings(rows, rows.groupBy("component").agg((F.count(F.lit(1)) * 13).alias("budget")))


@query("line_pairs files module_links", """, p AS (SELECT a.module_name AS ca, b.module_name AS cb FROM line_pairs JOIN files a ON a.path = left_path JOIN files b ON b.path = right_path WHERE a.module_name <> b.module_name),
  n AS (SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, count(*) AS pairs FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM module_links WHERE least(source_module, target_module) = a AND greatest(source_module, target_module) = b)""")  # fmt: skip
def behavioral_coupling(pairs, files, links):
    """R23."""
    return R.behavioral_coupling(pairs, files.select("path", F.col("module_name").alias("component")), C.local_edges(links))


FORBIDDEN = [(f"r{step}", f"nation_{i}", f"NATION_{(i + step) % 25}") for step in (1, 2, 3) for i in range(25)]


@query("dependencies", ", f(rule_name, a, b) AS (VALUES " + ", ".join(map(str, FORBIDDEN)) + ") SELECT rule_name, count(*) AS n FROM dependencies JOIN f ON lower(a) = lower(source_module) AND lower(b) = lower(target_module) GROUP BY 1")
def boundary_violations(deps):
    """Three families of forbidden pairs."""
    return R.boundary_violations(deps, FORBIDDEN)


@query("dependencies sparse_dependencies", " SELECT DISTINCT source_module AS source, target_module AS target FROM dependencies d WHERE source_module <> target_module AND NOT is_external AND NOT EXISTS (SELECT 1 FROM sparse_dependencies s WHERE s.source_module = d.source_module AND s.target_module = d.target_module)")
def absent_edges(declared, deps):
    """Declared edges that nothing uses."""
    return R.absences(C.local_edges(declared).select("source", "target"), C.local_edges(deps))


@query("files complexity module_links", " SELECT path AS file_path, 'c' || CAST(line % 25 AS VARCHAR) AS capability, module_name AS component FROM complexity JOIN files ON path = file_path JOIN module_links ON source_module = module_name AND target_module = 'm' || CAST(line % 25 AS VARCHAR)")
def capability_findings(files, complexity, links):
    """A module is denied the capabilities numbered like the modules it links to."""
    uses = complexity.select("file_path", F.concat(F.lit("c"), (F.col("line") % 25).cast("string")).alias("capability"))
    denied = links.select(F.col("source_module").alias("component"), F.concat(F.lit("c"), F.substring("target_module", 2, 9)).alias("capability"))
    return R.capability_findings(uses, files.select("path", F.col("module_name").alias("component")), denied).select("file_path", "capability", "component")


@query("module_links", """, e AS (SELECT target_module[length(target_module):] || '/' || source_module AS source, target_module[length(target_module):] || '/' || target_module AS target, CASE WHEN source_module < target_module THEN 'a/@x/b' ELSE 'a/b' END AS target_file_path FROM module_links)
  SELECT source, target, target_file_path FROM e WHERE split_part(source, '/', 2) <> split_part(target, '/', 2) AND target_file_path NOT LIKE '%/@x/%'""")  # fmt: skip
def slice_violations(links):
    """Slices of one layer that meet elsewhere than through ``@x`` paths."""
    layer = F.expr("substring(target_module, -1, 1)")
    path = F.when(F.col("source_module") < F.col("target_module"), "a/@x/b").otherwise("a/b")
    return R.slice_violations(links.select(F.concat_ws("/", layer, "source_module").alias("source"), F.concat_ws("/", layer, "target_module").alias("target"), path.alias("target_file_path")))


@query("findings", " SELECT file_path, count(*) AS n, list_sort(list(DISTINCT rule_name)) AS detectors FROM findings GROUP BY 1")
def grouped_diagnoses(findings):
    """A33."""
    return R.group_diagnoses(findings.withColumnRenamed("rule_name", "detector"), "file_path")


@query("findings", """ SELECT severity, confidence, detector, target FROM (SELECT DISTINCT severity, line / 10 AS confidence, rule_name AS detector, title AS target FROM findings)
  ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, confidence DESC, detector, target LIMIT 50""")  # fmt: skip
def diagnosis_order(findings):
    """The first page."""
    rows = findings.select("severity", (F.col("line") / 10).alias("confidence"), F.col("rule_name").alias("detector"), F.col("title").alias("target")).distinct()
    return R.diagnosis_order(rows).limit(50)


@query("role_dependencies", """, r AS (SELECT CASE WHEN contains(source, 'controller') THEN 'controller' WHEN contains(source, 'service') THEN 'service' WHEN contains(source, 'repository') THEN 'repository' END AS role FROM role_dependencies),
  c AS (SELECT role, count(*) AS matching FROM r GROUP BY 1), t AS (SELECT CAST(sum(matching) AS BIGINT) AS total FROM c), b AS (SELECT * FROM c WHERE role IS NOT NULL ORDER BY matching DESC, role LIMIT 1)
  SELECT role, matching, total, round(matching / total, 6) AS confidence FROM b, t WHERE total >= 3 AND matching / total >= 0.2""")  # fmt: skip
def database_convention(deps):
    """J3, A25."""
    return C.database_convention(deps.select(F.col("source").alias("path")), report=0.2)

"""Star-schema test tables in the roles of code facts.

Every role is one statement that both Spark and DuckDB run unchanged, so a query and its
oracle start from the same rows and differ only in how the operator itself is written.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels", "embeddings")


def path_of(key: str) -> str:
    return f"'src/m' || CAST({key} % 25 AS STRING) || '/f' || CAST({key} AS STRING) || '.ts'"


def _edges(most: int) -> str:
    """The ``most`` strongest pairs of a customer's and a supplier's nation: as many edges whatever the tables' size."""
    return f"""SELECT source_module, target_module, n_lines FROM (
        SELECT *, row_number() OVER (ORDER BY n_lines DESC, source_module, target_module) AS strength FROM (
            SELECT cn.n_name AS source_module, sn.n_name AS target_module, count(*) AS n_lines
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
            GROUP BY cn.n_name, sn.n_name) g) r WHERE strength <= {most}"""


ROLES = {
    # one row a pair of modules, 100 edges
    "dependencies": f"""SELECT source_module, target_module, 'pkg/' || lower(target_module) AS specifier,
        CASE WHEN n_lines % 5 = 0 THEN 'type_import' ELSE 'import' END AS dependency_kind, n_lines % 11 = 0 AS is_external, CAST(n_lines % 100 AS INT) AS evidence_line
        FROM ({_edges(100)}) e""",
    "sparse_dependencies": f"SELECT source_module, target_module, 'import' AS dependency_kind, false AS is_external FROM ({_edges(50)}) e",
    # each kind of event with the two that most often come next
    "cyclic_dependencies": """SELECT source_module, target_module, 'import' AS dependency_kind, false AS is_external FROM (
        SELECT source_module, target_module, row_number() OVER (PARTITION BY source_module ORDER BY count(*) DESC, target_module) AS strength FROM (
            SELECT event_type AS source_module, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_module FROM events) t
        WHERE target_module IS NOT NULL AND target_module <> source_module GROUP BY source_module, target_module) r WHERE strength <= 2""",
    "modules": "SELECT n_name AS name FROM nation",
    # modules of files, and which of them part and supplier of a line belong to
    "file_modules": "SELECT DISTINCT 'm' || CAST(p_partkey % 25 AS STRING) AS name FROM part",
    "module_links": """SELECT source_module, target_module, 'import' AS dependency_kind, false AS is_external FROM (
        SELECT source_module, target_module, row_number() OVER (ORDER BY count(*) DESC, source_module, target_module) AS strength FROM (
            SELECT 'm' || CAST(l_partkey % 25 AS STRING) AS source_module, 'm' || CAST(l_suppkey % 25 AS STRING) AS target_module FROM lineitem) t
        GROUP BY source_module, target_module) r WHERE strength <= 120""",
    "line_pairs": f"SELECT DISTINCT {path_of('l_partkey')} AS left_path, {path_of('(l_suppkey * 7 + 1)')} AS right_path FROM lineitem",
    "brand_sizes": "SELECT p_brand AS name, count(*) AS files FROM part GROUP BY p_brand",
    "commits": "SELECT o_orderkey AS id, 'c' || CAST(o_orderkey AS STRING) AS sha, 'a' || CAST(o_custkey % 37 AS STRING) AS author_email, CAST(o_orderdate AS TIMESTAMP) AS committed_at, o_orderstatus = 'F' AS is_fix FROM orders",
    "file_changes": f"SELECT l_orderkey AS commit_id, {path_of('l_partkey')} AS file_path, CASE WHEN l_linenumber = 7 AND l_partkey % 10 <> 0 THEN {path_of('(l_partkey - 1)')} END AS previous_path FROM lineitem",
    "brand_changes": "SELECT l_orderkey AS commit_id, p_brand AS file_path FROM lineitem JOIN part ON l_partkey = p_partkey",
    "supplier_changes": "SELECT l_orderkey AS commit_id, 's' || CAST(l_suppkey AS STRING) AS file_path FROM lineitem",
    "files": f"SELECT {path_of('p_partkey')} AS path, 'm' || CAST(p_partkey % 25 AS STRING) AS module_name, CAST(p_size * 400 AS BIGINT) AS size_bytes, CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'typescript' END AS language FROM part",
    "complexity": f"SELECT {path_of('p_partkey')} AS file_path, p_name AS qualified_name, p_size AS line, p_size % 15 AS cyclomatic, p_size % 31 AS cognitive, p_size * 4 AS line_count, CAST(p_partkey % 12 AS INT) AS param_count FROM part",
    "symbols": f"SELECT p_partkey AS id, {path_of('p_partkey')} AS file_path, 'm' || CAST(p_partkey % 25 AS STRING) AS module_id, CASE WHEN p_size % 5 = 0 THEN 'class' WHEN p_size % 5 = 1 THEN 'interface' WHEN p_size % 5 = 2 THEN 'method' ELSE 'function' END AS kind, CASE WHEN p_size % 5 = 2 THEN p_brand || '.' || CAST(p_partkey AS STRING) ELSE p_brand END AS qualified_name, p_size AS start_line, p_size + p_partkey % 60 AS end_line FROM part",
    "calls": "SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey % 150 + 1 AS caller_symbol_id, CASE WHEN l_linenumber <= 4 THEN l_partkey % 7 * 25 + 3 ELSE l_suppkey END AS callee_symbol_id FROM lineitem",
    "coverage": f"SELECT {path_of('p_partkey')} AS file_path, p_size AS lines_found, CAST(p_size - p_partkey % (p_size + 1) AS INT) AS lines_hit FROM part",
    "findings": f"SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, CASE l_returnflag WHEN 'R' THEN 'security/secret' WHEN 'A' THEN 'complexity' ELSE 'unused-export' END AS rule_name, CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS severity, 'f' || CAST(l_partkey AS STRING) AS title, {path_of('l_partkey')} AS file_path, l_linenumber AS line FROM lineitem",
    "role_dependencies": "SELECT 'src/' || CASE l_linenumber % 4 WHEN 1 THEN 'controller' WHEN 0 THEN 'service' WHEN 2 THEN 'repository' ELSE 'util' END || CAST(l_partkey AS STRING) AS source, 'src/' || CASE WHEN l_quantity > 44 THEN 'controller' WHEN l_quantity > 20 THEN 'service' ELSE 'model' END || CAST(l_suppkey AS STRING) AS target FROM lineitem",
    "snapshot_old": "SELECT o_orderpriority AS source_module, c_mktsegment AS target_module, o_orderstatus || CAST(o_orderkey % 60 AS STRING) AS specifier FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 97 < 6",
    "snapshot_new": "SELECT o_orderpriority AS source_module, c_mktsegment AS target_module, o_orderstatus || CAST(o_orderkey % 60 AS STRING) AS specifier FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 97 BETWEEN 3 AND 9",
    "old_files": f"SELECT {path_of('p_partkey')} AS path, CAST(p_size AS STRING) AS content_hash FROM part WHERE p_partkey % 10 <> 1",
    "new_files": f"SELECT {path_of('p_partkey')} AS path, CAST(p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS STRING) AS content_hash FROM part WHERE p_partkey % 10 <> 2",
    "snapshot_metrics": "SELECT 's' || CAST(user_id AS STRING) AS snapshot_id, user_id AS place, event_type AS metric_name, round(sum(CAST(value AS DECIMAL(18,6))), 2) AS value FROM events GROUP BY user_id, event_type",
    "user_events": "SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS at, value FROM events",
    "texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "pages": "SELECT page_id, url, html FROM pages",
    "messages": "SELECT conv_id, turn, role, text FROM conversations",
}


def roles(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named roles over the tables of ``sf_dir``; reads only the tables they mention."""
    out = []
    for name in names:
        sql = ROLES[name]
        for table in BASE:
            if re.search(rf"\b{table}\b", sql):
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        out.append(spark.sql(sql))
    return out


def oracle(names: str, body: str) -> str:
    """DuckDB SQL: the roles as CTEs, then ``body`` (more CTEs and the select)."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({ROLES[n]})" for n in names.split()) + body

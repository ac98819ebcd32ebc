"""Schemas of the code-fact tables, and typed empty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVIDENCE = "array<struct<file_path:string,line:int,symbol:string,detail:string>>"
SCHEMAS = {
    "repositories": "id string, root_path string, created_at timestamp",
    "files": "id string, path string, language string, content_hash string, size_bytes bigint, module_name string, last_indexed_at timestamp",
    "modules": "id string, name string, path_prefix string",
    "dependencies": "id string, source_file_path string, target_file_path string, source_module string, target_module string, specifier string, dependency_kind string, is_external boolean, evidence_line int",
    "symbols": "id string, file_id string, module_id string, language string, kind string, name string, qualified_name string, start_line int, end_line int, visibility string",
    "calls": "id string, caller_symbol_id string, callee_symbol_id string, callee_name string, call_kind string, evidence_line int",
    "apis": "id string, module_id string, method string, path string, name string, handler_symbol_id string, evidence_line int",
    "schema_objects": "id string, schema_kind string, name string, evidence_line int",
    "commits": "id string, sha string, parent_shas array<string>, author_email string, committed_at timestamp, message string, is_fix boolean, fix_confidence double",
    "file_changes": "id string, commit_id string, file_path string, change_kind string, previous_path string",
    "complexity": "id string, file_path string, qualified_name string, line int, cyclomatic int, cognitive int, line_count int, param_count int",
    "exports": "id string, file_path string, name string, line int, is_type_only boolean, re_export_source string, re_export_name string",
    "capability_uses": "id string, file_path string, capability string, api string, line int, occurrence_count int",
    "packages": "id string, ecosystem string, name string, version string, manifest_path string, is_direct boolean",
    "coverage": "file_path string, lines_found int, lines_hit int, functions_found int, functions_hit int",
    "co_changes": "left_path string, right_path string, support bigint, jaccard double, lift double, confidence_left double, confidence_right double, commit_shas array<string>",
    "findings": f"id string, finding_kind string, severity string, rule_name string, target_id string, title string, description string, evidence {EVIDENCE}",
    "graph_nodes": "id string, node_kind string, label string",
    "graph_edges": "source_id string, target_id string, edge_kind string, weight double",
    "snapshots": "id string, commit_sha string, created_at timestamp",
    "snapshot_metrics": "snapshot_id string, metric_name string, value double",
    "snapshot_modules": "snapshot_id string, module string",
    "snapshot_dependencies": "snapshot_id string, source_module string, target_module string, specifier string, is_external boolean",
    "snapshot_files": "snapshot_id string, path string, content_hash string",
    "snapshot_findings": f"snapshot_id string, identity string, finding_kind string, severity string, rule_name string, title string, evidence {EVIDENCE}",
}
NODE_KINDS = ("repository", "module", "file", "symbol", "api", "schema_object", "package")
EDGE_KINDS = ("contains", "depends_on", "declares", "calls", "exposes", "handles", "reads", "writes")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])

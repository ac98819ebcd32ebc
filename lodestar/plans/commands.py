"""The query grammar and the commands over an index."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coupling as C
from ..operators import graph as G
from ..operators import rules as R
from ..sinks import tables as K
from .index import Index, findings

VERBS = ("deps", "rdeps", "module", "paths", "cycles", "hotspots", "violations")


@dataclass
class Query:
    verb: str
    target: str | None = None
    other: str | None = None


def parse(text: str) -> Query:
    """``deps X``, ``rdeps X``, ``module X``, ``paths X``, ``a -> b``, ``cycles``, ``hotspots``, ``violations``."""
    text = text.strip()
    if m := re.fullmatch(r"(.+?)\s*->\s*(.+)", text):
        return Query("relation", m[1], m[2])
    verb, _, target = text.partition(" ")
    if verb not in VERBS:
        raise ValueError(f"unknown query {verb!r}; one of {', '.join(VERBS)} or 'a -> b'")
    needs = verb in ("deps", "rdeps", "module", "paths")
    if needs != bool(target.strip()):
        raise ValueError(f"{verb} takes {'a' if needs else 'no'} target")
    return Query(verb, target.strip() or None)


def graph(ix: Index) -> tuple[DataFrame, DataFrame]:
    nodes, edges = K.graph_tables(ix.files, ix.dependencies, ix.symbols, ix.calls, ix.apis, ix.accesses)
    return nodes, edges.where("edge_kind <> 'contains' AND edge_kind <> 'declares'").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))


def run(ix: Index, text: str) -> DataFrame:
    """The rows that answer a query."""
    q = parse(text)
    if q.verb == "cycles":
        return G.elementary_cycles(C.local_edges(ix.dependencies, runtime_only=True))
    if q.verb == "hotspots":
        return C.top_hotspots(C.fans(ix.modules(), C.local_edges(ix.dependencies)))
    if q.verb == "violations":
        return findings(ix)
    nodes, edges = graph(ix)
    one = lambda t: resolved(nodes, edges, t)
    if q.verb == "relation":
        return G.relation(edges, one(q.target), one(q.other))
    if q.verb == "module":
        return C.fans(ix.modules(), C.local_edges(ix.dependencies)).where(F.col("name") == one(q.target))
    start = ix.files.sparkSession.createDataFrame([(one(q.target),)], "node string")
    if q.verb == "paths":
        return G.blast_paths(edges, start)
    return G.blast_radius(edges, start, "down" if q.verb == "deps" else "up", 1)


def resolved(nodes: DataFrame, edges: DataFrame, text: str) -> str:
    """The id a target text means; the error names what comes close."""
    row = G.resolve_target(nodes, text).first()
    if row is None:
        close = [r["label"] for r in G.suggest(nodes, edges, text).collect()]
        raise LookupError(f"no {text!r} here" + (f"; did you mean {', '.join(close)}?" if close else ""))
    return row["id"]


def summary(ix: Index) -> DataFrame:
    return C.summary(ix.modules(), ix.dependencies, G.strong_components(C.local_edges(ix.dependencies, runtime_only=True)).select("component").distinct())


def impact(ix: Index, target: str, direction: str = "up", depth: int = G.BLAST_DEPTH) -> DataFrame:
    nodes, edges = graph(ix)
    start = ix.files.sparkSession.createDataFrame([(resolved(nodes, edges, target),)], "node string")
    return G.blast_summary(G.blast_radius(edges, start, direction, depth), nodes)


def report(ix: Index, command: str = "violations", **meta) -> str:
    """Findings as the JSON envelope, gravest first."""
    return K.envelope(command, K.rows(R.severity_floor(findings(ix), 0)), **meta)


def explain(row: dict) -> str:
    """A finding in one plain sentence, the same on every run."""
    where = f"{row['file_path']}:{row['line']}" if row.get("line") else row["file_path"]
    return f"{row['rule_name']} ({row['severity']}) at {where}: {row['title']}."

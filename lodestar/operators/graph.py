"""Graph operators: frontier loops, components, cycles, taint, reachability, clones.

Edges are (source, target) rows.  Every loop settles its frontier as a written table a
round, anti-joins what it has visited, and stops on an empty frontier or its bound.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

CYCLES_PER_COMPONENT, CYCLE_LENGTH, BLAST_DEPTH, TAINT_DEPTH, PATHS_SHOWN = 20, 12, 3, 8, 20
BANDS = ((75, "critical"), (50, "high"), (25, "medium"))


def frontier(edges: DataFrame, seeds: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """(keys..., node, depth) for all that is reachable from ``seeds`` (keys..., node), seeds at depth 0.

    ``keys`` are carried along: each combination is a search of its own.
    """
    hops = edges.select(F.col("source").alias("__s"), F.col("target").alias("__t")).distinct()
    seen = front = settle(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(hops, front.node == hops["__s"]).select(*keys, F.col("__t").alias("node")).distinct()
        front = settle(step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def risk_band(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def blast_radius(edges: DataFrame, target: DataFrame, direction: str = "up", depth: int = BLAST_DEPTH) -> DataFrame:
    """(node, depth) within ``depth`` hops of ``target`` (one row, node): who depends on it (up), what it uses (down) or both."""
    if direction == "both":
        up, down = (blast_radius(edges, target, d, depth) for d in ("up", "down"))
        return up.unionByName(down).groupBy("node").agg(F.min("depth").alias("depth"))
    return frontier(reverse(edges) if direction == "up" else edges, target, [], depth).where("depth > 0")


def blast_paths(edges: DataFrame, target: DataFrame, depth: int = BLAST_DEPTH, most: int = PATHS_SHOWN) -> DataFrame:
    """Simple label paths from ``target`` outward, the first ``most`` in order of length and label."""
    rows = target.select(F.array("node").alias("path"))
    hops = edges.select(F.col("source").alias("__s"), F.col("target").alias("__t")).distinct()
    found = None
    for _ in range(depth):
        rows = settle(rows.join(hops, F.element_at("path", -1) == hops["__s"]).where(~F.expr("array_contains(path, __t)")).select(F.concat("path", F.array("__t")).alias("path")))
        found = rows if found is None else found.unionByName(rows)
    return found.orderBy(F.size("path"), F.array_join("path", " > ")).limit(most)


def blast_summary(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts by kind of what is reached, the risk 5 modules + 6 apis + 6 tables + symbols, capped at 100 for display, and its band."""
    rows = reached.join(nodes.select(F.col("id").alias("node"), "node_kind"), "node")
    row = rows.agg(*[F.count_if(F.col("node_kind") == k).alias(n) for n, k in (("modules", "module"), ("apis", "api"), ("tables", "schema_object"), ("symbols", "symbol"), ("files", "file"))])
    raw = 5 * F.col("modules") + 6 * F.col("apis") + 6 * F.col("tables") + F.col("symbols")
    return row.withColumn("risk_score", F.least(raw, F.lit(100))).withColumn("risk", risk_band(raw))


def resolve_target(nodes: DataFrame, text: str) -> DataFrame:
    """The node a text means: its id, else its label, else the first label that holds it (``table:`` and ``api:`` narrow the kind)."""
    kind, _, rest = text.partition(":")
    kinds = {"table": "schema_object", "api": "api"}
    pool, want = (nodes.where(F.col("node_kind") == kinds[kind]), rest) if kind in kinds and rest else (nodes, text)
    tier = F.when(F.col("id") == text, 0).when(F.col("label") == want, 1).when(F.lower("label").contains(want.lower()), 2)
    return pool.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.length("label"), "label", "id").limit(1)


def suggest(nodes: DataFrame, references: DataFrame, text: str, most: int = 5) -> DataFrame:
    """Did you mean: labels (or what follows the last / or ::) within 1 + len/4 edits, most referenced first."""
    leaf = F.regexp_extract("label", r"([^/:]+)$", 1)
    distance = F.least(F.levenshtein(F.lower("label"), F.lit(text.lower())), F.levenshtein(F.lower(leaf), F.lit(text.lower())))
    rows = nodes.withColumn("distance", distance).where(F.col("distance") <= 1 + len(text) // 4)
    counts = references.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    return rows.join(counts, "id", "left").na.fill(0, ["refs"]).orderBy("distance", F.desc("refs"), "label").limit(most)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes in cycles; a component is named by its smallest node.

    Colouring: nodes without a way in or out are trimmed; the least label that reaches a
    node spreads forward; what reaches that label's owner within its colour is its
    component; the rest goes round again.  Work follows the edges left, not pairs of nodes.
    """
    left = settle(edges.where("source <> target").select("source", "target").distinct())
    found = None
    while True:
        n = left.count()
        while True:  # trim
            left = settle(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            now = left.count()
            if now == n:
                break
            n = now
        if not n:
            break
        colour = settle(left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # the least label that reaches each node
            into = left.join(colour, left.source == colour.node).select(F.col("target").alias("node"), "colour")
            spread = settle(into.unionByName(colour).groupBy("node").agg(F.min("colour").alias("colour")))
            changed = spread.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = spread
            if changed:
                break
        inside = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("c")), "source").join(colour.select(F.col("node").alias("target"), "colour"), "target").where("c = colour").select("source", "target", "colour")
        back = inside.select(F.concat_ws("\0", "colour", "target").alias("source"), F.concat_ws("\0", "colour", "source").alias("target"))
        roots = colour.where("node = colour").select(F.concat_ws("\0", "colour", "node").alias("node"))
        reached = settle(frontier(back, roots, []).select(F.split("node", "\0").alias("p")).select(F.col("p")[1].alias("node"), F.col("p")[0].alias("component")))
        found = reached if found is None else found.unionByName(reached)
        left = settle(left.join(reached.select(F.col("node").alias("source")), "source", "left_anti").join(reached.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"))
    if found is None:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    sized = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    return found.join(sized, "component").select("node", F.col("least").alias("component"))


def elementary_cycles(edges: DataFrame, per_component: int = CYCLES_PER_COMPONENT, longest: int = CYCLE_LENGTH) -> DataFrame:
    """(component, cycle) of simple cycles, each from its smallest member, shortest first, capped per component."""
    members = settle(strong_components(edges))
    a, b = members.select(F.col("node").alias("source"), F.col("component").alias("ca")), members.select(F.col("node").alias("target"), "component")
    inner = settle(edges.select("source", "target").distinct().join(a, "source").join(b, "target").where("ca = component").select("component", "source", "target"))
    rows, found, order = inner.select("component", F.array("source", "target").alias("path")).where("path[0] < path[1]"), None, Window.partitionBy("component").orderBy("length", F.array_join("cycle", " > "))
    hops = inner.select(F.col("component").alias("c"), F.col("source").alias("s"), F.col("target").alias("t"))
    for length in range(2, longest + 1):
        rows = settle(rows)
        if rows.isEmpty():
            break
        closed = rows.join(hops, (F.col("component") == F.col("c")) & (F.element_at("path", -1) == F.col("s")) & (F.col("path")[0] == F.col("t"))).select("component", F.col("path").alias("cycle"), F.lit(length).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        found = settle(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_component).drop("r"))
        full = found.groupBy("component").count().where(F.col("count") >= per_component).select("component")
        rows = rows.join(full, "component", "left_anti")  # its cap is met by shorter cycles: no longer one can enter
        rows = rows.join(hops, (F.col("component") == F.col("c")) & (F.element_at("path", -1) == F.col("s"))).where("t > path[0] AND NOT array_contains(path, t)").select("component", F.concat("path", F.array("t")).alias("path"))
    if found is None:
        return edges.select(F.col("source").alias("component"), F.array("source").alias("cycle"), F.lit(0).alias("length")).limit(0)
    return found.select("component", "cycle", "length")


def witness_walks(cycles: DataFrame, imports: DataFrame) -> DataFrame:
    """One file import for each hop of each cycle, chained through the file it arrived at where it can.

    ``imports``: source_module, target_module, source_file, target_file, line.  A walk of
    at most twelve hops is sequential; the candidates of one cycle go to one call.
    """
    hops = cycles.withColumn("id", F.array_join("cycle", " > ")).select("id", F.posexplode(F.expr("transform(cycle, (x, i) -> struct(x AS a, cycle[(i + 1) % size(cycle)] AS b))")).alias("place", "hop")).select("id", "place", F.col("hop.a").alias("source_module"), F.col("hop.b").alias("target_module"))
    w = Window.partitionBy("id", "place", "source_file").orderBy("target_file", "line")
    candidates = hops.join(imports, ["source_module", "target_module"]).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, arrived = [], None
        for place, rows in pdf.sort_values(["place", "source_file", "target_file", "line"]).groupby("place"):
            chained = rows[rows.source_file == arrived]
            row = (chained if len(chained) else rows).iloc[0]
            arrived = row.target_file
            out.append((row.id, place, row.source_file, row.target_file, row.line))
        return pd.DataFrame(out, columns=["id", "place", "source_file", "target_file", "line"])

    return candidates.groupBy("id").applyInPandas(walk, "id string, place int, source_file string, target_file string, line int")


def directory_edges(deps: DataFrame) -> DataFrame:
    """Distinct edges between directories of one module, neither above the other."""
    parent = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    rows = deps.where("NOT is_external AND source_module = target_module").select(parent("source_file_path").alias("source"), parent("target_file_path").alias("target"))
    apart = ~F.startswith(F.concat("source", F.lit("/")), F.concat("target", F.lit("/"))) & ~F.startswith(F.concat("target", F.lit("/")), F.concat("source", F.lit("/")))
    return rows.where(apart).distinct()


def component_of(path: Column, depth: int | None = None) -> Column:
    """A file's component: its parent directory, or the first ``depth`` segments; the root is ``<root>``."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    name = F.array_join(F.slice(parts, 1, depth) if depth else parts, "/")
    return F.when(name == "", "<root>").otherwise(name)


def taint_flows(apis: DataFrame, flow: DataFrame, inputs: DataFrame, sinks: DataFrame, depth: int = TAINT_DEPTH) -> DataFrame:
    """Flows from API handlers along calls to sinks: (api, sink, kind, tainted, severity).

    The state is (node, carries input): a path carries input once it meets a symbol that
    reads a request.  Reads are medium, writes high, eval and commands critical.
    """
    tainting = inputs.select(F.col("symbol").alias("node"), F.lit(True).alias("reads")).distinct()

    def mark(rows, flag):
        return rows.join(tainting, "node", "left").select("api", "node", (flag | F.coalesce("reads", F.lit(False))).alias("tainted"))

    seen = front = settle(mark(apis.select("api", F.col("handler").alias("node")).distinct(), F.lit(False)).distinct())
    hops = flow.select(F.col("source").alias("__s"), F.col("target").alias("__t")).distinct()
    for _ in range(depth):
        step = front.join(hops, front.node == hops["__s"]).select("api", F.col("__t").alias("node"), F.col("tainted").alias("was"))
        step = step.join(tainting, "node", "left").select("api", "node", (F.col("was") | F.coalesce("reads", F.lit(False))).alias("tainted")).distinct()
        front = settle(step.join(seen, ["api", "node", "tainted"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    rows = seen.join(sinks.select(F.col("symbol").alias("node"), "kind", "label"), "node").groupBy("api", "node", "kind", "label").agg(F.max("tainted").alias("tainted"))
    severity = F.when(F.col("kind") == "reads", "medium").when(F.col("kind") == "writes", "high").otherwise("critical")
    return rows.select("api", F.col("node").alias("sink"), "kind", "label", "tainted", severity.alias("severity"))


def unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that no entry point reaches."""
    return nodes.select("node").join(frontier(edges, entries, []).select("node"), "node", "left_anti")


def used_exports(seeds: DataFrame, forwards: DataFrame) -> DataFrame:
    """(file, name) used directly or through re-exports.

    ``forwards``: a use of (file, name) is a use of (source_file, source_name); a null name
    forwards every name.
    """
    seen = front = settle(seeds.select("file", "name").distinct())
    named, all_names = forwards.where("name IS NOT NULL"), forwards.where("name IS NULL").select("file", "source_file")
    while True:
        step = front.join(named, ["file", "name"]).select(F.col("source_file").alias("file"), F.col("source_name").alias("name")).unionByName(front.join(all_names, "file").select(F.col("source_file").alias("file"), "name"))
        front = settle(step.distinct().join(seen, ["file", "name"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def relation(edges: DataFrame, a: str, b: str, depth: int = BLAST_DEPTH) -> DataFrame:
    """The first shortest path from a to b, if b is within ``depth`` hops."""
    start = edges.sparkSession.createDataFrame([(a,)], "node string")
    paths = blast_paths(edges, start, depth, most=1_000_000)
    return paths.where(F.element_at("path", -1) == b).limit(1)


def calibrate(deps: DataFrame, stem: str, found: Column) -> DataFrame:
    """resolved, none or could_not_resolve: whether unresolved imports could have meant the target."""
    bearing = deps.where(F.startswith("target_module", F.lit("unresolved:")) & (F.regexp_extract("specifier", r"([^/.]+)(?:\.[^/]*)?$", 1) == stem))
    return bearing.agg(F.count(F.lit(1)).alias("unresolved")).withColumn("answer", F.when(found, "resolved").when(F.col("unresolved") > 0, "could_not_resolve").otherwise("none"))


def support_library(edges: DataFrame, threshold: int = 20) -> DataFrame:
    """Nodes that more than ``threshold`` others use."""
    return edges.select("source", "target").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("users")).where(F.col("users") > threshold).select(F.col("target").alias("node"), "users")


def subsystems(edges: DataFrame, threshold: int = 20, low: int = 2, high: int = 20) -> DataFrame:
    """(node, subsystem, role): support library, dominated sets of ``low`` to ``high`` files, adopted orphans.

    Clustering works on the module or file graph of one repository, which is small beside
    the facts; each weakly connected repository (``repository`` column if given) is one call.
    """
    keyed = edges if "repository" in edges.columns else edges.withColumn("repository", F.lit(""))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        repository = pdf.repository.iloc[0]
        succ: dict[str, set[str]] = {}
        pred: dict[str, set[str]] = {}
        for s, t in zip(pdf.source, pdf.target):
            if s != t:
                succ.setdefault(s, set()).add(t)
                pred.setdefault(t, set()).add(s)
        nodes = sorted(set(succ) | set(pred))
        support = {n for n in nodes if len(pred.get(n, ())) > threshold}
        own = [n for n in nodes if n not in support]
        idom = dominators(own, {n: succ.get(n, set()) - support for n in own}, {n: pred.get(n, set()) - support for n in own})
        children: dict[str, list[str]] = {}
        for n in own:
            children.setdefault(idom.get(n), []).append(n)

        def below(n):
            out, todo = [], [n]
            while todo:
                x = todo.pop()
                out.append(x)
                todo += children.get(x, [])
            return sorted(out)

        label, role = {n: "support" for n in support}, dict.fromkeys(support, "support")
        claims = sorted(((n, below(n)) for n in own), key=lambda c: (-len(c[1]), c[0]))
        for n, claim in claims:
            free = [x for x in claim if x not in label]
            if low <= len(free) <= high:
                for x in free:
                    label[x], role[x] = n, "core"
        for n in own:  # orphans, in order: earlier adoptions count
            if n not in label:
                votes: dict[str, int] = {}
                for x in succ.get(n, set()) | pred.get(n, set()):
                    if label.get(x, "support") != "support":
                        votes[label[x]] = votes.get(label[x], 0) + 1
                sizes = pd.Series(list(label.values())).value_counts()
                best = min(votes, key=lambda s: (-votes[s], -sizes[s], s)) if votes else "unclustered"
                label[n], role[n] = best, "adopted" if votes else "orphan"
        return pd.DataFrame([(repository, n, label[n], role[n]) for n in nodes], columns=["repository", "node", "subsystem", "role"])

    return keyed.select("repository", "source", "target").groupBy("repository").applyInPandas(cluster, "repository string, node string, subsystem string, role string")


def dominators(nodes: list[str], succ: dict[str, set[str]], pred: dict[str, set[str]]) -> dict[str, str | None]:
    """Immediate dominators below a virtual entry (None) to all nodes that nothing uses, and to one of each closed cycle."""
    order, seen = [], set()

    def visit(root):
        stack = [(root, iter(sorted(succ.get(root, ()))))]
        seen.add(root)
        while stack:
            n, it = stack[-1]
            nxt = next((x for x in it if x not in seen), None)
            if nxt is None:
                order.append(n)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(succ.get(nxt, ())))))

    roots = [n for n in sorted(nodes) if not pred.get(n)]
    for n in roots:
        visit(n)
    for n in sorted(nodes):
        if n not in seen:
            roots.append(n)
            visit(n)
    rank = {n: i for i, n in enumerate(order)} | {None: math.inf}
    idom: dict[str, str | None] = dict.fromkeys(roots)

    def meet(a, b):
        while a != b:
            while rank[a] < rank[b]:
                a = idom[a]
            while rank[b] < rank[a]:
                b = idom[b]
        return a

    changed = True
    while changed:
        changed = False
        for n in reversed(order):
            if n in roots:
                continue
            known = [p for p in pred.get(n, ()) if p in idom]
            new = known[0]
            for p in known[1:]:
                new = meet(new, p)
            if n not in idom or idom[n] != new:
                idom[n], changed = new, True
    return idom


def token_windows(tokens: DataFrame, k: int) -> DataFrame:
    """(file, at, print) of every run of ``k`` tokens of (file, at, token) rows."""
    w = Window.partitionBy("file").orderBy("at").rowsBetween(0, k - 1)
    rows = tokens.withColumn("run", F.collect_list(F.xxhash64("token")).over(w))
    return rows.where(F.size("run") == k).select("file", "at", F.sha2(F.array_join("run", ","), 256).alias("print"))


def clone_runs(tokens: DataFrame, k: int = 100, min_tokens: int | None = None) -> DataFrame:
    """Maximal duplicate runs: (first_file, first_at, file, at, length) against the first place of each run.

    Windows with one print form a family; every other occurrence is paired with the first
    only (so a family of n gives n - 1 rows), and pairs on one diagonal that follow one
    another merge into a run.
    """
    prints = token_windows(tokens, k)
    first = prints.groupBy("print").agg(F.min(F.struct("file", "at")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = prints.join(first, "print").select(F.col("f.file").alias("first_file"), F.col("f.at").alias("first_at"), "file", "at").where("first_file <> file OR abs(at - first_at) >= " + str(k))
    diagonal = Window.partitionBy("first_file", "file", F.col("at") - F.col("first_at")).orderBy("at")
    runs = pairs.withColumn("island", F.col("at") - F.row_number().over(diagonal)).groupBy("first_file", "file", (F.col("at") - F.col("first_at")).alias("shift"), "island").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    return runs.select("first_file", (F.col("at") - F.col("shift")).alias("first_at"), "file", "at", (F.col("n") + k - 1).alias("length")).where(F.col("length") >= (min_tokens or k))

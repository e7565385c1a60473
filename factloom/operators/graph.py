"""Directed graphs as edge tables (src, dst): degrees, reachability, components, layers, dependency injection.

Fixpoints are semi-naive: a round joins only what the round before found new,
and writes it to the shared folder, so lineage stays flat. Edges with a null
end are ignored; parallel edges and self-loops are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.reach import pairs, sparse
from factloom.scratch import Scratch


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node IS NOT NULL").distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, fan_in, fan_out) including nodes without edges; parallel edges count."""
    base = nodes_of(edges) if nodes is None else nodes.select("node").distinct()
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    return base.join(into, "node", "left").join(out, "node", "left").fillna(0)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, distance) of everything reachable from the roots (node), roots at 0."""
    scratch = Scratch(edges.sparkSession, "reach")
    e = scratch.save(_clean(edges), "edges")
    front = scratch.save(roots.where("node IS NOT NULL").select("node", F.lit(0).alias("distance")).distinct(), "front-0")
    seen, step = front, 0
    while not front.isEmpty():
        step += 1
        nxt = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = scratch.save(nxt.withColumn("distance", F.lit(step)), f"front-{step}")
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs joined by a path of at least one edge.

    As many rows as the closure has: for graphs of modules or packages, not of
    files. Where contracting circles leaves few edges no pair is moved;
    otherwise by path doubling, so log2(diameter) rounds.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    e, few = sparse(edges, scratch)
    if few:
        return pairs(e)
    fresh, step = scratch.save(e.distinct(), "new-0"), 0
    known = fresh
    while not fresh.isEmpty():
        step += 1
        # Of two paths that meet, one at least is new.
        then = fresh.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        before = known.alias("a").join(fresh.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        fresh = scratch.save(then.union(before).distinct().join(known, ["src", "dst"], "left_anti"), f"new-{step}")
        known = known.unionByName(fresh)
    return known


def _trim(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Edges between nodes that still have edges in and out: all others lie on no cycle."""
    step, n = 0, edges.count()
    while True:
        step += 1
        both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        kept = edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")
        edges = scratch.save(kept, f"trim-{label}-{step}")
        now = edges.count()
        if now == n:
            return edges
        n = now


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more; named by their least node.

    Colouring: the least node that reaches a node is its colour; the nodes of
    a colour that reach the colour's own node back are its component. They are
    taken out and the rest is coloured again. Trimming first removes what lies
    on no cycle. Each step moves edges, never pairs of nodes.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    left = scratch.save(_clean(edges).where("src <> dst"), "edges")
    done, round_ = None, 0
    while True:
        round_ += 1
        left = _trim(left, scratch, str(round_))
        if left.isEmpty():
            break
        colour = _least_upstream(left, scratch, round_)
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2")
        back = scratch.save(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), f"back-{round_}")
        # Edges stay within a colour, so each root reaches its own colour only.
        root = colour.where("node = colour").select("node")
        part = scratch.save(reachable(back, root).select("node").join(colour, "node").withColumnRenamed("colour", "component"), f"part-{round_}")
        done = part if done is None else done.unionByName(part)
        gone = part.select("node")
        left = scratch.save(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), f"left-{round_}")
    if done is None:
        node = edges.schema["src"].dataType
        return edges.sparkSession.createDataFrame([], f"node {node.simpleString()}, component {node.simpleString()}")
    sizes = done.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
    return done.join(sizes, "component", "left_semi").select("node", "component")


def _least_upstream(edges: DataFrame, scratch: Scratch, tag: int) -> DataFrame:
    """(node, colour): the least node from which each node can be reached, itself included."""
    now = scratch.save(nodes_of(edges).withColumn("colour", F.col("node")), f"colour-{tag}-0")
    step = 0
    while True:
        step += 1
        pushed = edges.join(now, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "colour")
        nxt = now.withColumn("_old", F.col("colour")).unionByName(pushed.withColumn("_old", F.lit(None).cast(edges.schema["src"].dataType))).groupBy("node").agg(F.min("colour").alias("colour"), F.max("_old").alias("_old"))
        saved = scratch.save(nxt, f"colour-{tag}-{step}")
        moved = saved.where("colour <> _old")
        now = saved.select("node", "colour")
        if moved.isEmpty():
            return now


def injection_cycles(dependencies: DataFrame) -> DataFrame:
    """(node, component) of cycles over non-deferred dependencies (src, dst, deferred); a self-dependency is one."""
    hard = dependencies.where(~F.coalesce("deferred", F.lit(False)))
    own = hard.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    parts = strong_components(hard)
    return parts.unionByName(own.distinct().join(parts, "node", "left_anti"))


def scope_violations(dependencies: DataFrame, scopes: DataFrame) -> DataFrame:
    """(root, node): bindings reachable from a scoped root whose scope is shorter-lived.

    ``scopes`` has (node, rank); a greater rank lives longer, null ranks are
    unscoped and only passed through. A root counts as its own only on a circle.
    """
    scratch = Scratch(dependencies.sparkSession, "scopes")
    rank = scopes.where("rank IS NOT NULL").select("node", "rank")
    e, few = sparse(dependencies, scratch)
    if few:
        # All nodes of the graph are few then, so their ranks are sent to where the pairs are made.
        of = F.broadcast(rank.join(nodes_of(e), "node", "left_semi"))
        seen = pairs(e, rank).select(F.col("src").alias("root"), F.col("dst").alias("node"))
        both = seen.join(of.select(F.col("node").alias("root"), F.col("rank").alias("own")), "root").join(of, "node")
        return both.where("own > rank").select("root", "node")
    front, step = scratch.save(rank.select(F.col("node").alias("root"), "node").distinct(), "front-0"), 0
    seen = None
    while not front.isEmpty():
        step += 1
        nxt = front.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = scratch.save(nxt if seen is None else nxt.join(seen, ["root", "node"], "left_anti"), f"front-{step}")
        seen = front if seen is None else seen.unionByName(front)
    both = (front if seen is None else seen).join(rank, "node").join(rank.select(F.col("node").alias("root"), F.col("rank").alias("own")), "root")
    return both.where("own > rank").select("root", "node")


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (layer, layer) pair is not allowed (src_layer, dst_layer).

    The same layer is always allowed, nodes without a layer are skipped, and a
    layer that is not listed may use none.
    """
    at = lambda end: layers.select(F.col("path").alias(end), F.col("layer").alias(f"{end}_layer")).where(f"{end}_layer IS NOT NULL")
    placed = edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst").where("src_layer <> dst_layer")
    return placed.join(allowed.select("src_layer", "dst_layer").distinct(), ["src_layer", "dst_layer"], "left_anti").select("src", "dst", "src_layer", "dst_layer")


def package_graph(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct package edges (src, dst) to declared packages, without self-edges."""
    known = packages.select(F.col("package").alias("dst")).distinct()
    return imports.select(F.col("package").alias("src"), F.regexp_extract("import", r"^(.*)\.[^.]*$", 1).alias("dst")).where("src <> dst").distinct().join(known, "dst", "left_semi").select("src", "dst")


def consumers(edges: DataFrame) -> DataFrame:
    """(node, consumers): the distinct sources of each target, sorted, joined by commas."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("consumers"))


def transitive_impact(seeds: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(fqn, file): every file hit by each processed symbol, starting from the seeds (fqn).

    A file that references a symbol's simple name and does not declare it is
    hit; a newly hit file's non-private declarations are processed next.
    """
    scratch = Scratch(symbols.sparkSession, "impact")
    syms = scratch.save(symbols.select("fqn", "name", "file", "visibility").distinct(), "symbols")
    uses = scratch.save(refs.select("name", "file").distinct(), "refs")
    declared = syms.select("name", "file").distinct()
    front = scratch.save(seeds.select("fqn").distinct(), "front-0")
    processed, hits, step = front, None, 0
    while not front.isEmpty():
        step += 1
        names = front.join(syms.select("fqn", "name").distinct(), "fqn")
        hit = scratch.save(names.join(uses, "name").join(declared, ["name", "file"], "left_anti").select("fqn", "file").distinct(), f"hits-{step}")
        fresh = hit.select("file").distinct()
        if hits is not None:
            fresh = fresh.join(hits.select("file").distinct(), "file", "left_anti")
        nxt = syms.where("visibility <> 'private'").join(fresh, "file", "left_semi").select("fqn").distinct().join(processed, "fqn", "left_anti")
        front = scratch.save(nxt, f"front-{step}")
        processed = processed.unionByName(front)
        hits = hit if hits is None else hits.unionByName(hit)
    return hits


def live_symbols(symbols: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    """Symbols (fqn, file) reachable from the roots' files.

    Visiting a file makes all of its references count, other than those at a
    declaration of the same name on the same line; each symbol so named is
    live, and its file is visited next.
    """
    sites = symbols.select("file", "name", "line").distinct()
    uses = refs.where(~F.col("in_comment")).join(sites, ["file", "name", "line"], "left_anti").select("file", "name").distinct()
    scratch = Scratch(symbols.sparkSession, "live")
    uses, declared = scratch.save(uses, "uses"), scratch.save(symbols.select("name", "file").distinct(), "declared")
    # From files to the names they use, and from these to the files that declare them: a name
    # declared in k files and used in m meets k + m of them, not k * m.
    front = scratch.save(roots.where("file IS NOT NULL").select("file").distinct(), "front-0")
    seen, step = front, 0
    while not front.isEmpty():
        step += 1
        names = uses.join(front, "file", "left_semi").select("name").distinct()
        front = scratch.save(declared.join(names, "name", "left_semi").select("file").distinct().join(seen, "file", "left_anti"), f"front-{step}")
        seen = seen.unionByName(front)
    named = uses.join(seen, "file", "left_semi").select("name").distinct()
    live = symbols.join(named, "name", "left_semi").select("fqn", "file")
    return live.union(symbols.join(roots.select("file").distinct(), "file", "left_semi").select("fqn", "file")).distinct()


def supertypes(declared: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, supertypes): one lookup each, by qualified name, else by simple name; no closure."""
    by_fqn = declared.groupBy(F.col("fqn").alias("name")).agg(F.min("supertypes").alias("_a"))
    by_name = declared.groupBy(F.regexp_extract("fqn", r"([^.]*)$", 1).alias("name")).agg(F.min("supertypes").alias("_b"))
    return wanted.select("name").distinct().join(by_fqn, "name", "left").join(by_name, "name", "left").select("name", F.coalesce("_a", "_b").alias("supertypes"))


def render_dot(edges: DataFrame) -> DataFrame:
    """(line): a DOT document, one row per line, in order of ``pos``."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), '"', '\\\\"'), F.lit('"'))
    body = edges.select("src", "dst").distinct().select(F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("line"), F.lit(1).alias("pos"))
    ends = edges.sparkSession.createDataFrame([("digraph {", 0), ("}", 2)], "line string, pos int")
    return body.union(ends).orderBy("pos", "line").select("line")


def _mermaid_id(c: str):
    return F.concat(F.lit("n"), F.regexp_replace(c, "[^A-Za-z0-9]", "_"))


def render_mermaid(edges: DataFrame) -> DataFrame:
    """(line): a Mermaid graph, one row per line: its nodes, then its edges, with their label where there is one (column ``label``)."""
    named = edges if "label" in edges.columns else edges.withColumn("label", F.lit(""))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    quoted = F.concat(F.lit('"'), F.regexp_replace("id", '(["\\\\])', "\\\\$1"), F.lit('"'))
    of_nodes = nodes.select(F.concat(F.lit("  "), _mermaid_id("id"), F.lit("["), quoted, F.lit("]")).alias("line"), F.lit(1).alias("pos"))
    arrow = F.when(F.coalesce("label", F.lit("")) == "", " --> ").otherwise(F.concat(F.lit(" -->|"), "label", F.lit("| ")))
    of_edges = named.select(F.concat(F.lit("  "), _mermaid_id("src"), arrow, _mermaid_id("dst")).alias("line"), F.lit(2).alias("pos")).distinct()
    head = edges.sparkSession.createDataFrame([("graph TD", 0)], "line string, pos int")
    return of_nodes.union(of_edges).union(head).orderBy("pos", "line").select("line")


def render_json(edges: DataFrame, scope: str = "module") -> DataFrame:
    """(line): a JSON document with nodes and edges, one of them a line."""
    from pyspark.sql.window import Window

    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(F.to_json(F.struct("id")).alias("v"), F.lit(1).alias("pos"))
    of_edges = edges.select(F.col("src").alias("from"), F.col("dst").alias("to")).distinct().select(F.to_json(F.struct("from", "to")).alias("v"), F.lit(3).alias("pos"))
    rows = nodes.union(of_edges)
    comma = F.when(F.lead("v").over(Window.partitionBy("pos").orderBy("v")).isNull(), "").otherwise(",")
    ends = edges.sparkSession.createDataFrame([(f'{{"scope":"{scope}","nodes":[', 0), ('],"edges":[', 2), ("]}", 4)], "line string, pos int")
    return rows.select(F.concat("v", comma).alias("line"), "pos").union(ends).orderBy("pos", "line").select("line")

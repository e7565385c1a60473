"""Problem 5: parent-child links of unknown depth to full hierarchies.

The forest is walked as Euler tours: every node is entered once and left once,
and each of these two events knows the event that follows it. Ranking the
lists of events gives entry-exit intervals, from which depth, root, ancestors,
descendants and paths follow.

Trees of up to WHOLE nodes are dealt with many at a time in a task: leaves are
peeled layer by layer until only the circles are left, then the tours of what
was peeled are ranked by pointer doubling over arrays. A larger tree, which
may hold any share of all rows, is spread over tasks. There leaves are peeled
once, since a layer costs a round over the cluster, and the lists are ranked by
contraction: in each round events that toss heads take over the next event if
that one tossed tails, so lists shrink to three quarters and all rounds
together move about four times the events. A circle contracts until an event
points to itself, which exposes it. What is left once FIT events remain is
ranked in one task, and the removed events are put back round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.scratch import Scratch

#: Nodes up to which a tree is walked in one task; larger trees are spread.
WHOLE = 100_000
#: Events that one task ranks at the end of the contraction.
FIT = 1_000_000
#: Children of one parent are chained in hash buckets of about this many nodes.
SIBLINGS = 50_000
#: Tour positions in one block of the path scan.
BLOCK = 8192
#: Characters of paths in one batch of the result.
FLUSH = 16_000_000

_SCHEMA = "tree string, node string, root string, depth int, n_descendants int, path string, enter bigint, leave bigint"
_ARROW = pa.schema([("tree", pa.string()), ("node", pa.string()), ("root", pa.string()), ("depth", pa.int32()), ("n_descendants", pa.int32()), ("path", pa.string()), ("enter", pa.int64()), ("leave", pa.int64())])


class _Rows:
    """Result rows, flushed by the size of their paths."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in _ARROW]
        self.size = 0

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)
        self.size += len(row[5]) + 64

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _ARROW)], schema=_ARROW)
        self.__init__()
        return out


# -- trees that fit


def rank_lists(nxt: np.ndarray, rest: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rest, total, last) summed from each event to the end of its list, by pointer doubling.

    ``nxt`` is -1 at an end; an event that never comes to one gets last -1.
    """
    nxt, rest, total = nxt.copy(), rest.copy(), total.copy()
    last = np.where(nxt < 0, np.arange(len(nxt)), -1)
    left = np.flatnonzero(nxt >= 0)
    for _ in range(len(nxt).bit_length() + 1):
        if not len(left):
            break
        to = nxt[left]
        rest[left], total[left], last[left], nxt[left] = rest[left] + rest[to], total[left] + total[to], last[to], nxt[to]
        left = left[nxt[left] >= 0]
    return rest, total, last


def peel(parent: np.ndarray) -> np.ndarray:
    """Whether each node lies on a circle: what is left when leaves are peeled layer by layer."""
    has = parent >= 0
    children = np.bincount(parent[has], minlength=len(parent))
    layer = np.flatnonzero(children == 0)
    circle = np.ones(len(parent), bool)
    while len(layer):
        circle[layer] = False
        above = parent[layer]
        above, gone = np.unique(above[above >= 0], return_counts=True)
        children[above] -= gone
        layer = above[children[above] == 0]
    return circle


def tours(parent: np.ndarray) -> tuple[np.ndarray, ...]:
    """(enter, leave, depth, root) of each node; root is -1 where the chain of parents never ends."""
    n = len(parent)
    circle = peel(parent)
    # Circles are cut, and what hangs below them has tours of its own that are told apart at the end.
    hangs = (parent >= 0) & circle[parent]
    up = np.where(hangs | circle, -1, parent)
    order = np.argsort(up, kind="stable")
    order = order[up[order] >= 0]
    over = up[order]
    new = np.append(True, over[1:] != over[:-1]) if len(order) else np.zeros(0, bool)
    first, sibling = np.full(n, -1), np.full(n, -1)
    first[over[new]] = order[new]
    sibling[order[:-1][~new[1:]]] = order[1:][~new[1:]]
    ids = np.arange(n)
    nxt = np.empty(2 * n, np.int64)
    nxt[0::2] = np.where(first >= 0, 2 * first, 2 * ids + 1)
    nxt[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(up >= 0, 2 * up + 1, -1))
    rest, total, last = rank_lists(nxt, np.ones(2 * n, np.int64), np.tile(np.array([1, -1]), n))
    root = last[0::2] >> 1
    # Entering adds 1 and leaving takes 1 away, so a tour's rest adds up to minus the depth at an entry.
    return rest[0::2], rest[1::2], -total[0::2], np.where(circle[root] | hangs[root], -1, root)


def _walk(tree: pa.Array, node: pa.Array, parent: pa.Array) -> Iterator[tuple]:
    """Result rows of whole trees; (tree, node) is unique and rows lie together by tree."""
    n = len(tree)
    at = pc.dictionary_encode(tree.cast(pa.large_string())).indices.to_numpy().astype(np.int64)
    codes = pc.dictionary_encode(pa.chunked_array([node, parent])).combine_chunks()
    code = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices
    names = code.to_numpy(zero_copy_only=False)[:n].astype(np.int64)
    above = code.fill_null(-1).to_numpy(zero_copy_only=False)[n:].astype(np.int64)
    key, wanted = at << 32 | names, np.where(above >= 0, at << 32 | above, -1)
    order = np.argsort(key)
    found = np.searchsorted(key[order], wanted).clip(max=n - 1)
    up = np.where((above >= 0) & (key[order][found] == wanted), order[found], -1)
    enter, leave, depth, root = tours(up)
    trees, nodes = tree.to_pylist(), node.to_pylist()
    for i in np.flatnonzero(root < 0).tolist():
        yield trees[i], nodes[i], "", -1, -1, "", None, None
    reached = np.flatnonzero(root >= 0)
    # In the order of the tours an ancestor's path is the last one of its depth.
    reached = reached[np.lexsort((-enter[reached], root[reached]))]
    paths: list[str] = []
    for i, e, l, d, r in zip(reached.tolist(), enter[reached].tolist(), leave[reached].tolist(), depth[reached].tolist(), root[reached].tolist()):
        path = f"{paths[d - 1]}/{nodes[i]}" if d else nodes[i]
        del paths[d:]
        paths.append(path)
        yield trees[i], nodes[i], nodes[r], d, (e - l - 1) // 2, path, e, l


def _whole_trees(links: DataFrame) -> DataFrame:
    """Result rows of trees of at most WHOLE nodes, several of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kept, size = _Rows(), [], 0

        def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            for row in _walk(*(c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in table.columns)):
                out.add(*row)
                if out.size > FLUSH:
                    yield out.batch()

        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= WHOLE:
                table = pa.Table.from_batches(kept).combine_chunks()
                # The last tree may go on in the next batch.
                start = pc.index(table.column(0), table.column(0)[-1]).as_py()
                if start:
                    yield from walk(table.slice(0, start))
                    kept, size = table.slice(start).to_batches(), table.num_rows - start
        if size:
            yield from walk(pa.Table.from_batches(kept))
        yield out.batch()

    return links.select("tree", "node", "parent").repartition("tree").sortWithinPartitions("tree").mapInArrow(run, _SCHEMA)


# -- trees spread over tasks


def _number(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes (id, tree, node, parent_id) with ids that one write fixed."""
    ids = scratch.save(links.select("tree", "node", "parent").withColumn("id", F.monotonically_increasing_id()), "ids")
    # A parent's row goes to each of the buckets of its children, so no parent's children meet in one task.
    buckets = max(1, ids.count() // SIBLINGS)
    spread = F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int").alias("b")
    wanted = ids.where(F.col("parent").isNotNull()).select("id", "tree", "parent", spread)
    asked = wanted.select("tree", F.col("parent").alias("node"), "b").distinct()
    answers = asked.join(ids.select("tree", "node", F.col("id").alias("parent_id")), ["tree", "node"]).select("tree", F.col("node").alias("parent"), "b", "parent_id")
    linked = wanted.join(answers, ["tree", "parent", "b"]).select("id", "parent_id")
    return scratch.save(ids.join(linked, "id", "left").select("id", "tree", "node", "parent_id"), "nodes")


def _bucket(nodes: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(max(1, nodes // SIBLINGS))).cast("int").alias("b")


def _peel(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inner nodes and roots (id, parent_id); leaves (id, parent_id, b, in_b) and their groups (parent_id, b, n, before).

    Leaves are numbered bucket by bucket, so a parent with a third of all
    nodes is spread over many groups.
    """
    parents = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"), F.lit(True).alias("inner")).distinct()
    marked = scratch.save(nodes.join(parents, "id", "left").select("id", "parent_id", "inner"), "marked")
    leaf = F.col("inner").isNull() & F.col("parent_id").isNotNull()
    leaves = marked.where(leaf).select("id", "parent_id", _bucket(nodes.count()))
    sizes = leaves.groupBy("parent_id", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("parent_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = scratch.save(sizes.withColumn("before", before), "groups")
    placed = leaves.withColumn("in_b", F.row_number().over(Window.partitionBy("parent_id", "b").orderBy("id")))
    return marked.where(~leaf).select("id", "parent_id"), placed, groups


def _successors(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Events (e, nxt, sum, rest): 2*id enters a node, 2*id+1 leaves it; nxt is null at the end of a tour.

    ``rest`` counts the event and, for an entry, those of the node's peeled
    leaves (id, leaves), which follow it. A parent's children are chained
    bucket by bucket.
    """
    kids = nodes.where(F.col("parent_id").isNotNull()).select("id", "parent_id", _bucket(nodes.count()))
    inside = kids.withColumn("sibling", F.lead("id").over(Window.partitionBy("parent_id", "b").orderBy("id")))
    firsts = kids.groupBy("parent_id", "b").agg(F.min("id").alias("first"))
    chain = Window.partitionBy("parent_id").orderBy("b")
    chained = firsts.withColumn("following", F.lead("first").over(chain)).withColumn("rank", F.row_number().over(chain))
    after = inside.join(chained.select("parent_id", "b", "following"), ["parent_id", "b"]).select("id", F.coalesce("sibling", "following").alias("sibling"))
    first_child = chained.where(F.col("rank") == 1).select(F.col("parent_id").alias("id"), F.col("first").alias("child"))
    full = nodes.select("id", "parent_id").join(first_child, "id", "left").join(after, "id", "left").join(leaves, "id", "left")
    enter, leave, one = 2 * F.col("id"), 2 * F.col("id") + 1, F.lit(1).cast("bigint")
    return full.select(
        F.inline(
            F.array(
                F.struct(enter.alias("e"), F.coalesce(2 * F.col("child"), leave).alias("nxt"), one.alias("sum"), (1 + 2 * F.coalesce("leaves", F.lit(0).cast("bigint"))).alias("rest")),
                F.struct(leave.alias("e"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent_id") + 1).alias("nxt"), (-one).alias("sum"), one.alias("rest")),
            )
        )
    )


def _rank_here(events: DataFrame) -> DataFrame:
    """Ranks (e, rest, sum, last) of at most FIT events, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[], [], [], []]
        for batch in batches:
            for have, c in zip(columns, batch.columns):
                have.append(c.fill_null(-1).to_numpy(zero_copy_only=False))
        e, nxt, total, rest = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        order = np.argsort(e)
        to = np.where(nxt >= 0, order[np.searchsorted(e[order], nxt).clip(max=max(len(e) - 1, 0))] if len(e) else nxt, -1)
        # An event may point to one that a circle took with it; it never ends either.
        lost = (nxt >= 0) & (e[to] != nxt) if len(e) else np.zeros(0, bool)
        to[lost] = np.flatnonzero(lost)
        rest, total, last = rank_lists(to, rest, total)
        ends = last >= 0
        for i in range(0, int(ends.sum()), 65536):
            at = np.flatnonzero(ends)[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (e[at], rest[at], total[at], e[last[at]])], names=["e", "rest", "sum", "last"])

    return events.select("e", "nxt", "sum", "rest").coalesce(1).mapInArrow(run, "e bigint, rest bigint, sum bigint, last bigint")


def _heads(e: Column, step: int) -> Column:
    return F.pmod(F.xxhash64(e, F.lit(step)), F.lit(2)) == 0


def _rank(events: DataFrame, scratch: Scratch) -> DataFrame:
    """Events of ending tours (e, rest, sum, last).

    ``rest`` counts the events from e to the end of its tour, ``sum`` adds
    their weights, ``last`` is the event that ends the tour. Events on circles
    get no row.
    """
    now, step, removed = scratch.save(events, "lists-0"), 0, []
    while (left := now.count()) > FIT:
        a = now.where(_heads(F.col("e"), step)).alias("a")
        b = now.where(~_heads(F.col("e"), step)).alias("b")
        met = a.join(b, F.col("a.nxt") == F.col("b.e"), "full_outer")
        both = F.col("a.e").isNotNull() & F.col("b.e").isNotNull()
        one = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        stays = F.struct(F.lit(False).alias("gone"), one("e").alias("e"), F.when(both, F.col("b.nxt")).otherwise(one("nxt")).alias("nxt"), F.when(both, F.col("a.sum") + F.col("b.sum")).otherwise(one("sum")).alias("sum"), F.when(both, F.col("a.rest") + F.col("b.rest")).otherwise(one("rest")).alias("rest"))
        goes = F.struct(F.lit(True).alias("gone"), F.col("b.e").alias("e"), F.col("b.nxt").alias("nxt"), F.col("b.sum").alias("sum"), F.col("b.rest").alias("rest"))
        step += 1
        split = met.select(F.inline(F.filter(F.array(stays, F.when(both, goes)), lambda x: x.isNotNull())))
        # A circle that has come down to one event is dropped: it never ends.
        saved = scratch.save(split.where(F.col("gone") | ~F.col("nxt").eqNullSafe(F.col("e"))), f"lists-{step}", ["gone"])
        if step > 1:
            scratch.drop(f"lists-{step - 1}/gone=false")
        removed.append(saved.where("gone").drop("gone"))
        now = saved.where("not gone").drop("gone")
    ranked = scratch.save(_rank_here(now), "ranked")
    for k in range(len(removed) - 1, -1, -1):
        ahead = ranked.select(F.col("e").alias("nxt"), F.col("rest").alias("r"), F.col("sum").alias("s"), "last")
        back = removed[k].join(ahead, "nxt", "left").where(F.col("nxt").isNull() | F.col("last").isNotNull())
        again = back.select("e", (F.col("rest") + F.coalesce("r", F.lit(0))).alias("rest"), (F.col("sum") + F.coalesce("s", F.lit(0))).alias("sum"), F.coalesce("last", "e").alias("last"))
        found = ranked.unionByName(again)
        ranked = scratch.save(found, f"ranked-{k}")
        scratch.drop(f"ranked-{k + 1}" if k + 1 < len(removed) else "ranked")
    return ranked


def _scan_paths(intervals: DataFrame) -> DataFrame:
    """Result rows from intervals (tree, node, root_id, depth, enter, leave).

    Ranks count down along a tour. Every node goes to the block of its entry,
    and to each later block that its interval reaches, where it is an ancestor
    that is still open. A block sorted by entry is read with a stack of open
    nodes; it holds BLOCK / 2 own nodes at most and the ancestors of its first.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    spread = intervals.withColumn("own", block("enter")).withColumn("blk", F.explode(F.sequence(block("leave"), F.col("own"))))
    rows = spread.select("root_id", "blk", "enter", "leave", "depth", "tree", "node", (F.col("blk") == F.col("own")).alias("mine"))
    ordered = rows.repartition("root_id", "blk").sortWithinPartitions("root_id", "blk", F.col("enter").desc())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaves, paths, top, out = None, [], [], "", _Rows()
        for batch in batches:
            for root, blk, enter, leave, depth, tree, node, mine in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, blk) != at:
                    # The root's interval reaches every block, so it always comes first.
                    at, leaves, paths, top = (root, blk), [], [], node
                while leaves and leaves[-1] > enter:
                    leaves.pop()
                    paths.pop()
                path = f"{paths[-1]}/{node}" if paths else node
                leaves.append(leave)
                paths.append(path)
                if mine:
                    out.add(tree, node, top, depth, (enter - leave - 1) // 2, path, enter, leave)
                    if out.size > FLUSH:
                        yield out.batch()
        yield out.batch()

    return ordered.mapInArrow(scan, _SCHEMA)


def _spread_trees(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Result rows of trees of any size, ranked across tasks."""
    nodes = _number(links, scratch)
    inner, leaves, groups = _peel(nodes, scratch)
    ranked = _rank(_successors(inner, groups.groupBy(F.col("parent_id").alias("id")).agg(F.sum("n").alias("leaves"))), scratch)
    sides = ranked.groupBy(F.shiftright("e", 1).alias("id")).agg(
        F.max(F.when(F.col("e") % 2 == 0, F.col("rest"))).alias("enter"),
        F.max(F.when(F.col("e") % 2 == 1, F.col("rest"))).alias("leave"),
        # Entering adds 1 and leaving takes 1 away, so what is left of a tour
        # from an entry on adds up to minus the depth there.
        F.max(F.when(F.col("e") % 2 == 0, -F.col("sum"))).cast("int").alias("depth"),
        F.shiftright(F.max("last"), 1).alias("root_id"),
    )
    sides = scratch.save(sides, "sides")
    # A parent's interval goes to each group of its leaves, which then find it by group.
    above = groups.join(sides.withColumnRenamed("id", "parent_id"), "parent_id").select("parent_id", "b", (F.col("enter") - 1 - 2 * F.col("before")).alias("e"), (F.col("depth") + 1).alias("depth"), "root_id")
    enter = F.col("e") - 2 * (F.col("in_b") - 1)
    peeled = leaves.join(above, ["parent_id", "b"]).select("id", enter.alias("enter"), (enter - 1).alias("leave"), "depth", "root_id")
    full = scratch.save(nodes.select("id", "tree", "node").join(sides.select("id", "enter", "leave", "depth", "root_id").unionByName(peeled), "id", "left"), "full")
    endless = full.where(F.col("root_id").isNull()).select("tree", "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit(-1).alias("n_descendants"), F.lit("").alias("path"), "enter", "leave")
    return _scan_paths(full.where(F.col("root_id").isNotNull())).unionByName(endless)


def hierarchies(links: DataFrame, label: str = "hierarchy") -> DataFrame:
    """Full hierarchies of links (tree, node, parent), one row per (tree, node).

    Returns (tree, node, root, depth, n_descendants, path, enter, leave): the
    node's root, its depth (0 at a root), the number of nodes below it and the
    nodes from the root to it joined by ``/``. A node x lies below y if both
    have the same tree and root and ``y.enter > x.enter`` and
    ``y.leave < x.leave``; ranks count down along a tour.

    A parent that is null or not among the tree's nodes makes its node a root.
    A node whose chain of parents never ends gets root ``''``, depth -1,
    n_descendants -1, path ``''`` and null ranks; so does one that is its own
    parent. (tree, node) must be unique and not null: see ``distinct_links``.
    An empty input gives no rows. The result is the same whichever way a tree
    is dealt with.
    """
    scratch = Scratch(links.sparkSession, label)
    kept = scratch.save(links.select("tree", "node", "parent"), "links")
    # Saved, so that the planner sees how few these are before it broadcasts them.
    large = scratch.save(kept.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("tree"), "large")
    if large.isEmpty():
        return _whole_trees(kept)
    return _whole_trees(kept.join(large, "tree", "left_anti")).unionByName(_spread_trees(kept.join(large, "tree", "left_semi"), scratch))


def distinct_links(rows: DataFrame, order: str | None = None) -> DataFrame:
    """(tree, node, parent) once for each tree and node, without null or empty ids.

    Rows of the same node with different parents: the row with the greatest
    ``order`` counts, ties and all without ``order`` by the greatest parent; a
    row with a parent goes before one without. Combined on the map side.
    """
    keep = rows.where((F.coalesce("tree", F.lit("")) != "") & (F.coalesce("node", F.lit("")) != ""))
    by = [F.col("parent").isNotNull().alias("has")] + ([F.col(order).alias("o")] if order else []) + [F.col("parent")]
    return keep.groupBy("tree", "node").agg(F.max(F.struct(*by))["parent"].alias("parent"))

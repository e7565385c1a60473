"""Reachability by contracted graphs against brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from factloom.operators import graph as G
from factloom.operators import reach as R
from factloom.scratch import Scratch


def brute(edges):
    to = {}
    for s, d in edges:
        if s is not None and d is not None:
            to.setdefault(s, set()).add(d)
    out = set()
    for root in to:
        front = set(to[root])
        seen = set()
        while front:
            seen |= front
            front = {d for n in front for d in to.get(n, ())} - seen
        out |= {(root, n) for n in seen}
    return out


def some_graphs():
    rnd = random.Random(5)
    yield [(f"n{i}", f"n{(i + 1) % 90}") for i in range(90)]
    yield [(f"n{i}", f"n{i + 1}") for i in range(90)] + [("n3", "n3"), (None, "n1"), ("n1", None)]
    for nodes, count in ((12, 14), (40, 50), (40, 90), (300, 310)):
        yield [(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(count)]


@pytest.fixture
def saved(monkeypatch):
    """Rows that an operator writes to the shared folder."""
    counts, save = [], Scratch.save

    def counted(self, df, name, partition_by=None):
        out = save(self, df, name, partition_by)
        counts.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    return counts


def scoped(edges, ranks):
    return sorted((a, b) for a, b in brute(edges) for x, r in ranks if x == a for y, q in ranks if y == b and r is not None and q is not None and r > q)


@pytest.mark.parametrize("few", [R.FEW, 8])
def test_scope_violations_equal_brute_force(spark, rows, monkeypatch, few):
    # With room for 8 edges graphs are cut into several tables, and those that don't shrink are walked edge by edge.
    monkeypatch.setattr(R, "FEW", few)
    for edges in list(some_graphs())[:5] if few > 8 else list(some_graphs())[2:3]:
        ranks = [(f"n{i}", None if i % 3 == 0 else i % 5) for i in range(0, 50)] + [("n1", 7), ("elsewhere", 9)]
        e = spark.createDataFrame(edges, "src string, dst string").repartition(3)
        assert rows(G.scope_violations(e, spark.createDataFrame(ranks, "node string, rank int")), "root", "node") == scoped(edges, ranks)
    none = spark.createDataFrame([], "src string, dst string")
    assert G.scope_violations(none, spark.createDataFrame(ranks, "node string, rank int")).count() == 0


def test_scope_violations_write_no_pairs(spark, saved):
    e = spark.createDataFrame([(i, (i * k + 1) % 60) for i in range(60) for k in (1, 2, 3)], "src int, dst int")
    ranks = spark.createDataFrame([(i, i % 2) for i in range(60)], "node int, rank int")
    assert G.scope_violations(e, ranks).count() == 900
    assert sum(saved) < 900


def test_contraction_keeps_who_reaches_whom():
    for edges in some_graphs():
        known = [(s, d) for s, d in edges if s and d]
        graph = R.Condensed(*(pa.chunked_array([pa.array(x[:20]), pa.array(x[20:])]) if len(x) > 20 else pa.chunked_array([pa.array(x)]) for x in zip(*known)))
        kept = list(zip(*(x.to_pylist() for x in graph.edges())))
        assert brute(kept) == brute(known) and len(kept) <= len(set(known))
        name = [graph.nodes[graph.first[c] : graph.first[c + 1]].to_pylist() for c in range(graph.count)]
        got = {(s, d) for c, to in graph.reached(list(range(graph.count))) for t in to for s in name[c] for d in name[t]}
        assert got == brute(known)


def test_closure_equals_brute_force(spark, rows, monkeypatch):
    for name, small in (("_SOURCES", 7), ("_BLOCK", 3), ("_LIST", 5)):
        monkeypatch.setattr(R, name, small)
    graphs = list(some_graphs())
    for edges in (*graphs[:2], graphs[4]):
        assert rows(G.closure(spark.createDataFrame(edges, "src string, dst string").repartition(3)), "src", "dst") == sorted(brute(edges))
    assert G.closure(spark.createDataFrame([], "src string, dst string")).count() == 0
    # Too many edges for one table: by path doubling over what is left.
    monkeypatch.setattr(R, "FEW", 8)
    assert rows(G.closure(spark.createDataFrame(graphs[2], "src string, dst string").repartition(3)), "src", "dst") == sorted(brute(graphs[2]))


def test_closure_writes_no_pairs(spark, saved):
    assert G.closure(spark.createDataFrame([(i, (i * k + 1) % 60) for i in range(60) for k in (1, 2, 3)], "src int, dst int")).count() == 3600
    assert sum(saved) < 900

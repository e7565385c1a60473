from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import hierarchy as H


def links(spark, data, extra=False):
    df = spark.createDataFrame(data, "tree string, node string, parent string")
    return df.withColumns({"id": F.lit("x"), "root": F.lit("y"), "parent_id": F.lit("z"), "path": F.lit("p")}) if extra else df


def brute(data):
    parent = {(t, n): (t, p) for t, n, p in data}
    out = {}
    for key in parent:
        chain, x = [key], key
        while parent[x] in parent and parent[x] not in chain:
            x = parent[x]
            chain.append(x)
        if parent[x] in parent:
            out[key] = ("", -1, -1, "")
        else:
            names = [n for _, n in reversed(chain)]
            out[key] = (names[0], len(names) - 1, 0, "/".join(names))
    for (t, n), (root, depth, _, path) in list(out.items()):
        if depth >= 0:
            below = sum(1 for (u, m), o in out.items() if u == t and o[1] > depth and o[3].startswith(path + "/"))
            out[t, n] = (root, depth, below, path)
    return sorted((t, n, *v) for (t, n), v in out.items())


def got(df):
    return sorted(tuple(r) for r in df.select("tree", "node", "root", "depth", "n_descendants", "path").collect())


#: Whole trees in a task; trees spread over tasks, ranked in one task; the same by contraction; both kinds together.
WAYS = {"whole": {}, "spread": {"WHOLE": 0}, "contracted": {"WHOLE": 0, "FIT": 8, "SIBLINGS": 16}, "mixed": {"WHOLE": 10, "FIT": 50}}


@pytest.fixture(params=sorted(WAYS))
def way(request, monkeypatch):
    for name, value in WAYS[request.param].items():
        monkeypatch.setattr(H, name, value)
    return request.param


def test_random_forests_with_cycles(spark, monkeypatch, way):
    monkeypatch.setattr(H, "BLOCK", 8)
    rnd = random.Random(3)
    data = [(t, f"n{i:02}", rnd.choice([None, "gone", *[f"n{j:02}" for j in range(40)], *[f"n{j:02}" for j in range(i)]])) for t in ("a", "b") for i in range(40)]
    data += [("c", "self", "self"), ("c", "x", "y"), ("c", "y", "x"), ("c", "hang", "x"), ("c", "low", "hang")]
    assert got(H.hierarchies(links(spark, data, extra=True))) == brute(data)


def test_deep_and_wide(spark, monkeypatch, way):
    monkeypatch.setattr(H, "BLOCK", 64)
    monkeypatch.setattr(H, "FLUSH", 10_000)
    deep = [("d", f"{i:04}", f"{i - 1:04}" if i else None) for i in range(300)]
    wide = [("w", "top", None)] + [("w", f"k{i:04}", "top") for i in range(500)]
    out = {(r.tree, r.node): r for r in H.hierarchies(links(spark, deep + wide)).collect()}
    assert len(out) == 801
    assert out["d", "0299"].depth == 299 and out["d", "0000"].n_descendants == 299
    assert out["d", "0299"].path.count("/") == 299
    assert out["w", "top"].n_descendants == 500 and out["w", "k0499"].path == "top/k0499"
    y, x = out["d", "0000"], out["d", "0200"]
    assert y.enter > x.enter and y.leave < x.leave
    tops = sorted((r.enter, r.leave) for r in out.values() if r.tree == "w")
    assert len(set(tops)) == 501 and tops[-1] == (1002, 1)


def test_one_parent_of_a_million_children(spark):
    wide = spark.range(1_000_000).select(F.lit("w").alias("tree"), F.concat(F.lit("k"), "id").alias("node"), F.lit("top").alias("parent"))
    out = H.hierarchies(wide.unionByName(links(spark, [("w", "top", None), ("w", "under", "k77")])))
    row = out.agg(F.count("*"), F.sum("depth"), F.max("n_descendants"), F.count_distinct("enter"), F.max(F.when(F.col("node") == "under", F.col("path")))).first()
    assert tuple(row) == (1_000_002, 1_000_002, 1_000_001, 1_000_002, "top/k77/under")


def test_empty_and_only_cycles(spark, way):
    assert got(H.hierarchies(links(spark, []))) == []
    assert got(H.hierarchies(links(spark, [("t", "a", "b"), ("t", "b", "a")]))) == [("t", "a", "", -1, -1, ""), ("t", "b", "", -1, -1, "")]
    assert got(H.hierarchies(links(spark, [("t", "a/b", None), ("t", "c", "a/b")]))) == [("t", "a/b", "a/b", 0, 1, "a/b"), ("t", "c", "a/b", 1, 0, "a/b/c")]


def test_many_trees_pass_through_one_task_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(H, "WHOLE", 50)
    data = [(f"t{t:03}", f"n{i}", f"n{i // 2}" if i else None) for t in range(60) for i in range(1 + t % 40)]
    assert got(H.hierarchies(links(spark, data).coalesce(1))) == brute(data)


def test_peeling_leaves_only_circles():
    # 0 <- 1 <- 2 is a tree, 3 and 4 a circle, 5 hangs below it, 6 is its own parent.
    assert np.flatnonzero(H.peel(np.array([-1, 0, 1, 4, 3, 3, 6]))).tolist() == [3, 4, 6]


def test_links_are_made_distinct(spark, rows):
    data = [("t", "a", None, 5), ("t", "a", "p", 1), ("t", "a", "q", 3), ("t", "b", "p", 1), ("t", "b", "q", 1), (None, "a", "p", 1), ("t", None, "p", 1), ("", "a", "p", 1), ("t", "", "p", 1), ("t", "c", None, None), ("t", "c", None, None)]
    df = spark.createDataFrame(data, "tree string, node string, parent string, at int")
    assert rows(H.distinct_links(df, "at")) == [("t", "a", "q"), ("t", "b", "q"), ("t", "c", None)]

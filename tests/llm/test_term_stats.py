from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import term_stats as T
from factloom.scratch import Scratch

pytest.importorskip("duckdb")
SCHEMA = "field string, term string, record string, n string, path string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def brute(data, rare=5, common=0.3):
    total, records, base = defaultdict(int), defaultdict(set), defaultdict(set)
    for f, t, r in data:
        t = (t or "").strip(" \t\r\n").lower()
        if f is None or not t:
            continue
        total[f, t] += 1
        records[f, t]
        if r is not None:
            records[f, t].add(r)
            base[f].add(r)
    mark = lambda f, n: "rare" if n < rare else "common" if n > common * len(base[f]) else None
    return sorted(((f, t, total[f, t], len(records[f, t]), mark(f, len(records[f, t]))) for f, t in total), key=repr)


def test_counts_marks_and_dirt(spark, rows):
    data = [("a", " Foo\t", "r1"), ("a", "foo", "r1"), ("a", "FOO\r\n", "r2"), ("a", "", "r3"), ("a", None, "r3"), ("a", "bar", None), (None, "x", "r1"), ("b", "foo", "r1"), ("b", "\xa0pad", "r1")]
    data += [("a", "much", f"r{i}") for i in range(30)] + [("a", f"t{i % 6}", f"r{i}") for i in range(30)]
    assert rows(T.term_frequencies(frame(spark, data))) == brute(data)


HOT = [("a", "hot", f"r{i}") for i in range(60)] + [("a", f"t{i % 17}", f"r{i % 20}") for i in range(80)]


@pytest.mark.parametrize("bounds", [{"rows": 10}, {"size": 400}])
def test_oversized_partitions_are_split_by_term_then_by_record(spark, rows, bounds):
    assert rows(T.term_frequencies(frame(spark, HOT), **bounds)) == brute(HOT)


def test_leaves_fit_and_are_spread_over_tasks(spark):
    pairs = frame(spark, HOT).groupBy("field", "term", "record").agg(F.count("*").alias("n"))
    first, spilled = T._spill(pairs, Scratch(spark, "test"), 10, T.BYTES)
    leaves = None
    for folder, paths in spilled:
        named = paths.select(F.lit(folder).alias("folder"), "path", "rows")
        leaves = named if leaves is None else leaves.unionByName(named)
    found = leaves.collect()
    assert max(r.rows for r in found) <= 10 and sum(r.rows for r in found) == pairs.count() == first.count()
    # By the term twice, then by the record.
    assert max(r.path.count("-") for r in found) >= 2
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    tasks = {r[0] for r in T._aggregate(leaves, 10).select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) > spark.sparkContext.defaultParallelism


def test_one_pair_only_and_empty(spark, rows):
    one = [("a", "x", "r")] * 50
    assert rows(T.term_frequencies(frame(spark, one), rows=10)) == [("a", "x", 50, 1, "rare")]
    assert rows(T.term_frequencies(frame(spark, []))) == []


def test_long_terms(spark, rows):
    data = [("a", "x" * 100_000, "r"), ("a", "X" * 100_000, "s")]
    got = T.term_frequencies(frame(spark, data)).select(F.length("term").alias("n"), "total", "records")
    assert rows(got) == [(100_000, 2, 2)]

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from factloom.llm.mixing import Allocation, _scales, mix, pareto_order
from tests.compare import SMALL

TARGETS = "source string, weight double, max_repeats int"


def docs(spark, data):
    return spark.createDataFrame([(*r, "clash", 1.0, 2) for r in data], "doc_id bigint, source string, text string, rank string, weight double, copies int")


def corpus(spark, per_source, words=20):
    data, i = [], 0
    for source, n in per_source.items():
        for _ in range(n):
            data.append((i, source, " ".join(["word"] * (words + i % 13))))
            i += 1
    return docs(spark, data)


def test_shares_reach_their_weights_within_the_repeats(spark):
    d = corpus(spark, {"a": 400, "b": 60, "c": 300, "untargeted": 50})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("missing", 0.1, 3)], TARGETS)
    mixed, shares = mix(d, targets)
    by = {r.source: r for r in shares.collect()}
    for source, weight in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert by[source].share == pytest.approx(weight, abs=0.005)
        assert abs(by[source].mix_tokens - by[source].target_tokens) <= 40
    assert by["missing"].share == 0 and by["missing"].documents == 0
    assert "untargeted" not in by
    # The source that limits the mix gives all that it may.
    assert any(by[s].used_documents == by[s].documents and by[s].most_copies == {"a": 1, "b": 4, "c": 2}[s] for s in "abc")
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    spread = {s: {r.copies for r in rows if r.source == s} for s in "abc"}
    assert all(max(c) - min(c) <= 1 for c in spread.values())


def test_a_given_total_caps_what_a_source_cannot_reach(spark):
    d = corpus(spark, {"a": 100, "b": 10})
    mixed, shares = mix(d, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS), total=2000)
    by = {r.source: r for r in shares.collect()}
    assert by["b"].most_copies == 2 and by["b"].mix_tokens == 2 * by["b"].available_tokens
    assert abs(by["a"].mix_tokens - 1000) <= 20


def test_dirt_repeats_and_empty_tables(spark, rows):
    d = docs(spark, [(1, "a", "one two"), (1, "a", "one two three"), (2, "a", None), (3, "a", ""), (None, "a", "x"), (4, None, "x"), (5, "b", "y")])
    targets = spark.createDataFrame([("a", 1.0, 1), ("a", 0.5, 1), ("b", None, 1), ("c", 1.0, None), (None, 1.0, 1), ("d", -1.0, 2), ("e", float("nan"), 2)], TARGETS)
    mixed, shares = mix(d, targets)
    assert rows(mixed) == [(1, "a", 3, 1)]
    assert [r.source for r in shares.orderBy("source").collect()] == ["a", "b", "c", "d", "e"]
    for a, b in ((d.limit(0), targets), (d, targets.limit(0))):
        mixed, shares = mix(a, b)
        assert mixed.count() == 0 and shares.count() == b.where("source IS NOT NULL").select("source").distinct().count()


def test_importance_makes_inclusion_unequal_and_repeats_cap_it(spark):
    d = corpus(spark, {"a": 600}, words=20).withColumn("imp", F.when(F.col("doc_id") % 3 == 0, 6.0).when(F.col("doc_id") % 3 == 1, 1.0).otherwise(None))
    mixed, shares = mix(d, spark.createDataFrame([("a", 1.0, 2)], TARGETS), total=9000, importance="imp")
    uses = {r.g: r.n for r in mixed.groupBy((F.col("doc_id") % 3).alias("g")).agg(F.sum("copies").alias("n")).collect()}
    row = shares.first()
    assert abs(row.mix_tokens - 9000) <= 20 and row.most_copies == 2
    # 400 tokens a document group of 200; the important ones reach both repeats or come near.
    assert 2 not in uses and uses[0] > 3 * uses[1]


def test_the_scale_is_exact_for_importances_of_any_spread(spark):
    rnd = random.Random(5)
    for values in ([10.0 ** rnd.uniform(-200, 200) for _ in range(300)], [1.0 + i * 2.0**-52 for i in range(300)], [2.0**-i for i in range(300)], [3.0] * 300):
        data = [(i, "a", rnd.randint(1, 50), v) for i, v in enumerate(values)]
        sized = spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint, importance double")
        tokens = sum(d[2] for d in data)
        for share in (0.001, 0.5, 0.97, 1.0):
            target = round(share * 3 * tokens)
            scale = _scales(sized, [Allocation("a", 1.0, 3, 300, tokens, target)], True)["a"]
            assert sum(t * min(3.0, scale * v) for _, _, t, v in data) == pytest.approx(target, rel=1e-6)


def test_shares_and_mix_agree_on_the_whole_tables(spark):
    if not Path(SMALL).exists():
        pytest.skip("needs the test tables")
    targets = {r.source: r for r in spark.read.parquet(f"{SMALL}/mix_targets.parquet").collect()}
    longest = dict(spark.read.parquet(f"{SMALL}/documents.parquet").groupBy("source").agg(F.max("n_chars")).collect())
    for kw in ({}, {"fill": 0.5, "importance": "n_chars"}):
        mixed, shares = mix(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/mix_targets.parquet"), **kw)
        got, by = mixed.collect(), {r.source: r for r in shares.collect()}
        assert set(by) == set(targets) and sum(r.share for r in by.values()) == pytest.approx(1.0)
        assert all(1 <= r.copies <= targets[r.source].max_repeats for r in got)
        able = sum(targets[s].weight for s, r in by.items() if r.target_tokens)
        for s, r in by.items():
            assert r.mix_tokens == sum(x.tokens * x.copies for x in got if x.source == s)
            # Half the tokens of the document at the edge, which are no more than its bytes.
            assert abs(r.mix_tokens - r.target_tokens) <= 2 * longest.get(s, 0)
            if r.target_tokens:
                assert r.target_tokens == pytest.approx(targets[s].weight / able * sum(x.target_tokens for x in by.values()), abs=2)


def test_the_same_seed_gives_the_same_mix(spark, rows):
    d = corpus(spark, {"a": 200})
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    first = rows(mix(d, targets, total=2000)[0])
    assert rows(mix(d.repartition(7), targets, total=2000)[0]) == first
    assert rows(mix(d, targets, total=2000, seed=8)[0]) != first


def test_pareto_ranks_follow_the_inclusion_odds(spark):
    df = spark.range(4000).withColumn("p", F.when(F.col("id") % 2 == 0, 0.6).otherwise(0.2))
    ranked = df.withColumn("r", pareto_order("id", F.col("p"), 1)).orderBy("r").limit(1600)
    share = {r.p: r.n / 2000 for r in ranked.groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert share[0.6] == pytest.approx(0.6, abs=0.04) and share[0.2] == pytest.approx(0.2, abs=0.04)

"""Problem 7: mixing sources to target weights.

Each source gets its share of the mix's size in tokens. The expected number of
times a document is used is its share of what its source must give; the whole
part of it is allocated with certainty, the fraction is an inclusion
probability. Pareto order sampling ranks a source's documents by random odds
divided by inclusion odds and takes the first ones, here until their tokens
fill what the certain copies left open. The random numbers are hashes of the
ids, so a recomputed task ranks alike.

The cut in the ranking is found by histograms of the ranks, coarse then fine,
so no source is ever sorted in one task; only the one bin in which the cut
falls, one millionth of the rank scale, is ordered exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.encoding import count_tokens
from factloom.scratch import Scratch

#: Bins of either histogram of ranks.
BINS = 1024


@dataclass(frozen=True)
class Allocation:
    """What a source has and must give."""

    source: str
    weight: float
    max_repeats: int
    documents: int
    tokens: float
    target: int


def allocate(sizes: DataFrame, targets: DataFrame, total: int | None = None, fill: float = 1.0) -> list[Allocation]:
    """Tokens that each source must give, one entry for each target.

    The targets are a control table; no more than one row for each of them
    comes to the driver. Repeated targets of a source count once, with the
    greater weight. Null or negative weights and repeats count as 0. Weights
    are shared among the sources that can give something. Without ``total``
    the mix is ``fill`` times the largest in which every one of these reaches
    its weight within its repeats; with it, a source that cannot reach its weight gives
    all that it may.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.greatest(F.coalesce(F.nanvl(F.col("weight"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    rows = wanted.join(sizes, "source", "left").select("source", "weight", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0.0)).alias("tokens")).orderBy("source").collect()
    able = {r["source"]: r["max_repeats"] * r["tokens"] for r in rows if r["weight"] > 0 and r["max_repeats"] * r["tokens"] > 0}
    share = {r["source"]: r["weight"] for r in rows if r["source"] in able}
    whole = sum(share.values())
    if total is None:
        total = fill * min((able[s] * whole / w for s, w in share.items()), default=0)
    goal = {s: min(able[s], total * w / whole) for s, w in share.items()}
    return [Allocation(r["source"], r["weight"], r["max_repeats"], r["documents"], r["tokens"], round(goal.get(r["source"], 0))) for r in rows]


def _uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) fixed by key and seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / F.lit(float(2**53))


def pareto_order(key: str, inclusion: Column, seed: int) -> Column:
    """Rank value in (0, 1): random odds divided by inclusion odds, q / (1 + q)."""
    u = _uniform(key, seed)
    q = (u / (1 - u)) / (inclusion / (1 - inclusion))
    return q / (1 + q)


def _cut(ranked: DataFrame, group: list[str], at: str, limit: Column, size: str, bin_of: Column) -> DataFrame:
    """(group, ``at``, open): for each group the bin in which the running sum of ``size`` passes ``limit``.

    ``open`` is what the bins before it leave of the limit. Bins are few, so
    the running sums are over BINS rows of a group at most.
    """
    bins = ranked.withColumn(at, bin_of).groupBy(*group, at).agg(F.sum(size).alias("_s"), F.max(limit).alias("_limit"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bins.withColumn("_before", before).where((F.col("_before") < F.col("_limit")) & (F.col("_before") + F.col("_s") >= F.col("_limit")))
    return placed.select(*group, at, (F.col("_limit") - F.col("_before")).alias("open"))


def _scales(sized: DataFrame, plan: list[Allocation], uneven: bool) -> dict[str, float]:
    """For each source the factor from a document's importance to its expected uses.

    With uneven importances some documents reach their repeats, and the factor
    is greater for the others. A document is full from the factor at which its
    importance alone gives all its repeats; between two such factors the
    expected tokens grow in a line. The stretch in which they reach the target
    is found by histograms of these factors' logarithms, each a thousandth as
    wide as the one before, until it holds a single one: as often as a double
    has digits for, whatever the documents. An aggregate with a row for each
    source comes to the driver in each round.
    """
    even = {a.source: a.target / a.tokens for a in plan if a.target}
    if not uneven or not even:
        return even
    spark = sized.sparkSession
    goal = {a.source: (a.max_repeats, a.target) for a in plan if a.target}
    full = F.log(F.col("most") / F.col("importance"))
    kept = sized.join(F.broadcast(spark.createDataFrame([(s, m, t) for s, (m, t) in goal.items()], "source string, most int, target bigint")), "source").withColumn("at", full)
    edges = {r["source"]: (r["lo"], r["hi"]) for r in kept.groupBy("source").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    # Of the documents below the stretch: their tokens times repeats; of those above it: importance times tokens.
    done, scale = {s: (0.0, 0.0) for s in edges}, {}
    while edges:
        now = F.broadcast(spark.createDataFrame([(s, float(lo), float(hi), *map(float, done[s])) for s, (lo, hi) in edges.items()], "source string, lo double, hi double, filled double, above double"))
        inside = kept.join(now, "source").where((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi")))
        bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        bins = inside.groupBy("source", bin_.alias("b")).agg(
            F.min("at").alias("first"), F.max("at").alias("last"), F.sum(F.col("most") * F.col("tokens").cast("double")).alias("fill"), F.sum(F.col("importance") * F.col("tokens")).alias("part"),
            F.max("target").alias("target"), F.max("filled").alias("filled"), F.max("above").alias("above"),
        )
        in_order = Window.partitionBy("source").orderBy("b")
        sums = bins.withColumns({
            "filled": F.col("filled") + F.coalesce(F.sum("fill").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "above": F.col("above") + F.coalesce(F.sum("part").over(in_order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)),
        })
        # The first bin at whose end the target is reached; the last one where rounding lets none reach it.
        reach = F.col("filled") + F.col("fill") + F.exp("last") * F.col("above") >= F.col("target")
        named = F.struct("b", "first", "last", "filled", "above", "fill", "part", "target")
        for r in sums.groupBy("source").agg(F.coalesce(F.min(F.when(reach, named)), F.max(named)).alias("x")).select("source", "x.*").collect():
            s, wide = r["source"], r["last"] > r["first"]
            if wide and (r["first"], r["last"]) != edges[s]:
                edges[s], done[s] = (r["first"], r["last"]), (r["filled"], r["above"])
                continue
            if wide:
                # No narrower: the logarithms are as close as doubles can be.
                edges[s], done[s] = (r["first"], r["first"]), (r["filled"], r["above"])
            # Between the factor before this one and this one nothing is full but what is below.
            growing = r["part"] + r["above"]
            scale[s] = min(max((r["target"] - r["filled"]) / growing, 0.0), math.exp(r["last"])) if growing > 0 else math.exp(r["last"])
            del edges[s]
    return scale


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, vocabulary: str | None = None, importance: str | None = None, fill: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies) and its shares.

    Shares: (source, weight, max_repeats, documents, available_tokens,
    target_tokens, used_documents, mix_tokens, share, most_copies), one row
    for each target, also where nothing was given.

    A document is used ``copies`` times, at least once and never more than its
    source's ``max_repeats``. The tokens of a source miss its target by half a
    document at most. ``importance`` names a column of relative uses within a
    source: inclusion is in proportion to it; null, not a number or not above
    0 counts as never used, and without the column all documents are alike.
    Documents without id, source, tokens or target are not used; a repeated
    doc_id counts once (the greatest source, then the longest text). Empty
    tables give an empty mix, targets without documents a share of 0.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    usable = documents.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    kept = usable.select("doc_id", "source", "text", (F.lit(1.0) if importance is None else F.col(importance).cast("double")).alias("importance"))
    counted = count_tokens(kept.where((F.col("importance") > 0) & ~F.isnan("importance")), ["doc_id", "source", "importance"], vocabulary=vocabulary)
    sized = scratch.save(counted.groupBy("doc_id").agg(F.max(F.struct("source", "tokens", "importance")).alias("x")).select("doc_id", "x.*").where("tokens > 0"), "sized")
    sizes = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").cast("double").alias("tokens"))
    plan = allocate(sizes, targets, total, fill)
    scale = _scales(sized, plan, importance is not None)

    # One row for each target source, as allocate() has it.
    given = F.broadcast(spark.createDataFrame([(a.source, scale[a.source], a.max_repeats, a.target) for a in plan if a.target], "source string, scale double, most int, target bigint"))
    expected = F.least(F.col("scale") * F.col("importance"), F.col("most").cast("double"))
    base = F.floor(expected + 1e-9).cast("int")
    used = sized.join(given, "source").withColumn("base", base)
    used = used.withColumn("rank", pareto_order("doc_id", F.greatest(F.least(expected - F.col("base"), F.lit(1 - 1e-12)), F.lit(1e-12)), seed))
    rest = F.broadcast(used.groupBy("source").agg((F.max("target") - F.sum(F.col("base") * F.col("tokens"))).alias("rest")).where("rest > 0"))
    ranked = used.where("base < most").join(rest, "source")
    coarse, fine = F.floor(F.col("rank") * BINS).cast("int"), F.floor(F.col("rank") * BINS * BINS).cast("int")
    # All of these have a row for each source at most.
    first = F.broadcast(_cut(ranked, ["source"], "b1", F.col("rest"), "tokens", coarse))
    inside = ranked.join(first, "source").where(coarse == F.col("b1"))
    second = F.broadcast(_cut(inside, ["source"], "b2", F.col("open"), "tokens", fine))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = ranked.join(second, "source").where(fine == F.col("b2")).withColumn("_before", before)
    # The document that passes the limit is taken if that comes nearer to it.
    taken = edge.where(2 * (F.col("open") - F.col("_before")) > F.col("tokens")).groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("upto"))
    cut = F.broadcast(second.join(taken, "source", "left").select("source", "b2", "upto"))
    # Where the tokens of all candidates do not reach the limit, there is no cut and all are taken.
    wanted = F.col("b2").isNull() | (fine < F.col("b2")) | F.coalesce((fine == F.col("b2")) & (F.struct("rank", "doc_id") <= F.col("upto")), F.lit(False))
    extra = F.when((F.col("base") < F.col("most")) & F.col("rest").isNotNull() & wanted, 1).otherwise(0)
    mixed = (
        used.join(rest, "source", "left").join(cut, "source", "left")
        .withColumn("copies", F.col("base") + extra)
        .where("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )
    mixed = scratch.save(mixed, "mixed")
    given_out = mixed.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    goals = spark.createDataFrame([(a.source, a.weight, a.max_repeats, a.documents, int(a.tokens), a.target) for a in plan], "source string, weight double, max_repeats int, documents bigint, available_tokens bigint, target_tokens bigint")
    full = goals.join(given_out, "source", "left").fillna(0, ["used_documents", "mix_tokens", "most_copies"])
    share = F.coalesce(F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
    return mixed, full.withColumn("share", share).select("source", "weight", "max_repeats", "documents", "available_tokens", "target_tokens", "used_documents", "mix_tokens", "share", "most_copies")

"""Runtime traces: states, transitions, merging, reconciliation with static symbols.

An event has (source_id, pos, timestamp_ns, frames array, role, kind); frames
list the top of the stack first. Events without frames are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.scalars import caller_chain_hash, fingerprint, package_of, prefix_locality, simple_name, suffix_similarity
from factloom.operators.windows import blocked_lag


def fingerprinted(events: DataFrame) -> DataFrame:
    top = F.element_at("frames", 1)
    chain = caller_chain_hash(F.col("frames"))
    return events.where(F.size("frames") > 0).withColumns({"top": top, "chain": chain, "fp": fingerprint(top, chain, F.col("role"))})


def reduce_states(events: DataFrame) -> DataFrame:
    """(fp, top, role, n, first_ns, last_ns, sources): times of 0 or less do not count unless there are no others."""
    ts = F.when(F.col("timestamp_ns") > 0, F.col("timestamp_ns"))
    return fingerprinted(events).groupBy("fp", "top", "role").agg(
        F.count("*").alias("n"), F.coalesce(F.min(ts), F.lit(0)).alias("first_ns"), F.coalesce(F.max(ts), F.lit(0)).alias("last_ns"), F.countDistinct("source_id").alias("sources")
    )


def transitions(events: DataFrame) -> DataFrame:
    """(from_fp, to_fp, n): consecutive different states within a source."""
    f = blocked_lag(fingerprinted(events), ["source_id"], "pos", "fp", "prev")
    return f.where(F.col("prev") != F.col("fp")).groupBy(F.col("prev").alias("from_fp"), F.col("fp").alias("to_fp")).agg(F.count("*").alias("n"))


def merge_states(*parts: DataFrame) -> DataFrame:
    """States of several reductions merged: counts add, times widen; 0 is no time."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("fp").agg(F.sum("n").alias("n"), F.coalesce(F.min(F.nullif("first_ns", F.lit(0))), F.lit(0)).alias("first_ns"), F.max("last_ns").alias("last_ns"))


def reconcile(states: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fp, how, fqn, confidence): exact by qualified or unique simple name, else ranked candidates, else unresolved.

    States have (fp, top, caller): a candidate whose package shares leading
    parts with the caller's counts min(1, sim / 2 + locality / 2 + 0.1).
    """
    known = symbols.select("fqn", "name").distinct()
    by_name = known.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).select(F.col("name").alias("leaf"), F.col("fqn").alias("candidate"), "_n")
    s = states.select("fp", "top", F.coalesce("caller", F.lit("")).alias("caller"), simple_name(F.col("top")).alias("leaf")).distinct()
    exact = s.join(known.select(F.col("fqn").alias("top")).distinct(), "top", "left_semi").select("fp", F.lit("exact").alias("how"), F.col("top").alias("fqn"), F.lit(1.0).alias("confidence"))
    rest = s.join(exact.select("fp"), "fp", "left_anti").join(by_name, "leaf", "left")
    sim = suffix_similarity(F.col("top"), F.col("candidate"))
    near = prefix_locality(package_of(F.col("candidate")), package_of(F.col("caller")))
    fuzzy = F.when(near > 0, F.least(F.lit(1.0), sim * 0.5 + near * 0.5 + 0.1)).otherwise(sim)
    how = F.when(F.col("candidate").isNull(), "unresolved").when(F.col("_n") == 1, "exact").otherwise("fuzzy")
    confidence = F.when(how == "fuzzy", fuzzy).when(how == "exact", 1.0)
    return exact.unionByName(rest.select("fp", how.alias("how"), F.col("candidate").alias("fqn"), confidence.alias("confidence")))


def best_candidates(reconciled: DataFrame) -> DataFrame:
    """The first candidate of each state by confidence, then name."""
    w = Window.partitionBy("fp").orderBy(F.desc("confidence"), "fqn")
    return reconciled.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def orphan_symbols(symbols: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Symbols that no state resolved to."""
    return symbols.select("fqn").distinct().join(reconciled.where("how = 'exact'").select("fqn").distinct(), "fqn", "left_anti")


def phantom_states(states: DataFrame, reconciled: DataFrame) -> DataFrame:
    """States that resolve to nothing, most frequent first."""
    return states.join(reconciled.where("how = 'unresolved'").select("fp"), "fp", "left_semi").orderBy(F.desc("n"), "fp")


def divergence(observed: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Transitions (from_fp, to_fp) seen by a source of ``first`` and by none of ``second``."""
    a = observed.where(F.col("source_id").isin(first)).select("from_fp", "to_fp").distinct()
    b = observed.where(F.col("source_id").isin(second)).select("from_fp", "to_fp").distinct()
    return a.join(b, ["from_fp", "to_fp"], "left_anti")


def observed_transitions(events: DataFrame) -> DataFrame:
    """(source_id, from_fp, to_fp) of consecutive different states."""
    f = blocked_lag(fingerprinted(events), ["source_id"], "pos", "fp", "from_fp")
    return f.where(F.col("from_fp") != F.col("fp")).select("source_id", "from_fp", F.col("fp").alias("to_fp"))


def match_frames(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """(frame, fqn, how): exact qualified name, else simple name, else the longest dotted prefix that is one."""
    known = symbols.select("fqn", "name").distinct()
    f = frames.select("frame").where("frame IS NOT NULL").distinct()
    exact = f.join(known.select(F.col("fqn").alias("frame")).distinct(), "frame", "left_semi").select("frame", F.col("frame").alias("fqn"), F.lit("exact").alias("how"))
    rest = f.join(exact, "frame", "left_anti")
    bare = rest.withColumn("name", simple_name(F.col("frame"))).join(known, "name").groupBy("frame").agg(F.min("fqn").alias("fqn")).withColumn("how", F.lit("simple"))
    rest = rest.join(bare, "frame", "left_anti")
    parts = F.split("frame", "\\.")
    prefixes = rest.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("fqn", F.array_join(F.slice(parts, 1, F.col("_n")), "."))
    longest = prefixes.join(known.select("fqn").distinct(), "fqn", "left_semi").groupBy("frame").agg(F.max_by("fqn", "_n").alias("fqn")).withColumn("how", F.lit("prefix"))
    return exact.unionByName(bare).unionByName(longest)


def otlp_frames(spans: DataFrame, depth: int = 32) -> DataFrame:
    """Spans (tree, node, path of names) to events' frames: the span, then its ancestors, at most ``depth``."""
    return spans.withColumn("frames", F.slice(F.reverse(F.split("path", "/")), 1, depth))

"""Metrics over snapshots and commits: roll-ups, diffs, timelines, gates, risk."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def churn(commits: DataFrame) -> DataFrame:
    """(file, churn): distinct commits that touched a file."""
    return commits.groupBy("file").agg(F.countDistinct("commit_sha").alias("churn"))


def risk_map(commits: DataFrame, complexity: DataFrame) -> DataFrame:
    """(file, churn, complexity, risk = churn × complexity) of files with commits, riskiest first."""
    return churn(commits).join(complexity, "file").withColumn("risk", F.col("churn") * F.col("complexity")).orderBy(F.desc("risk"), F.desc("churn"), "file")


def module_rollup(files: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module: files, loc, bytes, fan_in (consumers) and fan_out (dependencies).

    Modules without files are kept; files with a blank module are skipped.
    """
    sums = files.where(F.coalesce("module", F.lit("")) != "").groupBy("module").agg(F.count("*").alias("files"), F.sum("loc").cast("bigint").alias("loc"), F.sum("bytes").alias("bytes"))
    fan_in = edges.groupBy(F.col("dst").alias("module")).agg(F.countDistinct("src").alias("fan_in"))
    fan_out = edges.groupBy(F.col("src").alias("module")).agg(F.countDistinct("dst").alias("fan_out"))
    base = modules.select(F.col("path").alias("module")).distinct()
    return base.join(sums, "module", "left").join(fan_in, "module", "left").join(fan_out, "module", "left").fillna(0)


def repo_rollup(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct("module").alias("modules"), F.count("*").alias("files"), F.sum("loc").cast("bigint").alias("loc"), F.sum("bytes").alias("bytes"))


def scorecard(files: DataFrame, modules: DataFrame, findings_by_module: DataFrame) -> DataFrame:
    """(module, main_loc, test_ratio, findings, per_kloc); 0 where there is no main code."""
    loc = files.groupBy("module").agg(F.sum(F.when(~F.col("is_test"), F.col("loc")).otherwise(0)).cast("bigint").alias("main_loc"), F.sum(F.when(F.col("is_test"), F.col("loc")).otherwise(0)).cast("bigint").alias("test_loc"))
    out = modules.select(F.col("path").alias("module")).distinct().join(loc, "module", "left").join(findings_by_module, "module", "left").fillna(0, ["main_loc", "test_loc", "findings"])
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), 6), F.lit(0.0))
    return out.select("module", "main_loc", ratio(F.col("test_loc"), F.col("main_loc")).alias("test_ratio"), "findings", ratio(F.col("findings") * 1000, F.col("main_loc")).alias("per_kloc"))


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, captured_at, parent) by time of capture, ties by id."""
    ids = snapshots.groupBy("snapshot_id").agg(F.min("captured_at").alias("captured_at"))
    return ids.withColumn("parent", F.lag("snapshot_id").over(Window.orderBy("captured_at", "snapshot_id")))


def timeline(snapshots: DataFrame, target: Column, name: str) -> DataFrame:
    """(snapshot_id, captured_at, target, n): rows of a target per snapshot; absent targets have no row."""
    return snapshots.groupBy("snapshot_id", "captured_at", target.alias(name)).agg(F.count("*").alias("n")).orderBy("captured_at", "snapshot_id", name)


def history_delta(counts: DataFrame, key: str, at: list[str], value: str) -> DataFrame:
    """``value`` less that of the same key before; the first delta is 0."""
    w = Window.partitionBy(key).orderBy(*at)
    return counts.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value)))


def metric_diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, from, to, delta) over the union of keys; an absent side is 0, both 0 is dropped."""
    b, a = before.select(*key, F.col(value).alias("v_from")), after.select(*key, F.col(value).alias("v_to"))
    out = b.join(a, key, "full_outer").withColumns({"v_from": F.coalesce("v_from", F.lit(0)), "v_to": F.coalesce("v_to", F.lit(0))})
    return out.where((F.col("v_from") != 0) | (F.col("v_to") != 0)).withColumn("delta", F.col("v_to") - F.col("v_from"))


def percent_change(before: Column, after: Column) -> Column:
    """(after - before) / before in per cent; infinite from zero, 0 from zero to zero."""
    d = after - before
    return F.when(before != 0, d / F.abs(before).cast("double") * 100).when(d > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def gate(diff: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Violations (module, metric, constraint, value, bound) of (module, metric, max_absolute, max_increase, max_increase_pct).

    A module of ``*`` holds for all; bounds that are null do not apply;
    metrics absent from the diff are skipped.
    """
    named = diff.select("module", "metric", F.col("v_to").cast("double").alias("to"), F.col("delta").cast("double").alias("up"), percent_change(F.col("v_from"), F.col("v_to")).alias("pct"))
    bounds = thresholds.select(F.col("module").alias("_m"), F.col("metric").alias("_k"), "max_absolute", "max_increase", "max_increase_pct")
    # Thresholds are configuration: wildcards join on the metric alone.
    exact = named.join(bounds.where("_m <> '*'"), (F.col("module") == F.col("_m")) & (F.col("metric") == F.col("_k")))
    wild = named.join(bounds.where("_m = '*'"), F.col("metric") == F.col("_k"))
    rows = exact.unionByName(wild)
    checks = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(v).alias("value"), F.col(b).alias("bound")) for n, v, b in (("absolute", "to", "max_absolute"), ("increase", "up", "max_increase"), ("increase_pct", "pct", "max_increase_pct"))])
    return rows.select("module", "metric", F.inline(checks)).where(F.col("value") > F.col("bound"))


def bag_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, change) of rows whose key the other side lacks; repeated rows stay repeated."""
    b, a = before.select(*key), after.select(*key)
    removed = b.join(a.distinct(), [b[k].eqNullSafe(a[k]) for k in key], "left_anti").withColumn("change", F.lit("removed"))
    added = a.join(b.distinct(), [a[k].eqNullSafe(b[k]) for k in key], "left_anti").withColumn("change", F.lit("added"))
    return removed.unionByName(added)


def set_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, change) as sets: distinct keys of one side only."""
    b, a = before.select(*key), after.select(*key)
    return b.subtract(a).withColumn("change", F.lit("removed")).unionByName(a.subtract(b).withColumn("change", F.lit("added")))


def touched_modules(files: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Modules of added or removed files, sources of changed edges, and every module with a non-zero metric, even an unchanged one."""
    return files.select("module").union(edges.select(F.col("src"))).union(metrics.where((F.col("v_from") != 0) | (F.col("v_to") != 0)).select("module")).distinct()


def delta_cosine(deltas: DataFrame, item: str, key: str, value: str, seeds: DataFrame) -> DataFrame:
    """(item, score): greatest cosine of an item's delta vector with that of any seed (item), above 0.

    Zero deltas are dropped. Vectors are sparse and meet on their keys only.
    """
    v = deltas.where(F.col(value) != 0).groupBy(item, key).agg(F.sum(value).cast("double").alias("_v"))
    norm = v.groupBy(item).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_n"))
    seed = v.join(seeds.select(item).distinct(), item, "left_semi").select(F.col(item).alias("_seed"), key, F.col("_v").alias("_w"))
    dots = v.join(seed, key).where(F.col(item) != F.col("_seed")).groupBy(item, "_seed").agg(F.sum(F.col("_v") * F.col("_w")).alias("_dot"))
    scored = dots.join(norm, item).join(norm.select(F.col(item).alias("_seed"), F.col("_n").alias("_m")), "_seed")
    return scored.withColumn("_c", F.col("_dot") / (F.col("_n") * F.col("_m"))).where("_c > 0").groupBy(item).agg(F.max("_c").alias("score"))


# How far a signal of each tier is trusted alone.
PRIORS = {"stack": 0.95, "owner": 0.85, "diff": 0.60, "history": 0.50}


def bisect_fusion(signals: DataFrame) -> DataFrame:
    """(commit_sha, module, prior, tiers, confidence) of signals (commit_sha, module, tier), a tier being one of PRIORS.

    confidence = min(1, p + (1 - p)(n - 1) / 3) for the greatest prior p and n distinct tiers; signals without a module are none.
    """
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PRIORS.items() for x in p]), F.col("tier")), F.lit(0.0))
    out = signals.where(F.col("module") != "").groupBy("commit_sha", "module").agg(F.max(prior).alias("prior"), F.countDistinct("tier").alias("tiers"))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("prior") + (1 - F.col("prior")) * (F.col("tiers") - 1) / (len(PRIORS) - 1)))


# Where the tests of a module lie below its directory.
TEST_SOURCES = ["/src/test/", "/src/androidTest/", "/src/integrationTest/"]


def structural_bisect(events: DataFrame, symbols: DataFrame, files: DataFrame, modules: DataFrame, touched: DataFrame) -> DataFrame:
    """(event_id, commit_sha, module, prior, tiers, confidence): where failures may come from, by four tiers of signals.

    ``events`` has (event_id, commit_sha, failure_kind, signature, module,
    file, frames), ``symbols`` (fqn, file, start_byte), ``files`` (path,
    module), ``modules`` (path, dir), ``touched`` (commit_sha, module) the
    modules that each snapshot of the range changed.

    ``stack``: the module of the symbol that the first known frame names, by
    its whole name, else by the longest dotted prefix that is one; a frame
    without a dot may also be a symbol's last part. ``owner``: the module of
    the failing test's file, else the one whose directory holds its tests.
    ``diff``: modules touched at the event's snapshot. ``history``: modules of
    other events of the same kind or signature. Events of one kind or signature
    are counted by module first and meet those counts, not each other.
    """
    one = symbols.where(F.col("fqn") != "").groupBy("fqn").agg(F.max(F.struct("file", "start_byte"))["file"].alias("path"))
    last = one.groupBy(F.regexp_extract("fqn", r"([^.]*)$", 1).alias("fqn")).agg(F.max(F.struct("fqn", "path"))["path"].alias("path"))
    frames = events.select("event_id", "commit_sha", F.posexplode("frames").alias("pos", "frame"))
    parts = F.split(F.trim(F.split_part(F.trim("frame"), F.lit("("), F.lit(1))), "\\.")
    steps = frames.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("parts") - 1))).withColumn("fqn", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("k")), "."))
    named = steps.join(one, "fqn").select("event_id", "commit_sha", "pos", "k", "path")
    bare = steps.where(F.size("parts") == 1).join(last, "fqn").select("event_id", "commit_sha", "pos", F.lit(1).alias("k"), "path")
    hit = named.unionByName(bare).groupBy("event_id", "commit_sha").agg(F.min(F.struct("pos", "k", "path"))["path"].alias("path"))
    stack = hit.join(files, "path").select("event_id", "commit_sha", "module", F.lit("stack").alias("tier"))
    below = F.coalesce(*[F.when(F.locate(m, F.col("file")) > 1, F.split_part("file", F.lit(m), F.lit(1))) for m in TEST_SOURCES])
    homes = modules.groupBy(F.regexp_replace("dir", r"^\./", "").alias("dir")).agg(F.min("path").alias("home"))
    # A directory or the end of one: every trailing part of the path is looked up.
    ends = events.where(below.isNotNull()).select("event_id", F.split(below, "/").alias("d")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("d")))).withColumn("dir", F.array_join(F.slice("d", F.col("n"), F.size("d")), "/"))
    guessed = ends.join(homes, "dir").groupBy("event_id").agg(F.min_by("home", "n").alias("home"))
    owner = events.join(files.select(F.col("path").alias("file"), F.col("module").alias("own")), "file", "left").join(guessed, "event_id", "left").select("event_id", "commit_sha", F.coalesce(F.nullif("own", F.lit("")), "home").alias("module"), F.lit("owner").alias("tier"))
    diff = events.select("event_id", "commit_sha").join(touched.select("commit_sha", "module").distinct(), "commit_sha").select("event_id", "commit_sha", "module", F.lit("diff").alias("tier"))
    past = []
    for by in ("failure_kind", "signature"):
        known = events.where((F.col("module") != "") & (F.col(by) != "")).groupBy(by, "module").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
        met = events.drop("module").join(known, by).where((F.col("a") != F.col("event_id")) | (F.col("b") != F.col("event_id")))
        past.append(met.select("event_id", "commit_sha", "module", F.lit("history").alias("tier")))
    signals = stack.unionByName(owner).unionByName(diff).unionByName(past[0]).unionByName(past[1])
    keyed = signals.withColumn("commit_sha", F.struct("event_id", "commit_sha"))
    return bisect_fusion(keyed).select("commit_sha.*", "module", "prior", "tiers", "confidence")


#: Equal stretches of a value's range in which a percentile is looked for.
STRETCHES = 4096


def lower_percentile(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """(by, value) at index int((n - 1) p) of the ascending values, nulls and NaN left out.

    A histogram, combined on the map side, finds the stretch that holds the
    index in each group; only its values are sorted, so that a task sorts a
    small part of a group with most of the rows.
    """
    v = F.col(value).cast("double")
    left = rows.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(value).alias("_v"), v.alias("_d"))
    keys = [f"_k{i}" for i in range(len(by))]
    low, wide = left.agg(F.min("_d")).scalar(), left.agg(F.max("_d") - F.min("_d")).scalar()
    bin_ = F.when(wide > 0, F.least(F.floor((F.col("_d") - low) / wide * STRETCHES), F.lit(STRETCHES - 1))).otherwise(F.lit(0)).cast("int")
    placed = left.withColumn("_b", bin_)
    in_order = Window.partitionBy(*keys).orderBy("_b")
    sums = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumns({
        "_before": F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_at": F.floor((F.sum("_n").over(Window.partitionBy(*keys)) - 1) * F.lit(p)),
    })
    hit = sums.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n"))).withColumn("_at", F.col("_at") - F.col("_before"))
    same = reduce(and_, (F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys), F.col("l._b") == F.col("h._b"))
    near = placed.alias("l").join(hit.alias("h"), same).select(*[F.col(f"l.{k}").alias(k) for k in keys], "_v", "_at")
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1)
    return ranked.where(F.col("_r") == F.col("_at")).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("_v").alias(value))


def majority(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent value, ties to the least; nothing if fewer than two distinct values or rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    # The distinct values of a setting are few: the window runs over those counts.
    all_ = Window.partitionBy(F.lit(0))
    many = counts.withColumns({"_d": F.count("*").over(all_), "_t": F.sum("n").over(all_)})
    return many.where("_d >= 2 AND _t >= 2").orderBy(F.desc("n"), value).limit(1).select(value, "n")


def below_maximum(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, top) of the rows below the greatest value."""
    top = rows.agg(F.max(value)).scalar()
    return rows.withColumn("top", top).where(F.col(value) < F.col("top")).select(key, value, "top")


def all_but_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows that repeat a key, all but the first of each by ``order``."""
    return rows.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r > 1").drop("_r")


def experiment_matrix(runs: DataFrame) -> DataFrame:
    """(case, target, runs, min_ms, max_ms, mean_ms): whole means, cut off."""
    return runs.groupBy("case", "target").agg(F.count("*").alias("runs"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.floor(F.sum("ms") / F.count("*")).alias("mean_ms"))


def retention(snapshots: DataFrame, now: Column, keep_ref: str = "30 days", keep_orphan: str = "7 days") -> DataFrame:
    """(snapshot_id, keep): permanent ones stay; the others while their age, to the microsecond, isn't above what their reach allows."""
    until = lambda keep: F.col("captured_at").cast("timestamp") + F.expr(f"INTERVAL {keep}")
    at = now.cast("timestamp")
    keep = F.when(F.col("reach") == "permanent", True).when(F.col("reach") == "ref", until(keep_ref) >= at).otherwise(until(keep_orphan) >= at)
    return snapshots.select("snapshot_id", keep.alias("keep"))


def lru_evict(entries: DataFrame, cap: int, low: float = 0.8) -> DataFrame:
    """Entries (key, bytes, used_at) to evict, oldest first, when all exceed ``cap``, until ``low`` of it is left.

    The running sum is over buckets of time first, so no single task sorts
    every entry.
    """
    whole = entries.agg(F.sum("bytes")).scalar()
    hour = F.date_trunc("hour", "used_at")
    buckets = entries.groupBy(hour.alias("_h")).agg(F.sum("bytes").alias("_s"))
    newer = F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_h")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = entries.withColumn("_h", hour).join(buckets.withColumn("_newer", newer).drop("_s"), "_h")
    within = F.sum("bytes").over(Window.partitionBy("_h").orderBy(F.desc("used_at"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    kept = placed.withColumn("_sum", F.col("_newer") + within).withColumn("_all", whole)
    return kept.where((F.col("_all") > cap) & (F.col("_sum") > cap * low)).select("key", "bytes", "used_at")


def share_of_parent(spans: DataFrame, parent: str, value: str) -> DataFrame:
    """Each row's share of its parent's sum."""
    return spans.withColumn("share", F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(parent))))


def surface_hash(rows: DataFrame, by: list[str], signature: str) -> DataFrame:
    """(by, hash): sha256 of the sorted distinct signatures, one line each."""
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(signature))), 256).alias("hash"))

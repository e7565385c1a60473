"""Algebra over findings.

A finding has (file, line, col, start_byte, end_byte, rule_set, rule,
severity, message, confidence). Confidence is compared as whole per cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.ranges import points_in_intervals

# Severities from the least on.
SEVERITIES = ["info", "warning", "error"]
# Penalty points of a finding by severity, and the greatest score of each grade.
PENALTY = {"error": 100, "warning": 10, "info": 1}
GRADES = [(100, "A"), (1000, "B"), (5000, "C"), (10000, "D")]


def severity_rank(severity: Column) -> Column:
    """0 for info to 2 for error; null for anything else."""
    out = F.when(severity == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == name, i)
    return out


def per_cent(confidence: Column) -> Column:
    """Confidence as whole per cents, half up; null stays null."""
    return F.floor(confidence * 100 + 0.5).cast("int")


def min_confidence(findings: DataFrame, least: float) -> DataFrame:
    """Findings of at least this confidence; 0 or less keeps all, null counts as 0."""
    if least <= 0:
        return findings
    return findings.where(F.coalesce(per_cent(F.col("confidence")), F.lit(0)) >= int(least * 100 + 0.5))


def at_least(findings: DataFrame, severity: str, rules: list[str] | None = None) -> DataFrame:
    out = findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(severity))
    return out if rules is None else out.where(F.col("rule").isin(rules))


def promote_warnings(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", F.when(F.col("severity") == "warning", "error").otherwise(F.col("severity")))


def strip_fixes(findings: DataFrame, where: Column, fix: str = "fix") -> DataFrame:
    """Findings with the fix removed where the condition holds (null does not)."""
    return findings.withColumn(fix, F.when(F.coalesce(where, F.lit(False)), F.lit(None)).otherwise(F.col(fix)))


def in_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    return findings.join(files.select("file").distinct(), "file", "left_semi")


def on_changed_lines(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings whose line lies in a hunk (file, first, last), both ends included."""
    spans = hunks.select("file", F.col("first").alias("_first"), (F.col("last") + 1).alias("_stop"))
    return points_in_intervals(findings, spans, "file", "line", "_first", "_stop", "left_semi", width=64)


def unsuppressed(findings: DataFrame, suppressions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Findings outside every matching suppression (file, start_byte, end_byte, rule).

    Intervals are half open and may nest. A suppression's rule is ``all``, the
    finding's rule, ``ruleSet.rule`` or an alias (alias, rule) of it.
    """
    spans = suppressions.select("file", F.col("start_byte").alias("_from"), F.col("end_byte").alias("_to"), F.col("rule").alias("_rule"))
    if aliases is not None:
        other = spans.join(aliases.select(F.col("alias").alias("_rule"), F.col("rule").alias("_for")), "_rule").select("file", "_from", "_to", F.col("_for").alias("_rule"))
        spans = spans.unionByName(other).distinct()
    match = F.col("_rule").isin("all", "ALL") | (F.col("_rule") == F.col("rule")) | (F.col("_rule") == F.concat_ws(".", "rule_set", "rule"))
    return points_in_intervals(findings, spans, "file", "start_byte", "_from", "_to", "left_anti", also=match)


def not_ignored_inline(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Findings without an inline ignore (file, line, rule) on their line; an empty rule ignores all."""
    i = ignores.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("rule").alias("_r"))
    return findings.join(i, (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")) & ((F.col("_r") == "") | (F.col("_r") == F.col("rule"))), "left_anti")


def finding_id() -> Column:
    return F.concat_ws(":", "rule", "file", F.col("line").cast("string"), F.col("col").cast("string"))


def baseline_id(signature: Column | None = None) -> Column:
    """rule:file:signature, or rule:file:$rule$message without one; it has no line, so it survives moves."""
    fallback = F.concat(F.lit("$"), "rule", F.lit("$"), F.coalesce("message", F.lit("")))
    return F.concat_ws(":", "rule", "file", fallback if signature is None else F.coalesce(F.nullif(signature, F.lit("")), fallback))


def not_in_baseline(findings: DataFrame, baseline: DataFrame, signature: Column | None = None) -> DataFrame:
    """Findings whose id, or id with the bare file name, is not in the baseline (id)."""
    ids = baseline.select(F.col("id").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    bare = F.concat_ws(":", "rule", F.regexp_extract("file", r"([^/]*)$", 1), F.concat(F.lit("$"), "rule", F.lit("$"), F.coalesce("message", F.lit(""))))
    keyed = findings.withColumn("_k1", baseline_id(signature)).withColumn("_k2", bare)
    out = keyed.join(ids, F.col("_k1") == F.col("_id"), "left_anti").join(ids, F.col("_k2") == F.col("_id"), "left_anti")
    return out.drop("_k1", "_k2")


def baseline_audit(baseline: DataFrame, findings: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, verdict) of each baseline entry: live, or stale with the first reason that holds."""
    parts = baseline.select("id", F.regexp_extract("id", r"^([^:]*):", 1).alias("rule"), F.regexp_extract("id", r"^[^:]*:([^:]*):", 1).alias("file")).distinct()
    live = findings.select(baseline_id().alias("id")).distinct().withColumn("_live", F.lit(True))
    known_rule = rules.select("rule").distinct().withColumn("_rule", F.lit(True))
    known_file = files.select("file").distinct().withColumn("_file", F.lit(True))
    joined = parts.join(live, "id", "left").join(known_rule, "rule", "left").join(known_file, "file", "left")
    verdict = F.when(F.col("_live"), "live").when(F.col("_rule").isNull(), "rule deleted").when(F.col("_file").isNull(), "file gone").otherwise("finding gone")
    return joined.select("id", verdict.alias("verdict"))


def summary(findings: DataFrame, fixable: Column) -> DataFrame:
    """(rule_set, rule, n, fixable): in all, by rule set and by rule, in one pass."""
    return findings.withColumn("_fix", fixable.cast("int")).groupingSets([[F.col("rule_set")], [F.col("rule")], []], F.col("rule_set"), F.col("rule")).agg(F.count("*").alias("n"), F.sum("_fix").alias("fixable"))


def score(findings: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, grade): penalty points by severity, and the grade of their sum."""
    points = F.lit(0)
    for name, value in PENALTY.items():
        points = F.when(F.col("severity") == name, value).otherwise(points)
    grade = F.lit("F")
    for most, name in reversed(GRADES):
        grade = F.when(F.col("score") <= most, name).otherwise(grade)
    return findings.groupBy(*by).agg(F.sum(points).cast("bigint").alias("score")).withColumn("grade", grade)


def ordered(findings: DataFrame) -> DataFrame:
    """By file, line, column, rule set and rule; ties by offset and message."""
    return findings.orderBy("file", "line", "col", "rule_set", "rule", "start_byte", "message")


def hydrate(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with what a rule table (rule_set, rule, …) has; unknown rules keep nulls."""
    return findings.join(rules, ["rule_set", "rule"], "left")


def triage(findings: DataFrame, efforts: DataFrame, budget: int) -> DataFrame:
    """Findings of rules whose effort (rule, effort) is within the budget; unknown effort counts as the least."""
    return findings.join(efforts, "rule", "left").where(F.coalesce("effort", F.lit(0)) <= budget).drop("effort")


def in_every_run(findings: DataFrame, run: str, case: str, key: list[str]) -> DataFrame:
    """(case, *key) found in every run of its case."""
    runs = findings.groupBy(case).agg(F.countDistinct(run).alias("_runs"))
    seen = findings.groupBy(case, *key).agg(F.countDistinct(run).alias("_seen"))
    return seen.join(runs, case).where(F.col("_seen") == F.col("_runs")).select(case, *key)


def audit_rules(findings: DataFrame, target: str, least: int, share: float = 0.8) -> DataFrame:
    """(target, rule, n, cluster): counts of at least ``least``; cluster names a severity that ``share`` of them have."""
    n = findings.groupBy(target, "rule", "severity").agg(F.count("*").alias("_n"))
    per = n.groupBy(target, "rule").agg(F.sum("_n").alias("n"), F.max(F.struct("_n", "severity")).alias("_top")).where(F.col("n") >= least)
    return per.select(target, "rule", "n", F.when(F.col("_top._n") >= F.lit(share) * F.col("n"), F.col("_top.severity")).alias("cluster"))


def with_emit_defaults(raw: DataFrame, rule: str, rule_set: str, severity: str, per_line: bool) -> DataFrame:
    """Raw hits completed to findings: rule's names, severity and confidence where a hit has none."""
    values = {"rule": rule, "rule_set": rule_set, "severity": severity, "confidence": 0.75 if per_line else 0.95}
    for name, value in values.items():
        raw = raw.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in raw.columns else F.lit(value))
    return raw


def adjust_confidence(findings: DataFrame, observed: DataFrame, factor: float) -> DataFrame:
    """Confidence times ``factor``, at most 1, where the finding's symbol was observed."""
    seen = observed.select("symbol").distinct().withColumn("_seen", F.lit(True))
    out = findings.join(seen, "symbol", "left")
    return out.withColumn("confidence", F.when(F.col("_seen"), F.least(F.lit(1.0), F.col("confidence") * factor)).otherwise(F.col("confidence"))).drop("_seen")


def sample_for_rule(findings: DataFrame, rule: str, n: int) -> DataFrame:
    """The first ``n`` findings of a rule, for a report."""
    return ordered(findings.where(F.col("rule") == rule)).limit(n)


def duplicates(rows: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Rows whose key occurs more than once in its scope, with the number of the others."""
    n = F.count("*").over(Window.partitionBy(*scope, key))
    return rows.where(F.col(key).isNotNull()).withColumn("others", n - 1).where(F.col("others") > 0)

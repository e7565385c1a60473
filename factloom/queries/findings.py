"""Queries over findings, suppressions and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import findings as A
from factloom.operators.ranges import innermost
from factloom.queries.standins import fact, with_facts

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        SQL[name] = with_facts(facts, sql)
        return fn

    return add


_ID = "rule || ':' || file || ':$' || rule || '$' || coalesce(message, '')"
_KEYS = ["report_id", "file", "line", "col", "rule"]
_K = ", ".join(_KEYS)


@query("pf11_filter_rows", "found", f"SELECT {_K}, start_byte FROM found WHERE end_byte - start_byte > 40 AND rule_set = 'threading'")
def pf11(found):
    return found.where((F.col("end_byte") - F.col("start_byte") > 40) & (F.col("rule_set") == "threading")).select(*_KEYS, "start_byte")


@query("pf12_in_files", "found snaps", f"SELECT {_K} FROM found WHERE file IN (SELECT file FROM snaps WHERE rule = 'LeakyScope')")
def pf12(found, snaps):
    return A.in_files(found, snaps.where(F.col("rule") == "LeakyScope")).select(*_KEYS)


@query("pf13_min_confidence", "found", f"SELECT {_K}, confidence FROM found WHERE coalesce(floor(confidence * 100 + 0.5), 0) >= 50")
def pf13(found):
    return A.min_confidence(found, 0.495).select(*_KEYS, "confidence")


@query("pf14_promote_warnings", "found", "SELECT rule, CASE severity WHEN 'warning' THEN 'error' ELSE severity END AS severity, count(*) AS n FROM found GROUP BY ALL")
def pf14(found):
    return A.promote_warnings(found).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("pf15_strip_fixes", "found", "SELECT rule, count(*) FILTER (WHERE has_fix AND NOT coalesce(confidence < 0.5, false)) AS kept, count(*) FILTER (WHERE has_fix AND coalesce(confidence < 0.5, false)) AS stripped FROM found GROUP BY rule")
def pf15(found):
    fixed = found.withColumn("fix", F.when(F.col("has_fix"), F.col("rule")))
    out = A.strip_fixes(fixed, F.col("confidence") < 0.5)
    return out.groupBy("rule").agg(F.count("fix").alias("kept"), F.count_if(F.col("has_fix") & F.col("fix").isNull()).alias("stripped"))


@query("pf16_severity_filter", "found", f"SELECT {_K}, severity FROM found WHERE severity IN ('warning', 'error') AND rule IN ('leakyscope', 'staledrawable')")
def pf16(found):
    return A.at_least(found, "warning", ["leakyscope", "staledrawable"]).select(*_KEYS, "severity")


@query("pf23_triage", "found", f"SELECT {_K} FROM found f LEFT JOIN (SELECT rule AS r, length(rule) % 5 AS effort FROM found GROUP BY rule) e ON f.rule = e.r WHERE coalesce(effort, 0) <= 2")
def pf23(found):
    efforts = found.select("rule").distinct().withColumn("effort", F.length("rule") % 5)
    return A.triage(found, efforts, 2).select(*_KEYS)


_HUNKS = "SELECT file, min(line) AS first, min(line) + 40 AS last FROM snaps WHERE line > 0 GROUP BY file"


@query("pf25_on_changed_lines", "found snaps", f"SELECT {_K} FROM found f WHERE EXISTS (SELECT 1 FROM ({_HUNKS}) h WHERE h.file = f.file AND f.line BETWEEN h.first AND h.last)")
def pf25(found, snaps):
    hunks = snaps.where("line > 0").groupBy("file").agg(F.min("line").alias("first"), (F.min("line") + 40).alias("last"))
    return A.on_changed_lines(found, hunks).select(*_KEYS)


@query("jo13_unsuppressed", "found suppressions", f"""
    SELECT {_K}, start_byte FROM found f WHERE NOT EXISTS (SELECT 1 FROM suppressions s
      WHERE s.file = f.file AND f.start_byte >= s.start_byte AND f.start_byte < s.end_byte AND (s.rule = 'all' OR s.rule = f.rule))""")
def jo13(found, suppressions):
    return A.unsuppressed(found, suppressions).select(*_KEYS, "start_byte")


@query("jo14_inline_ignores", "found snaps", f"SELECT {_K} FROM found f WHERE NOT EXISTS (SELECT 1 FROM snaps s WHERE s.file = f.file AND s.line = f.line AND (lower(s.rule) = f.rule OR s.rule_set = 'assets'))")
def jo14(found, snaps):
    ignores = snaps.select("file", "line", F.when(F.col("rule_set") == "assets", "").otherwise(F.lower("rule")).alias("rule"))
    return A.not_ignored_inline(found, ignores).select(*_KEYS)


@query("jo15_baseline", "found baseline", f"""
    SELECT {_K}, message FROM found WHERE {_ID} NOT IN (SELECT id FROM baseline)
      AND rule || ':' || regexp_extract(file, '([^/]*)$', 1) || ':$' || rule || '$' || coalesce(message, '') NOT IN (SELECT id FROM baseline)""")
def jo15(found, baseline):
    return A.not_in_baseline(found, baseline).select(*_KEYS, "message")


@query("jo16_delta", "found", f"SELECT DISTINCT {_ID} AS id FROM found WHERE report_id >= 30 AND {_ID} NOT IN (SELECT {_ID} FROM found WHERE report_id < 30)")
def jo16(found):
    before = found.where("report_id < 30").select(A.baseline_id().alias("id"))
    return A.not_in_baseline(found.where("report_id >= 30"), before).select(A.baseline_id().alias("id")).distinct()


@query("jo17_baseline_audit", "baseline found snaps", f"""
    SELECT id, CASE WHEN id IN (SELECT {_ID} FROM found WHERE report_id >= 10) THEN 'live'
      WHEN regexp_extract(id, '^([^:]*):', 1) NOT IN (SELECT lower(rule) FROM snaps) THEN 'rule deleted'
      WHEN regexp_extract(id, '^[^:]*:([^:]*):', 1) NOT IN (SELECT file FROM snaps) THEN 'file gone' ELSE 'finding gone' END AS verdict
    FROM (SELECT DISTINCT id FROM baseline)""")
def jo17(baseline, found, snaps):
    return A.baseline_audit(baseline, found.where("report_id >= 10"), snaps, snaps.select(F.lower("rule").alias("rule")))


@query("jo35_hydrate", "found snaps", "SELECT f.rule_set, f.rule, known, count(*) AS n FROM found f LEFT JOIN (SELECT lower(rule_set) AS rs, lower(rule) AS r, count(*) AS known FROM snaps GROUP BY ALL) k ON f.rule_set = k.rs AND f.rule = k.r GROUP BY ALL")
def jo35(found, snaps):
    rules = snaps.groupBy(F.lower("rule_set").alias("rule_set"), F.lower("rule").alias("rule")).agg(F.count("*").alias("known"))
    return A.hydrate(found, rules).groupBy("rule_set", "rule", "known").agg(F.count("*").alias("n"))


@query("ag11_summary", "found", "SELECT rule_set, rule, count(*) AS n, sum(has_fix::INT)::BIGINT AS fixable FROM found GROUP BY GROUPING SETS ((rule_set), (rule), ())")
def ag11(found):
    return A.summary(found, F.col("has_fix"))


_SCORE = "sum(CASE severity WHEN 'error' THEN 100 WHEN 'warning' THEN 10 WHEN 'info' THEN 1 ELSE 0 END)::BIGINT AS score"


@query("ag12_score", "found", f"SELECT *, CASE WHEN score <= 100 THEN 'A' WHEN score <= 1000 THEN 'B' WHEN score <= 5000 THEN 'C' WHEN score <= 10000 THEN 'D' ELSE 'F' END AS grade FROM (SELECT rule_set, {_SCORE} FROM found GROUP BY rule_set)")
def ag12(found):
    return A.score(found, ["rule_set"])


@query("ag28_rule_audit", "found", """
    SELECT target, rule, n::BIGINT AS n, CASE WHEN top >= 0.8 * n THEN sev END AS cluster FROM (
      SELECT target, rule, sum(c) AS n, max(c) AS top, max_by(severity, struct_pack(a := c, b := severity)) AS sev FROM (
        SELECT split_part(file, '/', 1) AS target, rule, severity, count(*) AS c FROM found GROUP BY ALL) GROUP BY ALL) WHERE n >= 5""")
def ag28(found):
    return A.audit_rules(found.withColumn("target", F.split_part("file", F.lit("/"), F.lit(1))), "target", 5)


@query("so1_sorted", "found", f"SELECT {_K}, rule_set, start_byte, message FROM found")
def so1(found):
    return A.ordered(found).select(*_KEYS, "rule_set", "start_byte", "message")


@query("so7_sample", "found", f"SELECT {_K} FROM found WHERE rule = 'leakyscope' ORDER BY file NULLS FIRST, line NULLS FIRST, col NULLS FIRST, rule_set, rule, start_byte NULLS FIRST, message NULLS FIRST LIMIT 25")
def so7(found):
    return A.sample_for_rule(found, "leakyscope", 25).select(*_KEYS)


@query("se1_concat", "found", "SELECT rule, count(*) AS n FROM (SELECT rule FROM found WHERE severity = 'error' UNION ALL SELECT rule FROM found WHERE has_fix) GROUP BY rule")
def se1(found):
    return found.where(F.col("severity") == "error").unionByName(found.where("has_fix")).groupBy("rule").agg(F.count("*").alias("n"))


@query("se9_in_every_run", "found", """
    SELECT s.rule_set, s.rule FROM (SELECT rule_set, rule, count(DISTINCT report_id) AS n FROM found GROUP BY ALL) s
    JOIN (SELECT rule_set, count(DISTINCT report_id) AS n FROM found GROUP BY ALL) r ON s.rule_set = r.rule_set AND s.n = r.n""")
def se9(found):
    return A.in_every_run(found, "report_id", "rule_set", ["rule"])


@query("ag27_duplicates", "found", "SELECT report_id, rule, message, others FROM (SELECT *, count(*) OVER (PARTITION BY report_id, rule, message) - 1 AS others FROM found WHERE message IS NOT NULL) WHERE others > 0")
def ag27(found):
    return A.duplicates(found, ["report_id", "rule"], "message").select("report_id", "rule", "message", "others")


@query("sc7_finding_id", "found", "SELECT concat_ws(':', rule, file, line::VARCHAR, col::VARCHAR) AS id, count(*) AS n FROM found GROUP BY 1")
def sc7(found):
    return found.groupBy(A.finding_id().alias("id")).agg(F.count("*").alias("n"))


@query("sc8_baseline_id", "found", f"SELECT {_ID} AS id, count(*) AS n FROM found GROUP BY 1")
def sc8(found):
    return found.groupBy(A.baseline_id().alias("id")).agg(F.count("*").alias("n"))


@query("sc18_adjust_confidence", "found snaps", "SELECT rule, count(*) AS n, round(sum(CASE WHEN rule IN (SELECT lower(rule) FROM snaps) THEN least(1.0, confidence * 1.25) ELSE confidence END), 6) AS total FROM found GROUP BY rule")
def sc18(found, snaps):
    out = A.adjust_confidence(found.withColumn("symbol", F.col("rule")), snaps.select(F.lower("rule").alias("symbol")), 1.25)
    return out.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("total"))


@query("wi11_innermost_scope", "found suppressions", """
    SELECT file, start_byte, rule, scope FROM (
      SELECT f.file, f.start_byte, f.rule, s.rule AS scope, row_number() OVER (PARTITION BY f.file, f.start_byte, f.rule ORDER BY s.end_byte - s.start_byte, s.start_byte DESC, s.rule) AS n
      FROM (SELECT DISTINCT file, start_byte, rule FROM found) f JOIN suppressions s ON s.file = f.file AND f.start_byte >= s.start_byte AND f.start_byte < s.end_byte) WHERE n = 1""")
def wi11(found, suppressions):
    scopes = suppressions.select("file", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"), F.col("rule").alias("scope"))
    return innermost(found.select("file", "start_byte", "rule").distinct(), scopes, "file", "start_byte", "s", "e", "scope", ["file", "start_byte", "rule"])


@query("ud3_emit_defaults", "texts", "SELECT doc_id, 'TodoComment' AS rule, 'comments' AS rule_set, 'info' AS severity, 0.75::DOUBLE AS confidence FROM texts WHERE contains(text, 'warning')")
def ud3(texts):
    return A.with_emit_defaults(texts.where(F.col("text").contains("warning")).select("doc_id"), "TodoComment", "comments", "info", per_line=True)

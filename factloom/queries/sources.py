"""Queries over sinks, sources and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from factloom.operators.hierarchy import distinct_links, hierarchies
from factloom.operators.traces import otlp_frames
from factloom.queries.problems import SQL as P_SQL
from factloom.queries.problems import spans
from factloom.queries.standins import fact, with_facts
from factloom.session import table
from factloom.sources import files as SF
from factloom.sources import sinks as SK
from factloom.streaming import incremental as I

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str | None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        if sql:
            SQL[name] = with_facts(facts, sql)
        return fn

    return add


@query("src15_gradle_settings", "scripts", r"""
    SELECT doc_id, path, CASE WHEN path = own THEN 'x/' || substr(path, 2) ELSE replace(substr(path, 2), ':', '/') END AS dir FROM (
      SELECT doc_id, CASE WHEN starts_with(p, ':') THEN p ELSE ':' || p END AS path, own FROM (
        SELECT doc_id, unnest([regexp_extract(text, 'include[(]"([^"]*)", "([^"]*)"', 1), regexp_extract(text, 'include[(]"([^"]*)", "([^"]*)"', 2)]) AS p, regexp_extract(text, 'project[(]"([^"]*)"', 1) AS own FROM scripts WHERE contains(text, 'include(')))""")
def src15(scripts):
    return SF.gradle_settings(scripts)


@query("src13b_gradle_config", "texts", r"""
    SELECT doc_id, try_cast(regexp_extract(text, '(?m)^\s*minSdk(?:Version)?\s*[=(]?\s*(\d+)', 1) AS INT) AS min_sdk, try_cast(regexp_extract(text, '(?m)^\s*targetSdk(?:Version)?\s*[=(]?\s*(\d+)', 1) AS INT) AS target_sdk,
      try_cast(regexp_extract(text, '(?m)^\s*compileSdk(?:Version)?\s*[=(]?\s*(\d+)', 1) AS INT) AS compile_sdk,
      array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\bid\s*\(\s*["'']([^"'']+)["'']', 1))), ',') AS plugins FROM texts""")
def src13b(texts):
    return SF.gradle_config(texts)


@query("src36_plain", "found", "SELECT file || ':' || coalesce(line, 0) || ':' || coalesce(col, 0) || ': ' || coalesce(severity, 'info') || ': ' || coalesce(message, '') || ' [' || rule || ']' AS value FROM found")
def src36(found):
    return SK.plain(found)


@query("src38_checkstyle", "found", """
    SELECT file, '<file name="' || file || '">' || string_agg('<error line="' || coalesce(line::VARCHAR, '') || '" column="' || coalesce(col::VARCHAR, '') || '" severity="' || coalesce(severity, '') || '" message="' ||
      replace(replace(replace(replace(coalesce(message, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '" source="' || rule || '"/>', '' ORDER BY coalesce(line, 0), coalesce(col, 0),
      '<error line="' || coalesce(line::VARCHAR, '') || '" column="' || coalesce(col::VARCHAR, '') || '" severity="' || coalesce(severity, '') || '" message="' ||
      replace(replace(replace(replace(coalesce(message, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '" source="' || rule || '"/>') || '</file>' AS value FROM found GROUP BY file""")
def src38(found):
    return SK.checkstyle(found)


@query("src27_baseline_ids", "found", "SELECT DISTINCT rule || ':' || file || ':$' || rule || '$' || coalesce(message, '') AS id FROM found")
def src27(found):
    return SK.baseline_ids(found)


@query("src40_api_surface", "symbols", "SELECT DISTINCT kind || chr(9) || name AS value FROM symbols WHERE visibility = 'public'")
def src40(symbols):
    return SK.surface(symbols)


@query("src35_json_lines", "found", "SELECT file, line, rule, severity, message, confidence, count(*) AS n FROM found GROUP BY ALL")
def src35(found):
    """The lines, read back and counted, so that what they say is compared."""
    said = F.from_json("value", "file string, line int, rule string, severity string, message string, confidence double")
    return SK.json_lines(found).select(said.alias("x")).select("x.*").groupBy("file", "line", "rule", "severity", "message", "confidence").agg(F.count("*").alias("n"))


@query("src35b_json_summary", "found", """
    SELECT 'total' AS what, '' AS name, count(*)::INT AS n FROM found UNION ALL SELECT 'ruleSet', rule_set, count(*)::INT FROM found GROUP BY rule_set UNION ALL SELECT 'rule', rule, count(*)::INT FROM found GROUP BY rule""")
def src35b(found):
    """The summary, read back into its entries."""
    read = SK.json_summary(found).select(F.from_json("value", "total int, byRuleSet map<string,int>, byRule map<string,int>").alias("x"))
    total = read.select(F.lit("total").alias("what"), F.lit("").alias("name"), F.col("x.total").alias("n"))
    entries = lambda what, c: read.select(F.lit(what).alias("what"), F.explode(c).alias("name", "n"))
    return total.unionByName(entries("ruleSet", "x.byRuleSet")).unionByName(entries("rule", "x.byRule"))


@query("src37_sarif", "found", """
    SELECT rule_set || '/' || rule AS rule, CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, coalesce(message, '') AS text, greatest(coalesce(line, 1), 1) AS line, count(*) AS n FROM found GROUP BY ALL""")
def src37(found):
    """The results, read back from their JSON."""
    shape = "ruleId string, level string, message struct<text string>, locations array<struct<physicalLocation struct<region struct<startLine int>>>>"
    read = SK.sarif_results(found).select(F.from_json("value", shape).alias("x"))
    return read.groupBy(F.col("x.ruleId").alias("rule"), F.col("x.level").alias("level"), F.col("x.message.text").alias("text"), F.col("x.locations")[0]["physicalLocation"]["region"]["startLine"].alias("line")).agg(F.count("*").alias("n"))


def src18_otlp_events(spark, sf_dir):
    tree = hierarchies(distinct_links(spans(table(spark, sf_dir, "otel_sample")), "received_at"))
    framed = otlp_frames(tree.where("depth >= 0"))
    return framed.select(F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), F.size("frames").alias("n_frames"), F.element_at("frames", 1).alias("top"))


QUERIES["src18_otlp_events"] = src18_otlp_events
SQL["src18_otlp_events"] = f"SELECT trace_id, span_id, least(depth + 1, 32)::INT AS n_frames, span_id AS top FROM ({P_SQL['p5_found']}) WHERE depth >= 0"


@query("st2_debounce", "runtime", """
    SELECT path, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS events FROM (
      SELECT path, ts, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
        SELECT source_id AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY source_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM runtime)) GROUP BY path, burst""")
def st2(runtime):
    bursts = I.debounce(runtime.select(F.col("source_id").alias("path"), F.col("ts").cast("timestamp").alias("ts")), gap="30 minutes")
    return bursts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("st3_domain_versions", "files", "SELECT CASE WHEN ends_with(path, '.xml') THEN 'resources' ELSE 'source' END AS domain, count(*) AS version FROM files GROUP BY 1")
def st3(files):
    return I.domain_versions(files)


def st8_running_states(spark, sf_dir):
    """The events file read as a stream; its end state equals the batch result."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keyed = events.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("fp"), F.col("event_id").alias("timestamp_ns"))
    return I.drain(I.running_states(keyed), "states", "complete")


QUERIES["st8_running_states"] = st8_running_states
SQL["st8_running_states"] = "SELECT user_id || '-' || event_type AS fp, count(*) AS n, min(event_id) AS first_ns, max(event_id) AS last_ns FROM events GROUP BY 1"


def st9_once_each(spark, sf_dir):
    """Events delivered twice through a stream come out once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    twice = events.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return I.drain(I.once_each(twice, late="60 days").select("id"), "once")


QUERIES["st9_once_each"] = st9_once_each
SQL["st9_once_each"] = "SELECT event_id AS id FROM events"


@query("st6_replay", "found commits", None)
def st6(found, commits):
    affected = found.where(F.col("line") > 300).select("file").distinct()
    return I.replay(found, affected, found.withColumn("confidence", F.lit(1.0))).groupBy("rule").agg(F.count("*").alias("n"), F.sum((F.col("confidence") == 1.0).cast("int")).alias("sure"))


SQL["st6_replay"] = with_facts("found", "SELECT rule, count(*) AS n, sum(CASE WHEN confidence = 1.0 OR file IN (SELECT file FROM found WHERE line > 300) THEN 1 WHEN confidence IS NULL THEN NULL ELSE 0 END) AS sure FROM found GROUP BY rule")

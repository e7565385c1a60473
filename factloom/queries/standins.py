"""Fact relations over the driver's tables.

Each is one SELECT that Spark and DuckDB both understand, so an operator and
its SQL counterpart see the same rows. The relations carry the columns of the
fact model (symbols, references, modules, edges, findings and so on); the
business tables only lend their keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings findings finding_snapshots file_entries scan_runs oracle otel_sample mix_targets".split()

_PLAIN = "regexp_replace(replace({}, chr(92), '/'), '^[.]/', '')"

#: Names, files and modules that keys are folded into; they grow with the tables, from 700, 650, 300 and 100 of them up to sf0.01.
_NAMES = "(SELECT greatest(CAST(floor(count(*) * 7 / 20) AS BIGINT), 700) FROM part)"
_USED_NAMES = "(SELECT greatest(CAST(floor(count(*) * 13 / 40) AS BIGINT), 650) FROM part)"
_FILES = "(SELECT greatest(CAST(floor(count(*) / 50) AS BIGINT), 300) FROM orders)"
_MODULES = "(SELECT greatest(count(*), 1) FROM supplier)"

FACTS = {
    "symbols": f"""
        SELECT 'N' || (p_partkey % {_NAMES}) AS name,
               'dev.p' || p_size || '.N' || (p_partkey % {_NAMES}) AS fqn,
               p_type AS kind,
               CASE p_partkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'private' END AS visibility,
               'f' || (p_partkey % {_FILES}) AS file,
               CAST(p_partkey % 97 AS INT) AS line,
               CAST(p_partkey AS BIGINT) AS start_byte,
               p_partkey % 11 = 0 AS is_override,
               p_partkey % 13 = 0 AS is_test,
               p_partkey % 83 = 0 AS is_main,
               ':m' || (p_partkey % greatest({_MODULES}, 100)) AS module,
               p_name || '(' || p_brand || ')' AS signature,
               CAST(p_size % 4 AS INT) AS arity
        FROM part""",
    "refs": f"""
        SELECT CASE WHEN l_linenumber = 7 THEN 'dev.p' || (l_suppkey % 50 + 1) || '.N' || (l_partkey % {_USED_NAMES}) ELSE 'N' || (l_partkey % {_USED_NAMES}) END AS name,
               'f' || (l_orderkey % {_FILES}) AS file,
               CAST(l_linenumber AS INT) AS line,
               l_returnflag = 'R' AS in_comment,
               CAST(l_orderkey AS BIGINT) AS start_byte,
               ':m' || l_suppkey AS module,
               l_orderkey % {_FILES} % 9 = 0 AS is_test
        FROM lineitem""",
    "imports": f"""
        SELECT DISTINCT 'f' || (l_orderkey % {_FILES}) AS file,
               CASE WHEN l_linestatus = 'F' AND l_linenumber < 3 THEN 'dev.p' || (l_suppkey % 50 + 1) || '.*' ELSE 'dev.p' || (l_suppkey % 50 + 1) || '.N' || (l_partkey % {_USED_NAMES}) END AS import
        FROM lineitem""",
    "modules": """
        SELECT ':m' || s_suppkey AS path, 'src/m' || s_suppkey AS dir, r_name AS layer, s_acctbal < 1000 AS is_published
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # Every row is an edge between a supplier and a part folded into the suppliers; from the lower of five levels to the higher, so that the dense graph isn't one component.
    "module_edges": f"""
        SELECT DISTINCT ':m' || CASE WHEN a % 5 <= b % 5 THEN a ELSE b END AS src, ':m' || CASE WHEN a % 5 <= b % 5 THEN b ELSE a END AS dst, configuration
        FROM (SELECT l_suppkey AS a, l_partkey % {_MODULES} AS b,
                     CASE WHEN l_tax < 0.04 THEN 'api' ELSE 'implementation' END AS configuration
              FROM lineitem)""",
    "files": """
        SELECT 'src/m' || (o_custkey % 100) || '/f' || o_orderkey || CASE o_orderstatus WHEN 'O' THEN '.kt' WHEN 'F' THEN '.java' ELSE '.xml' END AS path,
               CASE o_orderstatus WHEN 'O' THEN 'kotlin' WHEN 'F' THEN 'java' ELSE 'xml' END AS language,
               ':m' || (o_custkey % 100) AS module,
               CAST(floor(o_totalprice / 1000) AS INT) AS loc, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
               o_orderkey % 10 = 0 AS is_test, CAST(o_orderkey AS BIGINT) AS file_id
        FROM orders""",
    "commits": f"""
        SELECT 'c' || o_orderkey AS commit_sha, 'f' || (l_partkey % {_FILES}) AS file, o_orderdate AS committed_at, 'dev' || (o_custkey % 40) AS author
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "found": f"""
        SELECT DISTINCT report_id, {_PLAIN.format("file")} AS file, line, col, start_byte, end_byte, lower(trim(rule_set)) AS rule_set, lower(trim(rule)) AS rule,
               severity, message, confidence, fix IS NOT NULL AS has_fix
        FROM findings WHERE file IS NOT NULL AND rule IS NOT NULL AND rule_set IS NOT NULL""",
    "suppressions": f"""
        SELECT DISTINCT {_PLAIN.format("file")} AS file, CAST(start_byte - 400 AS BIGINT) AS start_byte, CAST(start_byte + 900 AS BIGINT) AS end_byte,
               CASE WHEN line % 5 = 0 THEN 'all' ELSE lower(trim(rule)) END AS rule
        FROM findings WHERE file IS NOT NULL AND severity = 'info' AND fix IS NOT NULL AND start_byte IS NOT NULL AND rule IS NOT NULL""",
    # What was accepted once: every finding that only informs.
    "baseline": f"""
        SELECT DISTINCT lower(trim(rule)) || ':' || {_PLAIN.format("file")} || ':$' || lower(trim(rule)) || '$' || coalesce(message, '') AS id
        FROM findings WHERE file IS NOT NULL AND rule IS NOT NULL AND severity = 'info'""",
    "snaps": f"""
        SELECT DISTINCT snapshot_id, captured_at, rule, rule_set, {_PLAIN.format("file")} AS file, split_part({_PLAIN.format("file")}, '/', 1) || ':' || split_part({_PLAIN.format("file")}, '/', 2) AS module,
               coalesce(line, 0) AS line, coalesce(message, '') AS message
        FROM finding_snapshots WHERE rule IS NOT NULL AND file IS NOT NULL""",
    "runtime": """
        SELECT 'u' || user_id AS source_id, event_id AS pos, ts, event_type AS frame, CASE WHEN event_id % 17 = 0 THEN 0 ELSE CAST(event_id * 1000 AS BIGINT) END AS timestamp_ns,
               CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'test' END AS role, value
        FROM events""",
    "breakages": """
        SELECT 'kind' || (event_id % 3) AS failure_kind, 'Test ' || user_id || ' failed at 0x' || (event_id % 50) || 'ab after ' || (event_id % 20 + 100) || ' ms' AS signature,
               'c' || (event_id % 400) AS commit_sha, 'junit' AS source, ts AS occurred_at, ':m' || (user_id % 100) AS module
        FROM events WHERE event_type = 'error'""",
    # A build script, a settings file, a test, a layout and resources for each part.
    "scripts": """
        SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'main' AS source, concat_ws(chr(10),
          CASE WHEN p_partkey % 2 = 0 THEN '<layout>' ELSE 'include(":a' || p_size || '", "b:c' || p_partkey || '")' END,
          'project(":a' || p_size || '").projectDir = file("x/a' || p_size || '")',
          'implementation("g' || p_size || ':n' || p_partkey || ':1.' || p_size || '")',
          'api(projects.coreUi.n' || p_partkey || 'Kit) testImplementation( projects.app )',
          'val m' || p_size || ' = mockk<T>()', CASE WHEN p_size % 3 = 0 THEN 'verify { m' || p_size || '.run() } // io.mockk' ELSE '' END,
          '<dev.p' || p_size || '.View' || p_partkey || ' text="@string/t' || p_partkey || '" style="@style/s' || p_size || '"/>',
          '<plurals name="q' || p_size || '"><item quantity="one">1</item><item quantity="other"> n' || p_partkey || ' </item></plurals>',
          'val key = "AKIA' || upper(substr(md5(p_name), 1, 16)) || '" + "Bearer ' || md5(p_brand) || '" + "Bearer your-key-is-not-here"') AS text
        FROM part""",
    "failures": f"""
        SELECT event_id, 'kind' || (event_id % 40) || '-' || (user_id % 20) AS failure_kind, 'test ' || user_id || ' failed' AS signature, 'c' || (event_id * 7 % 5000 + 1) AS commit_sha,
               CASE WHEN event_id % 3 = 0 THEN '' ELSE ':m' || (user_id % 100) END AS module,
               CASE event_id % 3 WHEN 0 THEN 'f' || (event_id % {_FILES}) WHEN 1 THEN 'src/m' || (event_id % 100 + 1) || '/src/test/T.kt' ELSE '' END AS file,
               array(' java.lang.Thread.run(Thread.java:' || user_id || ')', 'dev.p' || (event_id % 50 + 1) || '.N' || (event_id % {_NAMES}) || '.open(N.kt:' || event_id || ')') AS frames
        FROM events WHERE event_type = 'error'""",
    "texts": "SELECT doc_id, text, source, path FROM documents WHERE text IS NOT NULL AND text <> ''",
}

_NEEDS = {name: [t for t in BASE if re.search(rf"\b{t}\b", sql)] for name, sql in FACTS.items()}


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact relation as a DataFrame, without leaving views behind."""
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _NEEDS[name]}
    sql = FACTS[name].replace("{", "{{").replace("}", "}}")
    for t in sources:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **sources)


def with_facts(names: str, select: str) -> str:
    """DuckDB SQL of ``select`` with the named relations in front of it."""
    ctes = ", ".join(f"{n} AS ({FACTS[n]})" for n in names.split()).replace(" array(", " list_value(")
    return f"WITH RECURSIVE {ctes} {select}" if "{rec}" not in select else select.replace("{rec}", f"WITH RECURSIVE {ctes}")

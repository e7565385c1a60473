"""Queries of the general problems: p1, p3, p4, p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paths import plain_path
from factloom.operators.change_capture import ChangeCapture, LogColumns
from factloom.operators.hierarchy import distinct_links, hierarchies
from factloom.operators.nested import NestedTables
from factloom.operators.snapshot_diff import diff_snapshots
from factloom.scratch import Scratch
from factloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = NestedTables(table(spark, sf_dir, "oracle"), "oracle_id", "payload", "received_at")
    return tables.links().select(F.col("record_id").alias("oracle_id"), F.col("unit").alias("file"), "entity", "path", "parent_path", "name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    capture = ChangeCapture(spark, Scratch(spark, "capture").path("files"))
    capture.ingest(table(spark, sf_dir, "file_entries"), LogColumns(key=plain_path(F.col("path")), version=F.nullif(F.lower("hash"), F.lit(""))))
    # Runs that failed plan their batches too; the next one that succeeds replays these.
    capture.plan_runs(table(spark, sf_dir, "scan_runs"), ok=F.col("status") == "ok")
    while capture.execute():
        pass
    return capture.sink().select("run_id", F.col("key").alias("path"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = {"rule": F.col("rule"), "file": plain_path(F.col("file")), "line": F.coalesce(F.col("line"), F.lit(0))}
    return diff_snapshots(table(spark, sf_dir, "finding_snapshots"), key, [F.coalesce(F.col("message"), F.lit(""))])


def spans(batches: DataFrame) -> DataFrame:
    """Delivered spans (tree, node, parent, received_at); an absent parent is null."""
    scope = batches.select("received_at", F.explode("resource_spans").alias("r")).select("received_at", F.explode("r.scope_spans").alias("s"))
    span = scope.select("received_at", F.explode("s.spans").alias("x"))
    parent = F.lower("x.parent_span_id")
    return span.select(F.lower("x.trace_id").alias("tree"), F.lower("x.span_id").alias("node"), F.when(~parent.rlike("^0*$"), parent).alias("parent"), "received_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchies(distinct_links(spans(table(spark, sf_dir, "otel_sample")), "received_at"))
    return tree.select(F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), F.col("root").alias("root_span_id"), "depth", "n_descendants", "path")


_PLAIN = "regexp_replace(replace({}, chr(92), '/'), '^[.]/', '')"

def _level(name: str, source: str, key: str, prefix: str, parent: str, label: str) -> str:
    """One level of lists below ``source`` (oracle_id, file, path, v) as SQL."""
    listed = f"CASE json_type(v, '$.{key}') WHEN 'OBJECT' THEN json_array(json_extract(v, '$.{key}')) WHEN 'ARRAY' THEN json_extract(v, '$.{key}') END"
    return (
        f"{name} AS (SELECT oracle_id, file, {prefix} || '{key}/' || key AS path, {parent} AS parent_path, value AS v, coalesce(value->>'$.{label}', '') AS name "
        f"FROM (SELECT *, {listed} AS l FROM {source}) s, json_each(s.l) WHERE l IS NOT NULL AND json_type(value) = 'OBJECT')"
    )


_P1 = "WITH " + ", ".join([
    "d AS (SELECT oracle_id, max_by(payload, received_at) AS p FROM oracle WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' GROUP BY oracle_id)",
    "fs AS (SELECT oracle_id, json_extract(p, '$.files') AS o FROM d WHERE json_type(p, '$.files') = 'OBJECT')",
    "f AS (SELECT oracle_id, key AS file, '' AS path, value AS v FROM fs, json_each(fs.o) WHERE json_type(value) = 'OBJECT')",
    _level("de", "f", "declarations", "''", "''", "fqn"),
    _level("me", "de", "members", "s.path || '/'", "s.path", "name"),
    _level("pa", "me", "params", "s.path || '/'", "s.path", "name"),
    _level("di", "f", "diagnostics", "''", "''", "factoryName"),
    "ex AS (SELECT oracle_id, file, 'expressions/' || key AS path, key AS name FROM (SELECT oracle_id, file, json_extract(v, '$.expressions') AS o FROM f WHERE json_type(v, '$.expressions') = 'OBJECT') s, json_each(s.o) WHERE json_type(value) = 'OBJECT')",
]) + """
    SELECT oracle_id, file, 'file' AS entity, '' AS path, '' AS parent_path, coalesce(v->>'$.package', '') AS name FROM f
    UNION ALL SELECT oracle_id, file, 'declaration', path, parent_path, name FROM de UNION ALL SELECT oracle_id, file, 'member', path, parent_path, name FROM me
    UNION ALL SELECT oracle_id, file, 'param', path, parent_path, name FROM pa UNION ALL SELECT oracle_id, file, 'diagnostic', path, parent_path, name FROM di
    UNION ALL SELECT oracle_id, file, 'expression', path, '', name FROM ex"""

_P3 = f"""
    WITH runs AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS i FROM scan_runs WHERE status = 'ok'),
    e AS (SELECT {_PLAIN.format("path")} AS path, lower(hash) AS h, arrived_at, entry_id FROM file_entries WHERE hash <> '' AND path IS NOT NULL),
    p AS (SELECT e.*, r.i FROM e ASOF JOIN runs r ON e.arrived_at < r.started_at),
    l AS (SELECT path, i, max_by(h, struct_pack(a := arrived_at, b := entry_id)) AS h FROM p GROUP BY path, i),
    w AS (SELECT *, lag(h) OVER (PARTITION BY path ORDER BY i) AS o FROM l)
    SELECT run_id, path AS path FROM w JOIN runs USING (i) WHERE o IS DISTINCT FROM h"""

_P4 = f"""
    WITH r AS (SELECT snapshot_id, captured_at, rule, {_PLAIN.format("file")} AS file, coalesce(line, 0) AS line, coalesce(message, '') AS m, delivered_at FROM finding_snapshots WHERE rule IS NOT NULL AND file IS NOT NULL),
    s AS (SELECT snapshot_id, row_number() OVER (ORDER BY min(captured_at), snapshot_id) AS seq FROM r GROUP BY 1),
    d AS (SELECT s.seq, r.rule, r.file, r.line, max_by(m, delivered_at) AS m FROM r JOIN s USING (snapshot_id) GROUP BY ALL),
    j AS (SELECT coalesce(b.seq, a.seq + 1) AS seq, coalesce(a.rule, b.rule) AS rule, coalesce(a.file, b.file) AS file, coalesce(a.line, b.line) AS line,
      CASE WHEN a.seq IS NULL THEN 'added' WHEN b.seq IS NULL THEN 'removed' WHEN a.m <> b.m THEN 'changed' END AS change
      FROM d a FULL JOIN d b ON b.seq = a.seq + 1 AND a.rule = b.rule AND a.file = b.file AND a.line = b.line)
    SELECT s.snapshot_id, change, rule, file, line FROM j JOIN s USING (seq) WHERE change IS NOT NULL AND seq > 1"""

_P5 = """
    WITH RECURSIVE x AS (SELECT unnest(scope_spans, recursive := false) AS ss FROM (SELECT unnest(resource_spans, max_depth := 2) FROM otel_sample)),
    s AS (SELECT unnest(ss.spans) AS sp FROM x),
    n AS (SELECT lower(sp.trace_id) AS t, lower(sp.span_id) AS s, max(CASE WHEN regexp_matches(coalesce(sp.parent_span_id, ''), '^0*$') THEN NULL ELSE lower(sp.parent_span_id) END) AS p
      FROM s WHERE sp.trace_id <> '' AND sp.span_id <> '' GROUP BY 1, 2),
    k AS (SELECT n.t, n.s, q.s AS p FROM n LEFT JOIN n q ON q.t = n.t AND q.s = n.p),
    r AS (SELECT t, s, s AS root, 0 AS depth, s AS path FROM k WHERE p IS NULL UNION ALL SELECT k.t, k.s, r.root, r.depth + 1, r.path || '/' || k.s FROM r JOIN k ON k.t = r.t AND k.p = r.s),
    c AS (SELECT t, a, count(*) - 1 AS n FROM (SELECT t, unnest(string_split(path, '/')) AS a FROM r) GROUP BY t, a)
    SELECT k.t AS trace_id, k.s AS span_id, coalesce(r.root, '') AS root_span_id, coalesce(r.depth, -1)::INT AS depth, coalesce(c.n, -1)::INT AS n_descendants, coalesce(r.path, '') AS path
    FROM k LEFT JOIN r ON r.t = k.t AND r.s = k.s LEFT JOIN c ON c.t = r.t AND c.a = r.s"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}
SQL = {"p1_found": _P1, "p3_found": _P3, "p4_found": _P4, "p5_found": _P5}

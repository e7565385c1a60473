"""Queries over compiler facts (``oracle``): symbols, supertypes and calls as the payloads have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts as C
from factloom.operators import references as R
from factloom.operators.nested import NestedTables
from factloom.queries.more import _FACTS
from factloom.queries.problems import _level
from factloom.session import table

QUERIES, SQL = {}, {}

_WITH = ", ".join([
    _FACTS,
    _level("pa", "me", "params", "s.path || '/'", "s.path", "name"),
    "ca AS (SELECT oracle_id, file, key AS place, value->>'$.callTarget' AS target, coalesce(lower(value->>'$.callTargetResolved') = 'true', false) AS resolved FROM (SELECT oracle_id, file, json_extract(v, '$.expressions') AS o FROM f WHERE json_type(v, '$.expressions') = 'OBJECT') s, json_each(s.o) WHERE json_type(value) = 'OBJECT' AND coalesce(value->>'$.callTarget', '') <> '')",
])


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(NestedTables(table(spark, sf_dir, "oracle"), "oracle_id", "payload", "received_at", label=name))
        if sql:
            SQL[name] = f"{_WITH} {sql}"
        return fn

    return add


@query("src17_fact_symbols", """
    SELECT oracle_id AS record_id, file, fqn, regexp_extract(fqn, '([^.]*)$', 1) AS name, regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS owner, NULL::INT AS arity FROM (SELECT oracle_id, file, v->>'$.fqn' AS fqn FROM de) WHERE coalesce(fqn, '') <> ''
    UNION ALL SELECT m.oracle_id, m.file, d.name || '.' || m.name, m.name, d.name, (SELECT count(*) FROM pa WHERE pa.oracle_id = m.oracle_id AND pa.file = m.file AND pa.parent_path = m.path)::INT
      FROM me m JOIN de d ON d.oracle_id = m.oracle_id AND d.file = m.file AND d.path = m.parent_path WHERE m.name <> '' AND d.name <> ''""")
def src17(tables):
    return C.symbols(tables).select("record_id", "file", "fqn", "name", "owner", "arity")


@query("gr11b_fact_supertypes", """
    SELECT DISTINCT fqn, supertype FROM (SELECT name AS fqn, CASE json_type(v, '$.supertypes') WHEN 'ARRAY' THEN CAST(json_extract(v, '$.supertypes') AS JSON[]) WHEN 'NULL' THEN [] ELSE [json_extract(v, '$.supertypes')] END AS l FROM de WHERE name <> ''), unnest(l) t(j), LATERAL (SELECT CASE json_type(j) WHEN 'NULL' THEN NULL ELSE j->>'$' END AS supertype) x WHERE coalesce(supertype, '') <> ''""")
def gr11b(tables):
    return C.supertypes(tables)


@query("pf27_call_targets", """
    SELECT oracle_id AS record_id, file, target, regexp_extract(target, '([^.]*)$', 1) AS callee, count(*) AS n FROM ca
    WHERE regexp_extract(target, '([^.]*)$', 1) IN (SELECT regexp_extract(target, '([^.]*)$', 1) FROM ca WHERE resolved) AND regexp_extract(target, '([^.]*)$', 1) <> '' GROUP BY ALL""")
def pf27(tables):
    """Calls whose callee has the name of one that is resolved somewhere, whatever it is called on."""
    calls = C.calls(tables)
    return C.call_target_filter(calls, calls.where("resolved")).groupBy("record_id", "file", "target", "callee").agg(F.count("*").alias("n"))


@query("ag2b_fact_call_counts", "SELECT target, count(*) AS calls, count(DISTINCT (oracle_id, file)) AS files FROM ca GROUP BY target")
def ag2b(tables):
    return C.calls(tables).groupBy("target").agg(F.count("*").alias("calls"), F.count_distinct(F.struct("record_id", "file")).alias("files"))


@query("jo7b_uncalled_members", """
    SELECT DISTINCT d.name || '.' || m.name AS fqn FROM me m JOIN de d ON d.oracle_id = m.oracle_id AND d.file = m.file AND d.path = m.parent_path
    WHERE m.name <> '' AND d.name <> '' AND m.name NOT IN (SELECT regexp_extract(target, '([^.]*)$', 1) FROM ca)""")
def jo7b(tables):
    """Members whose simple name no call has, in any file."""
    called = C.calls(tables).select(C.simple_callee("target").alias("name")).distinct()
    return C.symbols(tables).where("arity IS NOT NULL").join(called, "name", "left_anti").select("fqn").distinct()


@query("ag39_index_statistics", None)
def ag39(tables):
    """Estimates, which no exact SQL equals; the tests bound their error."""
    return R.index_statistics(C.calls(tables).select(F.col("target").alias("name"), "file"))

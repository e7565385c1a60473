"""Queries over resolution, scalars, canonical orders and typed compiler facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import graph as G
from factloom.operators import resolution as X
from factloom.operators.nested import NestedTables
from factloom.queries.problems import _level
from factloom.queries.standins import fact, with_facts
from factloom.session import table

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str | None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        if sql:
            SQL[name] = with_facts(facts, sql)
        return fn

    return add


_PKG = "regexp_extract({}, '^(.*)[.][^.]*$', 1)"
_CALLS = "SELECT DISTINCT r.file, 'dev.p' || (r.line * 5) AS package, r.name, CASE WHEN r.in_comment THEN -1 ELSE r.line % 4 END AS arity FROM refs r"
_CAND = f"SELECT DISTINCT fqn, name, arity AS a, {_PKG.format('fqn')} AS package FROM symbols"


@query("jo4_resolve_callables", "refs symbols imports", f"""
    SELECT DISTINCT file, name, arity, fqn, CASE p WHEN 1 THEN 'import' WHEN 2 THEN 'dotted' WHEN 3 THEN 'package' ELSE 'name' END AS how
    FROM (SELECT *, min(p) OVER (PARTITION BY file, name, arity) AS b FROM (
      SELECT c.file, c.name, c.arity, i.import AS fqn, 1 AS p FROM ({_CALLS}) c JOIN imports i ON i.file = c.file AND i.import NOT LIKE '%*' AND regexp_extract(i.import, '([^.]*)$', 1) = c.name
      UNION ALL SELECT file, name, arity, name, 2 FROM ({_CALLS}) WHERE contains(name, '.')
      UNION ALL SELECT c.file, c.name, c.arity, k.fqn, 3 FROM ({_CALLS}) c JOIN ({_CAND}) k ON k.package = c.package AND k.name = c.name AND (c.arity < 0 OR c.arity = k.a)
      UNION ALL SELECT c.file, c.name, c.arity, k.fqn, 4 FROM ({_CALLS}) c JOIN ({_CAND}) k ON k.name = c.name AND (c.arity < 0 OR c.arity = k.a))) WHERE p = b""")
def jo4(refs, symbols, imports):
    calls = refs.select("file", F.concat(F.lit("dev.p"), F.col("line") * 5).alias("package"), "name", F.when(F.col("in_comment"), -1).otherwise(F.col("line") % 4).alias("arity"))
    return X.resolve_callables(calls, symbols, imports)


@query("gr3_cycles_within_packages", "module_edges", """
    {rec}, e AS (SELECT DISTINCT src, dst FROM module_edges WHERE substr(src, 3)::INT % 5 = substr(dst, 3)::INT % 5),
    tc AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON tc.dst = e.src),
    m AS (SELECT DISTINCT a.src AS node, a.dst AS other FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
    SELECT substr(node, 3)::INT % 5 AS module, node, least(node, min(other)) AS component FROM m GROUP BY node""")
def gr3(module_edges):
    """Nodes stand for packages, the level in their number for the module they are in."""
    nodes = module_edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return X.cycles_within(module_edges.select("src", "dst").distinct(), nodes.withColumn("module", F.expr("CAST(substr(node, 3) AS INT) % 5")))


@query("gr11_supertypes", "symbols refs", """
    SELECT w.name, coalesce((SELECT min(signature) FROM symbols WHERE fqn = w.name), (SELECT min(signature) FROM symbols WHERE regexp_extract(fqn, '([^.]*)$', 1) = w.name)) AS supertypes FROM (SELECT DISTINCT name FROM refs) w""")
def gr11(symbols, refs):
    return G.supertypes(symbols.select("fqn", F.col("signature").alias("supertypes")), refs)


@query("gr12_exception_subtypes", "imports symbols", "SELECT DISTINCT file AS type, import AS wanted FROM imports WHERE import IN (SELECT fqn FROM symbols WHERE symbols.file = imports.file) OR file = import")
def gr12(imports, symbols):
    pairs = imports.select(F.col("file").alias("type"), F.col("import").alias("wanted")).distinct()
    return X.subtypes_of(pairs, symbols.select(F.col("file").alias("type"), F.col("fqn").alias("ancestor")))


@query("gr13_resource_graph", "scripts", r"SELECT doc_id, unnest(regexp_extract_all(text, '@(\w+)/\w+', 1)) AS kind, unnest(regexp_extract_all(text, '@\w+/(\w+)', 1)) AS name FROM scripts")
def gr13(scripts):
    kind, name = (F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (r"@(\w+)/\w+", r"@\w+/(\w+)"))
    return scripts.select("doc_id", F.inline(F.arrays_zip(kind.alias("kind"), name.alias("name"))))


@query("ud10_rename_plan", "symbols refs imports", """
    {rec}, n AS (SELECT DISTINCT fqn, name || 'Renamed' AS new_name, regexp_extract(fqn, '([^.]*)$', 1) AS name, regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS package FROM symbols WHERE is_main),
    sees AS (SELECT s.fqn, s.file FROM symbols s JOIN n USING (fqn) UNION SELECT n.fqn, i.file FROM imports i JOIN n ON n.fqn = i.import
      UNION SELECT n.fqn, s.file FROM n JOIN (SELECT DISTINCT regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS package, file FROM symbols) s USING (package)),
    u AS (SELECT DISTINCT n.fqn, n.new_name, n.name, r.file, r.line, r.start_byte FROM n JOIN sees USING (fqn) JOIN refs r ON r.file = sees.file AND r.name = n.name AND NOT r.in_comment)
    SELECT DISTINCT file, line, start_byte AS start, start_byte + length(name) AS stop, new_name AS replacement, 'rename' AS rule FROM u
    WHERE NOT EXISTS (SELECT 1 FROM imports i WHERE i.file = u.file AND regexp_extract(i.import, '([^.]*)$', 1) = u.name AND i.import <> u.fqn AND u.name <> '*')""")
def ud10(symbols, refs, imports):
    renames = symbols.where("is_main").select("fqn", F.concat("name", F.lit("Renamed")).alias("new_name"))
    return X.rename_plan(symbols, refs, imports, renames)


@query("ag35_mock_usage", "scripts", r"""
    SELECT doc_id, CASE WHEN contains(text, 'io.mockk') THEN 'mockk' ELSE 'other' END AS library, 1::BIGINT AS mocks, CASE WHEN contains(text, 'verify {') THEN 0 ELSE 1 END::BIGINT AS unused FROM scripts""")
def ag35(scripts):
    return X.mock_usage(scripts)


@query("sc23_config_fingerprint", "symbols", "SELECT module, sha256(string_agg(DISTINCT kind || '=' || visibility, chr(10) ORDER BY kind || '=' || visibility)) AS fingerprint FROM symbols GROUP BY module")
def sc23(symbols):
    return X.config_fingerprint(symbols.select("module", F.col("kind").alias("key"), F.col("visibility").alias("value")), ["module"])


@query("se11_union_strings", "symbols refs", "SELECT name, min(pos)::INT AS pos FROM (SELECT name, 0 AS pos FROM symbols UNION ALL SELECT name, 1 FROM refs) GROUP BY name")
def se11(symbols, refs):
    return X.keyed_union(symbols, refs, "name")


@query("so3_canonical_symbols", "symbols", "SELECT file, start_byte, fqn, name FROM symbols")
def so3(symbols):
    return symbols.orderBy("file", "start_byte", "fqn", "name").select("file", "start_byte", "fqn", "name")


@query("so5_max_results", "symbols", "SELECT fqn, count(*) AS n FROM symbols GROUP BY fqn ORDER BY n DESC, fqn LIMIT 40")
def so5(symbols):
    return symbols.groupBy("fqn").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fqn").limit(40)


@query("sc11_accessor_paths", "modules", "SELECT path, ':' || lower(substr(a, 1, 1) || regexp_replace(substr(a, 2), '(\\p{Lu})', '-\\1', 'g')) AS resolved FROM (SELECT path, 'core' || layer || 'Api' || replace(path, ':', '') AS a FROM modules)")
def sc11(modules):
    return modules.select("path", S.accessor_to_path(F.concat(F.lit("core"), "layer", F.lit("Api"), F.translate("path", ":", ""))).alias("resolved"))


@query("sc13_accessor_names", "symbols", "SELECT DISTINCT 'get' || name AS accessor, lower(substr(name, 1, 1)) || substr(name, 2) AS property FROM symbols")
def sc13(symbols):
    return symbols.select(F.concat(F.lit("get"), "name").alias("accessor")).distinct().select("accessor", S.accessor_property(F.col("accessor")).alias("property"))


@query("sc15_placeholder_secrets", "texts", r"SELECT doc_id, regexp_matches(lower(v), '^(x+|\*+|[.]+|<.*>|\$\{.*\}|.*(example|dummy|placeholder|changeme|your[-_]).*)$') AS placeholder, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\s)]*)', 1)) AS v FROM texts) GROUP BY ALL")
def sc15(texts):
    every = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s)]*)"), 1)).alias("v"))
    return every.groupBy("doc_id", S.placeholder_secret(F.col("v")).alias("placeholder")).agg(F.count("*").alias("n"))


@query("sc19_parse_since", "commits", "SELECT DISTINCT commit_sha, committed_at AS since FROM commits")
def sc19(commits):
    text = F.date_format("committed_at", "yyyy-MM-dd")
    return commits.select("commit_sha", S.parse_since(text).cast("timestamp_ntz").alias("since")).distinct()


@query("sc20_age_days", "commits", "SELECT DISTINCT commit_sha, datediff('day', committed_at::DATE, DATE '2026-01-01')::INT AS age FROM commits")
def sc20(commits):
    return commits.select("commit_sha", F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("committed_at")).alias("age")).distinct()


@query("sc27_density", "runtime", "SELECT source_id, round(sum(value * CASE frame WHEN 'click' THEN 0.75 WHEN 'view' THEN 1.0 WHEN 'error' THEN 1.5 WHEN 'signup' THEN 2.0 ELSE 0.0 END), 4) AS weighted FROM runtime GROUP BY source_id")
def sc27(runtime):
    bucket = F.element_at(F.create_map(*[F.lit(x) for p in (("click", "ldpi"), ("view", "mdpi"), ("error", "hdpi"), ("signup", "xhdpi"), ("purchase", "unknown")) for x in p]), F.col("frame"))
    return runtime.groupBy("source_id").agg(F.round(F.sum(F.col("value") * S.density_factor(bucket)), 4).alias("weighted"))


_FACTS = "WITH " + ", ".join([
    "d AS (SELECT oracle_id, max_by(payload, received_at) AS p FROM oracle WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' GROUP BY oracle_id)",
    "fs AS (SELECT oracle_id, json_extract(p, '$.files') AS o FROM d WHERE json_type(p, '$.files') = 'OBJECT')",
    "f AS (SELECT oracle_id, key AS file, '' AS path, value AS v FROM fs, json_each(fs.o) WHERE json_type(value) = 'OBJECT')",
    _level("de", "f", "declarations", "''", "''", "fqn"),
    _level("me", "de", "members", "s.path || '/'", "s.path", "name"),
    _level("di", "f", "diagnostics", "''", "''", "factoryName"),
])


def _tables(spark, sf_dir):
    return NestedTables(table(spark, sf_dir, "oracle"), "oracle_id", "payload", "received_at")


def p1_declarations(spark, sf_dir):
    """Declarations under their own schema."""
    return _tables(spark, sf_dir).table("declaration").select(F.col("record_id").alias("oracle_id"), F.col("unit").alias("file"), "path", "parent_path", "fqn", "kind", "visibility", "line")


def p1_members(spark, sf_dir):
    return _tables(spark, sf_dir).table("member").select(F.col("record_id").alias("oracle_id"), F.col("unit").alias("file"), "path", "parent_path", F.col("own_name").alias("name"), "kind", "returnType", "visibility")


def p1_diagnostics(spark, sf_dir):
    return _tables(spark, sf_dir).table("diagnostic").select(F.col("record_id").alias("oracle_id"), F.col("unit").alias("file"), "path", "factoryName", "severity", "message", "line", "col")


QUERIES |= {"p1_declarations": p1_declarations, "p1_members": p1_members, "p1_diagnostics": p1_diagnostics}
SQL |= {
    "p1_declarations": f"{_FACTS} SELECT oracle_id, file, path, parent_path, v->>'$.fqn' AS fqn, v->>'$.kind' AS kind, v->>'$.visibility' AS visibility, try_cast(v->>'$.line' AS BIGINT) AS line FROM de",
    "p1_members": f"{_FACTS} SELECT oracle_id, file, path, parent_path, v->>'$.name' AS name, v->>'$.kind' AS kind, v->>'$.returnType' AS \"returnType\", v->>'$.visibility' AS visibility FROM me",
    "p1_diagnostics": f"{_FACTS} SELECT oracle_id, file, path, v->>'$.factoryName' AS \"factoryName\", v->>'$.severity' AS severity, v->>'$.message' AS message, try_cast(v->>'$.line' AS BIGINT) AS line, try_cast(v->>'$.col' AS BIGINT) AS col FROM di",
}

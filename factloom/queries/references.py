"""Queries over symbols, references, imports and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import references as R
from factloom.queries.standins import fact, with_facts

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str):
    """Registers a function of the named facts (in order) with its SQL."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        SQL[name] = with_facts(facts, sql)
        return fn

    return add


_KEYED = "k AS (SELECT DISTINCT fqn, name, name AS ref FROM symbols UNION SELECT DISTINCT fqn, name, fqn FROM symbols)"
#: Files whose commit came last count as changed.
_CHANGED = "SELECT DISTINCT file FROM commits WHERE committed_at >= TIMESTAMP '2001-07-28'"


def _changed(commits):
    return commits.where(F.col("committed_at") >= F.lit("2001-07-28").cast("timestamp_ntz")).select("file").distinct()


@query("jo1_symbol_by_name", "symbols refs", "SELECT r.file, r.name, r.line, s.fqn, s.kind, count(*) AS n FROM refs r JOIN symbols s ON r.name = s.name GROUP BY ALL")
def jo1(symbols, refs):
    return refs.join(symbols.select("name", "fqn", "kind"), "name").groupBy("file", "name", "line", "fqn", "kind").agg(F.count("*").alias("n"))


@query("jo2_symbol_by_fqn", "symbols", "SELECT fqn, name, kind, visibility, file, start_byte FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY file DESC, start_byte DESC) AS r FROM symbols) WHERE r = 1")
def jo2(symbols):
    return R.lookup_by_fqn(symbols)


@query("jo3_resolve_types", "symbols refs imports", """SELECT DISTINCT file, name, fqn, CASE p WHEN 1 THEN 'import' WHEN 2 THEN 'dotted' WHEN 3 THEN 'wildcard' ELSE 'name' END AS how
    FROM (SELECT *, min(p) OVER (PARTITION BY file, name) AS b FROM (
      SELECT w.file, w.name, i.import AS fqn, 1 AS p FROM (SELECT DISTINCT file, name FROM refs) w JOIN imports i ON i.file = w.file AND regexp_extract(i.import, '([^.]*)$', 1) = w.name AND i.import NOT LIKE '%*'
      UNION ALL SELECT DISTINCT file, name, name, 2 FROM refs WHERE contains(name, '.')
      UNION ALL SELECT w.file, w.name, k.fqn, 3 FROM (SELECT DISTINCT file, name FROM refs) w JOIN imports i ON i.file = w.file AND i.import LIKE '%*' JOIN (SELECT DISTINCT fqn, name, regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS package FROM symbols) k ON k.package = regexp_extract(i.import, '^(.*)[.][*]$', 1) AND k.name = w.name
      UNION ALL SELECT w.file, w.name, k.fqn, 4 FROM (SELECT DISTINCT file, name FROM refs) w JOIN (SELECT DISTINCT fqn, name FROM symbols) k ON k.name = w.name)) WHERE p = b""")
def jo3(symbols, refs, imports):
    return R.resolve_types(refs, symbols, imports)


@query("jo5_referenced_elsewhere", "symbols refs", "SELECT fqn, name, file, line FROM symbols s WHERE EXISTS (SELECT 1 FROM refs r WHERE r.name = s.name AND r.file <> s.file AND NOT r.in_comment)")
def jo5(symbols, refs):
    return R.referenced_elsewhere(symbols, refs, count_comments=False).select("fqn", "name", "file", "line")


@query("jo6_referenced_strict", "symbols refs", "SELECT fqn, name, file, line FROM symbols s WHERE EXISTS (SELECT 1 FROM refs r WHERE r.name = coalesce(nullif(s.fqn, ''), s.name) AND r.file <> s.file)")
def jo6(symbols, refs):
    return R.referenced_elsewhere(symbols, refs, strict_fqn=True).select("fqn", "name", "file", "line")


@query("jo7_unused_symbols", "symbols refs", """
    SELECT fqn, name, kind, file, line FROM symbols s
    WHERE NOT is_override AND NOT is_main AND NOT is_test AND visibility <> 'private'
      AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.name IN (s.name, s.fqn) AND r.file <> s.file AND NOT r.in_comment)
      AND (SELECT count(*) FROM refs r WHERE r.name IN (s.name, s.fqn) AND r.file = s.file AND NOT r.in_comment) <= 1""")
def jo7(symbols, refs):
    return R.unused_symbols(symbols, refs).select("fqn", "name", "kind", "file", "line")


@query("jo9_importers", "imports", "SELECT DISTINCT import AS target, file FROM imports")
def jo9(imports):
    return R.importers(imports)


@query("jo10_affected_by_import", "commits symbols imports", f"""
    SELECT DISTINCT file FROM ({_CHANGED} UNION ALL
      SELECT i.file FROM imports i JOIN (SELECT DISTINCT s.fqn FROM symbols s WHERE s.file IN ({_CHANGED})) t
        ON i.import IN (t.fqn, regexp_extract(t.fqn, '^(.*)[.][^.]*$', 1) || '.*'))""")
def jo10(commits, symbols, imports):
    return R.affected_by_import(_changed(commits), symbols, imports)


@query("jo11_affected_set", "commits symbols refs", f"""
    SELECT DISTINCT file FROM ({_CHANGED}
      UNION ALL SELECT file FROM refs WHERE name IN (SELECT name FROM symbols WHERE file IN ({_CHANGED}))
      UNION ALL SELECT file FROM symbols WHERE name IN (SELECT name FROM refs WHERE file IN ({_CHANGED})))""")
def jo11(commits, symbols, refs):
    return R.affected_set(_changed(commits), [(symbols, refs)])


@query("jo12_affected_incremental", "commits symbols refs", f"""
    SELECT DISTINCT file FROM ({_CHANGED}
      UNION ALL SELECT file FROM refs WHERE in_comment AND name IN (SELECT name FROM symbols WHERE is_test AND file IN ({_CHANGED}))
      UNION ALL SELECT file FROM symbols WHERE is_test AND name IN (SELECT name FROM refs WHERE in_comment AND file IN ({_CHANGED}))
      UNION ALL SELECT file FROM refs WHERE NOT in_comment AND name IN (SELECT name FROM symbols WHERE NOT is_test AND file IN ({_CHANGED}))
      UNION ALL SELECT file FROM symbols WHERE NOT is_test AND name IN (SELECT name FROM refs WHERE NOT in_comment AND file IN ({_CHANGED})))""")
def jo12(commits, symbols, refs):
    removed = symbols.where("is_test"), refs.where("in_comment")
    current = symbols.where(~F.col("is_test")), refs.where(~F.col("in_comment"))
    return R.affected_set(_changed(commits), [removed, current])


@query("jo19_blast_radius", "commits symbols refs", f"""
    SELECT h.fqn, count(DISTINCT r.file) AS consumers, count(DISTINCT r.module) AS modules
    FROM (SELECT DISTINCT fqn, name, file FROM symbols WHERE file IN ({_CHANGED}) AND line BETWEEN 10 AND 60) h
    JOIN refs r ON r.name IN (h.name, h.fqn) AND r.file <> h.file GROUP BY h.fqn ORDER BY consumers DESC, h.fqn LIMIT 20""")
def jo19(commits, symbols, refs):
    return R.blast_radius(_changed(commits).select("file", F.lit(10).alias("first"), F.lit(60).alias("last")), symbols, refs)


@query("jo18_changed_symbols", "commits symbols", "SELECT DISTINCT s.fqn, s.file, s.line FROM symbols s JOIN (SELECT file, min(day(committed_at)) AS first, max(day(committed_at)) AS last FROM commits GROUP BY file) c ON s.file = c.file AND s.line BETWEEN c.first AND c.last")
def jo18(commits, symbols):
    hunks = commits.groupBy("file").agg(F.min(F.dayofmonth("committed_at")).alias("first"), F.max(F.dayofmonth("committed_at")).alias("last"))
    return symbols.join(hunks, "file").where(F.col("line").between(F.col("first"), F.col("last"))).select("fqn", "file", "line").distinct()


@query("jo20_select_tests", "commits symbols refs", f"SELECT DISTINCT file FROM refs WHERE is_test AND name IN (SELECT name FROM symbols WHERE NOT is_test AND file IN ({_CHANGED}) UNION SELECT fqn FROM symbols WHERE NOT is_test AND file IN ({_CHANGED}))")
def jo20(commits, symbols, refs):
    return R.select_tests(_changed(commits), symbols, refs)


@query("jo22_untested_public", "symbols refs", "SELECT DISTINCT fqn, name FROM symbols s WHERE visibility = 'public' AND NOT is_test AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.is_test AND r.name IN (s.name, s.fqn))")
def jo22(symbols, refs):
    return R.untested_public(symbols, refs)


@query("jo32_used_external", "imports refs symbols", """
    SELECT DISTINCT kind, name FROM (SELECT 'import' AS kind, import AS name FROM imports UNION ALL SELECT 'reference', name FROM refs WHERE contains(name, '.'))
    WHERE regexp_extract(name, '^(.*)[.][^.]*$', 1) NOT IN (SELECT regexp_extract(fqn, '^(.*)[.][^.]*$', 1) FROM symbols WHERE is_main)""")
def jo32(imports, refs, symbols):
    own = symbols.where("is_main").select(F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1).alias("package"))
    return R.used_external(imports, refs, own)


@query("jo34_outline", "refs", "SELECT name, file, line, count(*) AS n FROM refs GROUP BY ALL")
def jo34(refs):
    return refs.groupBy("name", "file", "line").agg(F.count("*").alias("n"))


@query("ag1_reference_aggregate", "refs", "SELECT name, count(*) AS n_refs, count(DISTINCT file) AS n_files, count(DISTINCT CASE WHEN NOT in_comment THEN file END) AS n_code_files FROM refs GROUP BY name")
def ag1(refs):
    return R.reference_aggregate(refs)


@query("ag2_reference_count", "refs", "SELECT name, count(*) AS n_refs FROM refs GROUP BY name")
def ag2(refs):
    return R.reference_count(refs)


@query("ag3_symbol_reference_count", "symbols refs", "SELECT s.fqn, s.name, count(r.name) AS n_refs FROM (SELECT DISTINCT fqn, name FROM symbols) s LEFT JOIN refs r ON r.name IN (s.name, s.fqn) GROUP BY ALL")
def ag3(symbols, refs):
    return R.symbol_reference_count(symbols, refs)


@query("ag4_local_reference_count", "refs", "SELECT name, file, count(*) AS n_refs FROM refs WHERE NOT in_comment GROUP BY ALL")
def ag4(refs):
    return R.local_reference_count(refs)


_FAN_IN = """SELECT d.name, d.kind, d.decl_file, count(DISTINCT r.file) AS fan_in
    FROM (SELECT name, file AS decl_file, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, start_byte, kind) AS n FROM symbols) WHERE n = 1) d
    LEFT JOIN refs r ON r.name = d.name AND r.file <> d.decl_file GROUP BY ALL"""


@query("ag5_symbol_fan_in", "symbols refs", _FAN_IN)
def ag5(symbols, refs):
    return R.symbol_fan_in(symbols, refs)


@query("ag6_hotspots", "symbols refs", f"SELECT * FROM ({_FAN_IN}) WHERE fan_in > 12 ORDER BY fan_in DESC, name")
def ag6(symbols, refs):
    return R.hotspots(symbols, refs, 12)


_DECL_FAN_IN = "SELECT name, fqn, kind, file, line, start_byte, (SELECT count(DISTINCT r.file) FROM refs r WHERE r.name = s.name AND r.file <> s.file) AS fan_in FROM symbols s"


@query("ag7_declaration_fan_in", "symbols refs", _DECL_FAN_IN)
def ag7(symbols, refs):
    return R.declaration_fan_in(symbols, refs).select("name", "fqn", "kind", "file", "line", "start_byte", "fan_in")


@query("ag8_hotspot_rule", "symbols refs", f"SELECT * FROM ({_DECL_FAN_IN}) WHERE kind IN ('SMALL', 'LARGE') AND fan_in >= 80")
def ag8(symbols, refs):
    return R.declaration_fan_in(symbols, refs, ["SMALL", "LARGE"], 80).select("name", "fqn", "kind", "file", "line", "start_byte", "fan_in")


@query("ag10_import_breadth", "imports", "SELECT file, count(DISTINCT regexp_extract(import, '^(.*)[.][^.]*$', 1)) AS breadth FROM imports GROUP BY file HAVING breadth > 20")
def ag10(imports):
    return imports.groupBy("file").agg(F.countDistinct(F.regexp_extract("import", r"^(.*)\.[^.]*$", 1)).alias("breadth")).where("breadth > 20")


@query("wi6_first_declaration", "symbols", "SELECT name, file AS decl_file, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, start_byte, kind) AS n FROM symbols) WHERE n = 1")
def wi6(symbols):
    return R.first_declarations(symbols)


@query("gr14_module_usage", "symbols refs modules", """
    SELECT fqn, module, CASE WHEN outside = 1 THEN 'used' WHEN inside = 1 THEN 'could-be-internal' ELSE 'dead' END AS verdict FROM (
      SELECT s.fqn, s.module, max(coalesce((r.module = s.module)::INT, 0)) AS inside, max(coalesce((r.module <> s.module)::INT, 0)) AS outside
      FROM symbols s LEFT JOIN refs r ON r.name IN (s.name, s.fqn) AND NOT r.in_comment
      WHERE s.visibility = 'public' AND NOT s.is_main AND s.module IN (SELECT path FROM modules WHERE NOT is_published) GROUP BY s.fqn, s.module)""")
def gr14(symbols, refs, modules):
    return R.module_usage(symbols, refs, modules)


@query("gr15_per_module_index", "symbols refs", "SELECT coalesce(s.module, r.module) AS module, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_refs, 0) AS n_refs FROM (SELECT module, count(*) AS n_symbols FROM symbols GROUP BY module) s FULL JOIN (SELECT module, count(*) AS n_refs FROM refs GROUP BY module) r ON s.module = r.module")
def gr15(symbols, refs):
    a, b = symbols.groupBy("module").agg(F.count("*").alias("n_symbols")), refs.groupBy("module").agg(F.count("*").alias("n_refs"))
    return a.join(b, "module", "full_outer").fillna(0)


@query("gr16_collaborators", "symbols refs", """
    SELECT s.file, sum(u.n)::BIGINT AS score, min(s.name) AS symbol FROM (SELECT DISTINCT fqn, name, file FROM symbols WHERE visibility = 'public' AND file <> 'f7') s
    JOIN (SELECT name, count(*) AS n FROM refs WHERE file = 'f7' AND NOT in_comment GROUP BY name) u ON u.name IN (s.name, s.fqn) GROUP BY s.file""")
def gr16(symbols, refs):
    return R.collaborators(symbols, refs, F.lit("f7"))


@query("se13_overlay", "refs commits", f"SELECT file, count(*) AS n, max(line) AS last FROM (SELECT * FROM refs WHERE file NOT IN ({_CHANGED}) UNION ALL SELECT * REPLACE (line + 1000 AS line) FROM refs WHERE file IN ({_CHANGED})) GROUP BY file")
def se13(refs, commits):
    changed = _changed(commits)
    fresh = refs.join(changed, "file", "left_semi").withColumn("line", F.col("line") + 1000).select(refs.columns)
    return R.overlay(refs, changed, fresh).groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("last"))

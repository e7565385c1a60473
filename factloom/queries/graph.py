"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.queries.standins import fact, with_facts

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str | None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        if sql:
            SQL[name] = with_facts(facts, sql)
        return fn

    return add


_TC = "{rec}, e AS (SELECT DISTINCT src, dst FROM module_edges), tc AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON tc.dst = e.src)"


@query("ag9_degrees", "module_edges modules", "SELECT path AS node, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM modules LEFT JOIN (SELECT dst, count(*) AS i FROM module_edges GROUP BY dst) a ON a.dst = path LEFT JOIN (SELECT src, count(*) AS o FROM module_edges GROUP BY src) b ON b.src = path")
def ag9(module_edges, modules):
    return G.degrees(module_edges, modules.select(F.col("path").alias("node")))


@query("gr_closure", "module_edges", f"{_TC} SELECT src, dst FROM tc")
def closure(module_edges):
    return G.closure(module_edges)


_SCC = f"{_TC}, m AS (SELECT DISTINCT a.src AS node, a.dst AS other FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) SELECT node, least(node, min(other)) AS component FROM m GROUP BY node"


@query("gr1_strong_components", "module_edges", _SCC)
def gr1(module_edges):
    return G.strong_components(module_edges)


@query("gr2_module_cycles", "module_edges", f"{_TC}, m AS (SELECT DISTINCT a.src AS node, a.dst AS other FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst), s AS (SELECT node, least(node, min(other)) AS component FROM m GROUP BY node) SELECT component, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM s GROUP BY component")
def gr2(module_edges):
    return G.strong_components(module_edges).groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"))


@query("gr4_injection_cycles", "module_edges", "{rec}, e AS (SELECT DISTINCT src, dst FROM module_edges WHERE configuration = 'api' UNION SELECT path, path FROM (SELECT DISTINCT src AS path FROM module_edges WHERE configuration <> 'api')), tc AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON tc.dst = e.src), m AS (SELECT DISTINCT a.src AS node, a.dst AS other FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src) SELECT node, min(other) AS component FROM m GROUP BY node")
def gr4(module_edges):
    hard = module_edges.select("src", "dst", (F.col("configuration") != "api").alias("deferred"))
    own = module_edges.where("configuration <> 'api'").select("src", F.col("src").alias("dst"), F.lit(False).alias("deferred"))
    return G.injection_cycles(hard.unionByName(own))


@query("gr6_scope_violations", "module_edges modules", "{rec}, e AS (SELECT DISTINCT src, dst FROM module_edges), tc AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON tc.dst = e.src), r AS (SELECT path AS node, length(layer) AS rank FROM modules WHERE is_published) SELECT tc.src AS root, tc.dst AS node FROM tc JOIN r a ON a.node = tc.src JOIN r b ON b.node = tc.dst WHERE a.rank > b.rank")
def gr6(module_edges, modules):
    scopes = modules.select(F.col("path").alias("node"), F.when(F.col("is_published"), F.length("layer")).alias("rank"))
    return G.scope_violations(module_edges, scopes)


@query("gr_reachable", "module_edges modules", "{rec}, e AS (SELECT DISTINCT src, dst FROM module_edges), r AS (SELECT path AS node, 0 AS distance FROM modules WHERE is_published UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 40) SELECT node, min(distance)::INT AS distance FROM r GROUP BY node")
def reachable(module_edges, modules):
    return G.reachable(module_edges, modules.where("is_published").select(F.col("path").alias("node")))


_ALLOWED = [("AFRICA", "ASIA"), ("AMERICA", "ASIA"), ("EUROPE", "AMERICA")]


@query("jo28_layer_violations", "module_edges modules", "SELECT DISTINCT src, dst, a.layer AS src_layer, b.layer AS dst_layer FROM module_edges JOIN modules a ON a.path = src JOIN modules b ON b.path = dst WHERE a.layer <> b.layer AND a.layer || '>' || b.layer NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in _ALLOWED) + ")")
def jo28(module_edges, modules):
    return G.layer_violations(module_edges, modules, module_edges.sparkSession.createDataFrame(_ALLOWED, "src_layer string, dst_layer string"))


_PACKAGES = "SELECT DISTINCT regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS package FROM symbols WHERE NOT is_override"


@query("gr9_package_graph", "imports symbols", f"SELECT DISTINCT s.package AS src, regexp_extract(i.import, '^(.*)[.][^.]*$', 1) AS dst FROM imports i JOIN (SELECT DISTINCT file, regexp_extract(fqn, '^(.*)[.][^.]*$', 1) AS package FROM symbols WHERE is_main) s ON s.file = i.file WHERE s.package <> regexp_extract(i.import, '^(.*)[.][^.]*$', 1) AND regexp_extract(i.import, '^(.*)[.][^.]*$', 1) IN ({_PACKAGES})")
def gr9(imports, symbols):
    package = F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1).alias("package")
    own = symbols.where("is_main").select("file", package).distinct()
    return G.package_graph(imports.join(own, "file"), symbols.where("NOT is_override").select(package))


@query("gr10_consumers", "module_edges", "SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS consumers FROM (SELECT DISTINCT src, dst FROM module_edges) GROUP BY dst")
def gr10(module_edges):
    return G.consumers(module_edges)


@query("gr8_transitive_impact", "symbols refs", """
    {rec}, u AS (SELECT DISTINCT r.name, r.file FROM refs r WHERE NOT EXISTS (SELECT 1 FROM symbols d WHERE d.name = r.name AND d.file = r.file)),
    n AS (SELECT DISTINCT fqn, name FROM symbols), e AS (SELECT DISTINCT n.fqn AS src, s.fqn AS dst FROM n JOIN u ON u.name = n.name JOIN symbols s ON s.file = u.file AND s.visibility <> 'private'),
    p AS (SELECT DISTINCT fqn FROM symbols WHERE is_main UNION SELECT e.dst FROM p JOIN e ON e.src = p.fqn)
    SELECT DISTINCT p.fqn, u.file FROM p JOIN n ON n.fqn = p.fqn JOIN u ON u.name = n.name""")
def gr8(symbols, refs):
    return G.transitive_impact(symbols.where("is_main").select("fqn"), symbols, refs)


@query("gr7_live_symbols", "symbols refs", """
    {rec}, u AS (SELECT DISTINCT r.file, r.name FROM refs r WHERE NOT in_comment AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file = r.file AND s.name = r.name AND s.line = r.line)),
    e AS (SELECT DISTINCT u.file AS src, s.file AS dst FROM u JOIN symbols s ON s.name = u.name),
    v AS (SELECT DISTINCT file FROM symbols WHERE is_main AND line < 3 UNION SELECT e.dst FROM v JOIN e ON e.src = v.file)
    SELECT DISTINCT fqn, file FROM symbols WHERE name IN (SELECT name FROM u WHERE file IN (SELECT file FROM v)) OR file IN (SELECT file FROM symbols WHERE is_main AND line < 3)""")
def gr7(symbols, refs):
    return G.live_symbols(symbols, refs, symbols.where("is_main AND line < 3").select("file"))


@query("src39_render_dot", "module_edges", "SELECT line FROM (SELECT DISTINCT '  \"' || src || '\" -> \"' || dst || '\";' AS line FROM module_edges UNION ALL SELECT 'digraph {' UNION ALL SELECT '}')")
def src39(module_edges):
    return G.render_dot(module_edges)


@query("ag37_structural_profile", "module_edges modules", "SELECT path AS module, count(dst) FILTER (WHERE configuration = 'api') > 0 AS has_api, count(dst) FILTER (WHERE configuration <> 'api') > 0 AS has_implementation FROM modules LEFT JOIN module_edges ON src = path GROUP BY path")
def ag37(module_edges, modules):
    edges = module_edges.withColumnRenamed("src", "path")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return modules.select("path").join(edges, "path", "left").groupBy(F.col("path").alias("module")).agg(has(F.col("configuration") == "api").alias("has_api"), has(F.col("configuration") != "api").alias("has_implementation"))


@query("src39b_render_mermaid", "module_edges", """
    SELECT line FROM (SELECT DISTINCT '  n' || regexp_replace(id, '[^A-Za-z0-9]', '_', 'g') || '["' || id || '"]' AS line FROM (SELECT src AS id FROM module_edges UNION SELECT dst FROM module_edges)
      UNION ALL SELECT DISTINCT '  n' || regexp_replace(src, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || configuration || '| n' || regexp_replace(dst, '[^A-Za-z0-9]', '_', 'g') FROM module_edges UNION ALL SELECT 'graph TD')""")
def src39b(module_edges):
    return G.render_mermaid(module_edges.withColumnRenamed("configuration", "label"))


@query("src39c_render_json", "module_edges", """
    SELECT regexp_replace(line, ',$', '') AS line, count(*) AS n FROM (SELECT DISTINCT '{"id":"' || id || '"}' AS line FROM (SELECT src AS id FROM module_edges UNION SELECT dst FROM module_edges)
      UNION ALL SELECT DISTINCT '{"from":"' || src || '","to":"' || dst || '"}' FROM module_edges UNION ALL SELECT '{"scope":"module","nodes":[' UNION ALL SELECT '],"edges":[' UNION ALL SELECT ']}') GROUP BY 1""")
def src39c(module_edges):
    """The lines without the commas between them, which follow from their order."""
    return G.render_json(module_edges).groupBy(F.regexp_replace("line", r"(?<=\}),$", "").alias("line")).agg(F.count("*").alias("n"))

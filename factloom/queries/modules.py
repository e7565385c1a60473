"""Queries over modules, rules, injection, resources, reviewers and syntax nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import modules as M
from factloom.plans import rules as P
from factloom.plans.builtin_rules import BUILTIN
from factloom.queries.standins import fact, with_facts

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str | None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        if sql:
            SQL[name] = with_facts(facts, sql)
        return fn

    return add


@query("pf30_file_to_module", "files modules", "SELECT f.path, coalesce((SELECT max_by(m.path, length(m.dir)) FROM modules m WHERE starts_with(f.path, m.dir || '/')), '') AS module FROM (SELECT DISTINCT path FROM files) f")
def pf30(files, modules):
    return M.file_to_module(files, modules)


_LAYERS = [("core", ["m1*", "m2"]), ("data", ["m?"]), ("ui", ["m3*", "m4*"])]


@query("pf31_layers", "modules", r"SELECT path, CASE WHEN regexp_matches(path, '^:m(1[^/]*|2)$') THEN 'core' WHEN regexp_matches(path, '^:m[^/]$') THEN 'data' WHEN regexp_matches(path, '^:m[34][^/]*$') THEN 'ui' END AS layer FROM modules")
def pf31(modules):
    return M.assign_layers(modules, _LAYERS)


_WANTED = "SELECT DISTINCT fqn AS src, CASE WHEN arity = 0 THEN 'dev.p3.N' || line ELSE 'N' || (line * 7) END AS target, file FROM symbols WHERE kind = 'PROMO'"
_BOUND = "SELECT DISTINCT fqn, regexp_extract(fqn, '([^.]*)$', 1) AS leaf FROM symbols WHERE visibility <> 'private'"


def _wanted(symbols):
    target = F.when(F.col("arity") == 0, F.concat(F.lit("dev.p3.N"), F.col("line"))).otherwise(F.concat(F.lit("N"), F.col("line") * 7))
    return symbols.where("kind = 'PROMO'").select(F.col("fqn").alias("src"), target.alias("target"), "file").distinct()


_GRAPH = f"""SELECT DISTINCT src, t.fqn AS dst, ['exact', 'import', 'dotted', 'package', 'simple'][t.p] AS how FROM (
    SELECT src, target, min(struct_pack(p := p, fqn := fqn)) AS t FROM (
      SELECT w.src, w.target, b.fqn, 1 AS p FROM ({_WANTED}) w JOIN ({_BOUND}) b ON b.fqn = w.target
      UNION ALL SELECT w.src, w.target, b.fqn, 2 FROM ({_WANTED}) w JOIN imports i ON i.file = w.file AND regexp_extract(i.import, '([^.]*)$', 1) = w.target JOIN ({_BOUND}) b ON b.fqn = i.import
      UNION ALL SELECT src, target, target, 3 FROM ({_WANTED}) WHERE contains(target, '.')
      UNION ALL SELECT w.src, w.target, b.fqn, 4 FROM ({_WANTED}) w JOIN ({_BOUND}) b ON b.fqn = regexp_extract(w.src, '^(.*)[.][^.]*$', 1) || '.' || w.target
      UNION ALL SELECT w.src, w.target, s.fqn, 5 FROM ({_WANTED}) w JOIN (SELECT leaf, min(fqn) AS fqn FROM ({_BOUND}) GROUP BY leaf HAVING count(*) = 1) s ON s.leaf = w.target) GROUP BY src, target)"""


def _injection(symbols, imports):
    return M.injection_graph(_wanted(symbols), symbols.where("visibility <> 'private'"), imports)


@query("gr5_injection_graph", "symbols imports", _GRAPH)
def gr5(symbols, imports):
    return _injection(symbols, imports)


@query("jo31_dead_bindings", "symbols imports", f"SELECT DISTINCT fqn FROM symbols WHERE visibility <> 'private' AND fqn NOT IN (SELECT dst FROM ({_GRAPH}))")
def jo31(symbols, imports):
    return M.dead_bindings(symbols.where("visibility <> 'private'"), _injection(symbols, imports))


@query("se2_merge_resources", "symbols", "SELECT kind, name, coalesce(max(signature) FILTER (WHERE visibility = 'public'), max(signature) FILTER (WHERE visibility = 'internal')) AS value FROM symbols WHERE visibility <> 'private' GROUP BY ALL")
def se2(symbols):
    part = lambda v: symbols.where(F.col("visibility") == v).select("kind", "name", F.col("signature").alias("value"))
    return M.merge_resources(part("internal"), part("public"))


_OWNERS = [("*", ["core"]), ("*.java", ["jvm", "core"]), ("/src/m7/", ["seven"])]
_OWNED = r"CASE WHEN starts_with(path, 'src/m7/') THEN 'seven' WHEN ends_with(path, '.java') THEN 'jvm,core' ELSE 'core' END"


@query("src32_codeowners", "files", f"SELECT path, {_OWNED} AS owners FROM files")
def src32(files):
    return M.owners(files, _OWNERS)


_DIRECT = "SELECT DISTINCT path FROM files WHERE loc < 20"
_TEAMS = f"SELECT unnest(string_split({_OWNED}, ',')) AS team, NULL AS fqn FROM ({_DIRECT}) UNION ALL SELECT unnest(string_split({_OWNED}, ',')), module FROM files WHERE loc > 480"


@query("jo23_suggest_reviewers", "files", f"""
    SELECT t.team, t.score, f.fqn FROM (SELECT team, count(*)::BIGINT AS score FROM ({_TEAMS}) GROUP BY team) t
    LEFT JOIN (SELECT team, fqn FROM (SELECT team, fqn, row_number() OVER (PARTITION BY team ORDER BY count(*) DESC, fqn) AS r FROM ({_TEAMS}) WHERE fqn IS NOT NULL GROUP BY team, fqn) WHERE r = 1) f ON f.team = t.team""")
def jo23(files):
    return M.suggest_reviewers(files.where("loc < 20"), files.where("loc > 480").select("path", F.col("module").alias("fqn")), _OWNERS)


@query("wi8_best_per_team", "files", f"SELECT team, fqn FROM (SELECT team, fqn, row_number() OVER (PARTITION BY team ORDER BY count(*) DESC, fqn) AS r FROM ({_TEAMS}) WHERE fqn IS NOT NULL GROUP BY team, fqn) WHERE r = 1")
def wi8(files):
    return jo23(files).select("team", "fqn")


@query("jo33_migrations", "refs symbols", "SELECT DISTINCT r.file, r.line, r.name AS old, m.new FROM refs r JOIN (SELECT name AS old, min(fqn) AS new FROM symbols WHERE is_override GROUP BY name) m ON m.old = r.name WHERE NOT r.in_comment")
def jo33(refs, symbols):
    mapping = symbols.where("is_override").groupBy(F.col("name").alias("old")).agg(F.min("fqn").alias("new"))
    return M.migrations(refs, mapping)


#: Findings as dead code: the rule's length says which rule, the line what its message says.
_DEAD = """SELECT DISTINCT file, line, has_fix, CASE length(rule) % 3 WHEN 0 THEN 'DeadCode' WHEN 1 THEN 'ModuleDeadCode' ELSE rule END AS rule,
    CASE line % 3 WHEN 0 THEN 'Private function ''' || rule || ''' is unused' WHEN 1 THEN 'Public class ''' || rule || ''' is unused. Consider making it internal.' ELSE message END AS message FROM found"""
_PLANNED = f"""SELECT file, line, kind, name, min(struct_pack(b := reason IS NOT NULL, rule := rule, reason := coalesce(reason, ''))) AS x FROM (
    SELECT file, line, rule, coalesce(nullif(regexp_extract(message, '^[A-Z][a-z]+ ([a-z]+) ''([^'']+)''', 1), ''), 'declaration') AS kind, coalesce(regexp_extract(message, '^[A-Z][a-z]+ ([a-z]+) ''([^'']+)''', 2), '') AS name,
      CASE WHEN rule = 'DeadCode' AND has_fix THEN NULL WHEN rule = 'DeadCode' THEN 'finding has no safe delete fix' WHEN contains(message, 'Consider making it internal.') THEN 'visibility narrowing is not deletion' ELSE 'module-aware dead code is not safely removable yet' END AS reason
    FROM ({_DEAD}) WHERE rule IN ('DeadCode', 'ModuleDeadCode')) GROUP BY ALL"""


def _dead(found):
    n, line = F.length("rule") % 3, F.col("line") % 3
    said = F.when(line == 0, F.concat(F.lit("Private function '"), "rule", F.lit("' is unused"))).when(line == 1, F.concat(F.lit("Public class '"), "rule", F.lit("' is unused. Consider making it internal."))).otherwise(F.col("message"))
    return found.select("file", "line", "has_fix", F.when(n == 0, "DeadCode").when(n == 1, "ModuleDeadCode").otherwise(F.col("rule")).alias("rule"), said.alias("message")).distinct()


@query("ud11_removal_plan", "found", f"SELECT file, line, x.rule AS rule, kind, name, nullif(x.reason, '') AS reason FROM ({_PLANNED})")
def ud11(found):
    return M.removal_plan(_dead(found))


@query("ag32_removal_plan", "found", f"""
    {{rec}}, p AS (SELECT file, kind, nullif(x.reason, '') AS reason FROM ({_PLANNED}))
    SELECT 'declarations' AS what, '' AS name, count(*) AS n FROM p WHERE reason IS NULL HAVING count(*) > 0 UNION ALL SELECT 'kind', kind, count(*) FROM p WHERE reason IS NULL GROUP BY kind
    UNION ALL SELECT 'blocked', '', count(*) FROM p WHERE reason IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'reason', reason, count(*) FROM p WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'files', '', count(DISTINCT file) FROM p WHERE reason IS NULL""")
def ag32(found):
    return M.removal_summary(M.removal_plan(_dead(found)))


@query("jo21_test_coverage", "symbols refs", """
    SELECT DISTINCT t.test, t.target, EXISTS (SELECT 1 FROM refs r WHERE r.file = t.file AND r.name = t.target) AS covered
    FROM (SELECT DISTINCT name || 'Test' AS test, file, name AS target FROM symbols WHERE is_test) t WHERE t.target IN (SELECT name FROM symbols)""")
def jo21(symbols, refs):
    tests = symbols.where("is_test").withColumn("name", F.concat("name", F.lit("Test")))
    return M.test_coverage(symbols.unionByName(tests), refs)


#: Findings' byte ranges stand for syntax nodes: the rule set is the node's type.
_NODES = "SELECT DISTINCT file, (report_id * 1000000 + start_byte)::BIGINT AS id, rule_set AS type, start_byte::BIGINT AS start, (end_byte + line * 3)::BIGINT AS stop FROM found WHERE start_byte IS NOT NULL AND end_byte IS NOT NULL AND line IS NOT NULL"


def _nodes(found):
    return found.where("start_byte IS NOT NULL AND end_byte IS NOT NULL AND line IS NOT NULL").select(
        "file", (F.col("report_id") * 1_000_000 + F.col("start_byte")).cast("bigint").alias("id"), F.col("rule_set").alias("type"), F.col("start_byte").cast("bigint").alias("start"), (F.col("end_byte") + F.col("line") * 3).cast("bigint").alias("stop")
    ).distinct()


@query("pf7_has_ancestor", "found", f"SELECT file, id, type, start, stop FROM ({_NODES}) n WHERE EXISTS (SELECT 1 FROM ({_NODES}) o WHERE o.type IN ('threading', 'lifecycle') AND o.file = n.file AND o.start <= n.start AND n.start < o.stop AND n.stop <= o.stop AND o.id <> n.id)")
def pf7(found):
    return M.ancestors_of(_nodes(found), ["threading", "lifecycle"])


@query("pf8_descendant_counts", "found", f"SELECT r.file, r.id, count(n.id) AS n FROM (SELECT * FROM ({_NODES}) WHERE type = 'threading') r LEFT JOIN ({_NODES}) n ON n.type = 'lifecycle' AND n.file = r.file AND r.start <= n.start AND n.start < r.stop AND n.stop <= r.stop AND n.id <> r.id GROUP BY r.file, r.id, r.start, r.stop")
def pf8(found):
    return M.descendant_counts(_nodes(found), ["threading"], ["lifecycle"])


@query("pf10_smallest_covering", "found", f"SELECT s.file, s.first, s.last, min_by(n.id, struct_pack(a := n.stop - n.start, b := -n.id)) AS id FROM (SELECT DISTINCT file, start + 2 AS first, start + 9 AS last FROM ({_NODES})) s JOIN ({_NODES}) n ON n.file = s.file AND n.start <= s.first AND s.first < n.stop AND s.last <= n.stop GROUP BY ALL")
def pf10(found):
    n = _nodes(found)
    return M.smallest_covering(n, n.select("file", (F.col("start") + 2).alias("first"), (F.col("start") + 9).alias("last")).distinct())


@query("pf6_nodes_of_type", "found", f"SELECT type, count(*) AS n, min(id) AS first FROM ({_NODES}) WHERE type IN ('threading', 'assets', 'clarity') GROUP BY type")
def pf6(found):
    return _nodes(found).where(F.col("type").isin("threading", "assets", "clarity")).groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("pf9_first_child", "found", f"SELECT file, type, min_by(id, struct_pack(a := start, b := id)) AS id FROM ({_NODES}) GROUP BY ALL")
def pf9(found):
    return _nodes(found).groupBy("file", "type").agg(F.min_by("id", F.struct("start", "id")).alias("id"))


#: Rule dimension from the findings: needs and flags follow from the name, the cost from the needs.
_RULES = """SELECT rule, rule_set, CASE len(rule) % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END AS cost, len(rule) % 3 = 0 AS default_on, len(rule) % 11 = 0 AS deprecated, len(rule) % 7 = 0 AS noisy, CASE WHEN len(rule) % 5 = 0 THEN 'experimental' ELSE 'stable' END AS maturity
    FROM (SELECT DISTINCT rule, rule_set FROM found)"""


def _rules(found):
    n = F.length("rule")
    needs = F.when(n % 4 == 0, F.array(F.lit("line-pass"))).when(n % 4 == 1, F.array(F.lit("resolver"), F.lit("oracle:expr-type"))).when(n % 4 == 2, F.array(F.lit("module-index"), F.lit("resolver"))).otherwise(F.array(F.lit("resources")))
    languages = F.when(n % 2 == 0, F.array(F.lit("kotlin"))).otherwise(F.array().cast("array<string>"))
    return found.select("rule", "rule_set").distinct().select(
        "rule", "rule_set", P.derived_cost(needs).alias("cost"), (n % 3 == 0).alias("default_on"), (n % 11 == 0).alias("deprecated"), (n % 7 == 0).alias("noisy"), F.when(n % 5 == 0, "experimental").otherwise("stable").alias("maturity"), needs.alias("needs"), languages.alias("languages")
    )


@query("pf17_active_rules", "found", f"SELECT rule, rule_set FROM ({_RULES}) WHERE CASE WHEN rule = 'leakyscope' THEN false WHEN rule = 'staledrawable' THEN true WHEN deprecated THEN false WHEN noisy THEN false WHEN maturity = 'experimental' THEN true ELSE default_on END")
def pf17(found):
    return _rules(found).where(P.is_active(["leakyscope"], ["staledrawable"], experimental=True, strict=True)).select("rule", "rule_set")


@query("pf18_max_cost", "found", f"SELECT rule, rule_set, cost::INT AS cost FROM ({_RULES}) WHERE cost <= 4")
def pf18(found):
    return P.within_cost(_rules(found), "balanced").select("rule", "rule_set", F.col("cost").cast("int").alias("cost"))


@query("pf19_capabilities", "found", "SELECT DISTINCT rule, rule_set FROM found WHERE len(rule) % 4 = 2")
def pf19(found):
    return _rules(found).where(P.capability_match(["resolver"], ["oracle", "no-such-label"])).select("rule", "rule_set")


@query("pf20_languages", "found", "SELECT DISTINCT rule, rule_set FROM found WHERE len(rule) % 2 = 1")
def pf20(found):
    return P.for_language(_rules(found), "java").select("rule", "rule_set")


@query("pf21_maturity", "found", f"SELECT rule, rule_set FROM ({_RULES}) WHERE maturity = 'experimental'")
def pf21(found):
    return _rules(found).where("maturity = 'experimental'").select("rule", "rule_set")


@query("ud1_run_rules", "symbols refs texts module_edges", None)
def ud1(symbols, refs, texts, module_edges):
    facts = {"symbols": symbols, "refs": refs, "texts": texts, "module_edges": module_edges}
    return P.run([BUILTIN.rules[i] for i in P.run_order(BUILTIN.rules)], facts).groupBy("rule", "rule_set", "severity", "confidence").agg(F.count("*").alias("n"))


@query("ud1b_unused_rule", "symbols refs", """
    SELECT 'UnusedSymbol' AS rule, file, line, start_byte, 'nothing uses ' || fqn AS message, 0.95::DOUBLE AS confidence FROM symbols s
    WHERE NOT is_override AND NOT is_main AND NOT is_test AND visibility <> 'private'
      AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.name IN (s.name, s.fqn) AND r.file <> s.file AND NOT r.in_comment)
      AND (SELECT count(*) FROM refs r WHERE r.name IN (s.name, s.fqn) AND r.file = s.file AND NOT r.in_comment) <= 1""")
def ud1b(symbols, refs):
    return P.run([BUILTIN.rules["UnusedSymbol"]], {"symbols": symbols, "refs": refs}).select("rule", "file", "line", "start_byte", "message", "confidence")


@query("ud_report_order", "found baseline", """
    SELECT rule, CASE severity WHEN 'warning' THEN 'error' ELSE severity END AS severity, count(*) AS n FROM found
    WHERE rule || ':' || file || ':$' || rule || '$' || coalesce(message, '') NOT IN (SELECT id FROM baseline)
      AND rule || ':' || regexp_extract(file, '([^/]*)$', 1) || ':$' || rule || '$' || coalesce(message, '') NOT IN (SELECT id FROM baseline)
      AND coalesce(floor(confidence * 100 + 0.5), 0) >= 80 GROUP BY ALL""")
def ud_report(found, baseline):
    return P.report(found, baseline, warnings_as_errors=True, least_confidence=0.8).groupBy("rule", "severity").agg(F.count("*").alias("n"))

"""Queries over source texts (documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import facts as C
from factloom.operators import text as X
from factloom.operators import trees as R
from factloom.scratch import Scratch
from factloom.queries.standins import fact, with_facts
from factloom.sources.tree import syntax_trees

QUERIES, SQL = {}, {}


def query(name: str, facts: str, sql: str | None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(fact(spark, sf_dir, f) for f in facts.split()))
        if sql:
            SQL[name] = with_facts(facts, sql)
        return fn

    return add


_LINES = r"SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1)::INT AS line_no FROM texts"


def _all(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({column}, '{pattern}', {group})"


@query("src_lines", "texts", f"SELECT doc_id, count(*) AS n, max(line_no)::INT AS last, max(length(line)) AS longest FROM ({_LINES}) GROUP BY doc_id")
def src_lines(texts):
    return X.lines(texts).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.max(F.length("line")).cast("bigint").alias("longest"))


_CODE = r"regexp_replace(text, '(?m)^[ \t]*//.*$', '', 'g')"


@query("ag17_cyclomatic", "texts", rf"SELECT doc_id, greatest(1, len({_all(_CODE, X.DECISION)}) + len({_all(_CODE, chr(92) + 'bfun' + chr(92) + 'b')}))::INT AS cyclomatic FROM texts WHERE source IN ('kotlin_code', 'java_code', 'build_config')")
def ag17(texts):
    return X.cyclomatic(texts.where(F.col("source").isin("kotlin_code", "java_code", "build_config")))


@query("pf1_declarations", "texts", rf"""
    SELECT doc_id, kind, name, CASE WHEN contains(mods, 'private') THEN 'private' WHEN contains(mods, 'internal') THEN 'internal' WHEN contains(mods, 'protected') THEN 'protected' ELSE 'public' END AS visibility,
      contains(mods, 'override') AS is_override, CASE WHEN package = '' THEN name ELSE package || '.' || name END AS fqn
    FROM (SELECT doc_id, regexp_extract(text, '{X.PACKAGE}', 1) AS package, unnest({_all('text', X.DECLARATION, 1)}) AS mods, unnest({_all('text', X.DECLARATION, 2)}) AS kind, unnest({_all('text', X.DECLARATION, 3)}) AS name FROM texts)""")
def pf1(texts):
    return X.declarations(texts)


@query("pf3_references", "texts", rf"SELECT name, in_comment, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, regexp_matches(line, '{X.COMMENT_LINE}') AS in_comment, unnest({_all('line', '[A-Za-z_][0-9A-Za-z_]*')}) AS name FROM ({_LINES})) GROUP BY ALL")
def pf3(texts):
    return X.references(texts).groupBy("name", "in_comment").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("pf4_accessor_references", "texts", rf"""
    SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter([name, CASE WHEN regexp_matches(name, '^(get|set)[A-Z]') THEN lower(substr(name, 4, 1)) || substr(name, 5) WHEN regexp_matches(name, '^is[A-Z]') THEN name END], lambda x: x IS NOT NULL))) AS name
      FROM (SELECT unnest({_all('line', '[A-Za-z_][0-9A-Za-z_]*')}) AS name FROM ({_LINES}))) GROUP BY name""")
def pf4(texts):
    return X.accessor_references(X.references(texts)).groupBy("name").agg(F.count("*").alias("n"))


@query("src_imports", "texts", rf"SELECT doc_id, unnest({_all('text', X.IMPORT, 1)}) AS import FROM texts")
def src_imports(texts):
    return X.imports(texts)


@query("sc9_package_drift", "texts", rf"""
    SELECT doc_id, declared, expected FROM (SELECT doc_id, regexp_extract(text, '{X.PACKAGE}', 1) AS declared,
      replace(regexp_extract(regexp_replace(path, '^(.*/)?src/[^/]+/(kotlin|java)/', ''), '^(.*)/[^/]*$', 1), '/', '.') AS expected FROM texts) WHERE declared <> '' AND expected <> '' AND declared <> expected""")
def sc9(texts):
    return X.package_drift(texts)


@query("src16_project_dependencies", "texts", f"SELECT doc_id, unnest({_all('text', X.PROJECT, 1)}) AS configuration, unnest({_all('text', X.PROJECT, 2)}) AS path FROM texts")
def src16(texts):
    return X.project_dependencies(texts)


@query("src16b_accessor_dependencies", "scripts", f"""
    SELECT doc_id, configuration, array_to_string(list_transform(string_split(accessor, '.'), lambda x: ':' || lower(substr(x, 1, 1) || regexp_replace(substr(x, 2), '(\\p{{Lu}})', '-\\1', 'g'))), '') AS path
    FROM (SELECT doc_id, unnest({_all('text', X.ACCESSOR, 1)}) AS configuration, unnest({_all('text', X.ACCESSOR, 2)}) AS accessor FROM scripts)""")
def src16b(scripts):
    return X.accessor_dependencies(scripts)


@query("src13_library_dependencies", "scripts", f"SELECT doc_id, unnest({_all('text', X.LIBRARY, 1)}) AS configuration, unnest({_all('text', X.LIBRARY, 2)}) AS \"group\", unnest({_all('text', X.LIBRARY, 3)}) AS name, unnest({_all('text', X.LIBRARY, 4)}) AS version FROM scripts")
def src13(scripts):
    return X.library_dependencies(scripts)


@query("src9_xml_references", "scripts", rf"SELECT doc_id, line_no, unnest({_all('line', chr(92) + 'b(?:[a-z][0-9A-Za-z_]*[.])+[A-Z][0-9A-Za-z_]*')}) AS name FROM ({_LINES.replace('FROM texts', 'FROM scripts')}) WHERE doc_id IN (SELECT doc_id FROM scripts WHERE regexp_matches(text, '^\s*<'))")
def src9(scripts):
    return X.xml_class_references(scripts)


@query("src11_resources", "texts", r"""
    SELECT doc_id, unnest(regexp_extract_all(text, p, 1)) AS kind, unnest(regexp_extract_all(text, p, 2)) AS name, unnest(regexp_extract_all(text, p, 3)) AS value
    FROM texts, (SELECT '<(string|color|dimen|item|bool|integer)\s+name="([^"]*)"[^>]*>([^<]*)</' AS p)""".replace("regexp_extract_all(text, p,", "regexp_extract_all(text, '<(string|color|dimen|item|bool|integer)\\s+name=\"([^\"]*)\"[^>]*>([^<]*)</',").split("FROM texts")[0] + "FROM texts")
def src11(texts):
    return X.resources(texts)


#: Pattern rules of the kind a configuration file gives.
RULES = [
    X.PatternRule("TodoComment", "comments", r"\b(TODO|FIXME)\b", "comment asks for work", "info"),
    X.PatternRule("TrailingWhitespace", "style", r"[ \t]+$", "white space at the end of a line", "info"),
    X.PatternRule("MaxLineLength", "style", r"^.{121}", "line of more than 120 characters"),
    X.PatternRule("HardcodedAddress", "security", r"\bhttps?://", "address in code", "warning", skip=r"localhost"),
    X.PatternRule("ForceUnwrap", "potential-bugs", r"!![.]", "forced unwrapping", "error"),
    X.PatternRule("MissingPackage", "naming", r"^import ", "no package at the top of the text", per_line=False),
]


@query("ud5_pattern_rules", "texts", f"SELECT rule, rule_set, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (" + " UNION ALL ".join(
    f"SELECT '{r.rule}' AS rule, '{r.rule_set}' AS rule_set, '{r.severity}' AS severity, doc_id FROM " + (f"({_LINES}) WHERE regexp_matches(line, '{r.pattern}')" + (f" AND NOT regexp_matches(line, '{r.skip}')" if r.skip else "") if r.per_line else f"texts WHERE regexp_matches(text, '{r.pattern}')") for r in RULES) + ") GROUP BY ALL")
def ud5(texts):
    return X.match_patterns(texts, RULES).groupBy("rule", "rule_set", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("ag34_line_metrics", "texts", rf"SELECT doc_id, count(*)::INT AS loc, count(*) FILTER (WHERE regexp_matches(line, '^\s*$'))::INT AS blank, count(*) FILTER (WHERE regexp_matches(line, '{X.COMMENT_LINE}'))::INT AS comments, max(length(line))::INT AS longest, count(*) FILTER (WHERE contains(line, chr(9)))::INT AS tabs FROM ({_LINES}) GROUP BY doc_id")
def ag34(texts):
    return X.line_metrics(texts)


@query("pf28_content_prefilter", "texts", "SELECT doc_id FROM texts WHERE contains(text, 'R.') OR contains(text, 'Context') OR contains(text, 'suspend ')")
def pf28(texts):
    wanted = ["R.", "Context", "suspend "]
    keep = F.col("text").contains(wanted[0])
    for w in wanted[1:]:
        keep = keep | F.col("text").contains(w)
    return texts.where(keep).select("doc_id")


_TEST = " OR ".join(f"contains(replace(path, chr(92), '/'), '{m}')" for m in S.TEST_PATHS)


@query("pf29_test_paths", "texts", f"SELECT doc_id, coalesce({_TEST}, false) AS is_test FROM texts")
def pf29(texts):
    return texts.select("doc_id", S.is_test_path(F.col("path")).alias("is_test"))


@query("src4_excluded_paths", "files", r"SELECT path FROM files WHERE regexp_matches('/' || path, '^/(?:.*/)?[^/]*[.]xml(?:/.*)?$') OR regexp_matches('/' || path, '^/src/m1[^/](?:/.*)?$')")
def src4(files):
    return files.where(S.excluded(F.col("path"), ["*.xml", "src/m1?"])).select("path")


@query("pf32_redact_paths", "files", "SELECT path, array_to_string([CASE WHEN p = '' THEN p ELSE 'h:' || substr(sha256(p), 1, 8) END FOR p IN string_split(path, '/')], '/') AS redacted FROM files")
def pf32(files):
    return files.select("path", S.redact_path(F.col("path")).alias("redacted"))


def _cut(sql: str, sign: str) -> str:
    """SQL of a text up to a sign, unless it starts with it, trimmed."""
    return f"CASE WHEN instr({sql}, '{sign}') > 1 THEN {_trim(f"substr({sql}, 1, instr({sql}, '{sign}') - 1)")} ELSE {sql} END"


def _trim(sql: str) -> str:
    return f"regexp_replace({sql}, '^{S.SPACE}+|{S.SPACE}+$', '', 'g')"


@query("sc6_finding_signature", "texts", f"SELECT {_cut('b', '=')} AS signature, count(*) AS n FROM (SELECT {_cut('a', '{')} AS b FROM (SELECT {_trim('line')} AS a FROM ({_LINES}))) GROUP BY 1".replace("WITH {", "WITH "))
def sc6(texts):
    return X.lines(texts).groupBy(S.finding_signature(F.col("line")).alias("signature")).agg(F.count("*").alias("n"))


@query("sc10_has_token", "texts", r"SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])suspend([^A-Za-z0-9_]|$)') AS word, regexp_matches(text, '(^|[^A-Za-z0-9_])@Composable([^A-Za-z0-9_]|$)') AS mark FROM texts")
def sc10(texts):
    return texts.select("doc_id", S.has_token(F.col("text"), "suspend").alias("word"), S.has_token(F.col("text"), "@Composable").alias("mark"))


@query("sc26_sarif_uri", "texts", "SELECT path, list_aggregate(list_transform(string_split(path, '/'), lambda p: replace(replace(replace(replace(url_encode(p), '%2A', '*'), '~', '%7E'), '%7E', '~'), '+', '%20')), 'string_agg', '/') AS uri FROM (SELECT DISTINCT replace(path, '/', ' a+ü/') || '/' || source AS path FROM texts)")
def sc26(texts):
    path = F.concat(F.replace("path", F.lit("/"), F.lit(" a+ü/")), F.lit("/"), "source")
    return texts.select(path.alias("path")).distinct().select("path", S.sarif_uri(F.col("path")).alias("uri"))


@query("sc22_content_hash", "texts", "SELECT doc_id, sha256(text) AS hash FROM texts")
def sc22(texts):
    return texts.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("ud9_apply_edits", "texts", "SELECT doc_id, CASE WHEN length(text) >= 12 THEN '<<' || substr(text, 4, 5) || '>>' || substr(text, 13) ELSE text END AS text, CASE WHEN length(text) >= 12 THEN 2 ELSE 0 END::INT AS applied FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM texts GROUP BY doc_id HAVING count(*) > 1)")
def ud9(texts):
    # Two edits, and a third that overlaps the later one and so is dropped.
    long = texts.where(F.length("text") >= 12).select("doc_id")
    spans = F.array(*[F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("stop"), F.lit(r).alias("replacement"), F.lit(n).alias("rule")) for a, b, r, n in ((0, 3, "<<", "a"), (8, 12, ">>", "b"), (6, 9, "??", "c"))])
    return X.apply_edits(texts, long.select("doc_id", F.inline(spans)))


def _trees(texts, types=None):
    """Syntax trees of all texts, those of Java sources read as Java."""
    return syntax_trees(texts.withColumn("language", F.when(F.col("source") == "java_code", "java").otherwise("kotlin")), types=types)


def _saved_trees(texts, types):
    """The same written once, for what reads them twice."""
    return Scratch(texts.sparkSession, "trees").save(_trees(texts, types), "nodes")


# No SQL parses these texts; the tests compare with a walk over the trees.


@query("src5_syntax_nodes", "texts", None)
def src5(texts):
    return _trees(texts).groupBy("type").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query("pf1b_tree_declarations", "texts", None)
def pf1b(texts):
    return R.declarations(_trees(texts, R.DECLARED_TYPES)).select("doc_id", "kind", "name", "fqn", "owner", "visibility", "arity", "signature", "is_override", "row")


@query("pf3b_tree_references", "texts", None)
def pf3b(texts):
    return R.references(_trees(texts, R.NAMED_TYPES)).groupBy("name", "kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("pf7b_calls_in_lambdas", "texts", None)
def pf7b(texts):
    return R.with_ancestor(_saved_trees(texts, ["call_expression", "lambda_literal"]), ["lambda_literal"]).where("type = 'call_expression'").groupBy("name").agg(F.count("*").alias("n"))


@query("pf8b_calls_by_function", "texts", None)
def pf8b(texts):
    return R.count_below(_saved_trees(texts, ["function_declaration", "call_expression"]), ["function_declaration"], ["call_expression"])


@query("ag18_function_metrics", "texts", None)
def ag18(texts):
    return R.function_metrics(_trees(texts, R.METRIC_TYPES))


@query("sc14_secrets", "scripts", f"""
    SELECT doc_id, CASE WHEN regexp_matches(b, '^({'|'.join(S.ACCESS_KEYS)})[A-Z0-9]{{16}}$') THEN 'aws' WHEN regexp_matches(b, '^Bearer [^ $]{{16,}}$') AND NOT regexp_matches(lower(b), 'example|dummy|placeholder|changeme|your[-_]') THEN 'bearer' END AS kind, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"]*)"', 1)) AS b FROM scripts) GROUP BY ALL HAVING kind IS NOT NULL""")
def sc14(scripts):
    return X.secrets(scripts)


@query("sc28_plurals", "scripts", r"""SELECT doc_id, regexp_extract(text, '<plurals name="([^"]*)"', 1) AS name, trim(regexp_extract(text, 'quantity="one">([^<]*)<', 1)) AS one, trim(regexp_extract(text, 'quantity="other">([^<]*)<', 1)) AS other FROM scripts""")
def sc28(scripts):
    items = X.resource_groups(scripts).where("kind = 'plurals'")
    return items.select("doc_id", "name", F.element_at("items", "one").alias("one"), F.element_at("items", "other").alias("other"))


@query("pf26_files_to_ask", "texts", "SELECT doc_id FROM texts WHERE contains(text, 'suspend') OR contains(text, ' as ') OR contains(text, '!!')")
def pf26(texts):
    return C.files_to_ask(texts, {"SuspendLeak": ["suspend", ""], "UnsafeCast": [" as ", "!!"], "TreeOnly": []})


@query("ud8_codemod", "texts", None)
def ud8(texts):
    """Throwing calls renamed in all Kotlin texts: edits from their trees, applied."""
    recipe = {"name": "RenameLog", "language": "kotlin", "match": "(call_expression log|println)", "replacement": "logger.info($text)"}
    docs = texts.withColumn("language", F.when(F.col("source") == "java_code", "java").otherwise("kotlin"))
    return X.apply_edits(texts, R.codemod(docs, recipe)).where("applied > 0").select("doc_id", "applied", F.length("text").alias("length"))

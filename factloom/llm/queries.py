"""Queries of the problems for training data: p2, p6, p7, p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paths import plain_path
from factloom.llm.encoding import encode_texts
from factloom.llm.mixing import mix
from factloom.llm.spam_pages import spam_pages
from factloom.llm.term_stats import term_frequencies
from factloom.operators.nested import COMPILER_FACTS, Entity, NestedTables
from factloom.session import table

_DIAGNOSTICS = Entity("file", "files", "package", keyed=True, children=tuple(c for c in COMPILER_FACTS.children if c.tag == "diagnostic"))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, record): a finding delivered twice, alike in all columns, counts once."""
    findings = table(spark, sf_dir, "findings")
    whole = [F.xxhash64(*findings.columns).alias("_a"), F.xxhash64(F.lit(1), *findings.columns).alias("_b")]
    file = plain_path(F.col("file"))
    once = findings.select(file.alias("record"), "rule", "rule_set", *whole).where(F.col("record") != "").distinct()
    of_findings = once.select("record", F.inline(F.array(F.struct(F.lit("rule").alias("field"), F.col("rule").alias("term")), F.struct(F.lit("ruleSet").alias("field"), F.col("rule_set").alias("term")))))
    diagnostics = NestedTables(table(spark, sf_dir, "oracle"), "oracle_id", "payload", "received_at", _DIAGNOSTICS, with_payload=False).links().where("entity = 'diagnostic'")
    of_payloads = diagnostics.select(F.lit("factoryName").alias("field"), F.col("name").alias("term"), F.concat_ws("\0", F.coalesce(F.col("record_id").cast("string"), F.lit("")), "unit").alias("record"))
    return of_findings.select("field", "term", "record").unionByName(of_payloads)


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_occurrences(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in which longer documents of a source are used more, by the logarithm of their length, half as large as it could be."""
    documents = table(spark, sf_dir, "documents").withColumn("importance", F.log2(F.length("text") + 1.0))
    return mix(documents, table(spark, sf_dir, "mix_targets"), fill=0.5, importance="importance")[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_weighted": p7_weighted, "p8_found": p8_found}
SQL: dict[str, str] = {}

_PLAIN = "regexp_replace(replace(file, chr(92), '/'), '^[.]/', '')"
_TERMS = f"""
    WITH d AS (SELECT oracle_id, max_by(payload, received_at) AS p FROM oracle WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' GROUP BY oracle_id),
    fs AS (SELECT oracle_id, json_extract(p, '$.files') AS o FROM d WHERE json_type(p, '$.files') = 'OBJECT'),
    f AS (SELECT oracle_id, key AS file, value AS v FROM fs, json_each(fs.o) WHERE json_type(value) = 'OBJECT'),
    l AS (SELECT oracle_id, file, CASE json_type(v, '$.diagnostics') WHEN 'OBJECT' THEN json_array(json_extract(v, '$.diagnostics')) WHEN 'ARRAY' THEN json_extract(v, '$.diagnostics') END AS l FROM f),
    g AS (SELECT DISTINCT * FROM findings WHERE file IS NOT NULL AND file <> ''),
    o AS (SELECT 'rule' AS field, rule AS term, {_PLAIN} AS record FROM g UNION ALL SELECT 'ruleSet', rule_set, {_PLAIN} FROM g
      UNION ALL SELECT 'factoryName', value->>'$.factoryName', oracle_id || chr(0) || file FROM l, json_each(l.l) WHERE l IS NOT NULL),
    c AS (SELECT field, lower(regexp_replace(term, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) AS term, record FROM o),
    k AS (SELECT * FROM c WHERE term <> ''),
    n AS (SELECT field, term, count(*) AS total, count(DISTINCT record) AS records FROM k GROUP BY ALL),
    b AS (SELECT field, count(DISTINCT record) AS base FROM k GROUP BY field),
    m AS (SELECT field, term, total, records, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.3 * base THEN 'common' END AS mark FROM n JOIN b USING (field))"""
SQL["p2_terms"] = f"{_TERMS} SELECT field, term, total, records, mark FROM m"
SQL["p2_found"] = f"{_TERMS} SELECT field, term, mark FROM m WHERE mark IS NOT NULL"

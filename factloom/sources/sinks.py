"""Sinks: findings as JSON, SARIF, Checkstyle and plain text; baselines; snapshots; keyed caches.

A report is a document per file of findings or per rule set where that is the
format; documents are built by grouped aggregates and never on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.scalars import sarif_uri
from factloom.operators.findings import baseline_id
from factloom.scratch import delete, exists

# SARIF's names of severities.
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def json_lines(findings: DataFrame) -> DataFrame:
    """(value): one JSON object a finding, without null fields."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def json_summary(findings: DataFrame) -> DataFrame:
    """(value): one object with total, byRuleSet and byRule; as many entries as rules."""
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("key", "n")))))
    counts = findings.groupingSets([[F.col("rule_set")], [F.col("rule")], []], F.col("rule_set"), F.col("rule")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = counts.select(F.when(F.col("g") == 1, "ruleSet").when(F.col("g") == 2, "rule").otherwise("all").alias("kind"), F.coalesce("rule_set", "rule", F.lit("")).alias("key"), "n")
    return named.agg(F.to_json(F.struct(F.coalesce(F.max(F.when(F.col("kind") == "all", F.col("n"))), F.lit(0)).alias("total"), by("ruleSet").alias("byRuleSet"), by("rule").alias("byRule"))).alias("value"))


def plain(findings: DataFrame) -> DataFrame:
    """(value): ``file:line:col: severity: message [rule]``."""
    return findings.select(F.format_string("%s:%d:%d: %s: %s [%s]", "file", F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), F.coalesce("severity", F.lit("info")), F.coalesce("message", F.lit("")), "rule").alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(file, value): SARIF 2.1 results, one JSON object a finding."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), F.col("severity")), F.lit("note"))
    place = F.struct(F.struct(F.struct(sarif_uri(F.col("file")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce("col", F.lit(1)), F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    return findings.select("file", F.to_json(F.struct(F.concat_ws("/", "rule_set", "rule").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def _xml(c: str):
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def checkstyle(findings: DataFrame) -> DataFrame:
    """(file, value): one ``<file>`` element a file, its errors by line and column."""
    error = F.concat(F.lit('<error line="'), _xml("line"), F.lit('" column="'), _xml("col"), F.lit('" severity="'), _xml("severity"), F.lit('" message="'), _xml("message"), F.lit('" source="'), _xml("rule"), F.lit('"/>'))
    rows = findings.select("file", F.struct(F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("col", F.lit(0)).alias("c"), error.alias("e")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "")
    return rows.groupBy("file").agg(F.concat(F.lit('<file name="'), F.first(_xml("file")), F.lit('">'), body, F.lit("</file>")).alias("value"))


def baseline_ids(findings: DataFrame) -> DataFrame:
    """(id): a new baseline's ids, sorted, each once."""
    return findings.select(baseline_id().alias("id")).distinct().orderBy("id")


def write_baseline(ids: DataFrame, path: str) -> None:
    """Write (section, id) as one baseline file, JSON by its ending, XML else; ids sorted, each once.

    A baseline is one document, made up of a row for each line in its order;
    the lines are written by one task but never gathered in one value.
    """
    spark = ids.sparkSession
    rows = ids.where("id <> ''").select("section", "id").distinct()
    last = F.lead("id").over(Window.partitionBy("section").orderBy("id")).isNull()
    if path.endswith(".json"):
        quoted = F.regexp_replace(F.to_json(F.struct(F.col("id").alias("x"))), r"^\{\"x\":|\}$", "")
        body = rows.select("section", F.lit(1).alias("at"), "id", F.concat(F.lit("    "), quoted, F.when(last, "").otherwise(",")).alias("value"))
        frame = {"ManuallySuppressedIssues": ('  "manuallySuppressed": [', "  ],"), "CurrentIssues": ('  "currentIssues": [', "  ]")}
        ends = ("{", "}")
    else:
        body = rows.select("section", F.lit(1).alias("at"), "id", F.concat(F.lit("    <ID>"), _xml("id"), F.lit("</ID>")).alias("value"))
        frame = {n: (f"  <{n}>", f"  </{n}>") for n in ("ManuallySuppressedIssues", "CurrentIssues")}
        ends = ("<SmellBaseline>", "</SmellBaseline>")
    marks = [("", 0, "", ends[0])] + [(n, at, "", v) for n, pair in frame.items() for at, v in zip((0, 2), pair)] + [("~", 3, "", ends[1])]
    whole = body.unionByName(spark.createDataFrame(marks, "section string, at int, id string, value string"))
    order = F.when(F.col("section") == "", 0).when(F.col("section") == "ManuallySuppressedIssues", 1).when(F.col("section") == "CurrentIssues", 2).otherwise(3)
    whole.withColumn("o", order).coalesce(1).sortWithinPartitions("o", "at", "id").select("value").write.mode("overwrite").text(path)


def append_metrics(records: DataFrame, path: str) -> None:
    """Append records to a JSONL history, an object a line."""
    records.write.mode("append").json(path)


def sarif_document(findings: DataFrame, tool: str) -> DataFrame:
    """(value): the lines of one SARIF 2.1 document in their order: the run, its rules, its results."""
    rules = findings.groupBy(F.concat_ws("/", "rule_set", "rule").alias("id")).agg(F.count("*").alias("n")).select(F.lit(1).alias("at"), F.col("id").alias("k"), F.to_json(F.struct("id")).alias("v"))
    results = sarif_results(findings).select(F.lit(3).alias("at"), F.col("file").alias("k"), F.col("value").alias("v"))
    rows = rules.unionByName(results)
    comma = F.when(F.lead("at").over(Window.partitionBy("at").orderBy("k", "v")).isNull(), "").otherwise(",")
    body = rows.select("at", "k", "v", F.concat("v", comma).alias("value"))
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"rules":['
    frame = findings.sparkSession.createDataFrame([(0, "", "", head), (2, "", "", ']}},"results":['), (4, "", "", "]}]}")], "at int, k string, v string, value string")
    return body.unionByName(frame).orderBy("at", "k", "v").select("value")


def surface(symbols: DataFrame) -> DataFrame:
    """(value): the API surface, ``kind<TAB>name`` a line, sorted, each once."""
    return symbols.where("visibility = 'public'").select(F.concat_ws("\t", "kind", "name").alias("value")).distinct().orderBy("value")


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("kind string, name string").csv(path)


class SnapshotStore:
    """Snapshots of tables below ``root``, one folder per commit; loading one commit reads its folder only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, commit: str, name: str, df: DataFrame) -> None:
        """Write or replace a table of a commit."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/commit_sha={commit}")

    def load(self, name: str, commit: str | None = None) -> DataFrame:
        all_ = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return all_ if commit is None else all_.where(F.col("commit_sha") == commit)


class KeyedCache:
    """Results by content hash, rule-set hash and kind; a miss is an anti-join.

    Kinds are folders. ``put`` writes only keys that are not held yet, each
    once; ``invalidate`` drops a kind, or all.
    """

    KEY = ["content_hash", "rules_hash", "kind"]

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _all(self, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.root) if exists(self.spark, self.root) else self.spark.createDataFrame([], like.schema)

    def put(self, rows: DataFrame) -> None:
        fresh = rows.dropDuplicates(self.KEY)
        fresh.join(self._all(rows).select(self.KEY), self.KEY, "left_anti").select(rows.columns).write.mode("append").partitionBy("kind").parquet(self.root)

    def invalidate(self, kind: str | None = None) -> None:
        delete(self.spark, self.root if kind is None else f"{self.root}/kind={kind}")

    def get(self, wanted: DataFrame) -> DataFrame:
        """Cached rows of the wanted keys, each once."""
        return self.spark.read.parquet(self.root).join(wanted.select(self.KEY).distinct(), self.KEY, "left_semi").dropDuplicates(self.KEY)

    def misses(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.spark.read.parquet(self.root).select(self.KEY).distinct(), self.KEY, "left_anti")

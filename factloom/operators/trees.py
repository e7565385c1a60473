"""Operators over syntax trees (see ``factloom.sources.tree``): posting lists, ancestors, subtrees, metrics, declarations.

Nodes below a node are those with greater ids up to its ``subtree_end``, so
every question about nesting is a join of ids with intervals of a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.ranges import points_in_intervals
from factloom.sources.tree import COGNITIVE, DECISIONS, DECLARATIONS, NESTING, OPERATORS, parse

#: The node types that each operator below needs.
METRIC_TYPES = DECISIONS | COGNITIVE | NESTING | {*OPERATORS.values(), "function_declaration"}
DECLARED_TYPES = DECLARATIONS | {"package_header"}
NAMED_TYPES = {"call_expression": "call", "type_identifier": "type", "simple_identifier": "name", "annotation": "annotation"}


def nodes_of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def _outer(nodes: DataFrame, types: list[str]) -> DataFrame:
    return nodes_of_type(nodes, *types).select("doc_id", F.col("id").alias("_from"), (F.col("subtree_end") + 1).alias("_to"))


def with_ancestor(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes that lie below a node of the given types, each once."""
    return points_in_intervals(nodes, _outer(nodes, types), "doc_id", "id", "_from", "_to", "left_semi", also=F.col("id") > F.col("_from"))


def count_below(nodes: DataFrame, roots: list[str], counted: list[str]) -> DataFrame:
    """(doc_id, id, n): nodes of the ``counted`` types below each node of the ``roots`` types."""
    outer = _outer(nodes, roots)
    inside = points_in_intervals(nodes_of_type(nodes, *counted).select("doc_id", "id"), outer, "doc_id", "id", "_from", "_to", also=F.col("id") > F.col("_from"))
    n = inside.groupBy("doc_id", "_from").agg(F.count("*").alias("n"))
    return outer.join(n, ["doc_id", "_from"], "left").select("doc_id", F.col("_from").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


def first_child(nodes: DataFrame, *types: str) -> DataFrame:
    """(doc_id, parent, id): the first child of each node, of the given types if any are."""
    kids = nodes.where(F.col("parent").isNotNull())
    return (nodes_of_type(kids, *types) if types else kids).groupBy("doc_id", "parent").agg(F.min("id").alias("id"))


def smallest_covering(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, first, last, id): the smallest node over each byte span, the innermost of equal ones."""
    outer = nodes.select("doc_id", "id", "start", "stop", "depth")
    hits = points_in_intervals(spans, outer, "doc_id", "first", "start", "stop", also=F.col("last") <= F.col("stop"))
    return hits.groupBy("doc_id", "first", "last").agg(F.min_by("id", F.struct(F.col("stop") - F.col("start"), -F.col("depth"))).alias("id"))


def function_metrics(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, name, row, cyclomatic, cognitive, nesting) of each function.

    Functions and lambdas within it count for themselves. One aggregate by
    owner, combined on the map side.
    """
    counts = ~F.col("type").isin("function_declaration", "lambda_literal")
    decisions = F.sum(F.when(F.col("type").isin(*DECISIONS, "elvis_expression"), 1).otherwise(0))
    hard = F.sum(F.when(F.col("type").isin(*COGNITIVE), 1 + F.col("cognitive")).when(F.col("type").isin(*OPERATORS.values()), 1).otherwise(0))
    is_function = F.col("type") == "function_declaration"
    itself = F.max(F.when(is_function, F.struct("name", "row"))).alias("f")
    group = F.when(is_function, F.col("id")).otherwise(F.col("owner"))
    sums = nodes.where(counts | is_function).where(group.isNotNull()).groupBy("doc_id", group.alias("id")).agg(itself, decisions.alias("d"), hard.alias("h"), F.max(F.when(counts, F.col("nesting"))).alias("nesting"))
    found = sums.where(F.col("f").isNotNull())
    return found.select("doc_id", "id", "f.name", "f.row", (1 + F.col("d")).cast("int").alias("cyclomatic"), F.col("h").cast("int").alias("cognitive"), F.coalesce("nesting", F.lit(0)).alias("nesting"))


def declarations(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, kind, name, fqn, owner, visibility, arity, signature, is_override, row) of named declarations that are no locals."""
    # A window over the few nodes of a document that declare something.
    package = F.min_by(F.when(F.col("type") == "package_header", F.col("name")), F.when(F.col("type") == "package_header", F.col("id"))).over(Window.partitionBy("doc_id"))
    kept = nodes_of_type(nodes, *DECLARED_TYPES).where("owner IS NULL").withColumn("package", package)
    full = nodes_of_type(kept, *DECLARATIONS).where("name <> ''").drop("owner")
    has = lambda word: F.array_contains(F.split("modifiers", " "), word)
    visibility = F.when(has("private"), "private").when(has("internal"), "internal").when(has("protected"), "protected").otherwise("public")
    fqn = F.concat_ws(".", F.nullif("package", F.lit("")), F.nullif("scope", F.lit("")), "name")
    return full.select(
        "doc_id", "id", F.regexp_replace("type", "_declaration$", "").alias("kind"), "name", fqn.alias("fqn"), F.concat_ws(".", F.nullif("package", F.lit("")), F.nullif("scope", F.lit(""))).alias("owner"),
        visibility.alias("visibility"), "arity", F.when(F.col("arity").isNotNull(), F.concat("name", F.lit("/"), F.col("arity").cast("string"))).otherwise(F.col("name")).alias("signature"), has("override").alias("is_override"), "row",
    )


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, kind, row): names that are called, used as types or read; those in comments and strings are none."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in NAMED_TYPES.items() for x in p]), F.col("type"))
    return nodes.where(kind.isNotNull() & (F.col("name") != "")).select("doc_id", "name", kind.alias("kind"), "row")


def codemod(docs: DataFrame, recipe: dict[str, str], language: str = "language") -> DataFrame:
    """(doc_id, start, stop, replacement, rule): the edits of a recipe over texts of its language, for ``apply_edits``.

    ``match`` is ``(type)`` or ``(type name)``, the name a regular expression
    for the whole name; ``$name`` in the replacement stands for the node's
    name, ``$text`` for its text. Offsets are in characters. Of nested matches
    the outer one counts, so edits never overlap.
    """
    found = re.fullmatch(r"\(\s*(\w+)(?:\s+(.+?))?\s*\)", recipe["match"].strip())
    if not found:
        raise ValueError("match must be (type) or (type name)")
    wanted, name = found.group(1), found.group(2) and re.compile(found.group(2))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                upto = -1
                for node in parse(text, recipe["language"]) if text else ():
                    if node[2] == wanted and node[0] > upto and (name is None or name.fullmatch(node[3])):
                        upto = node[7]
                        said = recipe["replacement"].replace("$name", node[3]).replace("$text", text[node[4] : node[5]])
                        for column, value in zip(out, (doc, node[4], node[5], said, recipe["name"])):
                            column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "stop", "replacement", "rule"])

    same = docs.where(F.lower(language) == recipe["language"].lower())
    return same.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, stop bigint, replacement string, rule string")

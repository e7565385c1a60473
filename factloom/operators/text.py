"""The text tier: lines, tokens, declarations, imports, metrics and pattern rules over source texts.

Inputs are (doc_id, text); a null text gives no rows. All of it stays in
generated code; only edits that must be applied in sequence run in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import DECISION, accessor_to_path, secret_kind

#: One declaration: modifiers, what it is, its name.
DECLARATION = r"(?m)^[ \t]*((?:(?:public|private|internal|protected|open|abstract|sealed|data|override|suspend|inline|static|final)[ \t]+)*)(class|interface|object|enum|fun|val|var)[ \t]+(?:class[ \t]+)?(\w+)"
IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+(?:\.\*)?)"
PACKAGE = r"(?m)^[ \t]*package[ \t]+([\w.]+)"
#: A dependency on a project of the same build: configuration and path.
PROJECT = r'(\w+)\s*\(\s*project\(\s*"(:[^"]+)"\s*\)\s*\)'
#: The same by an accessor below ``projects``.
ACCESSOR = r"(\w+)\s*\(\s*projects\.(\w+(?:\.\w+)*)\s*\)"
#: A dependency on a library: configuration, group, name, version.
LIBRARY = r'(\w+)\s*\(\s*"([^":]+):([^":]+):([^":]+)"\s*\)'
COMMENT_LINE = r"^\s*(//|\*|/\*)"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line) without line ends."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("_p", "line")).select("doc_id", (F.col("_p") + 1).alias("line_no"), "line")


def is_comment(line: Column) -> Column:
    return line.rlike(COMMENT_LINE)


def cyclomatic(docs: DataFrame) -> DataFrame:
    """(doc_id, cyclomatic): decisions outside ``//`` lines plus functions, at least 1.

    Counted in place, without making rows of the lines.
    """
    code = F.regexp_replace("text", r"(?m)^[ \t]*//.*$", "")
    n = F.regexp_count(code, F.lit(DECISION)) + F.regexp_count(code, F.lit(r"\bfun\b"))
    return docs.where("text IS NOT NULL").select("doc_id", F.greatest(n, F.lit(1)).alias("cyclomatic"))


def declarations(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name, visibility, is_override, fqn) of Kotlin- and Java-like declarations."""
    whole, mods, kinds, names = (F.regexp_extract_all("text", F.lit(DECLARATION), F.lit(i)) for i in range(4))
    rows = docs.select("doc_id", F.regexp_extract("text", PACKAGE, 1).alias("package"), F.inline(F.arrays_zip(mods.alias("mods"), kinds.alias("kind"), names.alias("name"))))
    visibility = F.when(F.col("mods").contains("private"), "private").when(F.col("mods").contains("internal"), "internal").when(F.col("mods").contains("protected"), "protected").otherwise("public")
    fqn = F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name"))
    return rows.select("doc_id", "kind", "name", visibility.alias("visibility"), F.col("mods").contains("override").alias("is_override"), fqn.alias("fqn"))


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, name, in_comment): every identifier of every line."""
    rows = lines(docs).withColumn("in_comment", is_comment(F.col("line")))
    return rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name"), "in_comment")


def accessor_references(refs: DataFrame) -> DataFrame:
    """References and, for getFoo, setFoo and isFoo, the property they stand for."""
    from factloom.functions.scalars import accessor_property

    return refs.withColumn("name", F.explode(F.array_distinct(F.array_compact(F.array(F.col("name"), accessor_property(F.col("name")))))))


def imports(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1))).alias("import"))


def package_drift(docs: DataFrame) -> DataFrame:
    """(doc_id, declared, expected) where a text's package is not that of its path."""
    from factloom.functions.scalars import expected_package

    declared, expected = F.regexp_extract("text", PACKAGE, 1), expected_package(F.col("path"))
    return docs.select("doc_id", declared.alias("declared"), expected.alias("expected")).where("declared <> '' AND expected <> '' AND declared <> expected")


def project_dependencies(docs: DataFrame) -> DataFrame:
    """(doc_id, configuration, path) of project dependencies in build scripts."""
    conf, path = (F.regexp_extract_all("text", F.lit(PROJECT), F.lit(i)) for i in (1, 2))
    return docs.select("doc_id", F.inline(F.arrays_zip(conf.alias("configuration"), path.alias("path"))))


def accessor_dependencies(docs: DataFrame) -> DataFrame:
    """(doc_id, configuration, path) of dependencies by typesafe accessors, each dotted part a part of the path."""
    conf, accessor = (F.regexp_extract_all("text", F.lit(ACCESSOR), F.lit(i)) for i in (1, 2))
    rows = docs.select("doc_id", F.inline(F.arrays_zip(conf.alias("configuration"), accessor.alias("accessor"))))
    parts = F.transform(F.split("accessor", "\\."), lambda part: accessor_to_path(part))
    return rows.select("doc_id", "configuration", F.array_join(parts, "").alias("path"))


def library_dependencies(docs: DataFrame) -> DataFrame:
    parts = [F.regexp_extract_all("text", F.lit(LIBRARY), F.lit(i)).alias(n) for i, n in enumerate(("configuration", "group", "name", "version"), 1)]
    return docs.select("doc_id", F.inline(F.arrays_zip(*parts)))


def xml_class_references(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, name): dotted class names in XML texts."""
    rows = lines(docs.where(F.col("text").rlike(r"^\s*<")))
    return rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\b(?:[a-z]\w*\.)+[A-Z]\w*"), F.lit(0))).alias("name"))


def resources(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name, value) of simple resource elements in XML texts."""
    kind, name, value = (F.regexp_extract_all("text", F.lit(r'<(string|color|dimen|item|bool|integer)\s+name="([^"]*)"[^>]*>([^<]*)</'), F.lit(i)) for i in (1, 2, 3))
    return docs.select("doc_id", F.inline(F.arrays_zip(kind.alias("kind"), name.alias("name"), value.alias("value"))))


@dataclass(frozen=True)
class PatternRule:
    """A rule given by a pattern; ``skip`` is a pattern of matches that do not count."""

    rule: str
    rule_set: str
    pattern: str
    message: str
    severity: str = "warning"
    per_line: bool = True
    skip: str | None = None


def match_patterns(docs: DataFrame, rules: list[PatternRule]) -> DataFrame:
    """Findings (doc_id, line, rule, rule_set, severity, message) of pattern rules, one per matching line (or text).

    All rules are tested in one pass over each line; the rules are
    configuration, so there is no join.
    """

    def hits(rules: list[PatternRule], text: Column) -> Column:
        made = []
        for r in rules:
            on = text.rlike(r.pattern)
            if r.skip:
                on = on & ~text.rlike(r.skip)
            made.append(F.when(on, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.rule_set).alias("rule_set"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))))
        return F.inline(F.array_compact(F.array(*made)))

    out = None
    per_line, whole = [r for r in rules if r.per_line], [r for r in rules if not r.per_line]
    if per_line:
        out = lines(docs).select("doc_id", F.col("line_no").alias("line"), hits(per_line, F.col("line")))
    if whole:
        rows = docs.where("text IS NOT NULL").select("doc_id", F.lit(1).alias("line"), hits(whole, F.col("text")))
        out = rows if out is None else out.unionByName(rows)
    return out


def line_metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, loc, blank, comments, longest, tabs): counts of a text's lines, in place."""
    parts = F.split("text", "\r\n|\n|\r")
    count = lambda f: F.size(F.filter(parts, f))
    return docs.where("text IS NOT NULL").select(
        "doc_id",
        F.size(parts).alias("loc"),
        count(lambda x: x.rlike(r"^\s*$")).alias("blank"),
        count(lambda x: x.rlike(COMMENT_LINE)).alias("comments"),
        F.array_max(F.transform(parts, F.length)).alias("longest"),
        count(lambda x: x.contains("\t")).alias("tabs"),
    )


_EDITED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("applied", pa.int32())])


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, applied) after edits (doc_id, start, stop, replacement, rule) by character offsets.

    Applied from the end on; of overlapping edits the later start wins, then
    the later end, then the rule's name. Edits outside the text are skipped.
    Texts without edits come out unchanged, with 0.
    """
    grouped = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "replacement", "rule")).alias("edits"))
    joined = docs.select(F.col("doc_id").cast("bigint"), "text").join(grouped, "doc_id", "left").select("doc_id", "text", F.coalesce("edits", F.array().cast("array<struct<start:bigint,stop:bigint,replacement:string,rule:string>>")).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, counts = [], [], []
            for doc, text, todo in zip(*(c.to_pylist() for c in batch.columns)):
                n = 0
                if text is not None and todo:
                    kept, tail, end = [], len(text), len(text)
                    for e in sorted(todo, key=lambda e: (-(e["start"] or 0), -(e["stop"] or 0), e["rule"] or "")):
                        start, stop = e["start"], e["stop"]
                        if start is None or stop is None or not 0 <= start <= stop <= end:
                            continue
                        kept.append(text[stop:tail])
                        kept.append(e["replacement"] or "")
                        tail = end = start
                        n += 1
                    kept.append(text[:tail])
                    text = "".join(reversed(kept))
                ids.append(doc)
                texts.append(text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], schema=_EDITED)

    return joined.mapInArrow(run, "doc_id bigint, text string, applied int")


#: A string literal, raw or not, without templates taken apart.
LITERAL = r'"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"'


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, n): string literals that hold a secret, counted by kind."""
    literal = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(0))).alias("literal"))
    n = F.length("literal")
    inside = F.when(F.col("literal").startswith('"""') & (n >= 6), F.substring("literal", F.lit(4), n - 6)).otherwise(F.substring("literal", F.lit(2), n - 2))
    body = F.regexp_replace(inside, r"\\(.)", "$1")
    return literal.select("doc_id", secret_kind(body).alias("kind")).where("kind IS NOT NULL").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def resource_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name, items): plurals by quantity, arrays by position, styles by attribute, of resource files.

    The last of two items with one key wins. Empty groups have no items.
    """
    group = r'(?s)<(plurals|string-array|integer-array|array|style)\s+name="([^"]*)"[^>/]*>(.*?)</\1>'
    kinds, names, bodies = (F.regexp_extract_all("text", F.lit(group), F.lit(i)) for i in (1, 2, 3))
    rows = docs.select("doc_id", F.inline(F.arrays_zip(kinds.alias("kind"), names.alias("name"), bodies.alias("body"))))
    values = F.transform(F.regexp_extract_all("body", F.lit(r"(?s)<item[^>]*>(.*?)</item>"), F.lit(1)), lambda v: F.trim(v))
    keyed = F.regexp_extract_all("body", F.lit(r'<item[^>]*?\s(?:quantity|name)="([^"]*)"'), F.lit(1))
    position = F.transform(F.sequence(F.lit(0), F.size(values)), lambda i: i.cast("string"))
    keys = F.when(F.col("kind").isin("plurals", "style"), keyed).otherwise(F.slice(position, F.lit(1), F.size(values)))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return rows.select("doc_id", "kind", "name", F.map_from_entries(last).alias("items"))

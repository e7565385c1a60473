"""Rules that come with the library, one for each scope of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.references import declaration_fan_in, unused_symbols
from factloom.operators.text import lines
from factloom.plans.rules import Registry

BUILTIN = Registry()


@BUILTIN.rule(id="MaxLineLength", rule_set="style", severity="warning")
def max_line_length(facts: dict[str, DataFrame], most: int = 120) -> DataFrame:
    return lines(facts["texts"]).where(F.length("line") > most).select(F.col("doc_id").cast("string").alias("file"), F.col("line_no").alias("line"), F.lit(f"line of more than {most} characters").alias("message"))


@BUILTIN.rule(id="TrailingWhitespace", rule_set="style", severity="info")
def trailing_whitespace(facts: dict[str, DataFrame]) -> DataFrame:
    return lines(facts["texts"]).where(F.col("line").rlike(r"[ \t]+$")).select(F.col("doc_id").cast("string").alias("file"), F.col("line_no").alias("line"), F.lit("white space at the end of the line").alias("message"))


@BUILTIN.rule(id="UnusedSymbol", rule_set="dead-code", severity="warning", needs=("cross-file",), per_line=False)
def unused(facts: dict[str, DataFrame]) -> DataFrame:
    return unused_symbols(facts["symbols"], facts["refs"]).select("file", "line", "start_byte", F.concat(F.lit("nothing uses "), "fqn").alias("message"))


@BUILTIN.rule(id="FanInHotspot", rule_set="architecture", severity="info", needs=("cross-file",), default_on=False, per_line=False)
def hotspot(facts: dict[str, DataFrame], allowed: int = 80) -> DataFrame:
    return declaration_fan_in(facts["symbols"], facts["refs"], at_least=allowed).select("file", "line", "start_byte", F.format_string("%s is used by %d files", "fqn", "fan_in").alias("message"))


@BUILTIN.rule(id="ModuleCycle", rule_set="architecture", severity="error", needs=("module-index",), per_line=False)
def module_cycle(facts: dict[str, DataFrame]) -> DataFrame:
    from factloom.operators.graph import strong_components

    return strong_components(facts["module_edges"]).select(F.col("node").alias("file"), F.concat(F.lit("in a cycle with "), "component").alias("message"))


@BUILTIN.rule(
    id="LargeFile", rule_set="complexity", severity="info", needs=("aggregate",), default_on=False, per_line=False,
    collect=lambda facts: lines(facts["texts"]).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("line_no").alias("last")),
)
def large_file(facts: dict[str, DataFrame], most: int = 400) -> DataFrame:
    """An aggregate rule: its facts are gathered by file first, combined on the map side."""
    return facts["collected"].where(F.col("lines") > most).select(F.col("doc_id").cast("string").alias("file"), F.col("last").alias("line"), F.format_string("%d lines are hard to keep in mind", "lines").alias("message"))

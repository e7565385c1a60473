"""Rules as named plans over facts, their selection, and running them.

A rule is a function from facts (named DataFrames) to raw hits; running a set
of rules is one union of lazy plans with one action at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalars import LABELS, label_rank
from factloom.operators.findings import min_confidence, ordered, promote_warnings, unsuppressed, with_emit_defaults

FINDING = "file string, line int, col int, start_byte bigint, end_byte bigint, rule_set string, rule string, severity string, message string, confidence double"
# Capabilities a rule may need; those of a prefix can be named together by it.
CAPABILITIES = [
    "resolver", "module-index", "cross-file", "line-pass", "parsed-files", "manifest", "resources", "gradle", "aggregate", "concurrent",
    "oracle:call-targets", "oracle:suspend-markers", "oracle:expr-type", "oracle:expr-annotations", "oracle:supertypes", "oracle:members",
    "oracle:member-signatures", "oracle:class-annotations", "oracle:member-annotations", "oracle:diagnostics", "oracle:library-classes",
]
GROUPS = {"oracle": [c for c in CAPABILITIES if c.startswith("oracle:")]}
COST = {name: rank for rank, name in enumerate(LABELS["cost"], 1)}


def derived_cost(needs: Column, typed: Column | None = None, native: Column | None = None) -> Column:
    """Rank of the cost that a rule's capabilities bring.

    ``native``: it needs compiler helpers of its own; ``typed``: it can't do
    without resolved types.
    """
    some = lambda labels: F.arrays_overlap(needs, F.array(*map(F.lit, labels)))
    flag = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    return (
        F.when(flag(native), COST["fir"])
        .when(some(GROUPS["oracle"]) | flag(typed), COST["oracle"])
        .when(some(["cross-file", "module-index", "parsed-files", "aggregate"]), COST["crossfile"])
        .when(some(["line-pass"]), COST["line"])
        .otherwise(COST["ast"])
    )


@dataclass(frozen=True)
class Rule:
    id: str
    rule_set: str
    severity: str
    check: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ("line-pass",)
    languages: tuple[str, ...] = ()
    default_on: bool = True
    deprecated: bool = False
    noisy: bool = False
    maturity: str = "stable"
    effort: int = 0
    after: tuple[str, ...] = ()
    per_line: bool = True

    #: A label of cost that goes before the one its needs bring.
    declared_cost: str | None = None
    typed: bool = False
    native: bool = False
    #: An aggregate rule: how its facts are gathered by group before the check sees them.
    collect: Callable[[dict[str, DataFrame]], DataFrame] | None = None

    def __post_init__(self) -> None:
        if unknown := [n for n in self.needs if n not in CAPABILITIES]:
            raise ValueError(f"unknown capabilities {unknown}")


@dataclass
class Registry:
    rules: dict[str, Rule] = field(default_factory=dict)

    def rule(self, **spec) -> Callable:
        """Decorator that registers a check."""

        def add(check):
            self.register(Rule(check=check, **spec))
            return check

        return add

    def register(self, rule: Rule) -> None:
        if rule.id in self.rules:
            raise ValueError(f"rule {rule.id} is registered twice")
        self.rules[rule.id] = rule

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as a dimension table."""
        rows = [(r.id, r.rule_set, r.severity, list(r.needs), list(r.languages), r.default_on, r.deprecated, r.noisy, r.maturity, r.effort, r.declared_cost, r.typed, r.native) for r in self.rules.values()]
        table = spark.createDataFrame(rows, "rule string, rule_set string, severity string, needs array<string>, languages array<string>, default_on boolean, deprecated boolean, noisy boolean, maturity string, effort int, declared_cost string, typed boolean, native boolean")
        cost = F.coalesce(label_rank("cost", F.col("declared_cost")), derived_cost(F.col("needs"), F.col("typed"), F.col("native")))
        return table.withColumn("cost", cost).drop("declared_cost", "typed", "native")


def is_active(disabled: Iterable[str] = (), enabled: Iterable[str] = (), all_rules: bool = False, experimental: bool = False, strict: bool = False) -> Column:
    """Whether a row of the rule table is active.

    In this order: disabled no, enabled yes, deprecated no, noisy under strict
    no, all rules yes, experimental yes where asked for, else the default.
    """
    rule = F.col("rule")
    return (
        F.when(rule.isin(list(disabled)), False)
        .when(rule.isin(list(enabled)), True)
        .when(F.col("deprecated"), False)
        .when(F.lit(strict) & F.col("noisy"), False)
        .when(F.lit(all_rules), True)
        .when(F.lit(experimental) & (F.col("maturity") == "experimental"), True)
        .otherwise(F.col("default_on"))
    )


def capability_match(require: list[str], exclude: list[str]) -> Column:
    """Rules that need all of ``require`` and none of ``exclude``.

    The name of a group stands for any of its capabilities. An unknown label
    to require rejects all rules, one to exclude is ignored.
    """
    members = lambda label: GROUPS.get(label) or ([label] if label in CAPABILITIES else [])
    some = lambda labels: F.arrays_overlap("needs", F.array(*map(F.lit, labels)).cast("array<string>"))
    if any(not members(r) for r in require):
        return F.lit(False)
    return reduce(and_, (some(members(r)) for r in require), F.lit(True)) & ~some([m for e in exclude for m in members(e)])


def for_language(rules: DataFrame, language: str) -> DataFrame:
    """Rules for a language; a rule without languages is for all."""
    return rules.where((F.size("languages") == 0) | F.array_contains("languages", language))


def within_cost(rules: DataFrame, most: str | None) -> DataFrame:
    """Rules whose cost is at most the labelled one; all without a label."""
    return rules if most is None else rules.where(F.col("cost") <= label_rank("cost", F.lit(most)))


def run_order(rules: dict[str, Rule]) -> list[str]:
    """Rule ids so that each comes after those it names; ties by id. A circle is an error."""
    left, out = {i: {a for a in r.after if a in rules} for i, r in rules.items()}, []
    while left:
        free = sorted(i for i, wait in left.items() if not wait)
        if not free:
            raise ValueError(f"rules wait for each other: {sorted(left)}")
        out += free
        left = {i: wait - set(free) for i, wait in left.items() if i not in free}
    return out


def run(rules: Iterable[Rule], facts: dict[str, DataFrame], suppressions: DataFrame | None = None) -> DataFrame:
    """Findings of the rules over the facts; suppression is applied once, over the union."""
    spark = next(iter(facts.values())).sparkSession
    parts = []
    for r in rules:
        seen = facts if r.collect is None else facts | {"collected": r.collect(facts)}
        hits = with_emit_defaults(r.check(seen), r.id, r.rule_set, r.severity, r.per_line)
        fields = spark.createDataFrame([], FINDING).schema
        parts.append(hits.select(*[(F.col(f.name) if f.name in hits.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]))
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FINDING)
    return out if suppressions is None else unsuppressed(out, suppressions)


def report(findings: DataFrame, baseline: DataFrame | None = None, changed_files: DataFrame | None = None, warnings_as_errors: bool = False, least_confidence: float = 0.0) -> DataFrame:
    """Findings as they are reported: baseline, changed files, promotion, confidence, then order."""
    from factloom.operators.findings import in_files, not_in_baseline

    if baseline is not None:
        findings = not_in_baseline(findings, baseline)
    if changed_files is not None:
        findings = in_files(findings, changed_files)
    if warnings_as_errors:
        findings = promote_warnings(findings)
    return ordered(min_confidence(findings, least_confidence))

"""Semantics that are easy to get wrong, each as a small case."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import scalars as S
from factloom.operators import findings as A
from factloom.operators import graph as G
from factloom.operators import history as H
from factloom.operators import references as R
from factloom.operators import traces as T
from factloom.operators.ranges import innermost, points_in_intervals
from factloom.operators.windows import blocked_lag
from factloom.operators.text import apply_edits, cyclomatic
from factloom.plans.builtin_rules import BUILTIN
from factloom.plans import rules as P

SYMBOL = "name string, fqn string, kind string, visibility string, file string, line int, start_byte bigint, is_override boolean, is_test boolean, is_main boolean, module string"
REF = "name string, file string, line int, in_comment boolean, start_byte bigint, module string, is_test boolean"


def symbol(name, file, fqn=None, visibility="public", line=1, **flags):
    return (name, fqn or f"p.{name}", "class", visibility, file, line, line * 10, flags.get("override", False), flags.get("test", False), flags.get("main", False), ":m")


def ref(name, file, comment=False, line=5, test=False):
    return (name, file, line, comment, 0, ":m", test)


def make(spark, symbols, refs):
    return spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(refs, REF)


def test_fan_in_excludes_the_first_file_of_a_name_or_each_rows_own(spark, rows):
    s, r = make(spark, [symbol("A", "f1"), symbol("A", "f2", fqn="q.A")], [ref("A", "f1"), ref("A", "f2"), ref("A", "f3"), ref("A", "f3")])
    assert rows(R.symbol_fan_in(s, r), "name", "decl_file", "fan_in") == [("A", "f1", 2)]
    assert rows(R.declaration_fan_in(s, r), "fqn", "file", "fan_in") == [("p.A", "f1", 2), ("q.A", "f2", 2)]


def test_thresholds_strict_and_inclusive(spark):
    s, r = make(spark, [symbol("A", "f1")], [ref("A", "f2"), ref("A", "f3")])
    assert R.hotspots(s, r, 2).count() == 0 and R.hotspots(s, r, 1).count() == 1
    assert R.declaration_fan_in(s, r, at_least=2).count() == 1


def test_unused_counts_the_declaration_and_both_names(spark, rows):
    symbols = [symbol("Used", "f1"), symbol("Once", "f1"), symbol("Twice", "f1"), symbol("ByFqn", "f1"), symbol("Comment", "f1"), symbol("Private", "f1", visibility="private"), symbol("Over", "f1", override=True), symbol("Same", "f1", fqn="Same")]
    refs = [ref("Used", "f2"), ref("Once", "f1"), ref("Twice", "f1"), ref("p.Twice", "f1"), ref("p.ByFqn", "f3"), ref("Comment", "f2", comment=True)]
    assert rows(R.unused_symbols(*make(spark, symbols, refs)), "name") == [("Comment",), ("Once",), ("Same",)]
    empty = make(spark, [], [])
    assert R.unused_symbols(*empty).count() == 0 and R.symbol_fan_in(*empty).count() == 0


def test_types_resolve_by_priority(spark, rows):
    s, _ = make(spark, [symbol("A", "f", fqn="x.A"), symbol("A", "g", fqn="y.A"), symbol("B", "f", fqn="x.B")], [])
    imports = spark.createDataFrame([("f1", "gone.A"), ("f2", "y.*")], "file string, import string")
    wanted = spark.createDataFrame([("f1", "A"), ("f2", "A"), ("f3", "A"), ("f3", "z.B"), ("f3", "No")], "file string, name string")
    assert rows(R.resolve_types(wanted, s, imports)) == [("f1", "A", "gone.A", "import"), ("f2", "A", "y.A", "wildcard"), ("f3", "A", "x.A", "name"), ("f3", "A", "y.A", "name"), ("f3", "z.B", "z.B", "dotted")]


FOUND = "file string, line int, col int, start_byte int, end_byte int, rule_set string, rule string, severity string, message string, confidence double"


def found(spark, *data):
    return spark.createDataFrame([(f, 1, 1, at, at + 1, "set", rule, "warning", "m", c) for f, at, rule, c in data], FOUND)


def test_confidence_is_compared_in_whole_per_cents(spark):
    f = found(spark, ("f", 1, "r", 0.0), ("f", 1, "r", 0.495), ("f", 1, "r", 0.5), ("f", 1, "r", 1.0), ("f", 1, "r", None))
    assert [A.min_confidence(f, x).count() for x in (0, 0.5, 0.495, 0.51, 1.0)] == [5, 3, 3, 1, 1]


def test_suppression_is_half_open_and_nests(spark, rows):
    f = found(spark, ("f", 9, "r", 1.0), ("f", 10, "r", 1.0), ("f", 19, "q", 1.0), ("f", 20, "r", 1.0), ("g", 12, "r", 1.0), ("f", 15, "alias-of", 1.0))
    spans = spark.createDataFrame([("f", 10, 20, "r"), ("f", 12, 18, "other"), ("f", 0, 100_000, "set.q"), ("f", 15, 15, "all"), ("f", 14, 16, "nick")], "file string, start_byte bigint, end_byte bigint, rule string")
    aliases = spark.createDataFrame([("nick", "alias-of")], "alias string, rule string")
    assert rows(A.unsuppressed(f, spans, aliases), "file", "start_byte") == [("f", 20), ("f", 9), ("g", 12)]


def test_intervals_over_bins(spark, rows):
    points = spark.createDataFrame([("k", 4095, 1), ("k", 4096, 2), ("k", None, 3), (None, 1, 4)], "key string, at bigint, id int")
    spans = spark.createDataFrame([("k", 0, 4096, "low"), ("k", 4000, 9000, "mid"), ("k", 4096, 4097, "one"), ("k", 7, 7, "empty")], "key string, s bigint, e bigint, name string")
    assert rows(points_in_intervals(points, spans, "key", "at", "s", "e"), "id", "name") == [(1, "low"), (1, "mid"), (2, "mid"), (2, "one")]
    assert rows(points_in_intervals(points, spans, "key", "at", "s", "e", "left_anti"), "id") == [(3,), (4,)]
    assert rows(innermost(points, spans, "key", "at", "s", "e", "name", ["id"])) == [(1, "low"), (2, "one")]


def test_baselines_survive_moves_and_bare_names(spark):
    f = found(spark, ("a/b.kt", 1, "r", 1.0), ("c.kt", 1, "q", 1.0))
    ids = spark.createDataFrame([("r:b.kt:$r$m",), (None,), ("q:c.kt:$q$m",), ("q:c.kt:$q$m",)], "id string")
    assert A.not_in_baseline(f, ids).count() == 0
    assert A.not_in_baseline(f, ids.limit(0)).count() == 2


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_components_drop_singletons_but_injection_keeps_self_use(spark, rows):
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("a", "c"), ("a", "b"), (None, "a"))
    assert rows(G.strong_components(e)) == [("a", "a"), ("b", "a"), ("d", "d"), ("e", "d"), ("f", "d")]
    hard = e.withColumn("deferred", F.col("src") == "e")
    assert rows(G.injection_cycles(hard)) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert G.strong_components(edges(spark, ("a", "b"))).count() == 0
    assert rows(G.degrees(e, spark.createDataFrame([("a",), ("lonely",)], "node string"))) == [("a", 2, 3), ("lonely", 0, 0)]


def test_reachability_and_closure(spark, rows):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"))
    assert rows(G.reachable(e, spark.createDataFrame([("a",), (None,)], "node string"))) == [("a", 0), ("b", 1), ("c", 2)]
    assert G.closure(e).count() == 10


def test_layers_deny_what_is_not_listed(spark, rows):
    layers = spark.createDataFrame([("a", "ui"), ("b", "data"), ("c", None), ("d", "ui")], "path string, layer string")
    allowed = spark.createDataFrame([("data", "ui")], "src_layer string, dst_layer string")
    assert rows(G.layer_violations(edges(spark, ("a", "b"), ("b", "a"), ("a", "c"), ("a", "d")), layers, allowed), "src", "dst") == [("a", "b")]


def test_bags_and_sets_differ(spark, rows):
    a, b = (spark.createDataFrame(x, "k string") for x in ([("x",), ("x",), ("y",)], [("y",), ("z",), (None,)]))
    assert rows(H.bag_diff(a, b, ["k"])) == [("x", "removed"), ("x", "removed"), ("z", "added"), (None, "added")]
    assert rows(H.set_diff(a, b, ["k"])) == [("x", "removed"), ("z", "added"), (None, "added")]


def test_gate_skips_what_is_absent_and_is_infinite_from_zero(spark, rows):
    before = spark.createDataFrame([("m", "a", 10), ("m", "z", 0)], "module string, metric string, n int")
    after = spark.createDataFrame([("m", "a", 15), ("m", "b", 2), ("m", "z", 0)], "module string, metric string, n int")
    diff = H.metric_diff(before, after, ["module", "metric"], "n")
    assert rows(diff) == [("m", "a", 10, 15, 5), ("m", "b", 0, 2, 2)]
    bounds = spark.createDataFrame([("m", "a", 15.0, 4.0, 50.0), ("*", "b", None, None, 1e9), ("m", "gone", 0.0, 0.0, 0.0)], "module string, metric string, max_absolute double, max_increase double, max_increase_pct double")
    assert rows(H.gate(diff, bounds), "metric", "constraint", "value") == [("a", "increase", 5.0), ("b", "increase_pct", float("inf"))]


def test_lower_percentile_is_by_index(spark, rows):
    df = spark.createDataFrame([("g", v) for v in (4, 1, 3, 2, None)], "k string, v int")
    assert [rows(H.lower_percentile(df, ["k"], "v", p))[0][1] for p in (0.0, 0.5, 0.95, 1.0)] == [1, 2, 3, 4]


def test_cache_eviction_only_beyond_the_cap(spark, rows):
    df = spark.createDataFrame([(f"k{i}", 10, f"2026-01-01 0{i}:00:00") for i in range(5)], "key string, bytes int, used_at string").withColumn("used_at", F.to_timestamp("used_at"))
    assert H.lru_evict(df, 50).count() == 0
    assert rows(H.lru_evict(df, 40), "key") == [("k0",), ("k1",)]


def event(source, pos, ts, *frames, role=""):
    return (source, pos, ts, list(frames), role)


def test_transitions_do_not_cross_sources_and_times_of_zero_do_not_widen(spark):
    e = spark.createDataFrame([event("s", 1, 0, "a"), event("s", 2, 50, "b"), event("s", 3, 10, "a"), event("t", 1, -5, "b"), event("t", 2, 7), event("t", 3, 9, "b")], "source_id string, pos int, timestamp_ns bigint, frames array<string>, role string")
    states = {r.top: r for r in T.reduce_states(e).collect()}
    assert (states["a"].n, states["a"].first_ns, states["a"].last_ns) == (2, 10, 10)
    assert (states["b"].n, states["b"].first_ns, states["b"].last_ns, states["b"].sources) == (3, 9, 50, 2)
    assert T.transitions(e).agg(F.sum("n")).first()[0] == 2
    assert {r.role for r in states.values()} == {""}


def test_lag_over_blocks_equals_the_plain_one(spark, rows):
    df = spark.createDataFrame([(k, i * i % 101, str(i % 7)) for k in ("a", "b") for i in range(11)] + [("c", None, "x"), (None, 3, "y")], "k string, pos int, v string").dropDuplicates(["k", "pos"])
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("pos")))
    for width in (1, 10, 1000):
        assert rows(blocked_lag(df, ["k"], "pos", "v", "p", width), "k", "pos", "v", "p") == rows(plain, "k", "pos", "v", "p")


def test_caller_chain_uses_four_frames_below_the_top(spark):
    df = spark.createDataFrame([(["t", "1", "2", "3", "4", "5"],), (["t", "1", "2", "3", "4", "other"],), (["t"],), ([],)], "f array<string>")
    a, b, none, empty = [r[0] for r in df.select(S.caller_chain_hash(F.col("f"))).collect()]
    assert a == b and len(a) == 16 and none == "" and empty == ""


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(S.normalize_signature(lit(" \x1b[31mFail\x1b[0m at 0xAF after 1234  ms "))) == "fail at <addr> after <n> ms"
    assert get(S.suffix_similarity(lit("a.b.C"), lit("x.b.C"))) == pytest.approx(2 / 3)
    assert get(S.suffix_similarity(lit("C"), lit("C"))) == 1.0 and get(S.suffix_similarity(lit(""), lit("C"))) == 0.0
    assert get(S.accessor_property(lit("getFooBar"))) == "fooBar" and get(S.accessor_property(lit("isOn"))) == "isOn" and get(S.accessor_property(lit("get"))) is None
    for accessor, path in (("circuitRuntime", ":circuit-runtime"), ("backstack", ":backstack"), ("circuitRuntimeUi", ":circuit-runtime-ui"), ("app", ":app"), ("", ":"), ("fooBARBaz", ":foo-b-a-r-baz"), ("Über", ":über")):
        assert get(S.accessor_to_path(lit(accessor))) == path, accessor
    for text, token, yes in (("foo", "foo", True), (" foo ", "foo", True), ("myfoo", "foo", False), ("foobar", "foo", False), ("foo1", "foo", False), ("foo_bar", "foo", False), ("foo.bar()", "foo", True), ("myfoo, foo", "foo", True), ("anything", "", False), ("", "foo", False), ("a.b.c", "a.b", True), ("xa.bc", "a.b", False), ("class A @Inject constructor", "@Inject", True), ("éfoo", "foo", True)):
        assert get(S.has_token(lit(text), token)) is yes, (text, token)
    for line, signature in (("fun calculate(x: Int) {", "fun calculate(x: Int)"), ("val x = 42", "val x"), ("{ a = b }", "{ a"), ("= 3", "= 3"), ("  a  {  b = c", "a"), ("{ x", "{ x"), ("\u00a0\tx\u2003", "x"), ("", "")):
        assert get(S.finding_signature(lit(line))) == signature, line
    for path, yes in (("a/src/test/kotlin/A.kt", True), ("a/jvmTest/A.kt", True), ("a/src/main/A.kt", False), ("test/A.kt", False), ("a\\androidTest\\A.kt", True), ("a/latest/A.kt", False), ("x/sharedTest/y", True)):
        assert get(S.is_test_path(lit(path))) is yes, path
    assert get(S.is_test_path(lit("a/it/B.kt"), also=[" /it/ "])) and not get(S.is_test_path(lit("a/test/B.kt"), instead=["/it/"]))
    assert get(S.is_test_path(lit(None).cast("string"))) is False
    assert get(S.expected_package(lit("m/src/main/kotlin/a/b/C.kt"))) == "a.b"
    assert get(S.redact_path(S.redact_path(lit("a//b")))) == get(S.redact_path(lit("a//b")))
    assert get(S.parse_since(lit("2026-01-02"))) is not None and get(S.parse_since(lit("soon"))) is None
    assert get(S.string_body(lit('"""a"b"""'))) == 'a"b' and get(S.density_factor(lit("xhdpi"))) == 2.0
    assert get(S.density_factor(lit("tvdpi?"))) == 0.0 and get(S.density_factor(lit(None).cast("string"))) == 0.0
    assert [get(F.unix_micros(S.parse_since(lit(f"2026-01-02T03:04:05{x}")))) % 10**6 for x in ("Z", ".5Z", ".123456+01:00")] == [0, 500_000, 123_456]
    assert get(S.placeholder_secret(lit("your-key-here"))) and not get(S.placeholder_secret(lit("AKIA123")))
    assert [get(S.label_rank("cost", lit(x))) for x in ("trivial", "line", "AST", "cross-file", "oracle", "FIR", "fast", "balanced", "thorough", "free")] == [1, 2, 3, 4, 5, 6, 3, 4, 6, None]
    assert [get(S.label_rank("effort", lit(x))) for x in ("trivial", "local", "refactor", "architectural", "small")] == [1, 2, 3, 4, None]
    assert [get(S.label_rank("precision", lit(x))) for x in ("heuristic/text-backed", "ast-backed", "project-structure-aware", "type-aware", "policy", "")] == [1, 2, 3, 4, 5, None]
    for glob, path, yes in (("*.kt", "a/b.kt", True), ("/a/*", "a/b.kt", True), ("/a/*", "x/a/b.kt", False), ("docs/", "x/docs/y", True), ("a/**/z.kt", "a/z.kt", True), ("a/**/z.kt", "a/b/c/z.kt", True), ("?.kt", "ab.kt", False)):
        assert get(S.excluded(lit(path), [glob])) is yes, glob


def test_edits_overlap_and_bounds(spark, rows):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, None), (3, "x")], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, 0, 1, "A", "r"), (1, 4, 6, "", "r"), (1, 5, 7, "Z", "q"), (1, 7, 99, "!", "r"), (1, None, 2, "n", "r"), (2, 0, 1, "x", "r")], "doc_id bigint, start bigint, stop bigint, replacement string, rule string")
    assert rows(apply_edits(docs, edits)) == [(1, "AbcdeZh", 2), (2, None, 0), (3, "x", 0)]
    assert rows(cyclomatic(docs)) == [(1, 1), (3, 1)]


def test_rule_selection_order_and_running(spark, rows):
    registry = P.Registry()

    @registry.rule(id="B", rule_set="s", severity="error", after=("A",), needs=("cross-file",))
    def b(facts):
        return facts["x"].select("file", F.lit(0.1).alias("confidence"))

    @registry.rule(id="A", rule_set="s", severity="info", deprecated=True)
    def a(facts):
        return facts["x"].select("file")

    assert P.run_order(registry.rules) == ["A", "B"]
    with pytest.raises(ValueError):
        registry.register(registry.rules["A"])
    with pytest.raises(ValueError):
        P.run_order({"X": P.Rule("X", "s", "info", a, after=("Y",)), "Y": P.Rule("Y", "s", "info", a, after=("X",))})
    out = P.run(registry.rules.values(), {"x": spark.createDataFrame([("f",)], "file string")})
    assert rows(out, "rule", "severity", "confidence") == [("A", "info", 0.75), ("B", "error", 0.1)]
    table = registry.table(spark)
    assert rows(table.where(P.is_active()), "rule") == [("B",)]
    assert rows(table.where(P.is_active(enabled=["A"], disabled=["B"])), "rule") == [("A",)]
    assert rows(table.where(P.capability_match(["cross-file"], [])), "rule") == [("B",)] and table.where(P.capability_match(["?"], [])).count() == 0
    assert rows(P.within_cost(table, "line"), "rule") == [("A",)] and P.within_cost(table, None).count() == 2


def test_costs_and_capabilities(spark, rows):
    check = lambda facts: facts["x"]
    needs = {"line": ("line-pass",), "node": (), "manifest": ("manifest", "resources", "gradle"), "wide": ("cross-file", "line-pass"), "sum": ("aggregate",), "oracle": ("oracle:members", "cross-file"), "typed": ("resolver",), "own": ("line-pass",), "said": ("oracle:members",)}
    registry = P.Registry()
    for name, n in needs.items():
        registry.register(P.Rule(name, "s", "info", check, needs=n, typed=name == "typed", native=name == "own", declared_cost="trivial" if name == "said" else None))
    table = registry.table(spark)
    assert dict(rows(table, "rule", "cost")) == {"line": 2, "node": 3, "manifest": 3, "wide": 4, "sum": 4, "oracle": 5, "typed": 5, "own": 6, "said": 1}
    assert rows(P.within_cost(table, "fast"), "rule") == [("line",), ("manifest",), ("node",), ("said",)]
    assert rows(table.where(P.capability_match(["oracle"], [])), "rule") == [("oracle",), ("said",)]
    assert rows(table.where(P.capability_match(["cross-file"], ["oracle", "?"])), "rule") == [("wide",)]
    assert table.where(P.capability_match(["nodes"], [])).count() == 0
    assert len(P.CAPABILITIES) == 21 and len(P.GROUPS["oracle"]) == 11
    with pytest.raises(ValueError):
        P.Rule("x", "s", "info", check, needs=("nodes",))


def test_an_aggregate_rule_sees_its_facts_gathered(spark, rows):
    texts = spark.createDataFrame([(1, "a\n" * 500), (2, "a\nb")], "doc_id bigint, text string")
    assert rows(P.run([BUILTIN.rules["LargeFile"]], {"texts": texts}), "rule", "file") == [("LargeFile", "1")]


def test_snapshots_are_kept_to_the_microsecond(spark, rows):
    at = lambda days, us=0: dt.datetime(2026, 3, 31) - dt.timedelta(days=days, microseconds=us)
    data = [(1, at(400), "permanent"), (2, at(30), "ref"), (3, at(30, 1), "ref"), (4, at(30) - dt.timedelta(hours=23), "ref"), (5, at(7), "orphan"), (6, at(7, 1), "orphan")]
    kept = H.retention(spark.createDataFrame(data, "snapshot_id int, captured_at timestamp_ntz, reach string"), F.lit("2026-03-31 00:00:00"))
    assert rows(kept) == [(1, True), (2, True), (3, False), (4, False), (5, True), (6, False)]


def test_fused_signals(spark, rows):
    data = [("c", "m", "stack"), ("c", "m", "diff"), ("c", "m", "diff"), ("c", "n", "history"), ("c", "", "stack"), ("c", None, "stack"), ("d", "m", "owner"), ("d", "m", "diff"), ("d", "m", "history"), ("d", "m", "stack")]
    got = H.bisect_fusion(spark.createDataFrame(data, "commit_sha string, module string, tier string"))
    assert [(r[0], r[1], round(r[2], 6)) for r in rows(got, "commit_sha", "module", "confidence")] == [("c", "m", round(0.95 + 0.05 / 3, 6)), ("c", "n", 0.5), ("d", "m", 1.0)]


def test_every_lineitem_gives_a_module_edge(spark):
    from factloom.queries.standins import fact
    from tests.compare import SMALL

    n = spark.read.parquet(f"{SMALL}/supplier.parquet").count()
    ends = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("l_suppkey AS a", f"l_partkey % {n} AS b").distinct().collect()
    edges = {(r.src, r.dst) for r in fact(spark, SMALL, "module_edges").collect()}
    assert edges == {(f":m{x}", f":m{y}") for r in ends for x, y in [sorted((r.a, r.b), key=lambda k: k % 5) if r.a % 5 != r.b % 5 else (r.a, r.b)]}
    assert len({e for e, _ in edges} | {e for _, e in edges}) == n


def test_names_and_files_grow_with_the_tables(spark):
    from factloom.queries.standins import FACTS

    def counts(parts, orders):
        tables = {"part": spark.range(parts).selectExpr("id AS p_partkey", "1 AS p_size", "'' AS p_type", "'' AS p_name", "'' AS p_brand"), "orders": spark.range(orders).selectExpr("id AS o_orderkey"), "supplier": spark.range(parts // 20),
                  "lineitem": spark.range(orders).selectExpr("id AS l_orderkey", f"id % {parts} AS l_partkey", "0 AS l_suppkey", "1 AS l_linenumber", "'N' AS l_returnflag")}
        out = []
        for fact, keys in (("symbols", ("name", "file", "module")), ("refs", ("name", "file"))):
            sql = FACTS[fact]
            for t in tables:
                sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
            df = spark.sql(sql, **{t: d for t, d in tables.items() if f"{{{t}}}" in sql})
            out += [df.select(k).distinct().count() for k in keys]
        return out

    assert counts(2000, 15000) == [700, 300, 100, 650, 300]
    assert counts(4000, 30000) == [1400, 600, 200, 1300, 600]


def test_every_lineitem_gives_an_import(spark):
    from factloom.queries.standins import fact
    from tests.compare import SMALL

    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    late = {(f"f{r.l_orderkey % 300}", f"dev.p{r.l_suppkey % 50 + 1}.N{r.l_partkey % 650}") for r in lines.where("l_linenumber >= 4").collect()}
    assert late and late <= {(r.file, r[1]) for r in fact(spark, SMALL, "imports").collect()}


def test_percentiles_of_skewed_groups(spark, rows):
    data = [("hot", float(i % 977)) for i in range(5000)] + [("one", 3.0), ("same", 7.0), ("same", 7.0), ("null", None), ("nan", float("nan")), (None, 1.0), (None, 2.0)] + [("wide", v) for v in (-1e9, 0.0, 1e9)]
    df = spark.createDataFrame(data, "g string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        want = []
        for g in {d[0] for d in data}:
            vs = sorted(v for k, v in data if k == g and v is not None and v == v)
            if vs:
                want.append((g, vs[int((len(vs) - 1) * p)]))
        assert rows(H.lower_percentile(df, ["g"], "v", p)) == sorted(want, key=repr)
    assert H.lower_percentile(df.limit(0), ["g"], "v", 0.5).count() == 0

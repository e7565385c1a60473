from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import modules as M
from factloom.operators import resolution as X


def test_callables_by_priority_and_arity(spark, rows):
    symbols = spark.createDataFrame([("p.f", "f", 1), ("p.f", "f", 2), ("q.f", "f", 2), ("q.g", "g", 0)], "fqn string, name string, arity int")
    imports = spark.createDataFrame([("imp", "gone.f"), ("imp", "q.*")], "file string, import string")
    calls = spark.createDataFrame([("imp", "p", "f", 9), ("own", "p", "f", 2), ("far", "z", "f", 2), ("far", "z", "f", -1), ("far", "z", "a.b", 0), ("far", "z", "f", 7)], "file string, package string, name string, arity int")
    assert rows(X.resolve_callables(calls, symbols, imports), "file", "name", "arity", "fqn", "how") == [
        ("far", "a.b", 0, "a.b", "dotted"), ("far", "f", -1, "p.f", "name"), ("far", "f", -1, "q.f", "name"), ("far", "f", 2, "p.f", "name"), ("far", "f", 2, "q.f", "name"),
        ("imp", "f", 9, "gone.f", "import"), ("own", "f", 2, "p.f", "package"),
    ]


def test_rename_leaves_names_that_mean_something_else(spark, rows):
    symbols = spark.createDataFrame([("p.A", "decl"), ("p.B", "peer")], "fqn string, file string")
    imports = spark.createDataFrame([("user", "p.A"), ("other", "z.A"), ("peer", "z.A")], "file string, import string")
    refs = spark.createDataFrame([(f, "A", 1, 10, False) for f in ("decl", "peer", "user", "other", "far")] + [("user", "A", 2, 20, True)], "file string, name string, line int, start_byte bigint, in_comment boolean")
    plan = X.rename_plan(symbols, refs, imports, spark.createDataFrame([("p.A", "New")], "fqn string, new_name string"))
    assert rows(plan, "file", "start", "stop", "replacement") == [("decl", 10, 11, "New"), ("user", 10, 11, "New")]


def test_mocks_subtypes_and_cycles(spark, rows):
    text = "import io.mockk.mockk\nval a = mockk<A>()\nval b: B = mock()\nverify { b.run() }\n"
    assert rows(X.mock_usage(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))) == [(1, "mockk", 2, 1)]
    pairs = spark.createDataFrame([("E", "E"), ("E", "Base"), ("E", "Other")], "type string, wanted string")
    assert rows(X.subtypes_of(pairs, spark.createDataFrame([("E", "Base")], "type string, ancestor string"))) == [("E", "Base"), ("E", "E")]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")], "src string, dst string")
    home = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "node string, module string")
    assert rows(X.cycles_within(edges, home)) == [("m", "a", "a"), ("m", "b", "a")]


def test_modules_layers_and_owners(spark, rows):
    files = spark.createDataFrame([("lib/core/x/A.kt",), ("lib/B.kt",), ("lib/corex/C.kt",), ("D.kt",)], "path string")
    modules = spark.createDataFrame([(":lib", "lib"), (":core", "lib/core")], "path string, dir string")
    assert rows(M.file_to_module(files, modules, "root")) == [("D.kt", "root"), ("lib/B.kt", ":lib"), ("lib/core/x/A.kt", ":core"), ("lib/corex/C.kt", ":lib")]
    assert rows(M.assign_layers(modules, [("inner", ["core"]), ("all", ["*"])])) == [(":core", "inner"), (":lib", "all")]
    assert rows(M.owners(files, [("*", ["@all"]), ("lib/core/", ["@a", "@b"])]), "path", "owners")[2] == ("lib/core/x/A.kt", "@a,@b")


def test_removal_takes_dead_code_only_and_gives_fixed_reasons(spark, rows):
    data = [
        ("f", 1, "DeadCode", "Private function 'gone' appears to be unused.", True),
        ("f", 1, "DeadCode", "Private function 'gone' appears to be unused.", False),
        ("f", 1, "ModuleDeadCode", "Private function 'gone' appears to be unused.", True),
        ("g", 2, "DeadCode", "Public class 'Kept' appears to be unused.", False),
        ("g", 3, "ModuleDeadCode", "Public class 'Api' is only used here. Consider making it internal.", True),
        ("g", 4, "ModuleDeadCode", "something else", True),
        ("g", 5, "MagicNumber", "Private function 'other' appears to be unused.", True),
        ("g", 6, "DeadCode", None, True),
    ]
    plan = M.removal_plan(spark.createDataFrame(data, "file string, line int, rule string, message string, has_fix boolean"))
    assert rows(plan, "file", "line", "rule", "kind", "name", "reason") == [
        ("f", 1, "DeadCode", "function", "gone", None),
        ("g", 2, "DeadCode", "class", "Kept", "finding has no safe delete fix"),
        ("g", 3, "ModuleDeadCode", "class", "Api", "visibility narrowing is not deletion"),
        ("g", 4, "ModuleDeadCode", "declaration", "", "module-aware dead code is not safely removable yet"),
        ("g", 6, "DeadCode", "declaration", "", None),
    ]
    assert rows(M.removal_summary(plan), "what", "name", "n") == [
        ("blocked", "", 3), ("declarations", "", 2), ("files", "", 2), ("kind", "declaration", 1), ("kind", "function", 1),
        ("reason", "finding has no safe delete fix", 1), ("reason", "module-aware dead code is not safely removable yet", 1), ("reason", "visibility narrowing is not deletion", 1),
    ]
    assert M.removal_summary(plan.limit(0)).collect() == [("files", "", 0)]


def test_nodes_by_nesting(spark, rows):
    nodes = spark.createDataFrame([("f", 1, "fun", 0, 100), ("f", 2, "if", 10, 50), ("f", 3, "if", 20, 30), ("f", 4, "if", 200, 210), ("g", 5, "if", 10, 20)], "file string, id bigint, type string, start bigint, stop bigint")
    assert rows(M.ancestors_of(nodes, ["fun"]), "id") == [(2,), (3,)]
    assert rows(M.descendant_counts(nodes, ["fun"], ["if"])) == [("f", 1, 2)]
    spans = spark.createDataFrame([("f", 21, 25), ("f", 60, 61)], "file string, first bigint, last bigint")
    assert rows(M.smallest_covering(nodes, spans), "first", "id") == [(21, 3), (60, 1)]
    assert nodes.where(F.lit(False)).count() == 0

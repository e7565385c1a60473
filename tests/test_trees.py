from __future__ import annotations

import duckdb
import pytest

from factloom.operators import trees as R
from factloom.sources import tree as T
from tests.compare import SMALL

KOTLIN = '''package a.b
import x.Y as Z
/* c /* nested */ fun no() {} */
data class Foo(val a: Map<Int, String>, var b: String = "x ${y + "}"} z") : Base(), I {
    private val list = listOf(1, 2).map { it + 1 }
    override fun <T> run(q: T, vararg more: Map<String, Int>,): Int {
        if (a > 1 && b == "}") { return 1 } else if (a < 0 || q != null) return 2 else { println("fun no()") }
        for (i in 0..3) while (true) { break }
        val r = when (a) { 1, 2 -> 5; in 3..4 -> { 6 }
            else -> a ?: 7 }
        try { foo() } catch (e: Exception) { } finally { }
        list.forEach { x -> if (x > 1) go(x) }
        return r
    }
    internal fun one() = 3
    companion object { const val C = 1 }
}
fun String.ext() = this.length
'''
JAVA = '''package a;
import static b.C.of;
public class D extends E {
    private int x = 3;
    List<String> names;
    D(int q) { this.x = q; }
    public static void main(String[] a, Map<String, Integer> m) throws IOException {
        if (a.length > 1) { foo(a); } else { bar(); }
        switch (x) { case 1: y(); break; default: z(); }
        for (int i = 0; i < 3; i++) x++;
        do { x--; } while (x > 0);
    }
}
'''


def named(rows, *types):
    return [(r[2], r[3]) for r in rows if r[2] in types]


def test_kotlin_nodes():
    rows = T.parse(KOTLIN)
    assert named(rows, "package_header", "import_header", "class_declaration", "object_declaration", "function_declaration") == [
        ("package_header", "a.b"), ("import_header", "x.Y"), ("class_declaration", "Foo"), ("function_declaration", "run"), ("function_declaration", "one"), ("object_declaration", ""), ("function_declaration", "ext"),
    ]
    count = lambda t: sum(r[2] == t for r in rows)
    assert [count(t) for t in ("if_expression", "for_statement", "while_statement", "when_expression", "when_entry", "try_expression", "catch_block", "elvis_expression", "lambda_literal", "comment")] == [3, 1, 1, 1, 3, 1, 1, 1, 2, 1]
    assert named(rows, "property_declaration") == [("property_declaration", n) for n in ("a", "b", "list", "r", "C")]


def test_java_nodes():
    rows = T.parse(JAVA, "java")
    assert named(rows, "import_header", "function_declaration", "property_declaration") == [("import_header", "b.C.of"), ("property_declaration", "x"), ("property_declaration", "names"), ("function_declaration", "D"), ("function_declaration", "main")]
    count = lambda t: sum(r[2] == t for r in rows)
    assert [count(t) for t in ("if_expression", "when_expression", "when_entry", "for_statement", "do_while_statement")] == [1, 1, 2, 1, 1]


@pytest.mark.parametrize("text", ["", "(" * 5000, "{" * 5000, "fun " * 900, '"' * 99, "/*" * 900, "if (x) " * 900, "a\\\\", "`", "${", "class \n\n object", "try{" * 900, "when{" * 900, "class A { " * 900, '"${' * 900, "else if (x) " * 900, "\u0000\ud83d\ude00 fun é() {}", "fun f(\n", "})]" * 99])
@pytest.mark.parametrize("language", ["kotlin", "java"])
def test_every_text_gives_a_tree(text, language):
    rows = T.parse(text, language)
    assert rows[0][:3] == [0, None, "source_file"] and rows[0][7] == len(rows) - 1 and rows[0][5] == len(text)
    check(rows)


def check(rows):
    """Ids in document order, children within their parents, subtrees without gaps."""
    for r in rows[1:]:
        parent = rows[r[1]]
        assert r[1] < r[0] <= r[7] <= parent[7] and r[8] == parent[8] + 1
        assert parent[4] <= r[4] <= r[5]


def test_trees_of_the_test_texts_are_sound():
    texts = duckdb.sql(f"SELECT text, source FROM '{SMALL}/documents.parquet' WHERE text IS NOT NULL").fetchall()
    for text, source in texts:
        check(T.parse(text, "java" if source == "java_code" else "kotlin"))


def frame(spark, *texts):
    return T.syntax_trees(spark.createDataFrame([(i, *t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, language string, name string"))


def test_offsets_are_bytes_and_dirt_is_read(spark, rows):
    nodes = frame(spark, ("val é = \"ü\"\nfun f() {}", "kotlin"), (None, "kotlin"), ("", None), ("fun g() {}", None))
    assert rows(nodes.where("type = 'function_declaration'"), "doc_id", "name", "start", "stop", "row") == [(0, "f", 14, 24, 1), (3, "g", 0, 10, 0)]
    assert rows(nodes.where("type = 'source_file'"), "doc_id", "stop") == [(0, 24), (2, 0), (3, 10)]
    assert frame(spark, ("x", "kotlin")).limit(0).count() == 0


def test_metrics_of_functions(spark, rows):
    nodes = frame(spark, (KOTLIN, "kotlin"), (JAVA, "java"))
    # run: if 1, && 1, else if 2, || 1, for 1, while 2, when 1, ?: 1, catch 1; the lambda's if is its own.
    assert rows(R.function_metrics(nodes), "doc_id", "name", "cyclomatic", "cognitive", "nesting") == [(0, "ext", 1, 0, 0), (0, "one", 1, 0, 0), (0, "run", 12, 11, 2), (1, "D", 1, 0, 0), (1, "main", 6, 4, 1)]


def test_declarations_and_references(spark, rows):
    nodes = frame(spark, (KOTLIN, "kotlin"), (JAVA, "java"))
    assert rows(R.declarations(nodes).where("kind IN ('class', 'function')"), "fqn", "owner", "visibility", "signature", "is_override") == [
        ("a.D", "a", "public", "D", False), ("a.D.D", "a.D", "public", "D/1", False), ("a.D.main", "a.D", "public", "main/2", False),
        ("a.b.Foo", "a.b", "public", "Foo/2", False), ("a.b.Foo.one", "a.b.Foo", "internal", "one/0", False), ("a.b.Foo.run", "a.b.Foo", "public", "run/2", True), ("a.b.ext", "a.b", "public", "ext/0", False),
    ]
    calls = rows(R.references(nodes).where("kind = 'call'").select("name").distinct())
    assert calls == [("bar",), ("foo",), ("forEach",), ("go",), ("listOf",), ("map",), ("println",), ("y",), ("z",)]


def test_nesting_by_ids_as_by_walking(spark, rows):
    texts = [(KOTLIN, "kotlin"), (JAVA, "java")]
    nodes = frame(spark, *texts)
    want, counts = [], []
    for i, (text, language) in enumerate(texts):
        tree = T.parse(text, language)

        def above(r):
            while r[1] is not None:
                r = tree[r[1]]
                yield r

        want += [(i, r[0]) for r in tree if any(a[2] == "lambda_literal" for a in above(r))]
        counts += [(i, r[0], sum(x[2] == "call_expression" and any(a[0] == r[0] for a in above(x)) for x in tree)) for r in tree if r[2] == "function_declaration"]
    assert rows(R.with_ancestor(nodes, ["lambda_literal"]), "doc_id", "id") == sorted(want, key=repr)
    assert rows(R.count_below(nodes, ["function_declaration"], ["call_expression"])) == sorted(counts, key=repr)
    firsts = {(d, p): i for d, p, i in rows(R.first_child(nodes), "doc_id", "parent", "id")}
    assert firsts[0, 0] == 1 and all(i == p + 1 for (_, p), i in firsts.items())
    at = KOTLIN.index("listOf")
    spans = spark.createDataFrame([(0, at, at + 6), (0, 0, len(KOTLIN))], "doc_id bigint, first bigint, last bigint")
    found = {r.first: r.id for r in R.smallest_covering(nodes, spans).collect()}
    assert T.parse(KOTLIN)[found[at]][2:4] == ["call_expression", "listOf"] and found[0] == 0

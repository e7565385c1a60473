from __future__ import annotations

import json
import struct

import pytest

from factloom.sources import files as SF
from factloom.sources import sinks as SK


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


def test_source_tree_lists_and_excludes(spark, tmp_path, rows):
    for name in ("a/Main.kt", "a/Old.java", "a/testData/Broken.kt", "a/build/Gen.kt", "a/readme.md", "settings.kts"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("class X")
    tree = SF.source_tree(spark, str(tmp_path), excludes=["build/"])
    assert [(p.split("/", 1)[-1] if "/" in p else p, lang) for p, lang in rows(tree, "path", "language")] == [("Main.kt", "kotlin"), ("Old.java", "java"), ("settings.kts", "kotlin")]
    assert {r.content for r in tree.collect()} == {"class X"}
    listed = spark.createDataFrame([("a", "git")], "path string, via string")
    walked = spark.createDataFrame([("a", "walk"), ("b", "walk")], "path string, via string")
    assert rows(SF.repeated_listing(listed, walked)) == [("a", "git"), ("b", "walk")]


def test_hunks_and_log(spark, rows):
    diff = ["+++ b/x.kt", "@@ -1,2 +3,4 @@ fun", "+a", "@@ -9 +12 @@", "@@ -20,3 +20,0 @@", "+++ b/y.kt", "@@ -0,0 +1,2 @@"]
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(diff)], "diff_id int, pos int, line string")
    assert rows(SF.git_hunks(df)) == [("x.kt", 12, 12), ("x.kt", 3, 6), ("y.kt", 1, 2)]
    log = ["commit:abc1", "", "x.kt", "y.kt", "commit:def2", "x.kt"]
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(log)], "log_id int, pos int, line string")
    assert rows(SF.git_log(df)) == [("abc1", "x.kt"), ("abc1", "y.kt"), ("def2", "x.kt")]


def test_android_and_gradle_texts(spark, rows):
    manifest = '<manifest package="p.q"><uses-permission android:name="A"/><uses-sdk android:minSdkVersion="21"/><activity android:exported="true"/></manifest>'
    assert rows(SF.manifest(texts(spark, manifest, "x", None))) == [(0, "p.q", 21, 1, 1, "A")]
    settings = 'include(":core", ":data:api")\ninclude \'app\'\nproject(":core").projectDir = file("lib/core")'
    assert rows(SF.gradle_settings(texts(spark, settings))) == [(0, ":app", "app"), (0, ":core", "lib/core"), (0, ":data:api", "data/api")]
    build = 'plugins { id("b"); id("a") }\nandroid {\n  compileSdk = 34\n  minSdkVersion(21)\n}'
    assert rows(SF.gradle_config(texts(spark, build, None))) == [(0, 21, None, 34, "a,b"), (1, None, None, None, None)]


def test_version_catalog(spark, rows):
    toml = '[versions]\nk = "1.9"\n[libraries]\nstd = { module = "g:std", version.ref = "k" }\nplain = "g:plain:2"\nbom = { group = "g", name = "bom" }\n'
    assert rows(SF.version_catalog(texts(spark, toml, "= broken", None, ""))) == [(0, "libraries", "bom", "g:bom", 6), (0, "libraries", "plain", "g:plain:2", 5), (0, "libraries", "std", "g:std:1.9", 4), (0, "versions", "k", "1.9", 2)]


def test_icons_from_headers(spark, rows):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 48, 32) + b"rest"
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    df = spark.createDataFrame([("a.png", png), ("b.gif", gif), ("c.bin", b"xx"), ("d", None)], "path string, content binary")
    assert rows(SF.icons(df)) == [("a.png", "png", 48, 32), ("b.gif", "gif", 7, 9), ("c.bin", None, None, None), ("d", None, None, None)]


def test_icons_of_jpeg_and_webp(spark, rows):
    sof = b"\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + b"\x00" * 10
    jpeg = b"\xff\xd8\xff\xe0\x01\x02" + b"x" * 256 + b"\xff\xc4\x00\x04ab" + sof
    lossy = b"RIFF\x00\x00\x00\x00WEBPVP8 \x00\x00\x00\x00\x00\x00\x00\x9d\x01\x2a\x30\x00\x20\x40"
    less = b"RIFF\x00\x00\x00\x00WEBPVP8L\x00\x00\x00\x00\x2f" + ((47 | 31 << 14).to_bytes(4, "little"))
    df = spark.createDataFrame([("a", jpeg), ("b", jpeg[:100]), ("c", lossy), ("d", less), ("e", b"\xff\xd8"), ("f", b"\xff\xd8\xff\xe0\x00\x00" * 40)], "path string, content binary")
    assert rows(SF.icons(df)) == [("a", "jpeg", 48, 32), ("b", None, None, None), ("c", "webp", 48, 32), ("d", "webp", 48, 32), ("e", None, None, None), ("f", None, None, None)]


def test_traces_and_failures(spark, rows, tmp_path):
    jfr = json.dumps({"events": [{"type": "jdk.ExecutionSample", "startTimeNs": 5, "thread": "main", "frames": [{"class": "A", "method": "m"}]}, {"type": "jdk.GC", "frames": [{"class": "A", "method": "m"}]}, {"frames": []}]})
    assert [(r.timestamp_ns, r.frames, r.role) for r in SF.jfr_events(texts(spark, jfr, "no json")).collect()] == [(5, ["A.m"], "main")]
    steps = json.dumps([{"test_class": "T", "test_method": "x", "stack": []}, {"stack": ["a", "b"], "timestamp_ns": 3}, {}])
    assert [(r.pos, r.frames) for r in SF.junit_steps(texts(spark, steps)).orderBy("pos").collect()] == [(0, ["T.x"]), (1, ["a", "b"])]
    out = [("run", None), ("output", "old\n"), ("pass", None), ("output", "one\n"), ("output", "two\n"), ("fail", None), ("output", "tail\n")]
    lines = [json.dumps({"Action": a, "Package": "p", "Test": "t", "Output": o}) for a, o in out] + ["not json", json.dumps({"Action": "fail", "Package": "p"})]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    assert rows(SF.go_test_failures(df)) == [("p", "t", "one\ntwo\n")]
    (tmp_path / "r.xml").write_text('<testsuite><testcase classname="C" name="ok"/><testcase classname="C" name="bad"><failure message="">text</failure></testcase><testcase classname="C" name="err"><error message="boom"/></testcase></testsuite>')
    assert rows(SF.junit_failures(spark, str(tmp_path / "r.xml"))) == [("C.bad", "text"), ("C.err", "boom")]


def test_baselines_history_and_texts(spark, tmp_path, rows):
    (tmp_path / "b.xml").write_text("<SmellBaseline><ManuallySuppressedIssues><ID>m</ID></ManuallySuppressedIssues><CurrentIssues><ID>a</ID><ID>b</ID></CurrentIssues></SmellBaseline>")
    assert rows(SF.baseline_xml(spark, str(tmp_path / "b.xml"))) == [("CurrentIssues", "a"), ("CurrentIssues", "b"), ("ManuallySuppressedIssues", "m")]
    (tmp_path / "h.jsonl").write_text('{"timestamp":"2026-01-01T00:00:00Z","version":"1","summary":{"total":3,"byRule":{"r":3}}}\n')
    assert SF.metrics_history(spark, str(tmp_path / "h.jsonl")).select("summary.total").first()[0] == 3
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        SF.metrics_history(spark, str(tmp_path / "bad.jsonl")).collect()
    assert SF.parse_codeowners("# c\n* @a @b # x\n/src/\n") == [("*", ["@a", "@b"])]
    config = "[*]\nindent_size = 4\n[*.{kt,kts}]\nindent_size = 2\nMax_Line = 100\n[*.java]\nx = y\n"
    assert SF.parse_editorconfig(config, "a/B.kt") == {"indent_size": "2", "max_line": "100"}
    assert SF.merge_config({"a": {"x": 1, "y": [1]}, "b": 1}, {"a": {"y": [2]}}) == {"a": {"x": 1, "y": [2]}, "b": 1}


def test_sinks(spark, tmp_path, rows):
    schema = "file string, line int, col int, rule_set string, rule string, severity string, message string"
    df = spark.createDataFrame([("a b.kt", 2, 3, "s", "r", "error", 'x < "y" & z'), ("a b.kt", 1, None, "s", "r", "warning", None)], schema)
    assert rows(SK.plain(df)) == [("a b.kt:1:0: warning:  [r]",), ('a b.kt:2:3: error: x < "y" & z [r]',)]
    xml = SK.checkstyle(df).first()["value"]
    assert xml.index('line="1"') < xml.index('line="2"') and "x &lt; &quot;y&quot; &amp; z" in xml
    sarif = [json.loads(r.value) for r in SK.sarif_results(df).collect()]
    assert {s["level"] for s in sarif} == {"error", "warning"} and sarif[0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20b.kt"
    assert json.loads(SK.json_summary(df).first()["value"]) == {"total": 2, "byRuleSet": {"s": 2}, "byRule": {"r": 2}}
    assert json.loads(SK.json_summary(df.limit(0)).first()["value"])["total"] == 0
    store = SK.SnapshotStore(spark, str(tmp_path / "snap"))
    store.save("c1", "files", df)
    store.save("c2", "files", df.limit(1))
    store.save("c2", "files", df.limit(1))
    assert store.load("files", "c1").count() == 2 and store.load("files").count() == 3
    cache = SK.KeyedCache(spark, str(tmp_path / "cache"))
    entry = spark.createDataFrame([("h1", "r", "k", "v")], "content_hash string, rules_hash string, kind string, value string")
    cache.put(entry)
    cache.put(entry)
    wanted = spark.createDataFrame([("h1", "r", "k"), ("h2", "r", "k")], "content_hash string, rules_hash string, kind string")
    assert cache.get(wanted).count() == 1 and rows(cache.misses(wanted)) == [("h2", "r", "k")]


def test_surface_round_trip(spark, tmp_path, rows):
    symbols = spark.createDataFrame([("fun", "b", "public"), ("fun", "b", "public"), ("class", "A", "private")], "kind string, name string, visibility string")
    SK.surface(symbols).coalesce(1).write.text(str(tmp_path / "api"))
    assert rows(SK.read_surface(spark, str(tmp_path / "api"))) == [("fun", "b")]

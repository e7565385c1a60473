"""File sources: source trees, XML, build scripts, JSON facts, traces, failures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalars import event_id, excluded, glob_regex, normalize_signature

# Languages by file name ending.
LANGUAGES = {"kt": "kotlin", "kts": "kotlin", "java": "java", "xml": "xml", "gradle": "gradle", "toml": "toml"}


# How build scripts write SDK levels and plugins, and diffs their hunks.
SDK_LEVEL = r"(?m)^\s*{}(?:Version)?\s*[=(]?\s*(\d+)"
PLUGIN_ID = r"\bid\s*\(\s*[\"']([^\"']+)[\"']"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def source_tree(spark: SparkSession, root: str, endings: tuple[str, ...] = ("kt", "kts", "java"), excludes: list[str] | None = None) -> DataFrame:
    """(path, language, size, modified, content) of the files below ``root``; excluded ones are never read.

    The listing and the filter on the path come before the contents: Spark
    prunes the content column where it isn't selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    ending = F.regexp_extract("path", r"\.([^./]+)$", 1)
    language = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending)
    return files.select(rel.alias("path"), language.alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content")).where(~excluded(F.col("path"), excludes or []))


def repeated_listing(kept: DataFrame, walked: DataFrame) -> DataFrame:
    """Paths of the tracked listing and of the walk, each once; the listing's row wins."""
    return kept.withColumn("_p", F.lit(0)).unionByName(walked.withColumn("_p", F.lit(1))).groupBy("path").agg(F.min_by(F.struct(*[c for c in kept.columns if c != "path"]), "_p").alias("r")).select("path", "r.*")


def git_hunks(diff: DataFrame) -> DataFrame:
    """(file, first, last) of the new side of unified diffs (file-ordered ``pos``, ``line``).

    A hunk that only removes lines gives no interval. The file is that of the
    last ``+++`` line before.
    """
    from pyspark.sql.window import Window

    name = F.nullif(F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1), F.lit(""))
    w = Window.partitionBy("diff_id").orderBy("pos")
    first = F.regexp_extract("line", HUNK, 1)
    count = F.regexp_extract("line", HUNK, 2)
    rows = diff.withColumn("file", F.last(name, ignorenulls=True).over(w)).where(F.col("line").startswith("@@ "))
    rows = rows.select("file", first.try_cast("int").alias("first"), F.coalesce(count.try_cast("int"), F.lit(1)).alias("n"))
    return rows.where("n > 0").select("file", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def git_log(lines: DataFrame) -> DataFrame:
    """(commit_sha, file) of ``git log --name-only --format=commit:%H`` lines (log_id, pos, line)."""
    from pyspark.sql.window import Window

    sha = F.nullif(F.regexp_extract("line", r"^commit:([0-9a-f]+)$", 1), F.lit(""))
    w = Window.partitionBy("log_id").orderBy("pos")
    return lines.withColumn("commit_sha", F.last(sha, ignorenulls=True).over(w)).where((F.col("line") != "") & ~F.col("line").startswith("commit:")).select("commit_sha", F.col("line").alias("file"))


def manifest(texts: DataFrame) -> DataFrame:
    """(doc_id, package, min_sdk, components, exported, permissions) of Android manifests; unreadable ones give nulls."""
    ok = texts.where(F.col("text").contains("<manifest"))
    attr = lambda name: F.nullif(F.regexp_extract("text", rf'\b{name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    return ok.select(
        "doc_id", attr("package").alias("package"), attr("android:minSdkVersion").try_cast("int").alias("min_sdk"),
        count(r"<(?:activity|service|receiver|provider)\b").alias("components"), count(r'android:exported\s*=\s*"true"').alias("exported"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r'<uses-permission[^>]*android:name\s*=\s*"([^"]*)"'), F.lit(1)))), ",").alias("permissions"),
    )


def gradle_settings(texts: DataFrame) -> DataFrame:
    """(doc_id, path, dir) of modules that settings scripts include, with their projectDir overrides."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)\binclude\s*\(([^)]*)\)"), F.lit(1))
    groovy = F.regexp_extract_all("text", F.lit(r"(?m)^\s*include\s+([^(\n][^\n]*)"), F.lit(1))
    named = texts.select("doc_id", F.explode(F.regexp_extract_all(F.array_join(F.concat(blocks, groovy), ","), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))).alias("raw"))
    path = F.when(F.col("raw").startswith(":"), F.col("raw")).otherwise(F.concat(F.lit(":"), "raw"))
    override = r"project\(\s*[\"'](:[^\"']+)[\"']\s*\)\.projectDir\s*=\s*file\(\s*[\"']([^\"']+)[\"']"
    moved = texts.select("doc_id", F.inline(F.arrays_zip(F.regexp_extract_all("text", F.lit(override), F.lit(1)).alias("path"), F.regexp_extract_all("text", F.lit(override), F.lit(2)).alias("own"))))
    return named.select("doc_id", path.alias("path")).distinct().join(moved, ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("own", F.translate(F.regexp_replace("path", "^:", ""), ":", "/")).alias("dir"))


def gradle_config(texts: DataFrame) -> DataFrame:
    """(doc_id, min_sdk, target_sdk, compile_sdk, plugins) of build scripts."""
    sdk = lambda name: F.regexp_extract("text", SDK_LEVEL.format(name), 1).try_cast("int")
    plugins = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(PLUGIN_ID), F.lit(1)))), ",")
    return texts.select("doc_id", sdk("minSdk").alias("min_sdk"), sdk("targetSdk").alias("target_sdk"), sdk("compileSdk").alias("compile_sdk"), plugins.alias("plugins"))


_CATALOG = pa.schema([("doc_id", pa.int64()), ("section", pa.string()), ("alias", pa.string()), ("value", pa.string()), ("line", pa.int32())])


def version_catalog(texts: DataFrame) -> DataFrame:
    """(doc_id, section, alias, value, line) of version catalogs (TOML), with version references resolved.

    A library's value is ``group:name:version``. Unreadable texts give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tomllib

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    data = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                at = {m.group(1).strip("\"' "): i for i, line in enumerate((text or "").splitlines(), 1) if (m := re.match(r"\s*([^=\s\[#]+)\s*=", line))}
                versions = {k: v if isinstance(v, str) else str(v.get("strictly") or v.get("require") or v.get("prefer") or "") for k, v in data.get("versions", {}).items()}
                rows += [(doc, "versions", k, v, at.get(k)) for k, v in versions.items()]
                for k, v in data.get("libraries", {}).items():
                    if isinstance(v, dict):
                        version = v.get("version", "")
                        version = versions.get(version.get("ref"), "") if isinstance(version, dict) else version
                        v = f"{v.get('module') or ':'.join((v.get('group', ''), v.get('name', '')))}:{version}".rstrip(":")
                    rows.append((doc, "libraries", k, str(v), at.get(k)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CATALOG)], schema=_CATALOG)

    return texts.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, section string, alias string, value string, line int")


_ICON = pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32())])


def icons(files: DataFrame) -> DataFrame:
    """(path, format, width, height) from the headers of images (path, content); unknown formats give nulls."""

    def header(data: bytes) -> tuple[str | None, int | None, int | None]:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
            return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
        if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
            return "gif", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8 " and data[23:26] == b"\x9d\x01\x2a" and len(data) >= 30:
            return "webp", int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and data[20:21] == b"\x2f" and len(data) >= 25:
            bits = int.from_bytes(data[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return jpeg(data) if data[:2] == b"\xff\xd8" else (None, None, None)

    def jpeg(data: bytes) -> tuple[str | None, int | None, int | None]:
        at = 2
        while at + 9 <= len(data):
            mark = data[at + 1]
            if data[at] != 0xFF:
                break
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 1 if mark == 0xFF else 2 if mark == 1 or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]], schema=_ICON)

    # Headers are short: no more of a file leaves the scan, but of JPEG files, whose size may stand behind other data.
    head = F.substring("content", 1, 64)
    return files.select("path", F.when(F.substring("content", 1, 2) == F.unhex(F.lit("FFD8")), F.col("content")).otherwise(head).alias("content")).mapInArrow(run, "path string, format string, width int, height int")


def jfr_events(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, timestamp_ns, frames, role) of JFR JSON; only execution samples, empty stacks dropped."""
    schema = "events array<struct<type string, startTimeNs bigint, thread string, frames array<struct<class string, method string>>>>"
    rows = texts.select("doc_id", F.posexplode(F.from_json("text", schema)["events"]).alias("pos", "e"))
    frames = F.transform("e.frames", lambda f: F.concat_ws(".", f["class"], f["method"]))
    kept = rows.where(F.coalesce(F.col("e.type"), F.lit("")).isin("", "jdk.ExecutionSample")).select("doc_id", "pos", F.coalesce("e.startTimeNs", F.lit(0)).alias("timestamp_ns"), frames.alias("frames"), F.when(F.lower("e.thread").contains("test"), "test").when(F.lower("e.thread") == "main", "main").otherwise("unknown").alias("role"))
    return kept.where(F.size("frames") > 0)


def junit_steps(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, timestamp_ns, frames, role) of JSON step lists, in their order; without a stack the test is the frame."""
    schema = "array<struct<timestamp_ns bigint, test_class string, test_method string, stack array<string>>>"
    rows = texts.select("doc_id", F.posexplode(F.from_json("text", schema)).alias("pos", "s"))
    own = F.concat_ws(".", "s.test_class", "s.test_method")
    frames = F.when(F.size("s.stack") > 0, F.col("s.stack")).when(own != "", F.array(own))
    return rows.select("doc_id", "pos", F.coalesce("s.timestamp_ns", F.lit(0)).alias("timestamp_ns"), frames.alias("frames"), F.lit("test").alias("role")).where(F.size("frames") > 0)


def go_test_failures(lines: DataFrame) -> DataFrame:
    """(package, test, output) of failed tests in ``go test -json`` lines (pos, line).

    A test's output since its last end is joined; passes and skips discard it.
    Lines that are no JSON, and those of packages, are skipped.
    """
    from pyspark.sql.window import Window

    rec = F.from_json("line", "Action string, Package string, Test string, Output string")
    rows = lines.select("pos", rec.alias("r")).select("pos", "r.*").where("Test IS NOT NULL AND Test <> '' AND Action IS NOT NULL")
    ends = F.col("Action").isin("pass", "fail", "skip").cast("int")
    w = Window.partitionBy("Package", "Test").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.withColumn("_run", F.coalesce(F.sum(ends).over(w), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when(F.col("Action") == "output", F.struct("pos", "Output"))))
    out = runs.groupBy("Package", "Test", "_run").agg(F.max(F.when(F.col("Action") == "fail", 1).otherwise(0)).alias("_failed"), parts.alias("_parts"))
    return out.where("_failed = 1").select(F.col("Package").alias("package"), F.col("Test").alias("test"), F.array_join(F.transform("_parts", lambda p: p["Output"]), "").alias("output"))


def junit_failures(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, message) of failed or broken test cases in JUnit XML files."""
    part = "struct<_message string, _VALUE string>"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(f"_classname string, _name string, failure {part}, error {part}").load(path)
    message = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("failure._message", "failure._VALUE", "error._message", "error._VALUE")], F.lit(""))
    return cases.where("failure IS NOT NULL OR error IS NOT NULL").select(F.concat_ws(".", "_classname", "_name").alias("symbol"), message.alias("message"))


def baseline_xml(spark: SparkSession, path: str) -> DataFrame:
    """(section, id) of baseline XML files."""
    out = None
    for section in ("ManuallySuppressedIssues", "CurrentIssues"):
        rows = spark.read.format("xml").option("rowTag", section).schema("ID array<string>").load(path).select(F.lit(section).alias("section"), F.explode("ID").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def metrics_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL history; a line that is no record is an error, not a null."""
    schema = "timestamp timestamp, version string, commit string, targets array<string>, summary struct<total int, byRuleSet map<string,int>, byRule map<string,int>, fixable int>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_codeowners(text: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of a CODEOWNERS text in its order; comments and patterns without owners are skipped."""
    rows = (line.split("#", 1)[0].split() for line in text.splitlines())
    return [(r[0], r[1:]) for r in rows if len(r) > 1]


def parse_editorconfig(text: str, path: str) -> dict[str, str]:
    """Settings that hold for a path: later sections win; names and values in lower case."""
    out: dict[str, str] = {}
    on = False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            globs = line[1:-1]
            m = re.search(r"\{([^}]*)\}", globs)
            names = [globs.replace(m.group(0), x) for x in m.group(1).split(",")] if m else [globs]
            on = any(re.match(glob_regex(n), "/" + path.lstrip("/")) for n in names)
        elif on and "=" in line and line[0] not in "#;":
            k, v = line.split("=", 1)
            out[k.strip().lower()] = v.strip().lower()
    return out


def merge_config(base: dict, over: dict) -> dict:
    """Two nested configurations; the second wins, maps are merged, lists replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_document(text: str):
    """A JSON document, or a YAML one where a YAML reader is installed."""
    import json

    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("no JSON, and no YAML reader is installed") from None
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as bad:
            raise ValueError(str(bad)) from None


def _required(data: dict, *keys: str) -> None:
    for key in keys:
        if not str(data.get(key) or "").strip():
            raise ValueError(f"{key} is required")


def recipe(text: str) -> dict[str, str]:
    """A codemod recipe: name, language (kotlin or java), match, replacement."""
    data = load_document(text)
    if not isinstance(data, dict):
        raise ValueError("a recipe is a map")
    _required(data, "name", "match")
    if str(data.get("language") or "").strip().lower() not in ("kotlin", "java"):
        raise ValueError("language must be kotlin or java")
    if not data.get("replacement"):
        raise ValueError("replacement is required")
    return {k: str(data[k]) for k in ("name", "language", "match", "replacement")}


def migration_map(spark: SparkSession, text: str) -> DataFrame:
    """(library, from_version, to_version, old, new, reason) of a library's migration map."""
    data = load_document(text)
    if not isinstance(data, dict):
        raise ValueError("a migration map is a map")
    _required(data, "library")
    rows = []
    for step in data.get("migrations") or []:
        _required(step, "from", "to")
        if not step.get("symbols"):
            raise ValueError("a migration needs a symbol")
        for entry in step["symbols"]:
            _required(entry, "symbol")
            rows.append((data["library"], str(step["from"]), str(step["to"]), entry["symbol"], entry.get("replacement"), entry.get("reason")))
    if not rows:
        raise ValueError("a migration map needs a migration")
    return spark.createDataFrame(rows, "library string, from_version string, to_version string, old string, new string, reason string")


_EVENT = "struct<failure_kind string, signature string, module string, file string, symbol string, source string, frames array<string>, message string>"


def generic_failures(texts: DataFrame, commit_sha: str, source: str = "local") -> DataFrame:
    """Failures of JSON documents that are one event or a list of them (doc_id, event_id, and the event's fields).

    An event without a kind is a runtime failure, without a signature its
    normalized message stands for it, without a source ``source``. A blank
    text has no events; one that is no JSON gives none.
    """
    if not commit_sha:
        raise ValueError("a commit is required")
    body = F.trim("text")
    whole = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    rows = texts.where(body != "").select("doc_id", F.explode(F.from_json(whole, f"array<{_EVENT}>")).alias("e")).where("e IS NOT NULL").select("doc_id", "e.*")
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    full = rows.select(
        "doc_id", F.lit(commit_sha).alias("commit_sha"), given("failure_kind", F.lit("runtime_failure")).alias("failure_kind"), given("signature", normalize_signature(F.coalesce("message", F.lit("")))).alias("signature"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("module", "file", "symbol")], F.when(F.trim("source") != "", F.col("source")).otherwise(source).alias("source"), "frames", F.coalesce("message", F.lit("")).alias("message"),
    )
    return full.withColumn("event_id", event_id(F.col("failure_kind"), F.col("signature"), F.col("commit_sha"), F.col("source")))


def baseline_json(spark: SparkSession, path: str) -> DataFrame:
    """(section, id) of baseline JSON files."""
    data = spark.read.option("multiLine", "true").schema("manuallySuppressed array<string>, currentIssues array<string>").json(path)
    named = F.array(F.struct(F.lit("ManuallySuppressedIssues").alias("section"), F.col("manuallySuppressed").alias("ids")), F.struct(F.lit("CurrentIssues").alias("section"), F.col("currentIssues").alias("ids")))
    return data.select(F.inline(named)).select("section", F.explode("ids").alias("id"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(section, id), each once; JSON by its ending, XML else."""
    return (baseline_json if path.endswith(".json") else baseline_xml)(spark, path).distinct()

"""Files to modules and layers, dependency injection, resources, reviewers, migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.scalars import glob_regex, package_of


def file_to_module(files: DataFrame, modules: DataFrame, fallback: str = "") -> DataFrame:
    """(path, module): the module with the longest directory that holds a file.

    Equi-join on every leading directory of the path, not a prefix comparison
    with every module.
    """
    parts = F.split("path", "/")
    ups = files.select("path").distinct().withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("dir", F.array_join(F.slice(parts, 1, F.col("_n")), "/"))
    dirs = modules.groupBy("dir").agg(F.min("path").alias("module"))
    best = ups.join(dirs, "dir", "left").groupBy("path").agg(F.max_by("module", F.when(F.col("module").isNotNull(), F.col("_n"))).alias("module"))
    return best.select("path", F.coalesce("module", F.lit(fallback)).alias("module"))


def assign_layers(modules: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """(path, layer): the first layer, in the order given, with a glob for the module; null without one."""
    rooted = F.concat(F.lit("/"), F.translate(F.regexp_replace("path", "^:", ""), ":", "/"))
    layer = F.lit(None).cast("string")
    for name, globs in reversed(layers):
        hit = F.lit(False)
        for g in globs:
            hit = hit | rooted.rlike(glob_regex(g))
        layer = F.when(hit, name).otherwise(layer)
    return modules.select("path", layer.alias("layer"))


def injection_graph(wanted: DataFrame, bindings: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, how) of constructor parameters (src, target, file) resolved to bindings (fqn).

    In this order: the exact name, an imported one that is bound, a dotted
    name as it is, the same package, a simple name that only one binding has.
    """
    b = bindings.select("fqn").distinct()
    leaf = F.regexp_extract("fqn", r"([^.]*)$", 1)
    w = wanted.select("src", "target", "file").distinct()
    imported = imports.select("file", F.col("import").alias("fqn"), F.regexp_extract("import", r"([^.]*)$", 1).alias("target")).join(b, "fqn", "left_semi")
    simple = b.select("fqn", leaf.alias("target")).withColumn("_n", F.count("*").over(Window.partitionBy("target"))).where("_n = 1").select("target", "fqn")
    tries = (
        w.join(b.withColumn("target", F.col("fqn")), "target").select("src", "target", "fqn", F.lit(1).alias("p"))
        .unionByName(w.join(imported, ["file", "target"]).select("src", "target", "fqn", F.lit(2).alias("p")))
        .unionByName(w.where(F.col("target").contains(".")).select("src", "target", F.col("target").alias("fqn"), F.lit(3).alias("p")))
        .unionByName(w.withColumn("fqn", F.concat_ws(".", package_of(F.col("src")), "target")).join(b, "fqn", "left_semi").select("src", "target", "fqn", F.lit(4).alias("p")))
        .unionByName(w.join(simple, "target").select("src", "target", "fqn", F.lit(5).alias("p")))
    )
    first = tries.groupBy("src", "target").agg(F.min(F.struct("p", "fqn")).alias("t"))
    how = F.element_at(F.array(*map(F.lit, ("exact", "import", "dotted", "package", "simple"))), F.col("t.p"))
    return first.select("src", F.col("t.fqn").alias("dst"), how.alias("how")).distinct()


def dead_bindings(bindings: DataFrame, edges: DataFrame) -> DataFrame:
    """Bindings that nothing injects."""
    return bindings.select("fqn").distinct().join(edges.select(F.col("dst").alias("fqn")).distinct(), "fqn", "left_anti")


def merge_resources(*indexes: DataFrame) -> DataFrame:
    """Resources (kind, name, value) of several indexes; the later index wins."""
    rows = None
    for i, df in enumerate(indexes):
        part = df.select("kind", "name", "value", F.lit(i).alias("_i"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", "name").agg(F.max(F.struct("_i", "value"))["value"].alias("value"))


def owners(files: DataFrame, codeowners: list[tuple[str, list[str]]]) -> DataFrame:
    """(path, owners): those of the last matching pattern, by commas; null without a match."""
    rooted = F.concat(F.when(F.col("path").startswith("/"), "").otherwise("/"), "path")
    out = F.lit(None).cast("string")
    for pattern, names in codeowners:
        out = F.when(rooted.rlike(glob_regex(pattern)), ",".join(names)).otherwise(out)
    return files.select("path", out.alias("owners"))


def suggest_reviewers(changed: DataFrame, hits: DataFrame, codeowners: list[tuple[str, list[str]]]) -> DataFrame:
    """(team, score, fqn): caller hits (path, fqn) and direct files count one each; fqn is the most hit, then the least name."""
    direct = owners(changed.select("path").distinct(), codeowners).select(F.explode(F.split("owners", ",")).alias("team"), F.lit(None).cast("string").alias("fqn"))
    called = hits.join(owners(hits.select("path").distinct(), codeowners), "path").select(F.explode(F.split("owners", ",")).alias("team"), "fqn")
    each = direct.unionByName(called).groupBy("team", "fqn").agg(F.count("*").alias("_n"))
    top = F.min(F.when(F.col("fqn").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("fqn").alias("fqn"))))
    return each.groupBy("team").agg(F.sum("_n").alias("score"), top["fqn"].alias("fqn")).orderBy(F.desc("score"), "team")


def migrations(refs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file, line, old, new): references outside comments to names of a migration map (old, new), each once."""
    return refs.where(~F.col("in_comment")).select("file", "line", F.col("name").alias("old")).join(mapping.select("old", "new").distinct(), "old").distinct().select("file", "line", "old", "new")


def test_coverage(symbols: DataFrame, refs: DataFrame, suffix: str = "Test") -> DataFrame:
    """(test, target, covered): classes that a test's name implies, and whether its file references them."""
    tests = symbols.where(F.col("name").endswith(suffix)).select(F.col("name").alias("test"), "file", F.regexp_replace("name", f"{suffix}$", "").alias("target")).distinct()
    known = symbols.select(F.col("name").alias("target")).distinct()
    used = refs.select("file", F.col("name").alias("target"), F.lit(True).alias("_used")).distinct()
    return tests.join(known, "target", "left_semi").join(used, ["file", "target"], "left").select("test", "target", F.coalesce("_used", F.lit(False)).alias("covered")).distinct()


def removal_plan(findings: DataFrame) -> DataFrame:
    """(file, line, rule, kind, name, reason) of dead code; a null reason means that it can be removed.

    ``findings`` has (file, line, rule, message, has_fix). A DeadCode finding
    with a fix is removable. Without one it is blocked, and so is every
    ModuleDeadCode finding. Kind and name come from the message, else they are
    ``declaration`` and ``''``. What is known by file, line, kind and name
    counts once, a removable finding before a blocked one.
    """
    kind, name = (F.regexp_extract("message", r"^[A-Z][a-z]+ ([a-z]+) '([^']+)'", i) for i in (1, 2))
    # The reasons.
    reason = (
        F.when((F.col("rule") == "DeadCode") & F.col("has_fix"), F.lit(None).cast("string"))
        .when(F.col("rule") == "DeadCode", "finding has no safe delete fix")
        .when(F.coalesce(F.col("message").contains("Consider making it internal."), F.lit(False)), "visibility narrowing is not deletion")
        .otherwise("module-aware dead code is not safely removable yet")
    )
    dead = findings.where(F.col("rule").isin("DeadCode", "ModuleDeadCode"))
    rows = dead.select("file", "line", "rule", F.coalesce(F.nullif(kind, F.lit("")), F.lit("declaration")).alias("kind"), F.coalesce(name, F.lit("")).alias("name"), reason.alias("reason"))
    first = F.min(F.struct(F.col("reason").isNotNull().alias("blocked"), "rule", "reason"))
    return rows.groupBy("file", "line", "kind", "name").agg(first.alias("x")).select("file", "line", "x.rule", "kind", "name", "x.reason")


def removal_summary(plan: DataFrame) -> DataFrame:
    """(what, name, n): declarations, files and kinds that can be removed, blocked ones and their reasons."""
    one = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    free = F.col("reason").isNull()
    facts = F.when(free, F.array(one("declarations", F.lit("")), one("kind", F.col("kind")))).otherwise(F.array(one("blocked", F.lit("")), one("reason", F.col("reason"))))
    counts = plan.select(F.inline(facts)).groupBy("what", "name").agg(F.count("*").alias("n"))
    files = plan.where(free).agg(F.count_distinct("file").alias("n")).select(F.lit("files").alias("what"), F.lit("").alias("name"), "n")
    return counts.unionByName(files)


def ancestors_of(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes (file, id, type, start, stop) that lie inside another of the given types (left semi).

    Bins spread the outer intervals, so nesting is an equi-join per file and bin.
    """
    from factloom.operators.ranges import points_in_intervals

    outer = nodes.where(F.col("type").isin(kinds)).select("file", F.col("id").alias("_oid"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    return points_in_intervals(nodes, outer, "file", "start", "_s", "_e", "left_semi", also=(F.col("stop") <= F.col("_e")) & (F.col("id") != F.col("_oid")))


def descendant_counts(nodes: DataFrame, roots: list[str], counted: list[str]) -> DataFrame:
    """(file, id, n): nodes of the ``counted`` types below each node of the ``roots`` types."""
    from factloom.operators.ranges import points_in_intervals

    outer = nodes.where(F.col("type").isin(roots)).select("file", F.col("id").alias("root"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    inside = points_in_intervals(nodes.where(F.col("type").isin(counted)), outer, "file", "start", "_s", "_e", also=(F.col("stop") <= F.col("_e")) & (F.col("id") != F.col("root")))
    n = inside.groupBy("file", "root").agg(F.count("*").alias("n"))
    return outer.select("file", "root").join(n, ["file", "root"], "left").fillna(0, ["n"]).withColumnRenamed("root", "id")


def smallest_covering(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, first, last, id): the smallest node that covers each byte span."""
    from factloom.operators.ranges import points_in_intervals

    outer = nodes.select("file", F.col("id"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    hits = points_in_intervals(spans, outer, "file", "first", "_s", "_e", also=F.col("last") <= F.col("_e"))
    return hits.groupBy("file", "first", "last").agg(F.min_by("id", F.struct(F.col("_e") - F.col("_s"), -F.col("id"))).alias("id"))

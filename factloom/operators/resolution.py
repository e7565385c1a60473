"""Callables, hierarchies of types, cycles within modules and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import package_of
from factloom.operators.graph import strong_components


def resolve_callables(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, arity, fqn, how) of calls (file, package, name, arity); a negative arity is unknown.

    An explicit import decides; else a dotted name is itself; else the same
    package (no wildcards); else the simple name over all. Candidates must
    have the arity where it is known.
    """
    known = symbols.select("fqn", "name", F.col("arity").alias("_arity"), package_of(F.col("fqn")).alias("package")).distinct()
    c = calls.select("file", "package", "name", "arity").distinct()
    explicit = imports.where(~F.col("import").endswith("*")).select("file", F.regexp_extract("import", r"([^.]*)$", 1).alias("name"), F.col("import").alias("fqn"))
    fits = (F.col("arity") < 0) | (F.col("arity") == F.col("_arity"))
    by = ["file", "name", "arity"]
    # Tier by tier, so that a simple name meets all symbols of that name only where nothing better was found.
    tiers = [
        ("import", lambda left: left.join(explicit, ["file", "name"])),
        ("dotted", lambda left: left.where(F.col("name").contains(".")).withColumn("fqn", F.col("name"))),
        ("package", lambda left: left.join(known, ["package", "name"]).where(fits)),
        ("name", lambda left: left.join(known.drop("package"), "name").where(fits)),
    ]
    left, out = c, None
    for how, tier in tiers:
        hits = tier(left).select(*by, "fqn", F.lit(how).alias("how")).distinct()
        out = hits if out is None else out.unionByName(hits)
        left = left.join(hits.select(by).distinct(), by, "left_anti")
    return out


def cycles_within(edges: DataFrame, home: DataFrame) -> DataFrame:
    """(module, node, component) of cycles among edges whose ends have the same home (node, module)."""
    at = lambda end: home.select(F.col("node").alias(end), F.col("module").alias(f"{end}_m"))
    inside = edges.join(at("src"), "src").join(at("dst"), "dst").where("src_m = dst_m").select("src", "dst")
    return strong_components(inside).join(home, "node").select("module", "node", "component")


def subtypes_of(pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Pairs (type, wanted) where the type is the wanted one or lists it among its ancestors (type, ancestor)."""
    same = pairs.where("type = wanted")
    listed = pairs.where("type <> wanted").join(ancestors.select("type", F.col("ancestor").alias("wanted")).distinct(), ["type", "wanted"], "left_semi")
    return same.unionByName(listed)


def rename_plan(symbols: DataFrame, refs: DataFrame, imports: DataFrame, renames: DataFrame) -> DataFrame:
    """(file, line, start, stop, replacement, rule) of edits for renames (fqn, new_name).

    A reference is renamed where its file declares the symbol, imports it, or
    is in its package; a name that means another symbol there is left alone.
    """
    named = renames.select("fqn", "new_name").distinct().withColumn("name", F.regexp_extract("fqn", r"([^.]*)$", 1))
    sees = (
        symbols.join(named.select("fqn"), "fqn", "left_semi").select("fqn", "file")
        .union(imports.select(F.col("import").alias("fqn"), "file").join(named.select("fqn"), "fqn", "left_semi"))
        .union(named.withColumn("package", package_of(F.col("fqn"))).join(symbols.select(package_of(F.col("fqn")).alias("package"), "file").distinct(), "package").select("fqn", "file"))
    ).distinct()
    other = imports.select("file", F.regexp_extract("import", r"([^.]*)$", 1).alias("name"), F.col("import").alias("_means")).where("name <> '*'")
    uses = named.join(sees, "fqn").join(refs.where(~F.col("in_comment")).select("file", "name", "line", "start_byte"), ["file", "name"])
    clash = uses.join(other, ["file", "name"]).where("_means <> fqn").select("fqn", "file").distinct()
    return uses.join(clash, ["fqn", "file"], "left_anti").select("file", "line", F.col("start_byte").alias("start"), (F.col("start_byte") + F.length("name")).alias("stop"), F.col("new_name").alias("replacement"), F.lit("rename").alias("rule")).distinct()


def mock_usage(docs: DataFrame) -> DataFrame:
    """(doc_id, library, mocks, unused) of test texts: mocks named by ``val x = mock…(``; unused if neither stubbed, verified nor used again."""
    name = r"val\s+(\w+)\s*(?::\s*[\w<>.]+\s*)?=\s*(?:mock|mockk|spyk|mockkClass)\b"
    library = F.when(F.col("text").contains("io.mockk"), "mockk").when(F.col("text").contains("org.mockito"), "mockito").otherwise("other")
    each = docs.select("doc_id", "text", library.alias("library"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(name), F.lit(1)))).alias("mock"))
    again = F.size(F.split("text", F.concat(F.lit(r"\b"), F.col("mock"), F.lit(r"\b")))) > 2
    return each.groupBy("doc_id", "library").agg(F.count("*").alias("mocks"), F.count_if(~again).alias("unused"))


def config_fingerprint(settings: DataFrame, by: list[str]) -> DataFrame:
    """(by, fingerprint): hash over the sorted distinct ``key=value`` settings."""
    line = F.concat_ws("=", "key", F.coalesce("value", F.lit("")))
    return settings.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("fingerprint"))


def keyed_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both, those of ``left`` first (column ``pos``)."""
    rows = left.select(F.col(key), F.lit(0).alias("pos")).unionByName(right.select(F.col(key), F.lit(1).alias("pos")))
    return rows.groupBy(key).agg(F.min("pos").alias("pos"))

"""Lookups, aggregates and joins over symbols and references.

Symbols have (name, fqn, kind, visibility, file, line, start_byte, module,
flags), references (name, file, line, in_comment, start_byte, module). A null
name never matches. Every function works on any DataFrame with the columns it
names; further columns are ignored unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def symbol_names(symbols: DataFrame, *keep: str) -> DataFrame:
    """Each symbol under its name and, where that differs, its qualified name (column ``ref``)."""
    return symbols.select(*keep, F.explode(F.array_distinct(F.array_compact(F.array("name", "fqn")))).alias("ref"))


def lookup_by_fqn(symbols: DataFrame) -> DataFrame:
    """One symbol per qualified name: the last in (file, start_byte) order."""
    last = F.max(F.struct("file", "start_byte", "name", "kind", "visibility")).alias("s")
    return symbols.where(F.col("fqn") != "").groupBy("fqn").agg(last).select("fqn", "s.name", "s.kind", "s.visibility", "s.file", "s.start_byte")


def first_declarations(symbols: DataFrame) -> DataFrame:
    """(name, decl_file, kind): the first declaration of each name by file and offset."""
    first = F.min(F.struct("file", "start_byte", "kind")).alias("f")
    return symbols.groupBy("name").agg(first).select("name", F.col("f.file").alias("decl_file"), F.col("f.kind").alias("kind"))


def reference_aggregate(refs: DataFrame) -> DataFrame:
    """Per name: references, files, files outside comments."""
    return refs.groupBy("name").agg(
        F.count("*").alias("n_refs"),
        F.countDistinct("file").alias("n_files"),
        F.countDistinct(F.when(~F.col("in_comment"), F.col("file"))).alias("n_code_files"),
    )


def reference_count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("name").agg(F.count("*").alias("n_refs"))


def symbol_reference_count(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(fqn, name, n_refs): references to the name plus those to a different qualified name."""
    counts = reference_count(refs).withColumnRenamed("name", "ref")
    keys = symbols.select("fqn", "name").distinct()
    hits = symbol_names(keys, "fqn", "name").join(counts, "ref", "left")
    return hits.groupBy("fqn", "name").agg(F.sum(F.coalesce("n_refs", F.lit(0))).alias("n_refs"))


def local_reference_count(refs: DataFrame) -> DataFrame:
    """(name, file, n): references outside comments."""
    return refs.where(~F.col("in_comment")).groupBy("name", "file").agg(F.count("*").alias("n_refs"))


def symbol_fan_in(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, kind, decl_file, fan_in): distinct files that reference a name, its first declaring file excepted."""
    files = refs.select("name", "file").distinct()
    decl = first_declarations(symbols)
    return decl.join(files, (decl["name"] == files["name"]) & (decl["decl_file"] != files["file"]), "left").groupBy(decl["name"], "kind", "decl_file").agg(F.count("file").alias("fan_in"))


def hotspots(symbols: DataFrame, refs: DataFrame, threshold: int) -> DataFrame:
    """Names with a fan-in above ``threshold`` (strict), by fan-in, then name."""
    return symbol_fan_in(symbols, refs).where(F.col("fan_in") > threshold).orderBy(F.desc("fan_in"), "name")


def declaration_fan_in(symbols: DataFrame, refs: DataFrame, kinds: list[str] | None = None, at_least: int = 0) -> DataFrame:
    """Fan-in of each declaration row, its own file excepted; ``at_least`` is inclusive."""
    some = symbols if kinds is None else symbols.where(F.col("kind").isin(kinds))
    keyed = some.select("name", "fqn", "kind", "file", "line", "start_byte")
    by_name = refs.select("name", F.col("file").alias("ref_file")).distinct()
    total = by_name.groupBy("name").agg(F.count("*").alias("_all"))
    own = by_name.select("name", F.col("ref_file").alias("file"), F.lit(1).alias("_own"))
    out = keyed.join(total, "name", "left").join(own, ["name", "file"], "left")
    return out.withColumn("fan_in", F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).where(F.col("fan_in") >= at_least).drop("_all", "_own")


def referenced_elsewhere(symbols: DataFrame, refs: DataFrame, strict_fqn: bool = False, count_comments: bool = True) -> DataFrame:
    """Symbols with a reference in another file (left semi).

    ``strict_fqn`` matches the qualified name where there is one.
    """
    used = refs if count_comments else refs.where(~F.col("in_comment"))
    used = used.select(F.col("name").alias("_ref"), F.col("file").alias("_file")).distinct()
    key = F.coalesce(F.nullif("fqn", F.lit("")), F.col("name")) if strict_fqn else F.col("name")
    return symbols.join(used, (key == F.col("_ref")) & (F.col("file") != F.col("_file")), "left_semi")


def unused_symbols(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols that nothing uses (left anti).

    Overrides, mains, tests and private symbols are left out. A symbol is used
    by a reference to its name or qualified name in another file, or by more
    than one in its own, since its declaration counts as one.
    """
    some = symbols.where(~F.col("is_override") & ~F.col("is_main") & ~F.col("is_test") & (F.col("visibility") != "private"))
    code = refs.where(~F.col("in_comment")).groupBy("name", "file").agg(F.count("*").alias("_n"))
    keyed = symbol_names(some.select("fqn", "name", "file", "start_byte").distinct(), "fqn", "name", "file", "start_byte")
    total = code.groupBy("name").agg(F.sum("_n").alias("_all")).withColumnRenamed("name", "ref")
    own = code.withColumnRenamed("name", "ref").withColumnRenamed("_n", "_own")
    counted = keyed.join(total, "ref", "left").join(own, ["ref", "file"], "left").groupBy("fqn", "name", "file", "start_byte").agg(
        F.sum(F.coalesce("_all", F.lit(0))).alias("_all"), F.sum(F.coalesce("_own", F.lit(0))).alias("_own")
    )
    used = counted.where((F.col("_all") > F.col("_own")) | (F.col("_own") > 1)).select("fqn", "name", "file", "start_byte")
    return some.join(used, ["fqn", "name", "file", "start_byte"], "left_anti")


def importers(imports: DataFrame) -> DataFrame:
    """(target, file): files that import a qualified name, or a whole package as ``package.*``."""
    return imports.select(F.col("import").alias("target"), "file").distinct()


def affected_by_import(changed: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Changed files (file) and the files importing what they declare, or its package."""
    fqns = symbols.join(changed.select("file").distinct(), "file", "left_semi").select("fqn").distinct()
    package = F.concat(F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1), F.lit(".*"))
    targets = fqns.select(F.explode(F.array("fqn", package)).alias("import")).distinct()
    return imports.join(targets, "import", "left_semi").select("file").union(changed.select("file")).distinct()


def affected_set(changed: DataFrame, versions: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Changed files, the referrers of what they declare and the declarers of what they reference.

    Computed over every (symbols, refs) version given, such as the one before
    and the one after a change, so what was removed still counts.
    """
    out = changed.select("file")
    hit = changed.select("file").distinct()
    for symbols, refs in versions:
        declared = symbols.join(hit, "file", "left_semi").select("name").distinct()
        referrers = refs.join(declared, "name", "left_semi").select("file")
        wanted = refs.join(hit, "file", "left_semi").select("name").distinct()
        declarers = symbols.join(wanted, "name", "left_semi").select("file")
        out = out.union(referrers).union(declarers)
    return out.distinct()


def overlay(prior: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The prior rows of unchanged files and the fresh rows of changed ones."""
    return prior.join(changed.select("file").distinct(), "file", "left_anti").unionByName(fresh)


def resolve_types(wanted: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, name, fqn, how): what a type name means in a file.

    An explicit import decides, even for an undeclared target; else a dotted
    name is itself; else all candidates of wildcard imports; only without any,
    the simple name over all symbols.
    """
    package = F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1)
    known = symbols.select("fqn", "name", package.alias("package")).distinct()
    w = wanted.select("file", "name").distinct()
    simple = F.regexp_extract("import", r"([^.]*)$", 1)
    explicit = imports.where(simple != "*").select("file", simple.alias("name"), F.col("import").alias("fqn")).distinct()
    wild = imports.where(simple == "*").select("file", F.regexp_extract("import", r"^(.*)\.\*$", 1).alias("package"), F.lit(1).alias("_wild")).distinct()
    imported = w.join(explicit, ["file", "name"]).select("file", "name", "fqn", F.lit("import").alias("how"))
    left = w.join(explicit, ["file", "name"], "left_anti")
    dotted = left.where(F.col("name").contains(".")).select("file", "name", F.col("name").alias("fqn"), F.lit("dotted").alias("how"))
    # Each candidate once; those of a wildcard import push out the others of the name.
    candidates = left.where(~F.col("name").contains(".")).join(known, "name").join(wild, ["file", "package"], "left")
    any_ = F.max("_wild").over(Window.partitionBy("file", "name"))
    kept = candidates.withColumn("_any", any_).where(F.col("_any").isNull() | F.col("_wild").isNotNull())
    named = kept.select("file", "name", "fqn", F.when(F.col("_any").isNull(), "name").otherwise("wildcard").alias("how"))
    return imported.unionByName(dotted).unionByName(named)


def dependents(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(fqn, file): files outside the declaring one that reference a symbol by either name."""
    keyed = symbol_names(symbols.select("fqn", "name", F.col("file").alias("own")).distinct(), "fqn", "own")
    return keyed.join(refs.select(F.col("name").alias("ref"), "file").distinct(), "ref").where(F.col("file") != F.col("own")).select("fqn", "file").distinct()


def blast_radius(changed_lines: DataFrame, symbols: DataFrame, refs: DataFrame, limit: int | None = 20) -> DataFrame:
    """(fqn, consumers, modules) of symbols declared on changed lines (file, first, last)."""
    hit = symbols.join(changed_lines, "file").where(F.col("line").between(F.col("first"), F.col("last"))).select("fqn", "name", "file").distinct()
    keyed = symbol_names(hit.withColumnRenamed("file", "own"), "fqn", "own")
    used = keyed.join(refs.select(F.col("name").alias("ref"), "file", "module").distinct(), "ref").where(F.col("file") != F.col("own"))
    out = used.groupBy("fqn").agg(F.countDistinct("file").alias("consumers"), F.countDistinct("module").alias("modules")).orderBy(F.desc("consumers"), "fqn")
    return out if limit is None else out.limit(limit)


def select_tests(changed: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Test files that reference anything declared in a changed file that is no test itself."""
    declared = symbols.where(~F.col("is_test")).join(changed.select("file").distinct(), "file", "left_semi").select("fqn", "name").distinct()
    names = symbol_names(declared).distinct().withColumnRenamed("ref", "name")
    return refs.where("is_test").join(names, "name", "left_semi").select("file").distinct()


def untested_public(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Public symbols outside tests that no test references."""
    public = symbols.where((F.col("visibility") == "public") & ~F.col("is_test")).select("fqn", "name").distinct()
    tested = refs.where("is_test").select(F.col("name").alias("ref")).distinct()
    covered = symbol_names(public, "fqn", "name").join(tested, "ref", "left_semi").select("fqn", "name").distinct()
    return public.join(covered, ["fqn", "name"], "left_anti")


def module_usage(symbols: DataFrame, refs: DataFrame, modules: DataFrame) -> DataFrame:
    """(fqn, module, verdict) of public symbols of unpublished modules.

    ``dead`` without any use, ``could-be-internal`` if only its own module
    uses it, else ``used``.
    """
    mine = symbols.where((F.col("visibility") == "public") & ~F.col("is_main")).join(modules.where(~F.col("is_published")).select(F.col("path").alias("module")), "module", "left_semi")
    keyed = symbol_names(mine.select("fqn", "name", "module").distinct(), "fqn", "module")
    uses = refs.where(~F.col("in_comment")).select(F.col("name").alias("ref"), F.col("module").alias("by")).distinct()
    joined = keyed.join(uses, "ref", "left").groupBy("fqn", "module").agg(
        F.max(F.coalesce((F.col("by") == F.col("module")).cast("int"), F.lit(0))).alias("inside"), F.max(F.coalesce((F.col("by") != F.col("module")).cast("int"), F.lit(0))).alias("outside")
    )
    verdict = F.when(F.col("outside") == 1, "used").when(F.col("inside") == 1, "could-be-internal").otherwise("dead")
    return joined.select("fqn", "module", verdict.alias("verdict"))


def collaborators(symbols: DataFrame, refs: DataFrame, seed_file: Column | str) -> DataFrame:
    """(file, score, symbol): other files whose public symbols the seed file uses, by uses."""
    uses = refs.where((F.col("file") == seed_file) & ~F.col("in_comment")).groupBy(F.col("name").alias("ref")).agg(F.count("*").alias("_n"))
    keyed = symbol_names(symbols.where((F.col("visibility") == "public") & (F.col("file") != seed_file)).select("fqn", "name", "file").distinct(), "fqn", "name", "file")
    return keyed.join(uses, "ref").groupBy("file").agg(F.sum("_n").alias("score"), F.min("name").alias("symbol")).orderBy(F.desc("score"), "symbol", "file")


def used_external(imports: DataFrame, refs: DataFrame, own_packages: DataFrame) -> DataFrame:
    """(kind, name): imports and dotted references outside the module's own packages."""
    named = imports.select(F.lit("import").alias("kind"), F.col("import").alias("name")).union(refs.where(F.col("name").contains(".")).select(F.lit("reference"), "name")).distinct()
    package = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    return named.join(own_packages.select(F.col("package").alias("_p")).distinct(), package == F.col("_p"), "left_anti")


def estimated_names(references: int) -> int:
    """How many distinct names an index of so many references is sized for: a sixteenth, within fixed bounds."""
    return min(max(references // 16, 1024), 262_144)


def index_statistics(refs: DataFrame, error: float = 0.02) -> DataFrame:
    """(refs, names, files): rows, and estimates of the distinct names and files; one pass of sketches, combined on the map side."""
    return refs.agg(F.count("*").alias("refs"), F.approx_count_distinct("name", error).alias("names"), F.approx_count_distinct("file", error).alias("files"))


def dispatch_order(files: DataFrame) -> DataFrame:
    """Files (path, bytes) in the order in which they are best begun: the largest first, ties by path."""
    return files.orderBy(F.desc("bytes"), "path")

"""Relations over compiler facts (see ``factloom.operators.nested``): declarations, supertypes, calls, and the filters that ask for them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.nested import NestedTables


def simple_callee(target):
    """The last dotted part of a call target."""
    return F.regexp_extract(target, r"([^.]*)$", 1)


def calls(tables: NestedTables) -> DataFrame:
    """(record_id, file, line, col, target, resolved): calls with a target; a place that isn't ``line:col`` has null numbers."""
    rows = tables.table("expression").where("callTarget <> ''")
    place = F.split("name", ":")
    return rows.select("record_id", F.col("unit").alias("file"), F.get(place, F.lit(0)).try_cast("int").alias("line"), F.get(place, F.lit(1)).try_cast("int").alias("col"), F.col("callTarget").alias("target"), F.coalesce("callTargetResolved", F.lit(False)).alias("resolved"))


def supertypes(tables: NestedTables) -> DataFrame:
    """(fqn, supertype): each link of a class to what it extends or implements, once."""
    return tables.table("declaration").where("fqn <> ''").select("fqn", F.explode("supertypes").alias("supertype")).where("supertype <> ''").distinct()


def symbols(tables: NestedTables) -> DataFrame:
    """(record_id, file, fqn, name, owner, kind, visibility, arity, line): declarations and their members; a member has no line and its number of parameters."""
    declared = tables.table("declaration").where("fqn <> ''").select("record_id", F.col("unit").alias("file"), "path", "fqn", F.regexp_extract("fqn", r"([^.]*)$", 1).alias("name"), F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1).alias("owner"), "kind", "visibility", F.lit(None).cast("int").alias("arity"), "line")
    n = tables.table("param").groupBy("record_id", F.col("unit").alias("file"), F.col("parent_path").alias("path")).agg(F.count("*").cast("int").alias("arity"))
    members = tables.table("member").where("own_name <> ''").select("record_id", F.col("unit").alias("file"), "path", "parent_path", F.col("own_name").alias("name"), "kind", "visibility")
    home = declared.select("record_id", "file", F.col("path").alias("parent_path"), F.col("fqn").alias("owner"))
    owned = members.join(home, ["record_id", "file", "parent_path"]).join(n, ["record_id", "file", "path"], "left")
    of_members = owned.select("record_id", "file", "path", F.concat_ws(".", "owner", "name").alias("fqn"), "name", "owner", "kind", "visibility", F.coalesce("arity", F.lit(0)).alias("arity"), F.lit(None).cast("bigint").alias("line"))
    return declared.unionByName(of_members).drop("path")


def files_to_ask(docs: DataFrame, filters: dict[str, list[str] | None], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the texts that hold what some rule looks for.

    ``filters`` names the texts of each rule; None asks for all files, which
    makes all of them wanted. Empty texts are none, and rules without any ask
    for no file.
    """
    if any(wanted is None for wanted in filters.values()):
        return docs.select(key)
    texts = sorted({t for wanted in filters.values() for t in wanted or () if t})
    held = reduce(or_, (F.col(text).contains(t) for t in texts), F.lit(False))
    return docs.where(held).select(key)


def call_target_filter(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls whose callee has the simple name of one of the ``targets`` (target), the union over all rules."""
    names = targets.where("target <> ''").select(simple_callee("target").alias("callee")).where("callee <> ''").distinct()
    return calls.withColumn("callee", simple_callee("target")).join(names, "callee", "left_semi")

"""Problem 1: deeply nested records to related flat tables.

One depth-first pass over each record emits tagged rows
(tag, record id, unit key, path, parent path, name, payload). The payload is a
list of texts by position, not a document that would have to be parsed again.
The rows are written once, partitioned by tag, and every tag is read back under
its own schema, so one parse of the records serves all the tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.scratch import Scratch, exists

#: Column types a payload field may have, with the value read from JSON.
KINDS = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class Entity:
    """What one level of nesting becomes.

    ``at`` is the key below the parent; ``keyed`` says that it holds a map of
    objects rather than a list. ``name`` is the field shown as the row's name,
    or ``None`` to show the map key. ``fields`` maps payload fields to a kind.
    """

    tag: str
    at: str
    name: str | None = None
    keyed: bool = False
    fields: dict[str, str] = field(default_factory=dict)
    children: tuple["Entity", ...] = ()


_PARAM = Entity("param", "params", "name", fields={"name": "string", "type": "string", "nullable": "boolean"})
_MEMBER = Entity(
    "member", "members", "name",
    fields={"name": "string", "kind": "string", "returnType": "string", "nullable": "boolean", "visibility": "string", "isOverride": "boolean", "annotations": "strings"},
    children=(_PARAM,),
)
_DECLARATION = Entity(
    "declaration", "declarations", "fqn",
    fields={"fqn": "string", "kind": "string", "supertypes": "strings", "isSealed": "boolean", "isData": "boolean", "isOpen": "boolean", "isAbstract": "boolean", "visibility": "string", "typeParameters": "strings", "line": "long"},
    children=(_MEMBER,),
)
_EXPRESSION = Entity("expression", "expressions", keyed=True, fields={"type": "string", "nullable": "boolean", "startByte": "long", "callTarget": "string", "callTargetResolved": "boolean"})
_DIAGNOSTIC = Entity("diagnostic", "diagnostics", "factoryName", fields={"factoryName": "string", "severity": "string", "message": "string", "line": "long", "col": "long", "startByte": "long"})
#: Documents of compiler facts: files, and what lies below them.
COMPILER_FACTS = Entity("file", "files", "package", keyed=True, fields={"package": "string"}, children=(_DECLARATION, _EXPRESSION, _DIAGNOSTIC))

_TAGGED = pa.schema([("tag", pa.string()), ("record_id", pa.int64()), ("unit", pa.string()), ("path", pa.string()), ("parent_path", pa.string()), ("name", pa.string()), ("scalars", pa.list_(pa.string())), ("lists", pa.list_(pa.list_(pa.string())))])
TAGGED = "tag string, record_id bigint, unit string, path string, parent_path string, name string, scalars array<string>, lists array<array<string>>"
#: The tag of records that hold no readable object.
UNREADABLE = "unreadable"


def _refuse(token: str) -> None:
    raise ValueError(token)


def _text(value: object) -> str:
    """A scalar as text; lone surrogates, which no column can hold, become U+FFFD."""
    if value.__class__ is str and value.isascii():
        return value
    if value is None:
        return ""
    out = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return out if out.isascii() else out.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def _string(value: object) -> str | None:
    return value if value is None or (value.__class__ is str and value.isascii()) else _text(value)


def _whole(value: object) -> str | None:
    if isinstance(value, bool):
        return None
    try:
        got = int(value) if isinstance(value, (int, str)) else int(value) if isinstance(value, float) and value.is_integer() else None
    except ValueError:
        return None
    return str(got) if got is not None and -(2**63) <= got < 2**63 else None


def _truth(value: object) -> str | None:
    got = value if isinstance(value, str) else "true" if value is True else "false" if value is False else ""
    return got if (got := got.strip().lower()) in ("true", "false") else None


def _texts(value: object) -> list[str] | None:
    if value is None:
        return None
    return [_text(x) for x in (value if isinstance(value, list) else [value]) if x is not None]


_READ: dict[str, Callable[[object], str | None]] = {"string": _string, "long": _whole, "boolean": _truth}


def parse_object(text: str | None) -> dict | None:
    """The one complete JSON object that ``text`` is, or None."""
    if not text:
        return None
    try:
        got = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def visit(record_id: int | None, root: dict, spec: Entity, emit: Callable[..., None], with_payload: bool = True) -> None:
    """Depth-first walk of one record; emits rows in the order of the columns of TAGGED.

    A row's payload is the texts of its entity's fields in their order, those
    that hold one value apart from those that hold a list.
    """
    plans = {}
    for e in _entities(spec):
        scalars = [(k, _READ[kind]) for k, kind in e.fields.items() if kind != "strings"] if with_payload else []
        plans[e.tag] = scalars, [k for k, kind in e.fields.items() if kind == "strings"] if with_payload else []

    def one(spec: Entity, node: dict, unit: str, path: str, parent: str, name: object) -> None:
        scalars, lists = plans[spec.tag]
        get = node.get
        emit(spec.tag, record_id, unit, path, parent, _text(name), [read(get(k)) for k, read in scalars], [_texts(get(k)) for k in lists])

    def below(spec: Entity, holder: dict, unit: str, prefix: str, parent: str) -> None:
        inside = holder.get(spec.at)
        if inside is None:
            return
        if spec.keyed:
            items = inside.items() if isinstance(inside, dict) else ()
        else:
            items = enumerate([inside] if isinstance(inside, dict) else inside if isinstance(inside, list) else ())
        for key, node in items:
            if isinstance(node, dict):
                path = f"{prefix}{spec.at}/{_text(key)}"
                one(spec, node, unit, path, parent, key if spec.name is None else node.get(spec.name))
                for child in spec.children:
                    below(child, node, unit, path + "/", path)

    units = root.get(spec.at)
    for unit, node in units.items() if isinstance(units, dict) else ():
        if isinstance(node, dict):
            unit = _text(unit)
            one(spec, node, unit, "", "", node.get(spec.name) if spec.name else unit)
            for child in spec.children:
                below(child, node, unit, "", "")


def newest_payload(df: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """One non-null payload per key, the last delivered; ties by the greater text.

    Combined on the map side, so a key delivered very often moves only once
    per task.
    """
    return df.where(F.col(payload).isNotNull()).groupBy(F.col(key).cast("bigint").alias("record_id")).agg(F.max(F.struct(F.col(order), F.col(payload).alias("payload"))).alias("last")).select("record_id", "last.payload")


class _Tagged:
    """Tagged rows by column, the lists of a row as stretches of flat ones."""

    def __init__(self) -> None:
        self.tags, self.ids, self.units, self.paths, self.parents, self.names = [], [], [], [], [], []
        self.scalars, self.scalar_ends = [], [0]
        # A list that is null starts nowhere.
        self.texts, self.starts, self.list_ends = [], [], [0]

    def add(self, tag: str, record_id: int | None, unit: str, path: str, parent: str, name: str, scalars: list, lists: list) -> None:
        self.tags.append(tag)
        self.ids.append(record_id)
        self.units.append(unit)
        self.paths.append(path)
        self.parents.append(parent)
        self.names.append(name)
        self.scalars += scalars
        self.scalar_ends.append(len(self.scalars))
        for texts in lists:
            self.starts.append(None if texts is None else len(self.texts))
            self.texts += texts or ()
        self.list_ends.append(len(self.starts))

    def flush(self, most: int) -> Iterator[pa.RecordBatch]:
        """What was added, in batches of at most ``most`` rows."""
        if not self.tags:
            return
        string, int32 = pa.string(), pa.int32()
        inner = pa.ListArray.from_arrays(pa.array([*self.starts, len(self.texts)], int32), pa.array(self.texts, string))
        columns = [pa.array(c, string) for c in (self.tags, self.units, self.paths, self.parents, self.names)]
        columns.insert(1, pa.array(self.ids, pa.int64()))
        columns.append(pa.ListArray.from_arrays(pa.array(self.scalar_ends, int32), pa.array(self.scalars, string)))
        columns.append(pa.ListArray.from_arrays(pa.array(self.list_ends, int32), inner))
        whole = pa.RecordBatch.from_arrays(columns, schema=_TAGGED)
        self.__init__()
        for start in range(0, whole.num_rows, most):
            yield whole.slice(start, most)


def readable_payloads(df: DataFrame) -> DataFrame:
    """The rows (record_id, order, payload) whose payload is one complete JSON object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([parse_object(t.as_py()) is not None for t in batch.column(2)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def emit_tagged(records: DataFrame, spec: Entity = COMPILER_FACTS, with_payload: bool = True, rows_per_batch: int = 20_000, report: bool = False) -> DataFrame:
    """Tagged rows of all records (record_id, payload).

    Unreadable, null or empty payloads, and payloads that are not one JSON
    object, give no rows; with ``report`` they give one with the tag
    UNREADABLE. A lone object stands for a list of one; null elements give no
    row but count as positions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Tagged()
        for batch in batches:
            for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = parse_object(text.as_py())
                if root is not None:
                    visit(record_id, root, spec, rows.add, with_payload)
                elif report:
                    rows.add(UNREADABLE, record_id, "", "", "", "", [], [])
                if len(rows.tags) >= rows_per_batch:
                    yield from rows.flush(rows_per_batch)
        yield from rows.flush(rows_per_batch)

    return records.select("record_id", "payload").mapInArrow(run, TAGGED)


def _entities(spec: Entity) -> Iterator[Entity]:
    yield spec
    for child in spec.children:
        yield from _entities(child)


class NestedTables:
    """The flat tables of a set of records, written once by tag.

    ``df`` has the records' ``key``, ``payload`` and ``order`` of delivery. Of
    a record delivered several times the last readable payload counts; a null
    key is a record of its own. Every table has record_id, unit, path,
    parent_path (the parent's path in the same record and unit), name, and the
    entity's own fields. An empty input gives empty tables.
    """

    def __init__(self, df: DataFrame, key: str, payload: str, order: str, spec: Entity = COMPILER_FACTS, label: str = "nested", with_payload: bool = True):
        self.entities = {e.tag: e for e in _entities(spec)}
        self.spark = df.sparkSession
        self.scratch = Scratch(self.spark, label)
        self._write(newest_payload(df, key, payload, order), spec, with_payload, "overwrite")
        self._all = self.spark.read.schema(f"{TAGGED.removeprefix('tag string, ')}, tag string").parquet(self.scratch.path("tagged"))
        if exists(self.spark, folder := self.scratch.path(f"tagged/tag={UNREADABLE}")):
            # The last delivery can't be read: look for the last one of these records that can.
            failed = self.spark.read.schema("record_id bigint").parquet(folder)
            sent = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(order).alias("o"), F.col(payload).alias("payload")).where(F.col("payload").isNotNull())
            again = sent.alias("s").join(failed.alias("f"), F.col("s.record_id").eqNullSafe(F.col("f.record_id")), "left_semi").select("record_id", "o", "payload")
            self._write(newest_payload(readable_payloads(again), "record_id", "payload", "o"), spec, with_payload, "append")
            self._all = self.spark.read.schema(self._all.schema).parquet(self.scratch.path("tagged"))

    def _write(self, records: DataFrame, spec: Entity, with_payload: bool, mode: str) -> None:
        emit_tagged(records, spec, with_payload, report=mode == "overwrite").write.mode(mode).partitionBy("tag").option("compression", "lz4").parquet(self.scratch.path("tagged"))

    def table(self, tag: str) -> DataFrame:
        fields, at = [], {"scalars": 0, "lists": 0}
        for k, kind in self.entities[tag].fields.items():
            held = "lists" if kind == "strings" else "scalars"
            fields.append(F.get(held, F.lit(at[held])).cast(KINDS[kind]).alias(k if k not in {"name", "path", "unit"} else f"own_{k}"))
            at[held] += 1
        return self._all.where(F.col("tag") == tag).select("record_id", "unit", "path", "parent_path", "name", *fields)

    def links(self) -> DataFrame:
        """All rows with their parent links, without payloads."""
        return self._all.where(F.col("tag") != UNREADABLE).select("record_id", "unit", F.col("tag").alias("entity"), "path", "parent_path", "name")

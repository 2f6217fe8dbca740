"""Deeply nested JSON into flat rows that keep their parent, by higher-order SQL projection.

A payload is one array expression: ``aggregate`` steps from level to level, nested ``transform`` calls
attach path and nearest enclosing item to each child, ``flatten`` joins the children of a level, and one
``inline`` emits the rows.  There is no shuffle and no fixed depth: steps come in rungs, and a text climbs to the next rung
only if something is left.  ``flatten_tables`` makes related tables of it: one for each kind of object, with a row
for each object, its own fields as columns, and the keys of its event and its parent.

A frontier entry is an object (``m``), an array (``a``) or a string that may be JSON text (``s``); such a
string has one child at its own path, the value it encodes.

Defined cases: null, blank and unparsable payloads (text after the value included) give nothing; of a
repeated object key the last value counts; a string counts as the object or array that it
encodes, also when it was encoded several times over; keys are taken as they are, dots included.  The JVM's parser
stops at a thousand levels; a text that may be deeper is walked in Python, by Arrow batches, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronolith.functions.jsontext import Number, parse, storable, written
from chronolith.runtime import materialize, settings

#: JSON white space, then what may start an object, an array or a string.
_OPENS = r"^[ \\t\\r\\n]*[\\[{\"]"

_ENTRY = "struct<path:string,item:string,m:map<string,variant>,a:array<variant>,s:string,element:boolean>"
_NODE = "array<struct<path:string,parent:string,object:map<string,variant>>>"


def _entry(path: str, item: str, value: str, element: str) -> str:
    """A frontier entry for a variant: cast once, and its text is looked at only if it is no container."""
    cast_once = f"named_struct('m', try_cast({value} AS map<string,variant>), 'a', try_cast({value} AS array<variant>))"
    text = f"filter(array(try_cast({value} AS string)), s -> substr(ltrim(' \\t\\r\\n', s), 1, 1) IN ('{{', '[', '\"'))"
    return f"""transform(array({cast_once}), y -> named_struct(
      'path', {path}, 'item', {item}, 'm', y.m, 'a', y.a, 's', CASE WHEN y.m IS NULL AND y.a IS NULL THEN get({text}, 0) END, 'element', {element}))[0]"""


#: The items below an entry: an object that is an element of an array is the parent of what it holds.
_ITEM = "if(f.element AND f.m IS NOT NULL, f.path, f.item)"

_CHILDREN = f"""filter(coalesce(
  CASE
    WHEN f.m IS NOT NULL THEN transform(map_entries(f.m), e -> {_entry("if(f.path = '', e.key, concat(f.path, '.', e.key))", _ITEM, "e.value", "false")})
    WHEN f.a IS NOT NULL THEN transform(f.a, (x, i) -> {_entry("concat(f.path, '[', i, ']')", _ITEM, "x", "true")})
    ELSE transform(filter(array(try_cast(try_parse_json(concat('[', f.s, ']')) AS array<variant>)), w -> size(w) = 1),
                   w -> {_entry("f.path", "f.item", "w[0]", "f.element")})
  END, array()),
  c -> c.m IS NOT NULL OR c.a IS NOT NULL OR c.s IS NOT NULL)"""

#: Steps are taken in rungs, each only if the one before left something: an idle step copies all that was found, so a text takes at most some
#: eight times as many steps as it has levels.  The last rung has as many as any text of its length can need.
_RUNGS = (12, 96, 768)


def climb(start: str, step: str, text: str, done: str = "size(acc.f) = 0") -> str:
    """``start`` taken through ``step`` (acc -> acc) until ``done`` holds, at most once for each character of the text."""
    out = f"aggregate(sequence(1, {_RUNGS[0]}), {start}, (acc, level) -> if({done}, acc, {step}))"
    for rung in [*map(str, _RUNGS[1:]), f"length({text}) + 1"]:
        out = f"transform(array({out}), acc -> if({done}, acc, aggregate(sequence(1, {rung}), acc, (acc, level) -> if({done}, acc, {step}))))[0]"
    return out


def objects_sql(text: str) -> str:
    """array<struct<path,parent,object>> of the objects that are elements of arrays somewhere in a JSON text."""
    start = f"""named_struct(
      'f', cast(array(named_struct('path', '', 'item', '', 'm', cast(NULL AS map<string,variant>), 'a', cast(NULL AS array<variant>), 's', {text}, 'element', false)) AS array<{_ENTRY}>),
      'out', cast(array() AS {_NODE}))"""
    step = f"""named_struct(
      'f', cast(flatten(transform(acc.f, f -> {_CHILDREN})) AS array<{_ENTRY}>),
      'out', cast(concat(acc.out, transform(filter(acc.f, f -> f.element AND f.m IS NOT NULL), f -> named_struct('path', f.path, 'parent', f.item, 'object', f.m))) AS {_NODE}))"""
    return f"CASE WHEN {text} RLIKE '{_OPENS}' THEN {climb(start, step, text)}.out END"


#: The JVM's parser refuses what is nested in more levels than this.
PARSER_DEPTH = 900


def _may_be_too_deep(text: str) -> str:
    """Whether the parser may refuse a text, or one that is encoded in it, for its depth alone.

    Such a text has many brackets, or escapes that may stand for some.  If it is parsed after all, then only a string that starts like JSON may be too deep.
    """
    marks = f"length({text}) - length(translate({text}, concat('[{{', chr(92)), ''))"
    quoted = f"{text} RLIKE concat('\" *[\\\\[{{', chr(92), chr(92), ']')"
    return f"({text} IS NOT NULL AND {marks} >= {PARSER_DEPTH} AND ({quoted} OR try_parse_json({text}) IS NULL))"


def _objects(value: Any) -> Iterator[tuple[str, str, dict]]:
    """path, parent path and object of the objects that are elements of arrays, by a stack: the same walk for any depth."""
    stack: list[tuple[Any, str, str, bool]] = [(value, "", "", False)]
    while stack:
        v, path, item, element = stack.pop()
        while isinstance(v, str) and not isinstance(v, Number):
            try:
                v = parse(v)
            except ValueError:
                v = None
        if isinstance(v, dict):
            if element:
                yield path, item, v
                item = path
            stack.extend((x, f"{path}.{k}" if path else k, item, False) for k, x in v.items())
        elif isinstance(v, list):
            stack.extend((x, f"{path}[{i}]", item, True) for i, x in enumerate(v))


def _scalars(value: dict) -> list[tuple[str, str]]:
    """The members of an object that are neither null nor containers, as text."""
    return [(storable(k), storable(str(v).lower() if isinstance(v, bool) else v)) for k, v in value.items() if isinstance(v, str | bool)]


def _walk(more: str | None):
    fields = {None: [], "object": [pa.string()], "fields": [pa.map_(pa.string(), pa.string())]}[more]
    write = {"object": lambda v: storable(written(v)), "fields": _scalars}.get(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = _objects(text)
                while some := list(islice(found, 10_000)):  # a batch stays small, whatever a text holds
                    key = batch.column(0).take(pa.array([i] * len(some), pa.int32()))
                    columns = [pa.array([storable(x[n]) for x in some], pa.string()) for n in (0, 1)] + [pa.array([write(x[2]) for x in some], t) for t in fields]
                    yield pa.RecordBatch.from_arrays([key, *columns], ["event_id", "item_path", "parent_path", more][: 3 + len(fields)])

    return run


#: The members of an object that are no containers, as text: what a flat table can have as columns.
_FIELDS = "transform_values(map_filter(object, (k, v) -> NOT is_variant_null(v) AND try_cast(v AS array<variant>) IS NULL AND try_cast(v AS map<string,variant>) IS NULL), (k, v) -> try_cast(v AS string))"


def _rows(df: DataFrame, text: str, keep: str, more: str | None = None) -> DataFrame:
    with settings(df.sparkSession, {"spark.sql.variant.allowDuplicateKeys": "true"}):  # read when the plan is made
        rows = df.select(F.col(f"`{keep}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.col("t").isNotNull())
        plain = rows.filter(f"NOT {_may_be_too_deep('t')}").select(F.col("k").alias("event_id"), F.expr(f"inline({objects_sql('t')})"))
        also = {"object": [F.to_json("object").alias("object")], "fields": [F.expr(_FIELDS).alias("fields")]}.get(more, [])
        plain = plain.select("event_id", F.col("path").alias("item_path"), F.col("parent").alias("parent_path"), *also)
        schema = f"event_id {dict(rows.dtypes)['k']}, item_path string, parent_path string" + {"object": ", object string", "fields": ", fields map<string,string>"}.get(more, "")
        return plain.unionByName(rows.filter(_may_be_too_deep("t")).mapInArrow(_walk(more), schema))


def flatten_objects(df: DataFrame, text: str = "payload", keep: str = "id", values: bool = False) -> DataFrame:
    """One row for each object that is a direct element of an array: keep, item_path, parent_path and, on request, its JSON text.

    Texts that may be too deep for the JVM's parser take the same walk in Arrow batches; no other row does.
    """
    return _rows(df, text, keep, "object" if values else None)


def kind_of(path: Column) -> Column:
    """Where in a payload an object stands, whatever its position: a path without the numbers in its brackets."""
    return F.regexp_replace(path, r"\[[0-9]+\]", "[]")


def flatten_tables(df: DataFrame, tables: dict[str, tuple[str, dict[str, str]]], text: str = "payload", keep: str = "id") -> dict[str, DataFrame]:
    """Related flat tables. tables: name -> (kind of object, {field: type}), e.g. ("a[].b[]", {"x": "bigint"}).

    Each table has event_id, item_path (its key within the event), parent_path (the key of the row of the table that its objects stand in, or
    ''), position (place in the array) and a column for every field; a field that an object lacks, or that can't be cast, is null.
    One table is a plan of its own; several share one pass over the payloads, written by kind, of which each reads its part.
    """
    wanted = [kind for kind, _ in tables.values()]
    rows = _rows(df, text, keep, "fields").withColumn("kind", kind_of(F.col("item_path"))).filter(F.col("kind").isin(wanted))
    if len(tables) > 1:
        rows = materialize(rows, "objects", ["kind"])
    position = F.regexp_extract("item_path", r"\[([0-9]+)\]$", 1).cast("int").alias("position")
    field = lambda name, kind: F.expr(f"try_cast(fields['{name}'] AS {kind})").alias(name)
    return {name: rows.filter(F.col("kind") == kind).select("event_id", "item_path", "parent_path", position, *[field(f, t) for f, t in fields.items()]) for name, (kind, fields) in tables.items()}

"""Schemas that drift from file to file: versioned fingerprints, migration steps, one table, one report.

``lines`` parses each record once into its fields: (path, type, text).  ``versions`` gives each file the fingerprint of its
field set, an order-free sum over (path, type).  Fingerprints decide what is done: only neighbours with different ones are compared
(``changes``), ``migrations`` holds the explicit step of every change from one fingerprint to the next (rename, default, drop, cast), and
``steps`` holds for every fingerprint what makes its records fit the one schema over all producers, once for all files that have it.
``one_table`` routes every file through the steps of its fingerprint, ``wide_table`` gives the same with a column for each field.

Fields that are gone or new are matched as renames if their values agree on all spans of both files, which is one equi-join on an order-free
value fingerprint, never a comparison of all pairs.

The one schema: paths that any producer renames into one another, over any chain of files, are one field, under the path that most files have;
paths that one file holds side by side are never joined.  A field is of its values' type; whole and fractional make fractional,
any other mix makes string, to which all can be cast.  The default of a field that a record lacks is null.

Records are parsed in Arrow batches: the higher-order form of the same walk over VARIANT took some five times the CPU, as every step copies what was found.

Defined cases: lines that are no JSON object (or have text after it) count for nothing; null and absent values
are equal; a span repeated in a file counts with its last line; of mixed types, whole and fractional make
fractional, any other mix makes the first of array, boolean, string; spans without trace_id or span_id are
in no two files; equal export times are ordered by file_id; a file without any record has no fields.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronolith.functions.jsontext import Number, parse, storable, written
from chronolith.runtime import materialize, shared_dir

#: Field types in the order that decides a mix.
_TYPES = "array boolean string fraction whole".split()
_LINE = "file_id {file}, line_no {line}, trace_id string, span_id string, leaf array<struct<path:string,type:string,text:string>>"


def _fraction(text: str) -> str:
    """A number with a fraction or an exponent as all equal ones are written."""
    x = float(text)
    return str(int(x)) if x == x // 1 and abs(x) < 9e15 else repr(x)


def _leaves(record: dict) -> Iterator[tuple[str, str, str]]:
    """path, type and text of the non-null values that are no objects, by a stack: records may nest as deep as they like."""
    stack: list[tuple[str, object]] = [("", record)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in reversed(v.items()))
        elif isinstance(v, Number):
            yield (path, "whole", str(v)) if v.whole else (path, "fraction", _fraction(v))
        elif isinstance(v, str):
            yield path, "string", v
        elif isinstance(v, bool):
            yield path, "boolean", "true" if v else "false"
        elif v is not None:
            yield path, "array", written(v)


def lines(records: DataFrame) -> DataFrame:
    """file_id, line_no, trace_id, span_id and leaf, the fields as array<struct<path,type,text>>, of every line that is a JSON object."""
    rows = records.select("file_id", "line_no", F.col("record").cast("string").alias("record")).filter(F.ltrim("record").startswith("{") | F.col("record").rlike(r"^[\t\r\n ]+\{"))
    names = ["file_id", "line_no", "trace_id", "span_id", "leaf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, paths, types, texts, ends = [], ([], []), [], [], [], [0]
            for i, text in enumerate(batch.column(2).to_pylist()):
                try:
                    record = parse(text)
                except ValueError:
                    continue
                at.append(i)
                own = [None, None]
                for path, kind, value in _leaves(record):
                    value = storable(value)
                    paths.append(storable(path))
                    types.append(kind)
                    texts.append(value)
                    if path == "trace_id" or path == "span_id":
                        own[path == "span_id"] = f"{kind}:{value}"
                ends.append(len(paths))
                ids[0].append(own[0])
                ids[1].append(own[1])
            leaf = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (paths, types, texts)], ["path", "type", "text"]))
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(ids[0], pa.string()), pa.array(ids[1], pa.string()), leaf], names)

    types = dict(records.dtypes)
    return rows.mapInArrow(run, _LINE.format(file=types["file_id"], line=types["line_no"]))


def order_of(files: DataFrame) -> DataFrame:
    """file_id, producer, version_no and prev_file_id in order of export."""
    w = Window.partitionBy("producer").orderBy("exported_at", "file_id")
    return files.select("file_id", "producer", F.lag("file_id").over(w).alias("prev_file_id"), F.row_number().over(w).alias("version_no"))


def field_types(rows: DataFrame) -> DataFrame:
    """file_id, field_path, type and all types that occur: the schema of each file, in one pass over ``lines``."""
    rank = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("x.type"))
    leaf = rows.select("file_id", F.explode("leaf").alias("x")).select("file_id", F.col("x.path").alias("field_path"), rank.cast("int").alias("t"))
    best = leaf.groupBy("file_id", "field_path").agg(F.min("t").alias("t"), *[F.max((F.col("t") == i + 1).cast("int")).alias(f"has{i}") for i in range(len(_TYPES))])
    held = F.filter(F.array(*[F.when(F.col(f"has{i}") == 1, F.lit(t)) for i, t in enumerate(_TYPES)]), lambda x: x.isNotNull())
    return best.select("file_id", "field_path", F.element_at(F.array(*map(F.lit, _TYPES)), F.col("t")).alias("type"), held.alias("types"))


def versions(schema: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, producer, version_no, fingerprint, n_fields, prev_file_id, prev_fingerprint. Equal fingerprints are equal schemas."""
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", "field_path", "type").cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    prints = schema.groupBy("file_id").agg(F.sum(mark).alias("s"), F.count("*").alias("n_fields"))
    total, n = F.coalesce("s", F.lit(0).cast("decimal(30,0)")).cast("string"), F.coalesce("n_fields", F.lit(0))
    out = order_of(files).join(prints, "file_id", "left").withColumn("fingerprint", F.md5(F.concat_ws(":", total, n.cast("string")).cast("binary")))
    before = F.lag("fingerprint").over(Window.partitionBy("producer").orderBy("version_no"))
    return out.select("file_id", "producer", "version_no", "fingerprint", n.alias("n_fields"), "prev_file_id", before.alias("prev_fingerprint"))


def changes(rows: DataFrame, schema: DataFrame, version: DataFrame) -> DataFrame:
    """file_id, change_kind, field_path, new_path, old_type, new_type of every change between neighbours, which are the files whose fingerprints differ.

    rows, schema and version are what ``lines``, ``field_types`` and ``versions`` gave, written before: each is read several times.
    """
    pairs = version.filter("prev_file_id IS NOT NULL AND fingerprint <> prev_fingerprint").select("file_id", "prev_file_id")
    cur = pairs.select("file_id").join(schema.select("file_id", "field_path", F.col("type").alias("new_type")), "file_id")
    prev = pairs.join(schema.select(F.col("file_id").alias("prev_file_id"), "field_path", F.col("type").alias("old_type")), "prev_file_id").drop("prev_file_id")
    both = materialize(prev.join(cur, ["file_id", "field_path"], "full").filter("old_type IS NULL OR new_type IS NULL OR old_type <> new_type"), "moved")
    moved = both.filter("old_type IS NULL OR new_type IS NULL")
    retyped = both.filter("old_type <> new_type").select("file_id", F.lit("retyped").alias("change_kind"), "field_path", F.lit("").alias("new_path"), "old_type", "new_type")

    # which fields of which file are wanted, as the later file of a change (new) and as the earlier one (gone)
    paths = lambda kind: F.collect_list(F.when(F.col(f"{kind}_type").isNotNull(), F.col("field_path")))
    wanted = moved.groupBy("file_id").agg(paths("new").alias("new_paths"), paths("old").alias("gone_paths")).filter("size(new_paths) > 0 AND size(gone_paths) > 0")
    ends = wanted.join(pairs, "file_id")
    sides = ends.select("file_id", F.col("file_id").alias("change_file"), F.lit("new").alias("side"), F.col("new_paths").alias("paths")).unionByName(
        ends.select(F.col("prev_file_id").alias("file_id"), F.col("file_id").alias("change_file"), F.lit("gone").alias("side"), F.col("gone_paths").alias("paths"))
    )
    # the last line of each span, of the spans that both files hold
    held = rows.filter("trace_id IS NOT NULL AND span_id IS NOT NULL").groupBy("file_id", "trace_id", "span_id").agg(F.max("line_no").alias("line_no"))
    tried = ends.select(F.col("file_id").alias("change_file"), F.explode(F.array("file_id", "prev_file_id")).alias("file_id"))
    spans = tried.join(held, "file_id").groupBy("change_file", "trace_id", "span_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("file_id", "line_no")).alias("at"))  # two files a span at most
    shared = spans.filter("n = 2").select("change_file", F.inline("at"))
    picked = rows.join(sides, "file_id").select("change_file", "file_id", "line_no", "side", "trace_id", "span_id", F.explode(F.filter("leaf", lambda x: F.array_contains("paths", x["path"]))).alias("x"))
    values = picked.join(shared, ["change_file", "file_id", "line_no"], "left_semi")
    of = F.when(F.col("x.type").isin("whole", "fraction"), "number").otherwise(F.col("x.type"))
    mark = lambda seed: F.xxhash64(F.lit(seed), "trace_id", "span_id", of, F.col("x.text")).cast("decimal(20,0)")
    prints = values.groupBy(F.col("change_file").alias("file_id"), F.col("x.path").alias("field_path"), "side").agg(F.sum(mark(1)).alias("s1"), F.sum(mark(2)).alias("s2"), F.count("*").alias("n"))
    prints = materialize(prints.join(moved.select("file_id", "field_path", F.coalesce("old_type", "new_type").alias("type")), ["file_id", "field_path"]), "prints")
    a = prints.filter("side = 'gone'").select("file_id", "type", "s1", "s2", "n", "field_path")
    b = prints.filter("side = 'new'").select("file_id", "type", "s1", "s2", "n", F.col("field_path").alias("new_path"))
    renamed = a.join(b, ["file_id", "type", "s1", "s2", "n"]).select("file_id", F.lit("renamed").alias("change_kind"), "field_path", "new_path", F.col("type").alias("old_type"), F.col("type").alias("new_type"))
    taken = renamed.select("file_id", F.explode(F.array("field_path", "new_path")).alias("field_path")).distinct()
    rest = moved.join(taken, ["file_id", "field_path"], "left_anti").select(
        "file_id", F.when(F.col("new_type").isNull(), "removed").otherwise("added").alias("change_kind"), "field_path", F.lit("").alias("new_path"), "old_type", "new_type"
    )
    return renamed.unionByName(rest).unionByName(retyped)


#: What a change of the schema asks of the records before it.
_OPS = {"renamed": "rename", "added": "default", "removed": "drop", "retyped": "cast"}


def migrations(change: DataFrame, version: DataFrame) -> DataFrame:
    """producer, from_version, to_version, from_fingerprint, to_fingerprint, op, field_path, new_path, new_type: the steps from each version to the next."""
    op = F.create_map(*[F.lit(x) for pair in _OPS.items() for x in pair])[F.col("change_kind")]
    rows = change.join(version.select("file_id", "producer", "version_no", "fingerprint", "prev_fingerprint"), "file_id")
    return rows.select(
        "producer", (F.col("version_no") - 1).alias("from_version"), F.col("version_no").alias("to_version"), F.col("prev_fingerprint").alias("from_fingerprint"), F.col("fingerprint").alias("to_fingerprint"),
        op.alias("op"), "field_path", "new_path", "new_type",
    )


def synonyms(change: DataFrame, used: DataFrame) -> DataFrame:
    """field_path, n_files, field: the name over all producers of every path in ``used`` (file_id, field_path).

    Paths are joined by the smallest path that renames lead to; each round also takes the smallest path of the smallest
    path.  What is joined are distinct paths, however many files and records there are.
    """
    shared_dir(used.sparkSession)
    at = lambda name: used.select("file_id", F.col("field_path").alias(name))
    edge = change.filter("change_kind = 'renamed'").select("field_path", "new_path").distinct()
    together = edge.join(at("field_path"), "field_path").join(at("new_path"), ["file_id", "new_path"]).select("field_path", "new_path").distinct()
    edge = edge.join(together, ["field_path", "new_path"], "left_anti")
    edge = edge.unionByName(edge.select(F.col("new_path").alias("field_path"), F.col("field_path").alias("new_path"))).distinct().checkpoint()
    paths = used.groupBy("field_path").agg(F.countDistinct("file_id").alias("n_files")).checkpoint()
    label = paths.select("field_path", F.col("field_path").alias("least"))
    while True:
        near = edge.join(label.select(F.col("field_path").alias("new_path"), "least"), "new_path").select("field_path", "least")
        near = label.unionByName(near).groupBy("field_path").agg(F.min("least").alias("least"))
        hop = near.select(F.col("field_path").alias("least"), F.col("least").alias("further"))
        nxt = near.join(hop, "least").select("field_path", F.col("further").alias("least")).checkpoint()
        if nxt.exceptAll(label).isEmpty():
            break
        label = nxt
    rows = paths.join(label, "field_path")
    name = rows.groupBy("least").agg(F.min_by("field_path", F.struct(-F.col("n_files"), "field_path")).alias("field"))
    return rows.join(name, "least").select("field_path", "n_files", "field")


def steps(schema: DataFrame, version: DataFrame, change: DataFrame) -> DataFrame:
    """fingerprint, field, op, source_path, type: what each fingerprint's records need, one row for each field of the one schema.

    op is keep or rename (from ``source_path``), each with a cast to ``type``, or default.  Of several paths of a file that have one name, the one
    spelled like it or else in most files gets it; the others are fields of their own.
    """
    used = schema.select("file_id", "field_path")
    name = materialize(synonyms(change, used), "names")
    # files of one fingerprint have the same paths and types, so they share their steps; which types mix in a field may differ
    printed = schema.join(version.select("file_id", "fingerprint"), "file_id")
    route = printed.select("fingerprint", "field_path").distinct().join(name, "field_path")
    first = Window.partitionBy("fingerprint", "field").orderBy(F.col("field_path") != F.col("field"), F.desc("n_files"), "field_path")
    route = route.withColumn("place", F.row_number().over(first))
    route = materialize(route.select("fingerprint", F.col("field_path").alias("source_path"), F.when(F.col("place") == 1, F.col("field")).otherwise(F.col("field_path")).alias("field")), "route")
    types = printed.select("fingerprint", F.col("field_path").alias("source_path"), F.explode("types").alias("t")).distinct().join(route, ["fingerprint", "source_path"])
    fields = types.groupBy("field").agg(F.collect_set("t").alias("types"))
    kind = F.when(F.size("types") == 1, F.col("types")[0]).when(F.size(F.array_except("types", F.array(F.lit("whole"), F.lit("fraction")))) == 0, F.lit("fraction")).otherwise(F.lit("string"))
    # the one schema is the head of the table to be made: its width is what is read here, whatever the number of files and records
    schema_ = json.dumps([{"field": r["field"], "type": r["type"]} for r in fields.select("field", kind.alias("type")).orderBy("field").collect()])
    have = version.select("fingerprint").distinct().select("fingerprint", F.inline(F.from_json(F.lit(schema_), "array<struct<field:string,type:string>>")))
    out = have.join(route, ["fingerprint", "field"], "left")
    op = F.when(F.col("source_path").isNull(), "default").when(F.col("source_path") == F.col("field"), "keep").otherwise("rename")
    return out.select("fingerprint", "field", op.alias("op"), "source_path", "type")


def _routed(rows: DataFrame, version: DataFrame, step: DataFrame) -> DataFrame:
    """The lines with the steps of their file's fingerprint: all of them by field, and those that have a path by path."""
    to = F.struct("field", "source_path", "type")
    each = step.groupBy("fingerprint").agg(F.sort_array(F.collect_list(to)).alias("steps"))
    entries = lambda key, rows: F.map_from_entries(F.transform(rows, lambda s: F.struct(s[key], s)))
    each = each.select("fingerprint", F.transform("steps", lambda s: s["field"]).alias("names"), entries("field", F.col("steps")).alias("of_field"), entries("source_path", F.filter("steps", lambda s: s["source_path"].isNotNull())).alias("of_path"))
    return rows.join(version.select("file_id", "producer", "fingerprint").join(each, "fingerprint"), "file_id")


def _cast(text: str, kind: str) -> str:
    return f"try_cast({text} AS {kind})"


def one_table(rows: DataFrame, version: DataFrame, step: DataFrame) -> DataFrame:
    """file_id, line_no, producer, field, type, value, ok, defaulted, typed, source_path, source_type, source_text: a row for each record and field.

    ``typed`` holds the cast value in the member for its type, ``value`` its text; both are null for a default.
    ``ok`` is false where the cast can't keep the value (digits of a whole number beyond a fraction's); ``source_text`` keeps it.
    A path that a record spells both nested and with a dotted key gives a row for each value.
    """
    routed = """transform(array(transform(leaf, x -> named_struct('s', of_path[x.path], 'x', x))), found -> concat(found,
      transform(array_except(names, transform(found, f -> f.s.field)), n -> named_struct('s', of_field[n], 'x', cast(NULL AS struct<path:string,type:string,text:string>)))))[0]"""
    out = _routed(rows, version, step).select("file_id", "line_no", "producer", F.explode(F.expr(routed)).alias("s"))
    out = out.select("file_id", "line_no", "producer", "s.s.field", "s.s.type", "s.s.source_path", F.col("s.x.type").alias("source_type"), F.col("s.x.text").alias("source_text"))
    text = lambda kind: f"CASE WHEN type = '{kind}' THEN source_text END"
    typed = f"""named_struct(
      'array', transform(try_cast(try_parse_json({text('array')}) AS array<variant>), v -> to_json(v)),
      'boolean', {_cast(text('boolean'), 'boolean')},
      'string', {text('string')},
      'fraction', {_cast(text('fraction'), 'double')},
      'whole', {_cast(text('whole'), 'decimal(38,0)')})"""
    out = out.withColumn("typed", F.expr(typed))
    value = "CASE type WHEN 'array' THEN if(typed.array IS NULL, NULL, source_text) WHEN 'boolean' THEN cast(typed.boolean AS string) WHEN 'string' THEN typed.string WHEN 'fraction' THEN cast(typed.fraction AS string) ELSE cast(typed.whole AS string) END"
    exact = "type <> 'fraction' OR source_type <> 'whole' OR coalesce(try_cast(typed.fraction AS decimal(38,0)) = try_cast(source_text AS decimal(38,0)), false)"
    out = out.withColumn("value", F.expr(value)).withColumn("defaulted", F.col("source_type").isNull())
    return out.select("file_id", "line_no", "producer", "field", "type", "value", F.expr(f"defaulted OR value IS NOT NULL AND ({exact})").alias("ok"), "defaulted", "typed", "source_path", "source_type", "source_text")


#: Column types of ``wide_table``.
_SQL_TYPES = {"array": "string", "boolean": "boolean", "string": "string", "fraction": "double", "whole": "decimal(38,0)"}


def wide_table(rows: DataFrame, version: DataFrame, step: DataFrame) -> DataFrame:
    """file_id, line_no, producer and a column for each field of the one schema, with its default where a record lacks it; arrays as JSON text.

    The columns of a table are named by the driver, so the one schema is read there: its size is the table's width.
    A path that a record spells both nested and with a dotted key counts with its first value.
    """
    schema = [(r["field"], r["type"]) for r in step.select("field", "type").distinct().orderBy("field").collect()]
    out = _routed(rows, version, step).select("file_id", "line_no", "producer", "leaf", "of_field")
    literal = lambda name: "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cell = lambda name: f"get(filter(leaf, x -> x.path = of_field[{literal(name)}].source_path), 0).text"
    return out.select("file_id", "line_no", "producer", *[F.expr(_cast(cell(f), _SQL_TYPES[t])).alias(f) for f, t in schema])

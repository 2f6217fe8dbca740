"""Span records (JSON lines) and agent journals as ledger events.

Records are parsed once into VARIANT; every field is a path expression.  Vendors prefix their attribute
names (``vendor.span.kind``); they are found by suffix, after the OpenInference name.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chronolith.functions.classify import parse_kind
from chronolith.functions.text import concise, json_text, stable_id
from chronolith.runtime import settings

#: How VARIANT takes a repeated key.
LAST_WINS = {"spark.sql.variant.allowDuplicateKeys": "true"}

TEXT_LIMIT = 2_400
TEXT_FIELDS = ["memory", "text", "content", "value"]


def once(value: Column) -> Column:
    """An array of one value that stays out of generated code: the probes of many paths would grow beyond what a method can hold."""
    return F.transform(F.array(value), lambda x: x)


def string(path: str, of: str = "v") -> Column:
    """A JSON string at a path; null if it is anything else."""
    kind = f"schema_of_variant(variant_get({of}, '{path}', 'variant'))"
    return F.expr(f"CASE WHEN try_variant_get({of}, '{path}', 'variant') IS NOT NULL AND {kind} = 'STRING' THEN try_variant_get({of}, '{path}', 'string') END")


def _said(path: str, of: str = "v") -> Column:
    """As ``_string``, trimmed, null if blank."""
    return F.nullif(F.btrim(string(path, of)), F.lit(""))


def _attribute(suffix: str, first: str | None = None) -> Column:
    """A string attribute whose name ends in .suffix; the OpenInference name counts first."""
    found = F.expr(f"get(filter(map_entries(try_variant_get(v, '$.attributes', 'map<string,string>')), e -> endswith(e.key, '.{suffix}') AND e.key <> '{first or ''}'), 0).value")
    return F.coalesce(string(f'$.attributes["{first}"]'), found) if first else found


def span_kind() -> Column:
    return F.coalesce(string("$.span_kind"), _attribute("span.kind", "openinference.span.kind"), string("$.kind"), F.lit("agent.step"))


def memory_kind() -> Column:
    """The first of the twelve places that holds a known kind."""
    places = ["$.input.kind", "$.input.memory_kind", "$.payload.kind", "$.payload.memory_kind", "$.output.kind", "$.output.memory_kind", "$.memory_kind", "$.node_kind", "$.name", "$.kind"]
    return F.coalesce(parse_kind(_attribute("memory.kind")), parse_kind(_said('$.attributes["memory.kind"]')), *[parse_kind(_said(p)) for p in places])


def write_text(of: str = "v") -> Column:
    nested = lambda base: [_said(f"{base}.{f}", of) for f in TEXT_FIELDS]
    return F.coalesce(*nested("$"), *nested("$.input"), _said("$.input", of), *nested("$.payload"), *nested("$.output"), _said("$.output", of))


def read_text(request: str = "$.input", result: str = "$.output", of: str = "v") -> Column:
    question = F.coalesce(_said(request, of), *[_said(f"{request}.{f}", of) for f in ("question", "query", "input", "text")], *[_said(f"{request}.input.{f}", of) for f in ("question", "query", "text")])
    answer = F.coalesce(_said(result, of), *[_said(f"{result}.{f}", of) for f in ("answer", "summary", "output", "text")], *[_said(f"{result}.output.{f}", of) for f in ("answer", "summary", "text")])
    asked = F.concat(F.lit("memory read question: "), question)
    return F.nullif(F.concat_ws(" ", asked, F.when(asked.isNull(), F.concat(F.lit("memory read answer: "), answer)).otherwise(F.concat(F.lit("answer: "), answer))), F.lit(""))


def unix_number_to_ms(value: Column) -> Column:
    """Epoch numbers by size: milliseconds from 1e12, seconds from 1e9, else as they are."""
    return F.when(value >= 1e12, F.round(value)).when(value >= 1e9, F.round(value * 1000)).otherwise(F.round(value)).cast("long")


def observed_at(now: Column) -> Column:
    number = lambda p: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(v, '{p}', 'variant')) = 'BIGINT' THEN try_variant_get(v, '{p}', 'bigint') END")

    def moment(p: str) -> Column:
        # a number, or a string that is RFC 3339 or a number
        num = F.expr(f"CASE WHEN schema_of_variant(try_variant_get(v, '{p}', 'variant')) RLIKE 'BIGINT|DECIMAL|DOUBLE' THEN try_variant_get(v, '{p}', 'double') END")
        text = _said(p)
        rfc = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.expr("unix_millis(try_to_timestamp(upper(btrim(try_variant_get(v, '" + p + "', 'string')))))"))
        plain = F.expr(f"try_cast(btrim(try_variant_get(v, '{p}', 'string')) AS double)")
        positive = lambda x: F.when(x >= 0, unix_number_to_ms(x))
        whole = number(p)
        return F.coalesce(F.when(whole.isNotNull(), unix_number_to_ms(whole.cast("double"))), positive(num), rfc, F.when(text.isNotNull(), positive(plain)))

    return F.coalesce(number("$.start_time_unix_ms"), number("$.start_time_ms"), number("$.timestamp_unix_ms"), moment("$.start_time"), moment("$.startTime"), moment("$.timestamp"), now)


def parsed(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``v`` (null: no JSON); of a repeated key the last value counts."""
    with settings(records.sparkSession, LAST_WINS):  # read when the plan is made
        wrapped = F.expr(f"try_cast(try_parse_json(concat('[', {record}, ']')) AS array<variant>)")
        return records.withColumn("v", F.when(F.size(wrapped) == 1, wrapped[0]))


def span_events(records: DataFrame, now_unix_ms: int, record: str = "record", tenant: str | None = None, project: str | None = None, env: str | None = None, source: str = "spans.jsonl") -> DataFrame:
    """Ledger events of JSON span records; keeps all other columns. Records that are no JSON are left out."""
    rows = parsed(records, record).filter("v IS NOT NULL")
    keep = [c for c in records.columns if c != record]
    # what is read several times below is worked out once: a generator is a barrier that projections are not merged across
    seq = F.expr("CASE WHEN schema_of_variant(try_variant_get(v, '$.seq', 'variant')) = 'BIGINT' AND try_variant_get(v, '$.seq', 'bigint') >= 0 THEN try_variant_get(v, '$.seq', 'bigint') END")
    given = lambda value, path: F.lit(value) if value is not None else string(path)
    found = F.struct(
        span_kind().alias("kind"), string("$.trace_id").alias("own_trace"), string("$.span_id").alias("own_span"), seq.alias("own_seq"), string("$.name").alias("own_name"), string("$.status").alias("own_status"),
        given(tenant, "$.tenant_id").alias("tenant"), given(project, "$.project_id").alias("project"), given(env, "$.environment_id").alias("env"), observed_at(F.lit(now_unix_ms)).alias("observed"),
    )
    rows = rows.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.col(record).alias("rec"), "v", F.inline(once(found)))
    kind = F.col("kind")
    told = F.struct(F.when(kind == "memory.write", write_text()).when(kind == "memory.read", read_text()).alias("said"), F.when(kind == "memory.write", memory_kind()).alias("memory"))
    rows = rows.select("*", F.inline(once(told)))
    unnamed = F.col("own_trace").isNull() | F.col("own_span").isNull()
    rows = rows.withColumn("flat", F.when(F.col("said").isNull() | unnamed, json_text(F.col("rec")))).withColumn("trace_id", F.coalesce("own_trace", stable_id("trace", F.col("flat"))))
    name = F.when(kind == "memory.write", F.coalesce("memory", F.lit("fact"))).when(kind == "memory.read", "episode").otherwise(F.coalesce("own_name", kind))
    return rows.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.lit(source).alias("source"), F.coalesce("tenant", F.lit("local")).alias("tenant_id"), F.coalesce("project", F.lit("default")).alias("project_id"),
        F.col("env").cast("string").alias("environment_id"), "trace_id", F.coalesce("own_span", stable_id("span", F.col("trace_id"), F.col("flat"))).alias("span_id"),
        F.coalesce("own_seq", F.lit(1).cast("long")).alias("seq"), kind.alias("span_kind"), name.alias("name"), F.coalesce("own_status", F.lit("ok")).alias("status"),
        concise(F.coalesce("said", "flat"), TEXT_LIMIT).alias("text"), F.col("rec").alias("payload"), F.col("observed").alias("observed_at_unix_ms"), F.lit(now_unix_ms).cast("long").alias("ingested_at_unix_ms"),
        F.lit(None).cast("long").alias("projected_at_unix_ms"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and record of a text file, read in blocks: each block's lines are counted, and the sums of the blocks before it are its offset."""
    raw = spark.read.text(path).select(F.col("value").alias("record"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file_path", "file_block_start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of a file
    offsets = blocks.select("file_path", "file_block_start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return raw.join(offsets, ["file_path", "file_block_start"]).select((F.col("offset") + F.col("at") - F.col("first") + 1).alias("line_no"), "record")


def import_jsonl(spark: SparkSession, path: str, now_unix_ms: int, **given: str) -> DataFrame:
    """Events of a JSON lines file: all or nothing. Raises with the number of the first line that is bad."""
    from chronolith.sources.ledger import validated

    lines = numbered_lines(spark, path)
    lines = lines.filter(F.btrim("record") != "")
    bad = parsed(lines).filter("v IS NULL").agg(F.min("line_no")).first()[0]
    if bad is not None:
        raise ValueError(f"invalid span record in line {bad}")
    events = validated(span_events(lines, now_unix_ms, **given))
    worst = events.filter("rejected IS NOT NULL").agg(F.min(F.struct("line_no", "rejected"))).first()[0]
    if worst is not None:
        raise ValueError(f"invalid span record in line {worst['line_no']}: {worst['rejected']}")
    return events.drop("rejected")


# -- agent journals ------------------------------------------------------------------------------
TERMINAL = ["completed", "complete", "succeeded", "success", "failed", "error", "errored", "cancelled", "canceled"]
SUCCESS = ["completed", "complete", "succeeded", "success"]


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables runs and steps of a SQLite journal, read-only. A journal is one small file of one agent."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        runs = con.execute("SELECT id, agent, status, input, created_at FROM runs").fetchall()
        steps = con.execute("SELECT run_id, seq, kind, status, request, result, tool_name, tool_use_id, attempt, started_at, finished_at FROM steps").fetchall()
    finally:
        con.close()
    return (
        spark.createDataFrame(runs, "id string, agent string, run_status string, run_input string, created_at long"),
        spark.createDataFrame(steps, "run_id string, seq long, kind string, status string, request string, result string, tool_name string, tool_use_id string, attempt long, started_at long, finished_at long"),
    )


def journal_span_kind(kind: Column, tool: Column) -> Column:
    return (
        F.when(kind == "llm_call", "llm.call")
        .when((kind == "tool_call") & tool.isin("memory.read", "memory_read"), "memory.read")
        .when((kind == "tool_call") & tool.isin("memory.write", "memory_write"), "memory.write")
        .when(kind == "tool_call", "tool.call")
        .otherwise(kind)
    )


def importable(status: Column, span_kind_: Column) -> Column:
    """Finished steps; memory writes only if they succeeded."""
    s = F.lower(F.btrim(status))
    return s.isin(TERMINAL) & ((span_kind_ != "memory.write") | s.isin(SUCCESS))


def journal_events(runs: DataFrame, steps: DataFrame, tenant: str, project: str, env: str | None, now_unix_ms: int, source: str = "journal") -> DataFrame:
    """Ledger events of the steps that are importable, in the order of runs and steps."""
    rows = runs.withColumnRenamed("id", "run_id").join(steps, "run_id")
    rows = rows.withColumn("span_kind", journal_span_kind(F.col("kind"), F.col("tool_name"))).filter(importable(F.col("status"), F.col("span_kind")))
    rows = rows.withColumn("v", F.expr("parse_json(concat('{\"input\":', request, ',\"output\":', coalesce(result, 'null'), '}'))"))
    rows = rows.withColumn("request_v", F.expr("parse_json(request)")).withColumn("result_v", F.expr("parse_json(coalesce(result, 'null'))"))
    kind_in = lambda of: F.coalesce(*[parse_kind(_said(p, of)) for p in ("$.input.kind", "$.input.memory_kind", "$.payload.kind", "$.payload.memory_kind", "$.output.kind", "$.output.memory_kind", "$.memory_kind", "$.node_kind", "$.name", "$.kind")])
    name = (
        F.when(F.col("span_kind") == "memory.write", F.coalesce(kind_in("request_v"), kind_in("result_v"), F.lit("fact")))
        .when(F.col("span_kind") == "memory.read", "episode")
        .otherwise(F.coalesce("tool_name", F.concat("agent", F.lit(":"), "kind")))
    )
    written = F.coalesce(write_text("request_v"), write_text("result_v"))
    plain = F.concat(F.lit("run input: "), "run_input", F.lit(" request: "), json_text(F.col("request")), F.lit(" result: "), F.coalesce(json_text(F.col("result")), F.lit("")))
    text = F.when((F.col("span_kind") == "memory.write") & written.isNotNull(), written).when((F.col("span_kind") == "memory.read") & read_text().isNotNull(), read_text()).otherwise(plain)
    payload = F.to_json(F.struct("agent", "run_status", "created_at", F.col("request_v").alias("request"), F.col("result_v").alias("result"), "tool_name", "tool_use_id", "attempt", "finished_at"))
    return rows.select(
        F.lit(None).cast("long").alias("id"),
        F.lit(source).alias("source"), F.lit(tenant).alias("tenant_id"), F.lit(project).alias("project_id"), F.lit(env).cast("string").alias("environment_id"), F.col("run_id").alias("trace_id"),
        F.coalesce("tool_use_id", F.concat(F.lit("step-"), F.col("seq").cast("string"))).alias("span_id"), "seq", "span_kind", name.alias("name"), "status", concise(text, TEXT_LIMIT).alias("text"), payload.alias("payload"),
        (F.col("started_at") * 1000).alias("observed_at_unix_ms"), F.lit(now_unix_ms).cast("long").alias("ingested_at_unix_ms"), F.lit(None).cast("long").alias("projected_at_unix_ms"), "created_at",
    )

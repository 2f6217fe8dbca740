"""The ledger: building, checking and appending observations.

Events are rows of the ledger schema.  Appending is first-wins on the exact message key within tenant and
project; ``operators.dedupe.MessageStore`` keeps one copy of messages whose identifiers are written carelessly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronolith.functions.text import stable_id

LEDGER_SCHEMA = (
    "id long, source string, tenant_id string, project_id string, environment_id string, trace_id string, span_id string, seq long, "
    "span_kind string, name string, status string, text string, payload string, observed_at_unix_ms long, ingested_at_unix_ms long, projected_at_unix_ms long"
)
EXACT_KEY = ["tenant_id", "project_id", "trace_id", "span_id", "seq"]
IDENTIFIERS = ["source", "tenant_id", "project_id", "trace_id", "span_id", "span_kind", "name", "status"]


def direct_write(rows: DataFrame, source: str = "direct") -> DataFrame:
    """Events of memory.write from tenant_id, project_id, environment_id, kind, text and now_unix_ms."""
    trace = stable_id("direct_trace", F.col("text"), F.col("now_unix_ms").cast("string"))
    return rows.withColumn("trace_id", trace).select(
        F.lit(source).alias("source"), "tenant_id", "project_id", "environment_id", "trace_id", stable_id("direct_span", F.col("trace_id")).alias("span_id"),
        F.lit(1).cast("long").alias("seq"), F.lit("memory.write").alias("span_kind"), F.col("kind").alias("name"), F.lit("ok").alias("status"), "text",
        F.to_json(F.struct("kind")).alias("payload"), F.col("now_unix_ms").alias("observed_at_unix_ms"), F.col("now_unix_ms").alias("ingested_at_unix_ms"),
    )


def with_idempotency_key(events: DataFrame, key: Column) -> DataFrame:
    """Trace and span ids that depend on scope, name and key only, and the key's hash in the payload."""
    key = F.btrim(key)
    env = F.coalesce("environment_id", F.lit(""))
    hashed = F.concat(F.lit('"idempotency_key_hash":"'), stable_id("idempotency_key", key), F.lit('"'))
    payload = F.when(F.col("payload") == "{}", F.concat(F.lit("{"), hashed, F.lit("}"))).otherwise(F.regexp_replace("payload", r"\}\s*$", F.concat(F.lit(","), hashed, F.lit("}"))))
    out = events.withColumn("trace_id", stable_id("direct_trace_idempotent", F.col("tenant_id"), F.col("project_id"), env, F.col("name"), key))
    return out.withColumn("span_id", stable_id("direct_span", F.col("trace_id"))).withColumn("payload", F.when(F.col("payload").rlike(r"^\s*\{"), payload).otherwise(F.col("payload")))


def rejection(columns: list[str]) -> Column:
    """The first rule that an event breaks, or null."""
    out = F.when(F.lit(False), F.lit(""))
    blank = lambda c: c.isNull() | (F.trim(F.regexp_replace(c, r"\p{IsWhite_Space}", " ")) == "")
    padded = lambda c: c.rlike(r"^\p{IsWhite_Space}|\p{IsWhite_Space}$")
    for name in IDENTIFIERS:
        out = out.when(blank(F.col(name)), f"{name} must not be empty").when(padded(F.col(name)), f"{name} must not have leading or trailing whitespace")
    env = F.col("environment_id")
    out = out.when(env.isNotNull() & blank(env), "environment_id must not be empty").when(env.isNotNull() & padded(env), "environment_id must not have leading or trailing whitespace")
    out = out.when(blank(F.col("text")), "text must not be empty")
    out = out.when(F.col("seq").isNull() | (F.col("seq") <= 0), "seq must be greater than 0")
    for name in ("observed_at_unix_ms", "ingested_at_unix_ms"):
        out = out.when(F.col(name).isNull() | (F.col(name) < 0), f"{name} must be non-negative")
    if "projected_at_unix_ms" in columns:
        out = out.when(F.col("projected_at_unix_ms") < 0, "projected_at_unix_ms must be non-negative")
    return out


def validated(events: DataFrame) -> DataFrame:
    """The events with the column ``rejected``: null for those that may enter the ledger."""
    return events.withColumn("rejected", rejection(events.columns))


def first_copies(events: DataFrame, order: str = "id") -> DataFrame:
    """The first arrival of each exact message key.

    Only the columns that are read later are shuffled, and each task passes on one row a key (a window
    group limit), so a key of many copies is no hot task.
    """
    w = Window.partitionBy(*EXACT_KEY).orderBy(order)
    return events.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def append(ledger: DataFrame, batch: DataFrame, order: str = "id") -> DataFrame:
    """The rows of a batch that are new to the ledger, first arrival first; the ledger's rows always win."""
    return first_copies(batch, order).join(ledger.select(*EXACT_KEY), EXACT_KEY, "left_anti")


def pending(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Events not projected yet, in order of observation and arrival."""
    rows = ledger.filter("projected_at_unix_ms IS NULL").orderBy("observed_at_unix_ms", "id")
    return rows if limit is None else rows.limit(guarded(limit, "limit"))


def projected_after(ledger: DataFrame, bounds: DataFrame) -> DataFrame:
    """For each bound (bound_id, scope, after_ms, after_id, before_ms): projected events of its scope strictly between."""
    at = F.struct(F.col("observed_at_unix_ms"), F.col("id"))
    scope = [ledger.tenant_id == bounds.b_tenant, ledger.project_id == bounds.b_project, F.coalesce(ledger.environment_id, F.lit("")) == F.coalesce(bounds.b_env, F.lit(""))]
    rows = ledger.filter("projected_at_unix_ms IS NOT NULL").join(bounds, scope[0] & scope[1] & scope[2])
    return rows.filter((at > F.struct("after_ms", "after_id")) & (F.col("before_ms").isNull() | (F.col("observed_at_unix_ms") < F.col("before_ms"))))


def latest_marks(marks: DataFrame) -> DataFrame:
    """id and projected_at_unix_ms of every projected event; an event that was marked twice counts once."""
    return marks.groupBy(F.col("ledger_event_id").alias("id")).agg(F.max("projected_at_unix_ms").alias("projected_at_unix_ms"))


BATCH_KEY = ["ledger_event_id", "distiller_kind", "distiller_fingerprint"]


def latest_batches(batches: DataFrame) -> DataFrame:
    """Accepted distillation batches: the latest by event, distiller and fingerprint. Appending to a table and reading it so is the upsert of a batch."""
    w = Window.partitionBy(*BATCH_KEY).orderBy(F.col("created_at_unix_ms").desc(), F.col("id").desc())
    return batches.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def batches_of(batches: DataFrame, kind: str, fingerprint: str) -> DataFrame:
    """ledger_event_id and memories of a distiller's accepted batches."""
    mine = batches.filter((F.col("distiller_kind") == kind) & (F.col("distiller_fingerprint") == fingerprint))
    return latest_batches(mine).select("ledger_event_id", "memories")


def missing_batches(ledger: DataFrame, batches: DataFrame, kind: str, fingerprint: str) -> DataFrame:
    """Projected events without an accepted batch of a distiller."""
    have = batches.filter((F.col("distiller_kind") == kind) & (F.col("distiller_fingerprint") == fingerprint)).select(F.col("ledger_event_id").alias("id"))
    return ledger.filter("projected_at_unix_ms IS NOT NULL").join(have, "id", "left_anti")


def pending_with_batches(ledger: DataFrame, batches: DataFrame, kind: str, fingerprint: str, limit: int | None = None) -> DataFrame:
    """Events not projected yet that a distiller has an accepted batch for, with its memories, in order of observation and arrival."""
    rows = ledger.filter("projected_at_unix_ms IS NULL").join(batches_of(batches, kind, fingerprint).withColumnRenamed("ledger_event_id", "id"), "id").orderBy("observed_at_unix_ms", "id")
    return rows if limit is None else rows.limit(guarded(limit, "limit"))


def guarded(limit: int, name: str) -> int:
    """A limit that Spark can take; raises ValueError for others."""
    if not 0 <= limit < 1 << 31:
        raise ValueError(f"{name} must be between 0 and {(1 << 31) - 1}")
    return limit

"""Projection of an ADD-only ledger into the memory graph, by aggregates and windows.

Each event adds an episode, a typed memory and entity cues.  A family is (scope, kind, base key); its versions
follow each other by the time they were observed.  Of events at the same time the first arrival makes the version and
the others only cite it; what one event says twice is merged.  ``lead`` closes each version where the next begins.
Revisions need the order of events and take ``operators.fold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chronolith.functions.classify import memory_kind, revision_op
from chronolith.functions.text import canonical_key, concise, estimate_tokens, merge_texts, stable_id, top_terms
from chronolith.operators.retrieve import cue_index
from chronolith.runtime import materialize

BODY_LIMIT, CUES = 900, 8
FAMILY = ["tenant_id", "project_id", "env", "kind", "base_key"]


def classified(ledger: DataFrame) -> DataFrame:
    """Adds body, memory_kind and op; a blank body makes a noop."""
    body = concise(F.col("text"), BODY_LIMIT)
    rows = ledger.withColumn("body", body).withColumn("memory_kind", memory_kind(F.col("name"), F.col("body")))
    return rows.withColumn("op", F.when(F.col("body") == "", "noop").otherwise(revision_op(F.col("body"))))


def memories(events: DataFrame) -> DataFrame:
    """The two memories of each event in order: its episode, then the typed one. events: classified."""
    both = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("episode").alias("kind"), F.concat("span_kind", F.lit(" "), "name", F.lit(": "), "body").alias("text")),
        F.struct(F.lit(1).alias("part"), F.col("memory_kind").alias("kind"), F.col("body").alias("text")),
    )
    span = F.concat(F.lit("episode:"), "trace_id", F.lit(":"), "span_id", F.lit(":"), F.col("seq").cast("string"))
    rows = events.filter("op <> 'noop'").withColumn("env", F.coalesce("environment_id", F.lit("")))
    rows = rows.select(F.col("id").alias("event_id"), "tenant_id", "project_id", "env", "environment_id", "trace_id", "span_id", "seq", F.col("observed_at_unix_ms").alias("valid_from"), span.alias("span_key"), F.inline(both))
    return rows.withColumn("base_key", F.when(F.col("kind") == "episode", F.col("span_key")).otherwise(canonical_key(F.col("kind"), F.col("text")))).drop("span_key")


def cue_memories(said: DataFrame) -> DataFrame:
    """The entity cues of each memory: the top terms of its version, which speaks in the words that came first."""
    version = [*FAMILY, "valid_from"]
    first = said.groupBy(*version).agg(F.min_by("text", F.struct("event_id", "part")).alias("first_text"))
    said = said.join(first, version).withColumn("text", F.col("first_text")).drop("first_text")
    rows = said.select("event_id", "tenant_id", "project_id", "env", "environment_id", "trace_id", "span_id", "seq", "valid_from", F.col("part").alias("of_part"), F.posexplode(top_terms(F.col("text"), CUES)).alias("pos", "text"))
    return rows.withColumn("kind", F.lit("entity_cue")).withColumn("base_key", canonical_key(F.col("kind"), F.col("text"))).withColumn("part", 2 + 100 * F.col("of_part") + F.col("pos")).drop("pos")


def _key(kind: str = "kind", base: str = "base_key", valid_from: str = "valid_from"):
    return F.when(F.col(kind) == "episode", F.col(base)).otherwise(F.concat(base, F.lit("|rev:"), F.col(valid_from).cast("string")))


def _node_id():
    return stable_id("node", F.col("tenant_id"), F.col("project_id"), F.col("env"), F.col("kind"), F.col("canonical_key"))


def identified(said: DataFrame) -> DataFrame:
    """Adds canonical_key and node_id of the version that each memory goes to."""
    return said.withColumn("canonical_key", _key()).withColumn("node_id", _node_id())


def nodes_add_only(said: DataFrame, clock_unix_ms: int) -> DataFrame:
    """memory_nodes of all identified memories and cues; ``clock_unix_ms`` is the projection's clock."""
    version = [*FAMILY, "valid_from", "canonical_key", "node_id"]
    told = F.array_sort(F.collect_list(F.struct("part", "text")))  # what one event says of one version: two memories and their cues at most
    each = said.groupBy(*version, "event_id").agg(told.alias("told"), F.count("*").cast("int").alias("observation_count"), F.first("environment_id").alias("environment_id"))
    rows = each.groupBy(*version).agg(F.min_by(F.struct("told", "observation_count", "environment_id", F.col("event_id").alias("first_event")), "event_id").alias("f")).select(*version, "f.*")
    rows = rows.withColumn("text", merge_texts(F.transform("told", lambda x: x["text"])))
    w = Window.partitionBy(*FAMILY).orderBy("valid_from")
    rows = rows.withColumn("valid_to_unix_ms", F.lead("valid_from").over(w)).withColumn("valid_to_event_id", F.lead("first_event").over(w))
    return rows.select(
        F.col("node_id").alias("id"), "tenant_id", "project_id", "environment_id", "kind", "text", "canonical_key", F.lit(clock_unix_ms).cast("long").alias("created_at_unix_ms"), F.lit(clock_unix_ms).cast("long").alias("updated_at_unix_ms"),
        F.col("valid_from").alias("valid_from_unix_ms"), "valid_to_unix_ms", "valid_to_event_id", F.round(F.least(F.lit(0.65) + 0.05 * (F.col("observation_count") - 1), F.lit(1.0)), 6).alias("confidence"),
        estimate_tokens(F.col("text")).alias("token_estimate"), "observation_count",
    )


def node_spans(said: DataFrame) -> DataFrame:
    """Which message each node cites."""
    return said.select("node_id", "tenant_id", "project_id", "trace_id", "span_id", "seq").distinct()


def edges_add_only(said: DataFrame, cues: DataFrame) -> DataFrame:
    """mentions (memory to cue), derived_from and observed_in (typed memory to episode); the first event of an edge counts."""
    scope = ["event_id", "tenant_id", "project_id", "environment_id"]
    ends = cues.select("event_id", F.col("of_part").alias("part"), F.col("node_id").alias("cue_id"))
    base = said.select(*scope, "part", "node_id", F.col("valid_from").alias("at"))
    mention = base.join(ends, ["event_id", "part"]).select(*scope, "at", F.col("node_id").alias("from_node_id"), F.col("cue_id").alias("to_node_id"), F.lit("mentions").alias("kind"), F.lit(0.55).alias("weight"))
    pair = base.groupBy(*scope, "at").agg(F.min(F.struct("part", "node_id")).alias("a"), F.max(F.struct("part", "node_id")).alias("b"))
    pair = pair.select(*scope, "at", F.col("b.node_id").alias("from_node_id"), F.col("a.node_id").alias("to_node_id"))
    link = pair.select("*", F.explode(F.array(F.struct(F.lit("derived_from").alias("kind"), F.lit(0.8).alias("weight")), F.struct(F.lit("observed_in").alias("kind"), F.lit(0.9).alias("weight")))).alias("x")).select(*pair.columns, "x.*")
    rows = mention.unionByName(link).filter("from_node_id <> to_node_id")
    first = rows.groupBy("from_node_id", "to_node_id", "kind").agg(F.min_by(F.struct("tenant_id", "project_id", "environment_id", "weight", "at", "event_id"), F.struct("at", "event_id")).alias("f"))
    return first.select("f.tenant_id", "f.project_id", "f.environment_id", "from_node_id", "to_node_id", "kind", "f.weight", F.col("f.at").alias("created_at_unix_ms"), F.col("f.event_id").alias("source_event_id"))


def project(ledger: DataFrame, clock_unix_ms: int) -> dict[str, DataFrame]:
    """nodes, edges, spans and cues of the events that add."""
    said = materialize(identified(memories(classified(ledger).filter("op = 'add'"))), "said")
    cues = materialize(identified(cue_memories(said)), "cues")
    every = said.unionByName(cues.drop("of_part"))
    nodes = nodes_add_only(every, clock_unix_ms)
    return {"nodes": nodes, "edges": edges_add_only(said, cues), "spans": node_spans(every), "cues": cue_index(nodes)}

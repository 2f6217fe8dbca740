"""Reads on two clocks: what was valid at one time as known at another.

Tables as in the ledger and the graph: nodes (memory_nodes), citations (node_spans), edges
(memory_edges) and the ledger reduced to one row a message.  All of it is joins on scope, node or event keys;
an instant may be a literal or a column, so one plan serves one read or many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronolith.functions.text import canonical_key, estimate_tokens, merge_texts
from chronolith.sources.ledger import EXACT_KEY

REVISION_KINDS = ["contradicts", "supersedes"]


def env_of(df: DataFrame) -> Column:
    return F.coalesce(df["environment_id"], F.lit(""))


def active_at(at: Column | int) -> Column:
    """valid_from <= at < valid_to, where a null end is open."""
    at = F.lit(at)
    return (F.col("valid_from_unix_ms") <= at) & (F.col("valid_to_unix_ms").isNull() | (F.col("valid_to_unix_ms") > at))


def node_events(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """node_id, event_id, observed, ingested, text of every cited event that is in the ledger."""
    events = ledger.select(*EXACT_KEY, F.col("id").alias("event_id"), F.col("observed_at_unix_ms").alias("observed"), F.col("ingested_at_unix_ms").alias("ingested"), F.col("text").alias("event_text"))
    return citations.select("node_id", *EXACT_KEY).distinct().join(events, EXACT_KEY).select("node_id", "event_id", "observed", "ingested", "event_text")


def first_events(sources: DataFrame) -> DataFrame:
    """node_id, first_event_id: the earliest cited event by observation and arrival."""
    return sources.groupBy("node_id").agg(F.min(F.struct("observed", "event_id")).alias("f")).select("node_id", F.col("f.event_id").alias("first_event_id"))


def with_closure(nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds closed_ingested: when the closing event was ingested; null if it is unknown."""
    closing = ledger.select(F.col("id").alias("valid_to_event_id"), F.col("ingested_at_unix_ms").alias("closed_ingested"))
    return nodes.join(closing, "valid_to_event_id", "left")


def known_sources(sources: DataFrame, as_of: int, known_at: int | None) -> DataFrame:
    """node_id of the nodes with a source observed by ``as_of`` and ingested by ``known_at``."""
    if known_at is None:
        raise ValueError("without known_at every node counts as known")
    return sources.filter((F.col("observed") <= as_of) & (F.col("ingested") <= known_at)).select("node_id").distinct()


def _closed(as_of: Column, known_at: Column | None) -> Column:
    """Whether a node has ended by as_of and that was known."""
    ended = F.col("valid_to_unix_ms").isNotNull() & (F.col("valid_to_unix_ms") <= as_of)
    return ended if known_at is None else ended & F.coalesce(F.col("closed_ingested") <= known_at, F.lit(False))


def read_nodes(nodes: DataFrame, sources: DataFrame, ledger: DataFrame, as_of: int, known_at: int | None) -> DataFrame:
    """Nodes that had begun and were known, with ``stale``: closed as of then, as known then. Not stale is visible."""
    begun = nodes.filter(F.col("valid_from_unix_ms") <= as_of)
    if known_at is None:
        return begun.withColumn("stale", _closed(F.lit(as_of), None))
    begun = begun.join(known_sources(sources, as_of, known_at).withColumnRenamed("node_id", "id"), "id", "left_semi")
    return with_closure(begun, ledger).withColumn("stale", _closed(F.lit(as_of), F.lit(known_at))).drop("closed_ingested")


def visible(nodes: DataFrame, sources: DataFrame, ledger: DataFrame, as_of: int, known_at: int | None = None) -> DataFrame:
    return read_nodes(nodes, sources, ledger, as_of, known_at).filter("NOT stale").drop("stale")


def stale(nodes: DataFrame, sources: DataFrame, ledger: DataFrame, as_of: int, known_at: int | None = None) -> DataFrame:
    return read_nodes(nodes, sources, ledger, as_of, known_at).filter("stale").drop("stale")


def _snapshot_columns(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Text, tokens, observations and the newest observation over cited events, merged in order."""
    agg = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("observed", "event_id", "event_text"))).alias("e"), F.count("*").cast("int").alias("observations"), F.max("observed").alias("newest"))
    text = merge_texts(F.transform("e", lambda x: x["event_text"]))
    return agg.select(*keys, text.alias("snapshot_text"), "observations", "newest").filter(F.trim("snapshot_text") != "")


def snapshot(nodes: DataFrame, sources: DataFrame, as_of: int, known_at: int) -> DataFrame:
    """Nodes as their known source events tell them: text, token_estimate, observation_count, updated_at."""
    known = sources.filter((F.col("observed") <= as_of) & (F.col("ingested") <= known_at))
    told = _snapshot_columns(known, ["node_id"]).withColumnRenamed("node_id", "id")
    rows = nodes.filter(F.col("valid_from_unix_ms") <= as_of).join(told, "id")
    return (
        rows.withColumn("text", F.col("snapshot_text"))
        .withColumn("token_estimate", estimate_tokens(F.col("snapshot_text")))
        .withColumn("observation_count", F.greatest("observations", F.lit(1)))
        .withColumn("updated_at_unix_ms", F.greatest("created_at_unix_ms", "newest"))
        .drop("snapshot_text", "observations", "newest")
    )


def visible_edges(edges: DataFrame, read: DataFrame, ledger: DataFrame, as_of: int, known_at: int | None) -> DataFrame:
    """Edges to be seen: revisions if the newer end is visible and the older stale; others by creation, source and ends.

    ``read``: what ``read_nodes`` returned for the same instants.
    """
    ends = read.select("id", "stale")
    rows = edges.join(ends.select(F.col("id").alias("from_node_id"), F.col("stale").alias("from_stale")), "from_node_id", "left")
    rows = rows.join(ends.select(F.col("id").alias("to_node_id"), F.col("stale").alias("to_stale")), "to_node_id", "left")
    revision = ~F.col("from_stale") & F.col("to_stale")
    ordinary = F.col("created_at_unix_ms") <= as_of
    if known_at is not None:
        source = ledger.select(F.col("id").alias("source_event_id"), F.col("ingested_at_unix_ms").alias("source_ingested"))
        rows = rows.join(source, "source_event_id", "left")
        ordinary = ordinary & (F.col("source_ingested") <= known_at) & ~F.col("from_stale") & ~F.col("to_stale")
    seen = F.when(F.col("kind").isin(REVISION_KINDS), revision).otherwise(ordinary)
    return rows.filter(F.coalesce(seen, F.lit(False))).select(*edges.columns)


def cited_spans(citations: DataFrame, ledger: DataFrame, as_of: int | None, known_at: int | None) -> DataFrame:
    """Citations to be read: spans without a ledger row stay unless known_at is given."""
    events = ledger.select(*EXACT_KEY, F.col("observed_at_unix_ms").alias("observed"), F.col("ingested_at_unix_ms").alias("ingested"))
    rows = citations.distinct().join(events, EXACT_KEY, "left")
    if as_of is not None:
        rows = rows.filter(F.col("observed").isNull() | (F.col("observed") <= as_of))
    if known_at is not None:
        rows = rows.filter(F.col("ingested") <= known_at)
    return rows.select("node_id", *EXACT_KEY)


def family_versions(nodes: DataFrame) -> DataFrame:
    """Versions of each family (scope, kind, key before |rev:), newest first, with the version that follows."""
    from pyspark.sql import Window

    family = F.substring_index("canonical_key", "|rev:", 1)
    rows = nodes.withColumn("env", F.coalesce("environment_id", F.lit(""))).withColumn("family_key", family)
    w = Window.partitionBy("tenant_id", "project_id", "env", "kind", "family_key").orderBy(F.col("valid_from_unix_ms").desc(), F.col("updated_at_unix_ms").desc(), "id")
    return rows.withColumn("version_rank", F.row_number().over(w)).withColumn("next_valid_from", F.lag("valid_from_unix_ms").over(w))


def backfilled_closings(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """valid_to_event_id for closed nodes that lack it: the earliest source of a revision edge, else of the next version."""
    open_ = nodes.filter("valid_to_unix_ms IS NOT NULL AND valid_to_event_id IS NULL")
    by_edge = edges.filter(F.col("kind").isin(REVISION_KINDS)).groupBy(F.col("to_node_id").alias("id")).agg(F.min("source_event_id").alias("edge_event"))
    scope = ["tenant_id", "project_id", "env", "kind", "family_key", "valid_to_unix_ms"]
    keyed = lambda df: df.withColumn("env", F.coalesce("environment_id", F.lit(""))).withColumn("family_key", F.substring_index("canonical_key", "|rev:", 1))
    nxt = keyed(nodes).withColumnRenamed("id", "node_id").withColumn("valid_to_unix_ms", F.col("valid_from_unix_ms")).select(*scope, "node_id")
    nxt = nxt.join(sources.select("node_id", "event_id"), "node_id").groupBy(*scope).agg(F.min("event_id").alias("next_event"))
    rows = keyed(open_).join(by_edge, "id", "left").join(nxt, scope, "left")
    return rows.select("id", F.coalesce("edge_event", "next_event").alias("valid_to_event_id")).filter("valid_to_event_id IS NOT NULL")


def nodes_by_id(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Nodes whose id is asked for; one or many at a time. asked: id."""
    return nodes.join(asked.select("id").distinct(), "id", "left_semi")


def nodes_by_scope_key(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """ask and node_id of the node with a scope, kind and canonical key. asked: ask, tenant_id, project_id, environment_id (null is none), kind, canonical_key."""
    keys = ["tenant_id", "project_id", "env", "kind", "canonical_key"]
    scoped = lambda df: df.withColumn("env", env_of(df))
    return scoped(asked).select("ask", *keys).join(scoped(nodes).select(F.col("id").alias("node_id"), *keys), keys).select("ask", "node_id")


def node_versions_by_text(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """ask and node_id of the version that a text began at a time. asked: ask, tenant_id, project_id, environment_id, kind, text, valid_from_unix_ms.

    Of several versions that began at once the first of the family's order (last updated, then smallest id) is taken.
    """
    keys = ["tenant_id", "project_id", "env", "kind", "family", "valid_from_unix_ms"]
    q = asked.withColumn("env", env_of(asked)).withColumn("family", canonical_key(F.col("kind"), F.col("text"))).select("ask", *keys)
    n = nodes.withColumn("env", env_of(nodes)).withColumn("family", F.substring_index("canonical_key", "|rev:", 1)).select(F.col("id").alias("node_id"), *keys, "updated_at_unix_ms")
    best = q.join(n, keys).groupBy("ask").agg(F.min_by("node_id", F.struct(-F.col("updated_at_unix_ms"), "node_id")).alias("node_id"))
    return best


def rebuild_reasons(nodes: DataFrame, edges: DataFrame, citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """metric, value: what an older projection left that only a rebuild mends. Edges without a source event, closed nodes without a closing event, and
    closed nodes whose closing event is ambiguous: a revising node cites several events of the moment they were closed."""
    closed = nodes.filter("valid_to_unix_ms IS NOT NULL")
    revising = edges.filter(F.col("kind").isin(REVISION_KINDS)).select(F.col("to_node_id").alias("id"), F.col("from_node_id").alias("node_id"))
    ends = closed.select("id", F.col("valid_to_unix_ms").alias("observed")).join(revising, "id")
    told = node_events(citations, ledger).select("node_id", "observed", "event_id")
    doubtful = ends.join(told, ["node_id", "observed"]).groupBy("id", "node_id").agg(F.countDistinct("event_id").alias("n")).filter("n > 1").select("id").distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    return (
        count(edges.filter("source_event_id IS NULL"), "edges_without_source_event")
        .unionByName(count(closed.filter("valid_to_event_id IS NULL"), "closed_without_event"))
        .unionByName(count(doubtful, "closing_event_ambiguous"))
    )

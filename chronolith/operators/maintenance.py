"""Counts, integrity, repair, audit and rate limits of a memory store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from chronolith.functions.classify import KINDS
from chronolith.operators.bitemporal import active_at

AUDIT_SCHEMA = "id long, occurred_at_unix_ms long, actor string, action string, outcome string, route string, status_code int, detail string"


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("ledger_events"), F.count_if(F.col("projected_at_unix_ms").isNull()).alias("pending_events"))


def node_stats(nodes: DataFrame, now: int) -> DataFrame:
    """One pass: nodes, active nodes, their tokens, and active nodes of each kind."""
    active = active_at(now)
    tokens = F.col("token_estimate").cast("long")
    return nodes.agg(
        F.count("*").alias("nodes"), F.count_if(active).alias("active_nodes"), F.coalesce(F.sum(tokens), F.lit(0)).alias("total_node_tokens"), F.coalesce(F.sum(F.when(active, tokens)), F.lit(0)).alias("active_node_tokens"),
        *[F.count_if(active & (F.col("kind") == k)).alias(f"active_{k}_nodes") for k in KINDS],
    )


def _rows(df: DataFrame) -> DataFrame:
    """metric, value of a one-row table of counts."""
    return df.unpivot([], df.columns, "metric", "value").select("metric", F.col("value").cast("long").alias("value"))


def stats(ledger: DataFrame, nodes: DataFrame, edges: DataFrame, now: int, audit: DataFrame | None = None) -> DataFrame:
    """metric, value of each count of a store; every table is read once."""
    out = _rows(ledger_stats(ledger)).unionByName(_rows(node_stats(nodes, now))).unionByName(_rows(edges.agg(F.count("*").alias("edges"))))
    return out if audit is None else out.unionByName(_rows(audit.agg(F.count("*").alias("audit_events"))))


def integrity(nodes: DataFrame, edges: DataFrame, spans: DataFrame, cues: DataFrame) -> DataFrame:
    """metric, value: rows that point to no node."""
    ids = nodes.select("id")
    lost = lambda df, col, name: _rows(df.join(ids.withColumnRenamed("id", col), col, "left_anti").agg(F.count("*").alias(name)))
    out = lost(edges, "from_node_id", "orphan_edges_from").unionByName(lost(edges, "to_node_id", "orphan_edges_to"))
    return out.unionByName(lost(spans, "node_id", "orphan_node_spans")).unionByName(lost(cues, "node_id", "orphan_cue_index_entries"))


def without_orphans(nodes: DataFrame, edges: DataFrame, spans: DataFrame, cues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, citations and cues whose nodes exist."""
    held = lambda df, col: df.join(nodes.select(F.col("id").alias(col)), col, "left_semi")
    return held(held(edges, "from_node_id"), "to_node_id"), held(spans, "node_id"), held(cues, "node_id")


def audit_recent(audit: DataFrame, limit: int) -> DataFrame:
    return audit.orderBy(F.col("occurred_at_unix_ms").desc(), F.col("id").desc()).limit(limit)


def audit_pruned(audit: DataFrame, before_unix_ms: int | None = None, retain_latest: int | None = None) -> DataFrame:
    """What stays: rows from a time on, then the newest of them.

    The newest n are found by a top-n of the order key (each task keeps n), and all rows from the n-th on stay.
    """
    kept = audit if before_unix_ms is None else audit.filter(F.col("occurred_at_unix_ms") >= before_unix_ms)
    if retain_latest is None:
        return kept
    if retain_latest == 0:
        return kept.filter("false")
    keys = kept.select("occurred_at_unix_ms", "id").orderBy(F.col("occurred_at_unix_ms").desc(), F.col("id").desc()).limit(retain_latest)
    last = keys.agg(F.min("occurred_at_unix_ms").alias("t"), F.min(F.struct("occurred_at_unix_ms", "id")).alias("key")).first()
    if last["key"] is None:
        return kept
    t, id_ = last["key"]["occurred_at_unix_ms"], last["key"]["id"]
    return kept.filter((F.col("occurred_at_unix_ms") > t) | ((F.col("occurred_at_unix_ms") == t) & (F.col("id") >= id_)))


def request_metrics(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action", "outcome").agg(F.count("*").alias("requests"))


def rate_limited(requests: DataFrame, actor: str, at: str, key: str, max_requests: int, window_ms: int = 60_000) -> DataFrame:
    """key, allowed, retry_after_seconds of each request, by a fixed window that opens with an actor's first request.

    A stream over rows sorted by actor and time; the state is one window, however many requests an actor makes.
    Zero allows everything.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, opened, count = None, 0, 0
        for frame in frames:
            allowed, wait = [], []
            for a, t in zip(frame["a"], frame["t"]):
                if a != who:
                    who, opened, count = a, t, 0
                if t - opened >= window_ms:
                    opened, count = t, 0
                ok = max_requests == 0 or count < max_requests
                count += ok
                allowed.append(ok)
                wait.append(0 if ok else (max(window_ms - (t - opened), 1) + 999) // 1000)
            yield pd.DataFrame({"k": frame["k"], "allowed": allowed, "retry_after_seconds": wait})

    rows = requests.select(F.coalesce(F.col(actor), F.lit("")).alias("a"), F.col(at).alias("t"), F.col(key).alias("k"))
    rows = rows.repartition("a").sortWithinPartitions("a", "t", "k")
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, allowed boolean, retry_after_seconds long").withColumnRenamed("k", key)


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")

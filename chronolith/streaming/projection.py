"""Structured Streaming: a ledger that grows by files, projected in micro-batches.

``stream_into`` appends each micro-batch first-wins and folds the scopes it touches again, so a late event gives the same
graph as a rebuild.  The engine's manifest is published once a batch; a batch that is delivered again inserts
nothing, so the projection is exactly-once.  No watermark is set: late events of any age count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolith.engine import MemoryEngine
from chronolith.functions.identity import message_key
from chronolith.operators.dedupe import MessageStore
from chronolith.operators.late import HOUR_MS, PeriodCounts, outcome, period_start
from chronolith.sources.ledger import EXACT_KEY, LEDGER_SCHEMA


def ledger_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as ledger events."""
    return spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def stream_into(events: DataFrame, engine: MemoryEngine, checkpoint: str, clock_unix_ms: int | None = None) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        engine.append(df)
        engine.project(clock_unix_ms)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_messages(events: DataFrame, within: str | None = None) -> DataFrame:
    """First arrivals by exact key.

    ``within``: so long after its first arrival a copy may come (an interval, by time of ingestion); the state then forgets keys that are older.
    Without it the state holds every key of the stream, as copies may come at any time; ``keep_once`` does the same in storage instead.
    """
    if within is None:
        return events.dropDuplicates(EXACT_KEY)
    timed = events.withColumn("_at", F.timestamp_millis("ingested_at_unix_ms")).withWatermark("_at", within)
    return timed.dropDuplicatesWithinWatermark(EXACT_KEY).drop("_at")


def keep_once(events: DataFrame, store: MessageStore, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Upsert every micro-batch as a sorted run of a message store; a batch that is delivered again changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        store.upsert(df, message_key(), F.col("id"), columns)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correct_periods(events: DataFrame, periods: PeriodCounts, checkpoint: str) -> StreamingQuery:
    """Log every micro-batch of messages, each once, and recompute the periods that it touches."""

    def batch(df: DataFrame, number: int) -> None:
        periods.log(df, F.col("id"), F.col("observed_at_unix_ms"), F.col("ingested_at_unix_ms"), F.lit(number))
        periods.apply(number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def period_counts(events: DataFrame, groups: list[str], period_ms: int = HOUR_MS, cutoff_ms: int = 6 * HOUR_MS) -> DataFrame:
    """Counts by group and period of the messages that came before the cut-off, in update mode."""
    late = outcome(F.col("observed_at_unix_ms"), F.col("ingested_at_unix_ms"), period_ms, cutoff_ms)
    rows = events.filter(late.isin("on_time", "correction")).withColumn("period_start_unix_ms", period_start(F.col("observed_at_unix_ms"), period_ms))
    return rows.groupBy(*groups, "period_start_unix_ms").agg(F.count("*").alias("messages"))

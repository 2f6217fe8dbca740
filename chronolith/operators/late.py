"""Per-period aggregates by event time that late records correct until a cut-off.

Raw messages are retained in an arrival log partitioned by batch and slot (a range of periods, one day by default), gathered
by slot before they are written, so a batch adds about one file a slot it touches.  For each batch, ``apply`` finds the slots its
accepted messages touch, recomputes those partitions entirely from the retained raw messages - the counts of every period and the list of
the messages that corrected it after its end - and publishes them by one manifest that is created in a single step, so readers
see either the old or the new version of every slot.  Messages whose period is past its cut-off touch no slot; ``apply``
publishes them as rejected.  ``counts``, ``corrections`` and ``rejected`` read what was published and nothing else.

Outcomes: ``on_time`` (ingested before the period ended), ``correction`` (before period end + cut-off),
``too_late`` (after that), ``no_time`` (a null clock; kept in the log, counted nowhere).
The slots a batch touches are listed on the driver: their number is bounded by the days between
the first and the last event time, not by the rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronolith.runtime import publish_once, scratch

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def period_start(observed: Column, period_ms: int = HOUR_MS) -> Column:
    return observed - F.pmod(observed, F.lit(period_ms))


def outcome(observed: Column, ingested: Column, period_ms: int = HOUR_MS, cutoff_ms: int = 6 * HOUR_MS) -> Column:
    end = period_start(observed, period_ms) + period_ms
    return (
        F.when(observed.isNull() | ingested.isNull(), "no_time")
        .when(ingested < end, "on_time")
        .when(ingested < end + cutoff_ms, "correction")
        .otherwise("too_late")
    )


class PeriodCounts:
    """Counts by group and period, kept right under late arrival."""

    def __init__(self, spark: SparkSession, groups: list[str], root: str | None = None, period_ms: int = HOUR_MS, cutoff_ms: int = 6 * HOUR_MS, slot_ms: int = DAY_MS):
        if slot_ms % period_ms:
            raise ValueError("a slot must hold whole periods")
        self.spark, self.groups, self.root = spark, groups, root or scratch(spark, "periods")
        self.period_ms, self.cutoff_ms, self.slot_ms = period_ms, cutoff_ms, slot_ms

    # -- arrival log ------------------------------------------------------------------------
    def _arrivals(self, df: DataFrame, event_id: Column, observed: Column, ingested: Column, batch: Column) -> DataFrame:
        kind = outcome(observed, ingested, self.period_ms, self.cutoff_ms)
        start = period_start(observed, self.period_ms)
        return df.select(
            event_id.alias("event_id"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(self.groups)],
            start.alias("period_start_unix_ms"), kind.alias("outcome"), ingested.alias("ingested"),
            batch.cast("int").alias("batch"), F.floor(start / F.lit(self.slot_ms)).cast("long").alias("slot"),
        )

    def log(self, df: DataFrame, event_id: Column, observed: Column, ingested: Column, batch: Column) -> None:
        """Retain raw messages; ``batch`` numbers them in order of arrival. A batch that is logged again replaces itself.

        Rows are gathered by batch and slot; adaptive execution cuts a slot that is too large for one task.
        """
        rows = self._arrivals(df, event_id, observed, ingested, batch)
        rows.hint("rebalance", "batch", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "slot").parquet(f"{self.root}/log")

    def arrivals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/log")

    # -- aggregates ------------------------------------------------------------------------
    def apply(self, batch: int) -> int:
        """Recompute the slots that a logged batch touches; returns how many."""
        log = self.arrivals()
        fresh = log.filter(F.col("batch") == batch)
        rows = fresh.filter(F.col("outcome").isin("on_time", "correction", "too_late")).groupBy("slot").agg(F.max(F.col("outcome") != "too_late").alias("accepted"), F.max(F.col("outcome") == "too_late").alias("refused")).collect()
        touched = sorted(r["slot"] for r in rows if r["accepted"])
        if not rows:
            return 0
        state = self._manifest()
        version = state["version"] + 1
        if touched:
            raw = log.filter(F.col("outcome").isin("on_time", "correction") & (F.col("batch") <= batch) & F.col("slot").isin(touched))
            keys = [f"g{i}" for i in range(len(self.groups))]
            counts = raw.groupBy("slot", *keys, "period_start_unix_ms").agg(F.count("*").alias("messages"), F.max("ingested").alias("as_of_unix_ms"))
            counts.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{self.root}/counts/version={version}")
            late = raw.filter("outcome = 'correction'").select("slot", "event_id", "period_start_unix_ms", "outcome")
            late.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{self.root}/corrections/version={version}")
        if any(r["refused"] for r in rows):
            refused = fresh.filter("outcome = 'too_late'").select("event_id", "period_start_unix_ms", "outcome")
            refused.coalesce(max(1, len(rows) // 8)).write.parquet(f"{self.root}/rejected/version={version}")
        late_slots = self._slots(f"corrections/version={version}")
        new = {
            "version": version, "counts": state["counts"] | {str(s): version for s in touched},
            "corrections": {s: v for s, v in state["corrections"].items() if int(s) not in touched} | {str(s): version for s in late_slots},
            "rejected": state["rejected"] + [version] * any(r["refused"] for r in rows),
        }
        if not publish_once(self.spark, f"{self.root}/manifest/{version:08d}.json", json.dumps(new)):
            raise RuntimeError(f"version {version} was published by another writer")
        return len(touched)

    def _slots(self, folder: str) -> list[int]:
        path, fs = self._fs(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return [int(n.removeprefix("slot=")) for n in names if n.startswith("slot=")]

    # -- what was published ------------------------------------------------------------------------
    def _published(self, kind: str, schema: str) -> DataFrame:
        state = self._manifest()[kind]
        paths = [f"{self.root}/{kind}/version={v}/slot={s}" for s, v in state.items()] if kind != "rejected" else [f"{self.root}/rejected/version={v}" for v in state]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _types(self) -> dict[str, str]:
        return dict(self.arrivals().dtypes)

    def counts(self) -> DataFrame:
        """The group columns, period_start_unix_ms, messages and as_of_unix_ms (the latest arrival counted)."""
        types = self._types()
        keys = [f"g{i}" for i in range(len(self.groups))]
        rows = self._published("counts", ", ".join([*(f"{k} {types[k]}" for k in keys), f"period_start_unix_ms long, messages long, as_of_unix_ms {types['ingested']}"]))
        return rows.select(*[F.col(k).alias(g) for k, g in zip(keys, self.groups)], "period_start_unix_ms", "messages", "as_of_unix_ms")

    def _late(self, kind: str) -> DataFrame:
        return self._published(kind, f"event_id {self._types()['event_id']}, period_start_unix_ms long, outcome string")

    def corrections(self) -> DataFrame:
        """event_id, period_start_unix_ms, outcome of the messages that corrected a period after its end, from the recomputed slots."""
        return self._late("corrections")

    def rejected(self) -> DataFrame:
        """The same of the messages that came after the cut-off."""
        return self._late("rejected")

    # -- manifests ------------------------------------------------------------------------
    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        path, fs = self._fs(f"{self.root}/manifest")
        names = sorted(n for f in fs.listStatus(path) if (n := f.getPath().getName()).endswith(".json")) if fs.exists(path) else []
        if not names:
            return {"version": 0, "counts": {}, "corrections": {}, "rejected": []}
        path, fs = self._fs(f"{self.root}/manifest/{names[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

"""Exactly one copy of every message: idempotent upsert into hash-bucketed sorted storage.

A store is a list of sorted runs.  A run holds deliveries, hashed by (identifier, salt) into buckets of one file each, every
file in the order identifier, salt, order value, row digest.  ``upsert`` appends one run for a batch.  ``compact`` merges
runs two by two, in a tree: a merge is a full outer sort-merge join of two runs on the whole sort key, bucket by bucket,
without exchange or sort, whose output is written in the order in which it comes.  The same delivery in both runs
collapses there, so a batch that is sent again changes nothing.  A last pass over the single run, again without exchange
or sort, collapses equal identifiers to the copy that comes first in ``order``; of the others only the link to the kept one
stays, their columns are let go.

The number of buckets follows from the bytes of the first batch (``BUCKET_BYTES`` each, at most), and grows when a compaction finds
buckets that hold several times as much.

Skew: identifiers that hold more than a small share of a run are found by a bounded frequent-items
sketch, and their rows are spread over ``salts`` buckets.  Their first copies of each salt, at most
``salts`` rows for each of at most ``4 * buckets`` identifiers (1,000 in all), are reduced once more and broadcast.

Defined cases: null key parts equal each other; a null order value comes last; of equal order values
the smaller row digest is kept; a row that equals another in identifier, order value and all stored columns is the same delivery and
counts once; an empty input gives an empty result; all other columns are carried in a struct, so their names may be anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from chronolith.runtime import delete, partitions, scratch, settings

#: A salt is worth its cost only above this many rows of one identifier.
HOT_ROWS = 50_000
#: So many bytes at most are planned for a bucket of a run, and so many at least are worth a file.
BUCKET_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
_BUCKET = ["ident", "salt"]
_ORDER = ["late", "pos", "tie"]
_SORTED = [*_BUCKET, *_ORDER]

# Bucketed scans say how they are sorted, joins on more than the bucket columns need no exchange, and a writer takes rows as they come.
_MERGE = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.join.preferSortMergeJoin": "true",
}


def identifier(parts: list[Column]) -> Column:
    """The parts of a key as one string that is never null: each with its length before it, or a dash for null."""
    text = [p.cast("string") for p in parts]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


class MessageStore:
    def __init__(self, spark: SparkSession, buckets: int | None = None, salts: int = 32, hot_rows: int = HOT_ROWS, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.buckets, self.salts, self.hot_rows, self.bucket_bytes = spark, buckets, salts, hot_rows, bucket_bytes
        self.root, self.name = scratch(spark, "store"), f"chronolith_store_{uuid.uuid4().hex[:12]}"
        self.runs: list[str] = []  # names of runs, each a folder below the root
        self.schemas: dict[str, StructType] = {}
        self.bytes, self.made, self.settled = 0, 0, True
        self.hot: set[int] = set()
        self.arrivals = (0, 0)  # the first and last arrival batch of upsert_by_arrival

    # -- runs ------------------------------------------------------------------------
    @contextmanager
    def _tables(self, *runs: str) -> Iterator[list[DataFrame]]:
        """Runs as bucketed, sorted tables; the catalog forgets them afterwards."""
        names = [f"{self.name}_{r}" for r in runs]
        with settings(self.spark, _MERGE):
            try:
                for run, name in zip(runs, names):
                    columns = self._files(run)._jdf.schema().toDDL()
                    self.spark.sql(
                        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(_BUCKET)}) SORTED BY ({', '.join(_SORTED)}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'"
                    )
                yield [self.spark.table(name) for name in names]
            finally:
                for name in names:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _files(self, run: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[run]).parquet(f"{self.root}/{run}")

    def _write(self, rows: DataFrame) -> str:
        """A new run from rows that each task has in order, one bucket a task."""
        self.made += 1
        run = f"run{self.made}"
        self.schemas[run] = rows.schema
        with settings(self.spark, _MERGE):
            name = f"{self.name}_{run}"
            rows.write.format("parquet").option("path", f"{self.root}/{run}").bucketBy(self.buckets, *_BUCKET).saveAsTable(name)
            self.spark.sql(f"DROP TABLE {name}")
        return run

    def _sorted(self, rows: DataFrame) -> DataFrame:
        """Rows of ident, late, pos, rec, tie by bucket and in order; a delivery that is there several times counts once."""
        salt = F.lit(0)
        if self.hot:
            salt = F.when(F.xxhash64("ident").isin(sorted(self.hot)), F.pmod(F.xxhash64("pos", "tie"), F.lit(self.salts)).cast("int")).otherwise(F.lit(0))
        rows = rows.select("ident", salt.alias("salt"), *_ORDER, "rec").repartition(self.buckets, *_BUCKET)
        once = Window.partitionBy(*_SORTED[:-1]).orderBy("tie")
        return rows.withColumn("before", F.lag("tie").over(once)).filter("before IS NULL OR before <> tie").drop("before")

    def _facts(self, keyed: DataFrame, arrival: Column | None = None):
        """Rows, bytes, ends of ``arrival`` and the digests of identifiers with too many rows for one bucket, at most 4 * buckets, from one narrow pass."""
        most = min(4 * (self.buckets or partitions(self.spark)), 1000)
        text = [F.octet_length(F.col(f"rec.`{f.name}`")) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in keyed.schema["rec"].dataType.fields]
        size = sum((F.coalesce(t, F.lit(0)) for t in text), F.octet_length("ident") + 24)
        ends = (F.min(arrival), F.max(arrival)) if arrival is not None else (F.lit(None), F.lit(None))
        row = keyed.select("*", F.xxhash64("ident").alias("h")).agg(
            F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.expr(f"approx_top_k(h, {most}, {max(10_000, 8 * most)})").alias("top"), ends[0].alias("lo"), ends[1].alias("hi")
        ).first()
        if self.buckets is None:
            self.buckets = max(min(partitions(self.spark), -(-row["bytes"] // LEAST_BYTES)), -(-row["bytes"] // self.bucket_bytes), 1)
        least = max(self.hot_rows, row["n"] // (4 * self.buckets))
        return row, {x["item"] for x in row["top"] or [] if x["count"] > least}

    def _keyed(self, batch: DataFrame, key: list[Column], order: Column, columns: list[str] | None, arrival: Column | None = None) -> DataFrame:
        columns = batch.columns if columns is None else columns
        if dict(batch.select(order.alias("o")).dtypes)["o"] not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError("the order must be a whole number")
        rec = F.struct(*[batch[f"`{c}`"] for c in columns]) if columns else F.struct(order.alias("ord"))
        also = [] if arrival is None else [arrival.alias("arrival")]
        rows = batch.select(identifier(key).alias("ident"), order.cast("long").alias("pos"), rec.alias("rec"), *also)
        return rows.select("ident", F.col("pos").isNull().alias("late"), F.coalesce("pos", F.lit(0)).alias("pos"), F.xxhash64("rec").alias("tie"), "rec", *rows.columns[3:])

    def _append(self, keyed: DataFrame) -> None:
        self.runs.append(self._write(self._sorted(keyed)))
        self.settled = False

    def _grown(self, hot: set[int]) -> None:
        """Earlier runs are laid out anew if identifiers became hot or buckets are far too full; rare, and the only time that a run is shuffled again."""
        needed = -(-self.bytes // self.bucket_bytes)
        if not (hot - self.hot) and needed <= 4 * (self.buckets or needed):
            return
        self.hot |= hot
        if self.runs:
            self.buckets = max(self.buckets, needed)
            old, self.runs = self.runs, []
            for run in old:
                self._append(self._files(run).select("ident", *_ORDER, "rec"))
            self._forget(old)

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            delete(self.spark, f"{self.root}/{run}")

    # -- writing ------------------------------------------------------------------------
    def upsert(self, batch: DataFrame, key: list[Column], order: Column, columns: list[str] | None = None) -> "MessageStore":
        """Append a batch as one sorted run. Sending a batch, or any of its rows, again changes nothing."""
        keyed = self._keyed(batch, key, order, columns)
        row, hot = self._facts(keyed)
        self.bytes += row["bytes"]
        self._grown(hot)
        self._append(keyed)
        return self

    def upsert_by_arrival(self, rows: DataFrame, key: list[Column], order: Column, arrival: str, columns: list[str] | None = None, blocks: int = 4) -> "MessageStore":
        """Append a table of many arrival batches as one run for each block of neighbouring batches; ``arrival`` numbers the batches, null is in the first."""
        number = rows[f"`{arrival}`"]
        row, hot = self._facts(self._keyed(rows, key, order, columns, number), F.col("arrival"))
        self.bytes += row["bytes"]
        self._grown(hot)
        lo, hi = self.arrivals = (row["lo"], row["hi"]) if row["lo"] is not None else (0, 0)
        width = max(-(-(hi - lo + 1) // blocks), 1)
        for n in range(blocks):
            inside = (number >= lo + n * width) & (number < lo + (n + 1) * width)
            self._append(self._keyed(rows.filter(inside | number.isNull() if n == 0 else inside), key, order, columns))
        return self

    def compact(self) -> "MessageStore":
        """Merge all runs into one, in which equal identifiers are collapsed."""
        if self.settled:
            return self
        self._grown(set())
        while len(self.runs) > 1:
            merged = [self._merged(*pair) if len(pair) == 2 else pair[0] for pair in (self.runs[i : i + 2] for i in range(0, len(self.runs), 2))]
            self._forget([r for r in self.runs if r not in merged])
            self.runs = merged
        old = self.runs
        with self._tables(*old) as (rows,):
            self.runs = [self._write(self._collapsed(rows))]
        self._forget(old)
        self.settled = True
        return self

    def _merged(self, a: str, b: str) -> str:
        with self._tables(a, b) as (left, right):
            return self._write(self.merge_plan(left, right))

    @staticmethod
    def merge_plan(left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one, in order. A kept row's columns win over those that an earlier compaction let go."""
        both = left.select(*_SORTED, "rec").join(right.select(*_SORTED, F.col("rec").alias("other")).hint("merge"), _SORTED, "full")
        return both.select(*_SORTED, F.coalesce("rec", "other").alias("rec"))

    def _collapsed(self, rows: DataFrame) -> DataFrame:
        """Every delivery with the order value of the copy to keep: kept_late, kept_pos, is_kept; only that copy has its columns."""
        w = Window.partitionBy(*_BUCKET).orderBy(*_ORDER)
        place = F.struct(*_ORDER, "salt")
        out = rows.select(*_SORTED, "rec", F.first(place).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("head"))
        best = F.col("head")
        if self.hot:
            firsts = out.filter(F.xxhash64("ident").isin(sorted(self.hot)) & (F.col("head") == place))
            firsts = firsts.groupBy(F.col("ident").alias("hot_ident")).agg(F.min("head").alias("best"))  # at most 4 * buckets identifiers
            out = out.join(F.broadcast(firsts), F.col("ident") == F.col("hot_ident"), "left")
            best = F.coalesce("best", "head")
        kept = best == place
        return out.select(*_SORTED, F.when(kept, F.col("rec")).alias("rec"), best["late"].alias("kept_late"), best["pos"].alias("kept_pos"), kept.alias("is_kept"))

    # -- reading ------------------------------------------------------------------------
    def _read(self) -> DataFrame:
        self.compact()
        if not self.runs:
            raise ValueError("the store is empty: nothing was upserted")
        return self._files(self.runs[0])

    def kept(self) -> DataFrame:
        """One row a message, with the columns that were upserted; runs that are not merged yet are merged first."""
        return self._read().filter("is_kept").select("rec.*")

    def dropped(self) -> DataFrame:
        """kept_id and dropped_id of every other copy."""
        value = lambda late, pos: F.when(~F.col(late), F.col(pos))
        return self._read().filter("NOT is_kept").select(value("kept_late", "kept_pos").alias("kept_id"), value("late", "pos").alias("dropped_id"))

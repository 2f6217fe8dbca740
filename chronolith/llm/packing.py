"""Filling containers of fixed capacity with documents, split only if they exceed the capacity alone.

Sizes are whole tokens, so a container of capacity C sees at most C distinct sizes: the packing is planned on
that histogram, whose size depends on the capacity and never on the corpus, and moves in runs of equal
items.  Items above C/3 meet at most in pairs: from the largest size down, each is matched with the largest that
still fits.  Items up to C/3 follow in falling size, each run into the tightest gaps it fits.  Documents then look up
their bin by their rank among the items of their size.

Skew: ranks of a size that many items share are taken within salts, with the counts of the salts before as offset.
Defined cases: null and empty texts have no tokens and lie in bin 0; a document above C gives full pieces, each alone
in a bin, and one rest that is packed; repeated rows are placed each on their own; an empty table places nothing;
capacities below 1 or null and containers without a name are refused.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronolith.runtime import materialize

#: Items of one size whose ranks one task may give.
ROWS_A_RANK = 1_000_000


class Plan:
    """Runs of equal items for one capacity: items lo.. of a size lie ``each`` to a bin from ``bin`` on."""

    def __init__(self, capacity: int, histogram: dict[int, int]):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int]] = []  # size, lo, each, bin
        self._next: dict[int, int] = dict.fromkeys(histogram, 0)
        self._gaps: list[int] = []
        self._at: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
        left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
        self._large(dict(left))
        self._small(left)
        if histogram.get(0):
            self.runs.append((0, 0, histogram[0], 0))
            self.bins = max(self.bins, 1)

    def _place(self, size: int, bin_: int, each: int, items: int) -> None:
        self.runs.append((size, self._next[size], each, bin_))
        self._next[size] += items

    def _free(self, gap: int, bin_: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in self._at:
                insort(self._gaps, gap)
            self._at.setdefault(gap, []).append((bin_, n))

    def _open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def _large(self, left: dict[int, int]) -> None:
        cap = self.capacity
        sizes = sorted(s for s in left if 3 * s > cap)
        while sizes:
            s = sizes[-1]
            fit = bisect_left(sizes, cap - s + 1) - 1
            p = sizes[fit] if fit >= 0 else None
            if p is None:
                n = left[s]
                at = self._open(n)
                self._place(s, at, 1, n)
                self._free(cap - s, at, n)
                left[s] = 0
            elif p == s:
                n = left[s] // 2
                if n:
                    at = self._open(n)
                    self._place(s, at, 2, 2 * n)
                    self._free(cap - 2 * s, at, n)
                left[s] -= 2 * n
                if left[s]:  # one is left over: the next smaller size, or none, is its partner
                    p = sizes[fit - 1] if fit else None
                    at = self._open(1)
                    self._place(s, at, 1, 1)
                    if p is not None:
                        self._place(p, at, 1, 1)
                        left[p] -= 1
                    self._free(cap - s - (p or 0), at, 1)
                    left[s] = 0
                    if p is not None and not left[p]:
                        sizes.remove(p)
            else:
                n = min(left[s], left[p])
                at = self._open(n)
                self._place(s, at, 1, n)
                self._place(p, at, 1, n)
                self._free(cap - s - p, at, n)
                left[s] -= n
                left[p] -= n
                if not left[p]:
                    sizes.pop(fit)
            if not left[s]:
                sizes.pop()

    def _small(self, left: dict[int, int]) -> None:
        cap = self.capacity
        for s in sorted((s for s in left if 3 * s <= cap), reverse=True):
            count = left[s]
            while count:
                at = bisect_left(self._gaps, s)
                if at == len(self._gaps):
                    each = min(cap // s, count)
                    n = count // each
                    first = self._open(n)
                    self._place(s, first, each, n * each)
                    self._free(cap - each * s, first, n)
                    count -= n * each
                    continue
                gap = self._gaps[at]
                bin_, n = self._at[gap].pop()
                each = min(gap // s, count)
                used = min(n, count // each)
                if used < n:
                    self._at[gap].append((bin_ + used, n - used))
                elif not self._at[gap]:
                    del self._at[gap]
                    self._gaps.pop(at)
                self._place(s, bin_, each, used * each)
                self._free(gap - each * s, bin_, used)
                count -= used * each


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """container_id, capacity, doc_id, piece_no, start_token, n_tokens of everything that is to be placed."""
    named = [(r["container_id"], r["capacity_tokens"]) for r in containers.select("container_id", "capacity_tokens").distinct().collect()]
    if len({c for c, _ in named}) < len(named):
        raise ValueError("a container has one capacity")
    if any(c is None or n is None or n < 1 for c, n in named):
        raise ValueError("every container needs a name and a capacity of at least one token")
    wanted = F.array(*[F.struct(F.lit(c).alias("container_id"), F.lit(n).cast("long").alias("capacity")) for c, n in named])
    rows = sizes.select("doc_id", "n_tokens", F.explode(wanted).alias("c")).select("doc_id", "n_tokens", "c.*")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)) - 1
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity")
    return rows.select("container_id", "capacity", "doc_id", F.col("piece_no"), start.alias("start_token"), F.least(F.col("n_tokens") - start, F.col("capacity")).alias("n_tokens"))


def pack(sizes: DataFrame, containers: DataFrame, rows_a_rank: int = ROWS_A_RANK) -> DataFrame:
    """container_id, bin_no, doc_id, piece_no, start_token, n_tokens. sizes: doc_id, n_tokens.

    Bins, their number and the sizes in each follow from the sizes alone.  Which of the documents of one size takes which of its places follows from
    their order by id, or, where a size has more than ``rows_a_rank`` rows, by salt and then id.
    """
    spark = sizes.sparkSession
    items = pieces(sizes, containers)
    # at most one row for each container and size up to its capacity
    histogram = items.groupBy("container_id", "capacity", "n_tokens").count().collect()
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in histogram:
        by.setdefault((r["container_id"], r["capacity"]), {})[r["n_tokens"]] = r["count"]
    plans = {key: Plan(key[1], h) for key, h in by.items()}
    salts = max([1, *(-(-n // rows_a_rank) for h in by.values() for n in h.values())])
    group = ["container_id", "n_tokens", "salt"]
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)) if salts > 1 else F.lit(0))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "piece_no")) - 1)
    if salts > 1:
        count = items.groupBy(*group).count()
        before = Window.partitionBy("container_id", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offset = count.select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
        ranked = ranked.join(offset, group).withColumn("rank", F.col("rank") + F.col("offset"))

    base: dict[tuple[str, int], int] = {}
    lo, each, first, total = [], [], [], 0
    for (name, _), plan in plans.items():
        for size in sorted({r[0] for r in plan.runs}):
            base[name, size] = total
            total += by[name, plan.capacity][size]
        for size, a, k, b in plan.runs:
            lo.append(base[name, size] + a)
            each.append(k)
            first.append(b)
    order = np.argsort(np.array(lo, np.int64), kind="stable")
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (lo, each, first)))
    known = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, step, bins = table.value
        bases = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            names, sizes_ = batch.column("container_id").to_pylist(), batch.column("n_tokens").to_pylist()
            at = np.fromiter((bases[x] for x in zip(names, sizes_)), np.int64, len(names)) + batch.column("rank").to_numpy()
            i = np.searchsorted(starts, at, "right") - 1
            bin_no = bins[i] + (at - starts[i]) // step[i]
            cols = [batch.column("container_id"), pa.array(bin_no), *(batch.column(c) for c in ("doc_id", "piece_no", "start_token", "n_tokens"))]
            yield pa.RecordBatch.from_arrays(cols, ["container_id", "bin_no", "doc_id", "piece_no", "start_token", "n_tokens"])

    id_type = dict(sizes.dtypes)["doc_id"]
    ranked = ranked.select("container_id", "doc_id", "piece_no", "start_token", "n_tokens", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(run, f"container_id string, bin_no long, doc_id {id_type}, piece_no long, start_token long, n_tokens long")


def pack_documents(documents: DataFrame, containers: DataFrame, **tokenizer: str) -> DataFrame:
    from chronolith.llm.tokenize import token_counts

    return pack(materialize(token_counts(documents, **tokenizer), "sizes"), containers)

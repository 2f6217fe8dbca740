"""Continuous periods and gaps of overlapping intervals, by a mergeable aggregate.

The aggregate's state is a list of sorted disjoint intervals.  ``collapse`` merges the states of a
sorted stream; it runs before the shuffle (partial lists of each task) and after it (lists of each time
slice of an entity).  A slice in which an entity has more intervals than ``DENSE`` is cut into narrower ones, again and again if need
be, before its lists meet.  A running maximum over one summary row a slice then carries open ends from slice to slice, so
the lists of an entity never meet in one task: a hot entity is spread over its slices, and the window
holds at most one small row for each slice of the covered time.

Defined cases: a null start, or an end at or before its start, counts for nothing; a null end is open and
comes out as -1; intervals that touch are continuous; null entity columns equal each other; repeated rows
change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronolith.runtime import materialize

OPEN = (1 << 63) - 1
#: Width of a time slice: 2**SLICE ms, about twelve days; a dense one is cut into 2**CUT.
SLICE, CUT = 30, 5
#: So many partial intervals of a slice may meet in one task.
DENSE = 200_000


def merge_lists(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of sorted disjoint intervals as one, in linear time after placing b's starts among a's."""
    at = np.searchsorted(a[0], b[0], "right")
    start, end = np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])
    reach = np.maximum.accumulate(end)
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > reach[:-1]
    ix = np.flatnonzero(first)
    return start[ix], np.maximum.reduceat(end, ix)


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a new key begins in a batch that is sorted by key."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        col = batch.column(k)
        a, b = col.slice(0, len(col) - 1), col.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        new[1:] |= differs
    return new


def collapse(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One row a key with the merged list, from rows sorted by key that hold partial lists."""
    held: tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]] | None = None

    def row(key: pa.RecordBatch, state: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        lists = [pa.array([x], pa.list_(pa.int64())) for x in state]
        return pa.RecordBatch.from_arrays([key.column(k) for k in keys] + lists, [*keys, "starts", "ends"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _changes(batch, keys)
        starts, ends = batch.column("starts"), batch.column("ends")
        sizes = np.diff(starts.offsets.to_numpy())
        group = np.repeat(np.cumsum(new) - 1, sizes)
        s, e = starts.flatten().to_numpy(), ends.flatten().to_numpy()
        order = np.lexsort((s, group))
        s, e, group = s[order], e[order], group[order]
        reach = pd.Series(e).groupby(group).cummax().to_numpy()
        first = np.ones(len(s), bool)
        first[1:] = (group[1:] != group[:-1]) | (s[1:] > reach[:-1])
        ix = np.flatnonzero(first)
        s, e, group = s[ix], np.maximum.reduceat(e, ix) if len(ix) else e, group[ix]
        bounds = np.append(np.searchsorted(group, np.arange(new.sum())), len(group)).astype(np.int32)
        heads = np.flatnonzero(new)
        done = 0
        if held is not None:
            same = all(held[0].column(k)[0] == batch.column(k)[0] or (not held[0].column(k)[0].is_valid and not batch.column(k)[0].is_valid) for k in keys)
            if same:
                state = merge_lists(held[1], (s[: bounds[1]], e[: bounds[1]]))
                held, done = (held[0], state), 1
                if len(heads) == 1:
                    continue
            yield row(*held)
        last = len(heads) - 1
        if done < last:
            take = pa.array(heads[done:last])
            off = bounds[done : last + 1]
            lists = [pa.ListArray.from_arrays(pa.array(off - off[0]), pa.array(x[off[0] : off[-1]])) for x in (s, e)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in keys] + lists, [*keys, "starts", "ends"])
        held = batch.slice(int(heads[last]), 1), (s[bounds[last] :], e[bounds[last] :])
    if held is not None:
        yield row(*held)


def disjoint_lists(rows: DataFrame, entity: list[str], start: str = "start", end: str = "end", dense: int = DENSE) -> DataFrame:
    """e0.., slice, starts, ends: the disjoint intervals that begin in each time slice of an entity. ``slice`` is where it begins; slices of an entity do not overlap."""
    names = [f"e{i}" for i in range(len(entity))]
    keys = [*names, "slice"]
    valid = rows.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    flat = valid.select(*[F.col(c).alias(n) for c, n in zip(entity, names)], _slice(F.col(start).cast("long"), SLICE), F.col(start).cast("long").alias("s"), F.coalesce(F.col(end).cast("long"), F.lit(OPEN)).alias("e"))
    single = lambda df: df.sortWithinPartitions(*keys, "s").select(*keys, F.array("s").alias("starts"), F.array("e").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return collapse(batches, keys)

    def partial(df: DataFrame) -> DataFrame:
        return materialize(single(df).mapInArrow(run, single(df).schema), "partial-lists")

    todo, width, done = partial(flat), SLICE, []
    while width > 0:
        sizes = todo.groupBy(*keys).agg(F.sum(F.size("starts").cast("long")).alias("n")).filter(F.col("n") > dense)
        sizes = sizes.select(*[F.col(k).alias(f"j{k}") for k in keys])
        if sizes.isEmpty():
            break
        sizes = materialize(sizes, "dense-slices")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"j{k}"))
        width = max(width - CUT, 0)
        done.append(todo.join(sizes, on, "left_anti"))
        each = todo.join(sizes, on, "left_semi").select(*names, F.inline(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))))
        todo = partial(each.select(*names, _slice(F.col("s"), width), "s", "e"))
    for lists in done:
        todo = todo.unionByName(lists)
    return todo.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, todo.schema)


def _slice(at: Column, width: int) -> Column:
    """Where the slice of 2**width ms that holds a time begins."""
    return F.shiftleft(F.shiftright(at, width), width).alias("slice")


def periods_and_gaps(rows: DataFrame, entity: list[str], start: str = "start", end: str = "end", dense: int = DENSE) -> DataFrame:
    """The entity columns, piece ('period' or 'gap'), start_unix_ms and end_unix_ms (-1: open)."""
    names = [f"e{i}" for i in range(len(entity))]
    lists = materialize(disjoint_lists(rows, entity, start, end, dense), "intervals")
    summary = lists.select(*names, "slice", F.array_max("ends").alias("reach"))
    before = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*[F.col(n).alias(f"j{n}") for n in names], F.col("slice").alias("jslice"), F.max("reach").over(before).alias("carry"), F.max("reach").over(Window.partitionBy(*names)).alias("reach"))
    on = F.col("slice") == F.col("jslice")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"j{n}"))
    # what begins in the slice: the start of each period with the end of the one before it
    begin = """filter(transform(starts, (s, i) -> named_struct('e', greatest(carry, if(i > 0, array_max(slice(ends, i, 1)), NULL)), 's', s)),
                      x -> x.e IS NULL OR x.s > x.e)"""
    opened = lists.join(carried, on).select(*names, "slice", "reach", F.expr(begin).alias("b")).filter("size(b) > 0")
    opened = materialize(opened, "openings")
    pieces = opened.select(*names, F.expr("""inline(concat(
        transform(filter(b, x -> x.e IS NOT NULL), x -> named_struct('piece', 'gap', 'start_unix_ms', x.e, 'end_unix_ms', x.s)),
        transform(slice(b, 2, size(b)), (x, i) -> named_struct('piece', 'period', 'start_unix_ms', b[i].s, 'end_unix_ms', x.e))))"""))
    after = Window.partitionBy(*names).orderBy("slice").rowsBetween(1, 1)
    last = opened.select(*names, F.lit("period").alias("piece"), F.expr("element_at(b, -1).s").alias("start_unix_ms"), F.coalesce(F.first(F.expr("b[0].e")).over(after), F.col("reach")).alias("end_unix_ms"))
    out = pieces.unionByName(last)
    closed = F.when(F.col("end_unix_ms") == OPEN, F.lit(-1)).otherwise(F.col("end_unix_ms")).cast("long")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, entity)], "piece", "start_unix_ms", closed.alias("end_unix_ms"))

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolith.operators.late import HOUR_MS, PeriodCounts

SCHEMA = "id long, tenant_id string, seen long, got long, batch int, slot string"


def events(n=500):
    r = random.Random(3)
    rows, clock = [], 0
    for i in range(n):
        clock += r.randrange(400_000)
        seen = max(0, clock - r.choice([0, 60_000, 2 * HOUR_MS, 5 * HOUR_MS, 9 * HOUR_MS, 40 * HOUR_MS]))
        rows.append((i, r.choice(["a", "b", None]), seen, clock, i * 5 // n, "extra"))
    return rows + [(n, "a", None, clock, 4, ""), (n + 1, "a", 5, None, 4, "")]


def counted(rows, cutoff=6):
    out = Counter()
    for _, tenant, seen, got, *_ in rows:
        if seen is not None and got is not None and got < seen - seen % HOUR_MS + (1 + cutoff) * HOUR_MS:
            out[tenant, seen - seen % HOUR_MS] += 1
    return out


def test_counts_are_right_after_every_batch(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    periods = PeriodCounts(spark, ["tenant_id"])
    for k in range(5):
        for _ in range(1 + (k == 1)):  # a batch that is delivered again replaces itself
            periods.log(df.filter(F.col("batch") == k), F.col("id"), F.col("seen"), F.col("got"), F.col("batch"))
        touched = periods.apply(k)
        assert touched >= 1
        got = {(r["tenant_id"], r["period_start_unix_ms"]): r["messages"] for r in periods.counts().collect()}
        assert got == counted([r for r in rows if r[4] <= k])


def test_outcomes_and_untouched_slots(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    periods = PeriodCounts(spark, ["tenant_id"], slot_ms=4 * HOUR_MS)
    periods.log(df, F.col("id"), F.col("seen"), F.col("got"), F.col("batch"))
    assert periods.apply(0) > 0
    before = periods._manifest()
    periods.apply(4)
    after = periods._manifest()
    assert any(before["counts"][s] == after["counts"].get(s) for s in before["counts"])
    got = {r["event_id"]: r["outcome"] for r in periods.arrivals().collect()}
    for i, _, seen, at, *_ in rows:
        want = "no_time" if seen is None or at is None else "on_time" if at < seen - seen % HOUR_MS + HOUR_MS else "correction" if at < seen - seen % HOUR_MS + 7 * HOUR_MS else "too_late"
        assert got[i] == want


def test_corrections_and_rejections_come_from_what_was_applied(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    periods = PeriodCounts(spark, ["tenant_id"])
    periods.log(df, F.col("id"), F.col("seen"), F.col("got"), F.col("batch"))
    assert periods.corrections().count() == 0 and periods.rejected().count() == 0
    for k in range(5):
        periods.apply(k)
        got = {(r["event_id"], r["outcome"]) for r in periods.corrections().unionByName(periods.rejected()).collect()}
        late = lambda seen, at: at - (seen - seen % HOUR_MS + HOUR_MS)
        assert got == {(i, "correction" if late(seen, at) < 6 * HOUR_MS else "too_late") for i, _, seen, at, batch, _ in rows if batch <= k and seen is not None and at is not None and late(seen, at) >= 0}


def test_log_is_gathered_by_slot_and_versions_are_published_once(spark):
    rows = events(2000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    periods = PeriodCounts(spark, ["tenant_id"])
    periods.log(df, F.col("id"), F.col("seen"), F.col("got"), F.col("batch"))
    log = periods.arrivals()
    assert len(log.inputFiles()) <= log.select("batch", "slot").distinct().count()
    periods.apply(0)
    other = PeriodCounts(spark, ["tenant_id"], periods.root)
    other._manifest = lambda: {"version": 0, "counts": {}, "corrections": {}, "rejected": []}
    with pytest.raises(Exception):
        other.apply(1)


def test_empty_batch(spark):
    periods = PeriodCounts(spark, ["tenant_id"])
    df = spark.createDataFrame([(1, "a", 5, 6, 0, "")], SCHEMA)
    periods.log(df, F.col("id"), F.col("seen"), F.col("got"), F.col("batch"))
    assert periods.apply(7) == 0 and periods.counts().count() == 0
    assert periods.apply(0) == 1 and periods.counts().count() == 1

import random

from pyspark.sql import functions as F

from chronolith.functions.identity import message_key
from chronolith.operators.dedupe import MessageStore

SCHEMA = "id long, tenant_id string, project_id string, trace_id string, span_id string, seq long, k0 string, rec string, ord string"


def deliveries(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        trace, span = f"t{r.randrange(12)}", f"s{r.randrange(6)}"
        rows.append((i, r.choice(["a", "b", None]), "p", r.choice([trace, f" {trace.upper()}\t", trace]), r.choice([span, f"{span} "]), r.choice([1, 2, None]), "x", "y", "z"))
    return rows


def brute(rows):
    norm = lambda s: None if s is None else s.strip().lower()
    first, out = {}, set()
    for row in sorted(rows, key=lambda x: x[0]):
        key = (row[1], row[2], norm(row[3]), norm(row[4]), row[5])
        kept = first.setdefault(key, row[0])
        if kept != row[0]:
            out.add((kept, row[0]))
    return set(first.values()), out


def test_whole_table_and_clashing_column_names(spark):
    rows = deliveries()
    kept, dropped = brute(rows)
    store = MessageStore(spark).upsert(spark.createDataFrame(rows, SCHEMA), message_key(), F.col("id"))
    assert {tuple(r) for r in store.dropped().collect()} == dropped
    out = store.kept()
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r["id"] for r in out.collect()} == kept


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_batches_in_any_order_and_twice_and_compacted(spark):
    rows = deliveries()
    kept, dropped = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    store = MessageStore(spark, buckets=3)
    for k in (2, 0, 1, 2):
        store.upsert(df.filter(F.col("id") % 3 == k), message_key(), F.col("id"))
    assert len(store.runs) == 4
    store.compact()
    assert len(store.runs) == 1
    assert ids(store.kept()) == sorted(kept)
    assert sorted(tuple(r) for r in store.dropped().collect()) == sorted(dropped)
    store.upsert(df, message_key(), F.col("id")).upsert(df.filter("id < 50"), message_key(), F.col("id"))
    assert ids(store.kept()) == sorted(kept)
    assert sorted(tuple(r) for r in store.dropped().collect()) == sorted(dropped)


def test_a_first_copy_that_comes_last_takes_over_all_links(spark):
    make = lambda *ids: spark.createDataFrame([(i, "a", "p", "t", "s", 1, "", "", "") for i in ids], SCHEMA)
    store = MessageStore(spark, buckets=2).upsert(make(7, 9), message_key(), F.col("id")).compact()
    store.upsert(make(3), message_key(), F.col("id")).upsert(make(5, 9), message_key(), F.col("id"))
    assert sorted(tuple(r) for r in store.dropped().collect()) == [(3, 5), (3, 7), (3, 9)]
    assert [r["rec"] for r in store.kept().collect()] == [""] and ids(store.kept()) == [3]


def test_blocks_of_arrival(spark):
    rows = deliveries(600, 3)
    kept, dropped = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("batch", F.when(F.col("id") != 5, F.floor(F.col("id") / 7)))
    store = MessageStore(spark, buckets=4).upsert_by_arrival(df, message_key(), F.col("id"), "batch", ["id"], 5)
    assert len(store.runs) == 5
    assert {tuple(r) for r in store.dropped().collect()} == dropped and ids(store.kept()) == sorted(kept)


def test_hot_message_is_salted_and_stays_exact(spark):
    rows = [(i, "a", "p", "hot", "s", 1, "", "", "") for i in range(300)] + [(1000 + i, "a", "p", f"t{i}", "s", 1, "", "", "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    store = MessageStore(spark, buckets=4, salts=8, hot_rows=10).upsert(df, message_key(), F.col("id"), ["id"])
    assert len(store.hot) == 1
    assert {tuple(r) for r in store.dropped().collect()} == {(0, i) for i in range(1, 300)}
    assert store.kept().count() == 301


def test_message_that_grows_hot_later(spark):
    df = spark.createDataFrame([(i, "a", "p", "hot", "s", 1, "", "", "") for i in range(200)], SCHEMA)
    store = MessageStore(spark, buckets=2, salts=4, hot_rows=50)
    store.upsert(df.filter("id < 20"), message_key(), F.col("id"), ["id"]).upsert(df.filter("id >= 20"), message_key(), F.col("id"), ["id"])
    assert store.hot and {tuple(r) for r in store.dropped().collect()} == {(0, i) for i in range(1, 200)}


def test_buckets_follow_bytes_and_grow(spark):
    rows = deliveries(400)
    kept, dropped = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    store = MessageStore(spark, bucket_bytes=2_000).upsert(df.filter("id < 60"), message_key(), F.col("id"))
    before = store.buckets
    assert before > 1
    store.upsert(df.filter("id >= 60"), message_key(), F.col("id"))
    assert {tuple(r) for r in store.dropped().collect()} == dropped and ids(store.kept()) == sorted(kept)
    assert store.buckets > before


def test_null_order_and_repeated_rows(spark):
    rows = [(None, "a", "p", "t", "s", 1, "", "", ""), (5, "a", "p", "t", "s", 1, "", "", ""), (5, "a", "p", "t", "s", 1, "", "", ""), (5, "a", "p", "t", "s", 1, "other", "", "")]
    store = MessageStore(spark).upsert(spark.createDataFrame(rows, SCHEMA), message_key(), F.col("id"))
    assert [r["id"] for r in store.kept().collect()] == [5]
    assert sorted((r["kept_id"], r["dropped_id"]) for r in store.dropped().fillna(-1).collect()) == [(5, -1), (5, 5)]


def test_empty_table(spark):
    store = MessageStore(spark).upsert(spark.createDataFrame([], SCHEMA), message_key(), F.col("id"))
    assert store.kept().count() == 0 and store.dropped().count() == 0


def test_runs_merge_and_collapse_without_exchange_or_sort(spark):
    df = spark.createDataFrame(deliveries(), SCHEMA)
    store = MessageStore(spark, buckets=4)
    for k in range(2):
        store.upsert(df.filter(F.col("id") % 2 == k), message_key(), F.col("id"), ["id"])
    steps = lambda x: x._jdf.queryExecution().executedPlan().toString()
    with store._tables(*store.runs) as (a, b):
        plan = steps(store.merge_plan(a, b))
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan and "Bucketed: true" in plan
        plan = steps(store._collapsed(a))
        assert "Window" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert spark.catalog.listTables() == [] or not [t for t in spark.catalog.listTables() if t.name.startswith(store.name)]
    store.compact()
    for path in spark.read.parquet(f"{store.root}/{store.runs[0]}").inputFiles():
        at = [tuple(r) for r in spark.read.parquet(path).coalesce(1).select("ident", "salt", "late", "pos", "tie").collect()]
        assert at == sorted(at)

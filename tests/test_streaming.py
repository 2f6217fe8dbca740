
from chronolith.operators.dedupe import MessageStore
from chronolith.operators.late import HOUR_MS, PeriodCounts
from chronolith.sources.ledger import LEDGER_SCHEMA
from chronolith.streaming.projection import correct_periods, distinct_messages, keep_once, ledger_stream

COLUMNS = [c.split()[0] for c in LEDGER_SCHEMA.split(", ")]


def write(spark, path, rows):
    """rows: (id, span, observed, ingested), one file each."""
    for id_, span, seen, got in rows:
        row = (id_, "s", "t", "p", None, "trace", span, 1, "memory.write", "fact", "ok", "text", None, seen, got, None)
        spark.createDataFrame([row], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_messages_are_kept_once_and_periods_corrected(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [(1, "a", 5, 10), (2, " A", 5, 20), (3, "b", 5, HOUR_MS + 5), (4, "b", 5, HOUR_MS + 9), (5, "c", 5, 9 * HOUR_MS)])
    store = MessageStore(spark, buckets=2)
    keep_once(ledger_stream(spark, path, 2), store, f"{tmp_path}/c1", ["id", "tenant_id", "observed_at_unix_ms", "ingested_at_unix_ms"]).awaitTermination(120)
    assert len(store.runs) == 3
    assert {tuple(r) for r in store.dropped().collect()} == {(1, 2), (3, 4)}
    store.kept().coalesce(1).write.parquet(f"{tmp_path}/kept")
    stream = spark.readStream.schema(store.kept().schema).parquet(f"{tmp_path}/kept")
    periods = PeriodCounts(spark, ["tenant_id"])
    correct_periods(stream, periods, f"{tmp_path}/c2").awaitTermination(120)
    assert [(r["period_start_unix_ms"], r["messages"]) for r in periods.counts().collect()] == [(0, 2)]
    assert [r["event_id"] for r in periods.corrections().collect()] == [3] and [r["event_id"] for r in periods.rejected().collect()] == [5]


def test_distinct_messages_forget_old_keys(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [(1, "a", 5, 10), (2, "a", 5, 20), (3, "b", 5, 30)])
    for name, df in (("all", distinct_messages(ledger_stream(spark, path))), ("some", distinct_messages(ledger_stream(spark, path), "1 hour"))):
        q = df.select("span_id").writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/k{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        assert sorted(r["span_id"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) == ["a", "b"]

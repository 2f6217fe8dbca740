import dataclasses
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from chronolith.engine import InvalidInput, MemoryEngine, Query
from chronolith.operators import fold as W, project as P
from chronolith.sources import ledger as L
from chronolith.store import Store, StoreError

ROW = "source string, tenant_id string, project_id string, environment_id string, trace_id string, span_id string, seq long, span_kind string, name string, status string, text string, payload string, observed_at_unix_ms long, ingested_at_unix_ms long"
OLD = "Harbour pilots moor ferries at the western quay."
NEW = "Harbour pilots no longer moor ferries at the western quay; the eastern quay takes them."


def event(kind, text, t, got=None, key=None):
    return ("test", "tenant", "project", None, f"trace-{key or t}", f"span-{key or t}", 1, "memory.write", kind, "ok", text, "{}", t, t if got is None else got)


def engine(spark, tmp_path, events, name="store"):
    e = MemoryEngine(spark, f"file://{tmp_path}/{name}")
    e.append(spark.createDataFrame(events, ROW).coalesce(1))
    e.project(clock_unix_ms=0)
    return e


def ask(e, question, **options):
    return e.ask(Query(question, "tenant", "project", **options))


def texts(answer):
    return [x["text"] for x in answer.evidence]


def test_remember_and_ask(spark, tmp_path):
    e = engine(spark, tmp_path, [event("gotcha", "Pump seven failed when valve_pressure fell. Bleed valve_pressure first.", 1000)])
    a = ask(e, "pump failure valve_pressure", as_of_unix_ms=2000)
    assert a.evidence and a.cited_spans and "Relevant memory" in a.answer
    assert all(x["kind"] != "entity_cue" for x in a.evidence)
    assert ask(e, "pump", as_of_unix_ms=500).answer == "No matching memory was found for this scope."


def test_invalidation_is_bitemporal(spark, tmp_path):
    e = engine(spark, tmp_path, [event("fact", OLD, 1000), event("fact", NEW, 2000)])
    before, after = (ask(e, "western quay ferries", as_of_unix_ms=t, modes=["semantic"]) for t in (1500, 2500))
    assert texts(before) == [OLD] and not before.contradictions and not before.stale_assumptions
    assert OLD not in texts(after) and NEW in texts(after) and after.contradictions and after.stale_assumptions
    assert "Warning: " in after.answer


def test_late_known_event(spark, tmp_path):
    e = engine(spark, tmp_path, [event("fact", "Lantern twelve shows amber to incoming trawlers.", 1000, 3000)])
    q = "lantern twelve amber"
    assert not texts(ask(e, q, as_of_unix_ms=1500, known_at_unix_ms=2500))
    assert texts(ask(e, q, as_of_unix_ms=1500, known_at_unix_ms=3500))


def test_restating_an_old_fact_does_not_change_the_past(spark, tmp_path):
    e = engine(spark, tmp_path, [event("fact", OLD, 1000), event("fact", NEW, 2000), event("fact", OLD, 3000)])
    a = ask(e, "western quay ferries", as_of_unix_ms=2500, modes=["semantic"])
    assert OLD not in texts(a) and a.stale_assumptions


def test_arrival_in_any_order_and_batches_gives_the_rebuilt_graph(spark, tmp_path):
    events = [event("fact", "Use crowd token alpha.", 3000), event("fact", "The crowd token alpha is no longer true; use crowd token beta.", 2000), event("fact", "Use crowd token alpha.", 1000), event("state", "Current crowd size is 4.", 1500)]
    e = MemoryEngine(spark, f"file://{tmp_path}/a")
    for x in events:
        e.append(spark.createDataFrame([x], ROW))
        e.project(clock_unix_ms=0)
    shape = lambda e: sorted((r["kind"], r["text"], r["valid_from_unix_ms"], r["valid_to_unix_ms"] or -1) for r in e.store.read("nodes").collect())
    once = shape(e)
    e.rebuild(clock_unix_ms=0)
    assert shape(e) == once
    other = engine(spark, tmp_path, sorted(events, key=lambda x: x[12]), "b")
    assert shape(other) == once


def test_append_is_first_wins_and_all_or_nothing(spark, tmp_path):
    e = engine(spark, tmp_path, [event("fact", "first", 1000)])
    out = e.append(spark.createDataFrame([event("fact", "changed", 1000), event("fact", "other", 2000)], ROW))
    assert out == {"rows_seen": 2, "events_inserted": 1, "events_duplicate": 1}
    bad = list(event("fact", "x", 5))
    for i, value, said in [(1, " tenant", "whitespace"), (4, "", "trace_id"), (6, 0, "seq"), (10, "  ", "text"), (12, -1, "observed"), (13, -1, "ingested"), (8, "", "name"), (9, " ", "status")]:
        row = tuple(bad[:i] + [value] + bad[i + 1 :])
        with pytest.raises(InvalidInput, match=said):
            e.append(spark.createDataFrame([event("fact", "fine", 9000), row], ROW))
    assert {r["text"] for r in e.store.read("ledger").collect()} == {"first", "other"}
    ids = [r["id"] for r in e.store.read("ledger").collect()]
    assert sorted(ids) == [1, 2]


def test_idempotency_key(spark, tmp_path):
    e = MemoryEngine(spark, f"file://{tmp_path}/store")
    e.remember("a fact", now_unix_ms=1, idempotency_key="k")
    assert e.remember("a fact told again", now_unix_ms=2, idempotency_key=" k ")["events_duplicate"] == 1
    payload = json.loads(e.store.read("ledger").first()["payload"])
    assert payload["kind"] == "fact" and payload["idempotency_key_hash"].startswith("idempotency_key_")


def test_reconstruction_and_routing(spark, tmp_path):
    events = [event("fact", f"Service svc{i} depends on service svc{i + 1} for tide tables.", 1000, key=f"k{i}") for i in range(4)]
    e = engine(spark, tmp_path, events)
    a = ask(e, "why svc0", as_of_unix_ms=2000, reconstruction="force", max_tokens=60)
    assert a.tier_used == "active_reconstruction" and a.reconstruction["reason"] == "forced" and a.reconstruction["steps_used"] >= 1
    assert sum(x["token_estimate"] for x in a.evidence) <= 60
    assert ask(e, "svc1", as_of_unix_ms=2000).routing["reason"] == "ambiguous_fallback"
    with pytest.raises(InvalidInput):
        ask(e, " ")
    with pytest.raises(InvalidInput):
        ask(e, "x", modes=["nonsense"])


def test_provider_batches_are_kept_and_replayed(spark, tmp_path):
    import sys

    from chronolith.providers import command_distiller

    calls, script = tmp_path / "calls", tmp_path / "distil.py"
    script.write_text(
        "import sys, json\n"
        "p = json.load(sys.stdin); e = p['event']\n"
        f"open({str(calls)!r}, 'a').write(e['span_id'] + chr(10))\n"
        "cite = [{'tenant_id': 'tenant', 'project_id': 'project', 'trace_id': e['trace_id'], 'span_id': e['span_id'], 'seq': e['seq']}]\n"
        "if 'refuse' in e['text']: print('no JSON'); sys.exit()\n"
        "print(json.dumps({'memories': [{'op': 'add', 'node_kind': 'fact', 'text': 'Distilled: ' + e['text'], 'cited_spans': cite}]}))\n"
    )
    root = f"file://{tmp_path}/store"
    e = MemoryEngine(spark, root, distiller=command_distiller([sys.executable, str(script)], 20, 0))
    e.append(spark.createDataFrame([event("fact", "Buoys blink twice", 1000), event("fact", "Cranes rest at night", 2000), event("fact", "refuse this", 3000)], ROW))
    first = e.project(clock_unix_ms=7, limit=1)
    assert (first["events_projected"], first["distillation_provider_calls"], first["memories_added"]) == (1, 1, 1)
    assert e.stats(now_unix_ms=5000)["pending_events"] == 2
    rest = e.project(clock_unix_ms=8)
    assert (rest["events_seen"], rest["events_projected"], rest["events_skipped"], rest["distillation_rejections"]) == (2, 1, 1, 1)
    assert rest["distillation_replayed_batches"] == 0 and len(calls.read_text().split()) == 3  # the first event was replayed, not asked again
    assert {(r["id"], r["projected_at_unix_ms"]) for r in e.ledger().collect()} == {(1, 7), (2, 8), (3, None)}
    texts_of = lambda e: sorted(r["text"] for r in e.store.read("nodes").filter("kind = 'fact'").collect())
    want = texts_of(e)
    assert want == ["Distilled: Buoys blink twice", "Distilled: Cranes rest at night"]
    again = e.rebuild(clock_unix_ms=9)
    assert again["distillation_replayed_batches"] == 2 and again["distillation_provider_calls"] == 0 and texts_of(e) == want and len(calls.read_text().split()) == 3
    other = MemoryEngine(spark, root, distiller=command_distiller([sys.executable, "other.py"], 20, 0))
    with pytest.raises(InvalidInput, match="2 are missing"):
        other.rebuild()


def test_an_older_store_is_migrated(spark, tmp_path):
    e = engine(spark, tmp_path, [event("fact", OLD, 1000), event("fact", NEW, 2000)])
    parts = {k: v for k, v in e.store.manifest["parts"].items() if k != "projected"}
    e.store.publish(schema_version=1, projected_to=1, parts=parts)
    again = MemoryEngine(spark, f"file://{tmp_path}/store")
    assert again.store.manifest["schema_version"] == 2 and again.stats(now_unix_ms=1)["pending_events"] == 1
    assert again.project(clock_unix_ms=0)["events_projected"] == 1


def test_housekeeping(spark, tmp_path):
    e = engine(spark, tmp_path, [event("fact", OLD, 1000), event("fact", NEW, 2000)])
    for i in range(5):
        e.audit("me", "query", "ok", now_unix_ms=100 + i)
    assert e.stats(now_unix_ms=5000)["ledger_events"] == 2 and e.stats(now_unix_ms=5000)["audit_events"] == 5 and e.health()["clean"]
    lost = e.store.read("edges").limit(1).withColumn("from_node_id", F.lit("nowhere"))
    e.store.write(edges=lost)
    assert not e.health()["clean"]
    report = e.maintenance(repair_orphans=True, compact=True, prune_audit_before_unix_ms=101, retain_latest_audit_events=2)
    assert e.health()["clean"] and report["audit_events_removed"] == 3
    assert sorted(r["id"] for r in e.store.read("audit").collect()) == [4, 5]
    e.store.backup(f"file://{tmp_path}/copy")
    with pytest.raises(StoreError):
        e.store.backup(f"file://{tmp_path}/copy")
    back = Store.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/again")
    assert back.read("nodes").count() == e.store.read("nodes").count()
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "file").write_text("x")
    with pytest.raises(StoreError):
        Store(spark, f"file://{tmp_path}/foreign")


def test_jsonl_and_journal(spark, tmp_path):
    spans = tmp_path / "spans.jsonl"
    write = {"tenant_id": "tenant", "project_id": "project", "trace_id": "trace", "span_id": "span-write", "seq": 7, "attributes": {"vendor.span.kind": "memory.write", "vendor.memory.kind": "Workflow"}, "name": "memory.write", "start_time": "2026-07-01T00:00:00Z", "input": {"memory": "Drain bilge tanks via outlet_b", "kind": "procedure"}}
    read = {"trace_id": "t", "span_id": "s", "span_kind": "memory.read", "input": "what", "output": "that", "start_time": 1_700_000_000}
    spans.write_text("\n".join([json.dumps(write), "", json.dumps(read), json.dumps({"z": [1, {"y": "x"}], "trace_id": "q", "span_id": "r"})]) + "\n")
    e = MemoryEngine(spark, f"file://{tmp_path}/store")
    assert e.import_jsonl(str(spans), now_unix_ms=5)["events_inserted"] == 3
    got = {r["span_id"]: r for r in e.store.read("ledger").collect()}
    w = got["span-write"]
    assert (w["span_kind"], w["name"], w["text"], w["observed_at_unix_ms"], w["seq"]) == ("memory.write", "procedure", "Drain bilge tanks via outlet_b", 1782864000000, 7)
    assert (got["s"]["name"], got["s"]["text"], got["s"]["observed_at_unix_ms"], got["s"]["tenant_id"]) == ("episode", "memory read question: what answer: that", 1_700_000_000_000, "local")
    assert (got["r"]["text"], got["r"]["span_kind"], got["r"]["observed_at_unix_ms"]) == ("z: 1 y: x", "agent.step", 5)
    spans.write_text(json.dumps(write) + "\n{broken\n")
    with pytest.raises(ValueError, match="line 2"):
        e.import_jsonl(str(spans), now_unix_ms=5)

    db = tmp_path / "journal.db"
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE runs(id TEXT, agent TEXT, status TEXT, input TEXT, created_at INT, updated_at INT)")
    con.execute("CREATE TABLE steps(run_id TEXT, seq INT, kind TEXT, status TEXT, request TEXT, result TEXT, tool_name TEXT, tool_use_id TEXT, attempt INT, started_at INT, finished_at INT)")
    con.execute("INSERT INTO runs VALUES('run', 'agent', 'completed', 'go', 1, 2)")
    for seq, status in ((1, "completed"), (2, "started"), (3, "failed")):
        con.execute("INSERT INTO steps VALUES('run', ?, 'tool_call', ?, ?, NULL, 'memory_write', NULL, 0, 7, 8)", (seq, status, json.dumps({"memory": f"kept {seq}", "kind": "state"})))
    con.commit()
    con.close()
    assert e.import_journal(str(db), "tenant", "project", now_unix_ms=9) == {"rows_seen": 3, "events_inserted": 1, "events_duplicate": 0, "rows_skipped": 2}
    assert e.import_journal(str(db), "tenant", "project", now_unix_ms=9)["events_duplicate"] == 1
    j = e.store.read("ledger").filter("trace_id = 'run'").first()
    assert (j["span_id"], j["name"], j["text"], j["observed_at_unix_ms"]) == ("step-1", "state", "kept 1", 7000)


def test_line_numbers_over_blocks_of_a_file(spark, tmp_path):
    from chronolith.runtime import settings
    from chronolith.sources.spans import numbered_lines

    (tmp_path / "lines").write_text("\n".join(f"line {i} " + "x" * (i % 50) for i in range(1, 3001)))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "0"}):
        rows = numbered_lines(spark, str(tmp_path / "lines")).collect()
    assert sorted(int(r["record"].split()[1]) for r in rows) == list(range(1, 3001))
    assert all(int(r["record"].split()[1]) == r["line_no"] for r in rows)


def test_windows_agree_with_the_fold_on_an_add_only_ledger(spark):
    rows, n = [], 0
    for t in (1000, 1000, 2000, 3000):
        for text in ("The deploy token lives in vault/path.", "Billing plan is gold tier", "Billing plan is gold tier"):
            n += 1
            rows.append((n, *event("episode" if n % 5 == 0 else "note", text, t, key=f"k{n}")))
    ledger = spark.createDataFrame(rows, "id long, " + ROW)
    assert all(W.op_of(r[11]) == "add" for r in rows)
    tables = P.project(ledger, 0)
    want = W.fold(ledger)
    shape = lambda df: sorted((r["id"], r["text"], r["valid_from_unix_ms"], r["valid_to_unix_ms"] or -1, r["valid_to_event_id"] or -1, r["observation_count"], r["confidence"], r["token_estimate"]) for r in df.collect())
    assert shape(tables["nodes"]) == shape(W.fold_nodes(want))
    edges = lambda df: sorted((r["from_node_id"], r["to_node_id"], r["kind"], r["weight"], r["source_event_id"]) for r in df.collect())
    assert edges(tables["edges"]) == edges(W.fold_edges(want))
    assert sorted(map(tuple, tables["spans"].collect())) == sorted((r["node_id"], r["tenant_id"], r["project_id"], r["trace_id"], r["span_id"], r["seq"]) for r in W.fold_spans(want).collect())


def test_stream_equals_batch(spark, tmp_path):
    from chronolith.streaming.projection import distinct_messages, ledger_stream, stream_into

    events = [event("fact", OLD, 1000), event("fact", NEW, 2000), event("fact", OLD, 1500, key="late"), event("fact", OLD, 1000)]
    for i, x in enumerate(events):
        full = spark.createDataFrame([(i, *x, None)], "id long, " + ROW + ", projected_at_unix_ms long")
        full.selectExpr(*[c.split()[0] for c in L.LEDGER_SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    e = MemoryEngine(spark, f"file://{tmp_path}/store")
    q = stream_into(ledger_stream(spark, f"{tmp_path}/in", 1), e, f"{tmp_path}/ck", clock_unix_ms=0)
    q.awaitTermination(120)
    assert q.exception() is None
    batch = engine(spark, tmp_path, events[:3], "batch")
    shape = lambda e: sorted((r["kind"], r["text"], r["valid_from_unix_ms"], r["valid_to_unix_ms"] or -1) for r in e.store.read("nodes").collect())
    assert shape(e) == shape(batch) and e.store.read("ledger").count() == 3
    assert distinct_messages(ledger_stream(spark, f"{tmp_path}/in")).isStreaming


def test_lookups(spark):
    from chronolith.operators import bitemporal as B

    nodes = W.fold_nodes(W.fold(spark.createDataFrame([(1, *event("fact", OLD, 1000)), (2, *event("fact", OLD, 2000))], "id long, " + ROW)))
    nodes = nodes.withColumn("updated_at_unix_ms", F.lit(0).cast("long"))
    ask = lambda *rows: spark.createDataFrame(list(rows), "ask string, tenant_id string, project_id string, environment_id string, kind string, text string, valid_from_unix_ms long")
    found = B.node_versions_by_text(nodes, ask(("a", "tenant", "project", None, "fact", OLD, 2000), ("b", "tenant", "project", "x", "fact", OLD, 2000), ("c", "tenant", "project", None, "fact", OLD, 5))).collect()
    by_key = {r["canonical_key"]: r["id"] for r in nodes.filter("kind = 'fact'").collect()}
    assert [(r["ask"], r["node_id"]) for r in found] == [("a", next(i for k, i in by_key.items() if k.endswith("|rev:2000")))]
    with pytest.raises(ValueError, match="limit"):
        L.pending(spark.createDataFrame([], L.LEDGER_SCHEMA), 1 << 31)


def test_explicit_modes_are_not_routed(spark):
    from chronolith.functions.classify import MODES, route

    df = spark.createDataFrame([("what fails",)], "q string")
    routed, given = df.select(route(F.col("q")).alias("r"), route(F.col("q"), MODES).alias("g")).first()
    assert routed["reason"] != given["reason"] == "ambiguous_fallback" or len(routed["modes"]) < 5
    assert given["modes"] == MODES and given["confidence"] == 0.2


def test_command_line(spark, tmp_path, capsys):
    from chronolith.cli import configured, main, parser

    args = parser().parse_args([f"file://{tmp_path}/s", "--distiller-command", "distil --fast", "--max-repairs", "2", "--weight", "ppr=0.5", "stats"])
    e = configured(spark, args)
    assert e.distiller.provider.command == ["distil", "--fast"] and e.distiller.max_repairs == 2 and e.blend["ppr"] == 0.5 and e.blend["base"] == 0.3
    assert main([f"file://{tmp_path}/s", "--weight", "nonsense=1", "stats"]) == 1 and "unknown weight" in capsys.readouterr().err


def test_answer_is_plain_data(spark, tmp_path):
    e = engine(spark, tmp_path, [event("fact", "Alpha beta gamma.", 1000)])
    json.dumps(dataclasses.asdict(ask(e, "alpha", as_of_unix_ms=1500)))


def test_service(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from chronolith.server import RateLimit, Service, serve

    service = Service(MemoryEngine(spark, f"file://{tmp_path}/store"), {"secret": "me"}, task_ms=120_000)
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None, token="secret"):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {token}", "X-Request-Id": "r-1"})
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                text = r.read().decode()
                return r.status, json.loads(text) if text[:1] in "{[" else text, r.headers
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    try:
        assert call("/livez", token="")[0] == 200 and call("/v1/stats", token="wrong")[0] == 401
        assert call("/v1/remember", {"text": "Alpha runs on port 80."})[1]["events_inserted"] == 1
        status, answer, headers = call("/v1/query", {"question": "alpha port"})
        assert status == 200 and "Alpha" in answer["answer"] and headers["X-Request-Id"] == "r-1"
        assert call("/v1/query", {"question": "x", "bogus": 1})[0] == 400 and call("/v1/query", {"question": " "})[0] == 400 and call("/nowhere")[0] == 404
        assert {r["actor"] for r in call("/v1/audit")[1]} == {"me"}
        assert "chronolith_requests_total" in call("/v1/metrics/prometheus")[1]
        assert call("/readyz", token="")[0] == 200 and call("/v1/manage", {"limit": 0})[0] == 400
        service.task_ms = 0
        assert call("/v1/stats")[0] == 504
        service.task_ms, held = 60_000, [service.permits.acquire(blocking=False) for _ in range(32)]
        assert call("/v1/stats")[0] == 503
        for ok in held:
            if ok:
                service.permits.release()
    finally:
        server.shutdown()
    limit = RateLimit(2)
    assert [limit.check("a", t) for t in (0, 1, 2, 60_000)] == [0, 0, 60, 0] and RateLimit(0).check("a", 1) == 0

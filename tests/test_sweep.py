import random

import pyarrow as pa
import pytest

from chronolith.operators import fold as W, sweep as S
from chronolith.sources import ledger as L

WORDS = "alpha beta/path gamma.delta quay 12 replica-14 the harbour Moor ÜBER café no-longer_x of".split()
SAYS = ["", "", "", "", "no longer ", "Update: ", "now ", "deprecated ", "error "]


def _events(n, seed=1, scopes=(("t", "p", None), ("t", "p", "prod"), ("u", "p", ""))):
    r, rows = random.Random(seed), []
    for i in range(1, n + 1):
        tenant, project, env = r.choice(scopes)
        text = r.choice([" ", "...", "x" * 1000]) if r.random() < 0.03 else r.choice(SAYS) + " ".join(r.choices(WORDS, k=r.randrange(1, 6)))
        # few instants, so that several events share one; arrivals out of order
        rows.append((i, "test", tenant, project, env, f"trace{i % 7}", "é", i, r.choice(["memory.write", "memory.read"]), r.choice(["fact", "Note", "episode", "episodic", "state"]), "ok", text, None, 1000 + r.randrange(n // 2), 0, None))
    return rows


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_agrees_with_the_fold(spark, seed):
    ledger = spark.createDataFrame(_events(1200, seed), L.LEDGER_SCHEMA).repartition(3)
    folded = W.fold(ledger).persist()
    nodes, edges = W.fold_nodes(folded), W.fold_edges(folded)
    did = W.fold_events(folded).selectExpr("sum(updated)", "sum(invalidated)").first()
    assert min(did) > 20
    swept = S.sweep(ledger, "nodes")
    assert [(f.name, f.dataType) for f in swept.schema] == [(f.name, f.dataType) for f in nodes.schema]
    assert _rows(swept) == _rows(nodes)
    swept = S.sweep(ledger, "edges")
    assert [(f.name, f.dataType) for f in swept.schema] == [(f.name, f.dataType) for f in edges.schema]
    assert _rows(swept) == _rows(edges.select(swept.columns))
    folded.unpersist()


def test_sweep_cuts_far_back_in_the_same_order():
    """Many nodes of one term, most of them closed: the neighbours are the fold's."""
    rows = sorted(_events(1500, 3, [("t", "p", None)]), key=lambda x: (x[13], x[0]))
    old, new = W.Scope("t", "p", ""), S.Sweep(S._Place(("t", "p", ""), None), S.NodeRows(), S.EdgeRows())
    for x in rows:
        found = W.terms(x[11])
        assert [n.id for n in old.neighbours(x[11], x[13])] == ["node_" + new._id(n) for n in new.neighbours(found)]
        old.apply({"id": x[0], "at": x[13], "span": (x[5], x[6], x[7]), "span_kind": x[8], "name": x[9], "text": x[11]})
        new.apply(x[0], x[13], x[5], x[6], x[7], x[8], x[9], x[11])


def test_a_scope_is_not_read_whole(monkeypatch):
    """Rows leave while events still arrive, so neither time nor memory needs the whole scope at once."""
    monkeypatch.setattr(S, "BATCH", 500)
    rows = sorted(_events(2000, 4, [("t", "p", None)]), key=lambda x: (x[13], x[0]))
    columns = [*zip(*[(x[2], x[3], x[4] or "", x[4], x[0], x[13], x[5], x[6], x[7], x[8], x[9], x[11]) for x in rows])]
    batches, read = pa.table({k: pa.array(c) for k, c in zip(S.EVENT, columns)}).to_batches(200), []
    for part in ("nodes", "edges"):
        read.clear()
        out = S._sweep((read.append(b) or b for b in batches), part)
        first = next(out)
        assert first.num_rows >= 500 and len(read) < len(batches) / 2
        assert sum(b.num_rows for b in out) > 0


@pytest.mark.parametrize("query", ["project_fold_edges", "project_fold_nodes"])
def test_queries_sweep(spark, data, query):
    """One pandas group a scope took the square of its events."""
    from chronolith.plans.memory import QUERIES

    plan = QUERIES[query](spark, data)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_identifiers_of_a_batch():
    from chronolith.functions.text import fnv1a64_ids

    parts = ["", "a", "漢字|rev:1", "a" * 300]
    got = fnv1a64_ids("node_", [W.fnv_state("t", "é", str(i)) for i in range(4)], parts).to_pylist()
    assert got == ["node_" + W.fnv("t", "é", str(i), p) for i, p in enumerate(parts)]

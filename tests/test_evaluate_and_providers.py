import json
import sys

import pytest

from chronolith.engine import InvalidInput
from chronolith.evaluate import run_suite, validate_suite
from chronolith.operators.reconstruct import best_candidate, provider_policy, walk
from chronolith.providers import CommandProvider, ProviderError, SchemaError, distill_with, parse_decision, parse_distillation

SPAN = {"tenant_id": "t", "project_id": "p", "trace_id": "a", "span_id": "b", "seq": 1}


def memory(**changes):
    return {"op": "add", "node_kind": "fact", "text": "x y z", "target_node_id": None, "relation_edges": [], "cited_spans": [SPAN]} | changes


def case(id_, question, events, **more):
    return {"id": id_, "question": question, "events": [{"kind": k, "text": t} for k, t in events]} | more


def suite(**more):
    cases = [
        case("one", "what is the checkout database?", [("fact", "The checkout database is Postgres.")], expected_evidence_contains=["postgres"], expected_answer_contains=["Relevant memory"], baseline_full_context_score=1.0),
        case("two", "deploy steps", [("procedure", "Deploy steps: run migrations, then restart.")], expected_evidence_contains=["migrations"]),
        case("three", "western quay ferries", [("fact", "Harbour pilots moor ferries at the western quay."), ("fact", "Harbour pilots no longer moor ferries at the western quay; the eastern quay takes them.")], modes=["semantic"], expected_stale_contains=["western"], expected_contradiction_contains=["conflicts with"]),
    ]
    return {"name": "s", "cases": cases} | more


def test_suite_passes(spark, tmp_path):
    report = run_suite(spark, suite(), f"file://{tmp_path}/store")
    assert (report["cases"], report["passed"], report["failed"], report["score"], report["context_saturation_gap"]) == (3, 3, 0, 1.0, 0.0), report["cases_"]


def test_tier_gate_and_isolation(spark, tmp_path):
    s = suite(cases=[case("a", "checkout database", [("fact", "The checkout database is Postgres.")], expected_evidence_contains=["Postgres"], expected_tier="active_reconstruction"), case("b", "checkout database", [("fact", "Unrelated memory of apples.")], expected_evidence_contains=["Postgres"])])
    report = run_suite(spark, s, f"file://{tmp_path}/store")
    a, b = report["cases_"]
    assert a["score"] == 0.0 and a["content_score"] == 1.0 and a["hard_gate_failed"]
    assert b["failures"] and report["passed"] == 0


def test_suite_validation():
    validate_suite(suite())
    for broken in (suite(contract_version=2), suite(name=" "), suite(cases=[]), suite(extra=1), suite(cases=[suite()["cases"][0]] * 2), suite(cases=[case("x", "q", [("fact", "t")])])):
        with pytest.raises(InvalidInput):
            validate_suite(broken)


def test_provider_contract():
    assert parse_distillation(json.dumps({"memories": [memory(op="DELETE", target_node_id="n")]}))[0]["op"] == "invalidate"
    bad = [
        "no json", json.dumps({"memories": []}), json.dumps({"memories": [memory()], "x": 1}), json.dumps({"memories": [memory(extra=1)]}), json.dumps({"memories": [memory(op="grow")]}),
        json.dumps({"memories": [memory(text=" ")]}), json.dumps({"memories": [memory(cited_spans=[])]}), json.dumps({"memories": [memory(op="noop", target_node_id="n")]}),
        json.dumps({"memories": [memory(relation_edges=[{"kind": "supersedes", "target_node_id": "n"}])]}), json.dumps({"memories": [memory(cited_spans=[SPAN | {"seq": 0}])]}),
        json.dumps({"memories": [memory(op="invalidate", text="")]}),
    ]
    for raw in bad:
        with pytest.raises(SchemaError):
            parse_distillation(raw)


class Scripted:
    def __init__(self, *answers):
        self.answers = list(answers)

    def _next(self, *_):
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    distill = repair = decide = _next


def test_repair_and_rejection():
    good = json.dumps({"memories": [memory()]})
    out = distill_with(Scripted("bad", good), {"text": "e"}, [], 1)
    assert not out.rejected and out.metrics["repair_successes"] == 1 and out.metrics["provider_calls"] == 2
    assert distill_with(Scripted("bad", "bad"), {"text": "e"}, [], 1).rejected
    assert distill_with(Scripted(ProviderError("x")), {"text": "e"}, [], 1).metrics["provider_errors"] == 1


def test_command_provider():
    echo = CommandProvider([sys.executable, "-c", "import sys,json; json.load(sys.stdin); print(json.dumps({'decision':'stop'}))"], 20)
    assert parse_decision(echo.decide({"candidates": []}), []) == ("stop", None)
    with pytest.raises(ProviderError):
        CommandProvider([sys.executable, "-c", "import time; time.sleep(30)"], 0.5).decide({})
    with pytest.raises(ProviderError):
        CommandProvider(["/nonexistent/command"]).decide({})


def test_fold_with_a_provider():
    from chronolith.operators.fold import Scope, provider_distiller

    at = lambda i, text: {"id": i, "at": i * 1000, "span": ("a", f"s{i}", 1), "span_kind": "memory.write", "name": "fact", "text": text}
    cite = lambda i: [SPAN | {"span_id": f"s{i}"}]
    said = lambda *m: json.dumps({"memories": list(m)})
    scope = Scope("t", "p", "")
    scope.apply(at(1, "The endpoint is https://old.example now"), provider_distiller(Scripted(said(memory(text="The endpoint is https://old.example", cited_spans=cite(1))))))
    old = next(n for n in scope.nodes.values() if n.kind == "fact")
    update = memory(op="update", text="The endpoint is https://new.example", target_node_id=old.id, cited_spans=cite(2))
    scope.apply(at(2, "The endpoint is https://new.example"), provider_distiller(Scripted(said(update))))
    new = next(n for n in scope.nodes.values() if n.kind == "fact" and n is not old)
    assert (old.valid_to, new.valid_to, new.family) == (2000, None, old.family)
    assert [k[2] for k in scope.edges if k[0] == new.id and k[1] == old.id] == ["supersedes"]
    size = len(scope.nodes)
    assert scope.apply(at(3, "endpoint"), provider_distiller(Scripted("bad", "bad")))["op"] == "noop" and len(scope.nodes) == size
    assert scope.apply(at(4, "endpoint"), provider_distiller(Scripted(said(memory(cited_spans=cite(9))))))["skipped"] == 1
    with pytest.raises(ValueError):
        scope.apply(at(5, "endpoint"), provider_distiller(Scripted(said(memory(op="update", target_node_id="nowhere", cited_spans=cite(5))))))
    related = memory(text="endpoint example serves checkout", relation_edges=[{"kind": "part_of", "target_node_id": new.id}], cited_spans=cite(6))
    scope.apply(at(6, "The endpoint is https://new.example"), provider_distiller(Scripted(said(related))))
    assert any(k[2] == "part_of" and k[1] == new.id for k in scope.edges)


def test_walk_budget_prune_and_stop():
    nodes = [{"node_id": n, "text": n, "token_estimate": t, "lexical": 0.0, "eligible": True, "kind": "fact"} for n, t in (("a", 1), ("big", 50), ("mid", 5), ("small", 2))]
    edges = [("a", "big", 0.95), ("a", "mid", 0.9), ("small", "a", 0.7)]
    out = walk(nodes, edges, ["a"], "q", best_candidate, 4, 10)
    assert out["accepted"][0] == "mid" and "big" in out["pruned"] and out["tokens_spent"] <= 10
    metrics = {}
    failing = provider_policy(Scripted(ProviderError("x")), metrics)
    assert walk(nodes, edges, ["a"], "q", failing)["accepted"] == [] and metrics["provider_errors"] == 1
    wrong = provider_policy(Scripted(json.dumps({"decision": "accept", "node_id": "zz"})), metrics)
    assert walk(nodes, edges, ["a"], "q", wrong)["accepted"] == [] and metrics["schema_errors"] == 1
    prune = provider_policy(Scripted(json.dumps({"decision": "prune", "node_id": "mid"}), json.dumps({"decision": "stop"})))
    assert "mid" in walk(nodes, edges, ["a"], "q", prune)["pruned"]


def test_rate_limit(spark):
    from chronolith.operators.maintenance import rate_limited

    rows = [(i, "a", t) for i, t in enumerate([0, 10, 20, 59_999, 60_000, 60_001, 60_002])] + [(99, "b", 5)]
    df = spark.createDataFrame(rows, "id long, who string, t long")
    got = {r["id"]: (r["allowed"], r["retry_after_seconds"]) for r in rate_limited(df, "who", "t", "id", 2).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 60), 3: (False, 1), 4: (True, 0), 5: (True, 0), 6: (False, 60), 99: (True, 0)}
    assert all(r["allowed"] for r in rate_limited(df, "who", "t", "id", 0).collect())

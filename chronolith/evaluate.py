"""Evaluation suites: cases with their own events, one question and what the answer must hold."""

from __future__ import annotations

import json
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolith.engine import Answer, InvalidInput, MemoryEngine, Query
from chronolith.functions.classify import KINDS, MODES, ascii_lower
from chronolith.operators.fold import fnv, tokens

CONTRACT_VERSION = 1
ABILITIES = "information_extraction multi_session_reasoning temporal_reasoning knowledge_update abstention premise_awareness procedural".split()
EXPECTED = {"expected_answer_contains": "answer", "expected_evidence_contains": "evidence", "expected_stale_contains": "stale assumption", "expected_contradiction_contains": "contradiction"}
_SUITE = {"contract_version", "name", "source", "tenant_id", "project_id", "environment_id", "shared_haystack", "cases"}
_CASE = {"id", "ability", "tenant_id", "project_id", "environment_id", "as_of_unix_ms", "known_at_unix_ms", "require_fresh", "question", "max_tokens", "modes", "reconstruction", "baseline_full_context_score", "events", "expected_tier", *EXPECTED}
_EVENT = {"kind", "text", "observed_at_unix_ms", "ingested_at_unix_ms"}


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise InvalidInput(message)


def validate_suite(suite: dict[str, Any]) -> dict[str, Any]:
    """The suite, if it keeps the contract; unknown fields are refused."""
    known = lambda d, names, what: _need(not set(d) - names, f"{what} has unknown fields {sorted(set(d) - names)}")
    known(suite, _SUITE, "eval suite")
    _need(suite.get("contract_version", CONTRACT_VERSION) == CONTRACT_VERSION, f"unsupported eval contract_version {suite.get('contract_version')}; expected {CONTRACT_VERSION}")
    _need(str(suite.get("name", "")).strip(), "eval suite name must not be empty")
    _need(suite.get("cases"), "eval suite must include at least one case")
    ids: set[str] = set()
    for case in suite["cases"]:
        known(case, _CASE, "eval case")
        id_ = str(case.get("id", "")).strip()
        _need(id_, "eval case id must not be empty")
        _need(id_ not in ids, f"duplicate eval case id {id_!r}")
        ids.add(id_)
        _need(str(case.get("question", "")).strip(), f"eval case {id_!r} question must not be empty")
        _need(case.get("events"), f"eval case {id_!r} must include at least one event")
        for event in case["events"]:
            known(event, _EVENT, f"event of case {id_!r}")
            _need(event.get("kind") in KINDS, f"event of case {id_!r} has unknown kind {event.get('kind')!r}")
            _need(str(event.get("text", "")).strip(), f"eval case {id_!r} event text must not be empty")
        wanted = [w for e in EXPECTED for w in case.get(e) or []]
        _need(wanted, f"eval case {id_!r} must include at least one content expectation")
        _need(all(isinstance(w, str) and w.strip() for w in wanted), f"eval case {id_!r} expectations must not be empty")
        _need(case.get("max_tokens", 1) > 0, f"eval case {id_!r} max_tokens must be greater than 0")
        _need(case.get("modes") is None or case["modes"] and not set(case["modes"]) - set(MODES), f"eval case {id_!r} has unknown modes")
    return suite


def case_scope(suite: dict[str, Any], case: dict[str, Any]) -> tuple[str, str, str | None]:
    """Tenant, project and environment of a case; without a shared haystack each case has a project of its own."""
    project = suite.get("project_id", "eval")
    own = project if suite.get("shared_haystack") else f"{project}-eval_case_project_{fnv(suite['name'], case['id'])}"
    return case.get("tenant_id") or suite.get("tenant_id", "local"), case.get("project_id") or own, case.get("environment_id") or suite.get("environment_id")


def case_events(suite: dict[str, Any], index: int) -> list[tuple]:
    """Ledger rows of a case's events; times default to 1000 + 10000 * case + 1000 * event."""
    case = suite["cases"][index]
    tenant, project, env = case_scope(suite, case)
    rows = []
    for i, e in enumerate(case["events"]):
        trace = "eval_trace_" + fnv(suite["name"], case["id"], str(i))
        at = e.get("observed_at_unix_ms")
        at = 1_000 + index * 10_000 + i * 1_000 if at is None else at
        payload = json.dumps({"eval_case_id": case["id"], "eval_contract_version": CONTRACT_VERSION, "eval_suite": suite["name"], "kind": e["kind"]})
        got = e.get("ingested_at_unix_ms")
        rows.append(("eval", tenant, project, env, trace, "eval_span_" + fnv(trace), i + 1, "memory.write", e["kind"], "ok", e["text"], payload, at, at if got is None else got))
    return rows


_ROW = "source string, tenant_id string, project_id string, environment_id string, trace_id string, span_id string, seq long, span_kind string, name string, status string, text string, payload string, observed_at_unix_ms long, ingested_at_unix_ms long"


def judge(case: dict[str, Any], answer: Answer) -> dict[str, Any]:
    """Score of an answer: the share of expectations met; another tier than expected makes it zero."""
    held = {"expected_answer_contains": [answer.answer], "expected_evidence_contains": [e["text"] for e in answer.evidence], "expected_stale_contains": [s["summary"] for s in answer.stale_assumptions], "expected_contradiction_contains": [c["summary"] for c in answer.contradictions]}
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    checks = [(label, want, any(lower(want) in lower(h) for h in held[name])) for name, label in EXPECTED.items() for want in case.get(name) or []]
    failures = [f"missing {label} substring {want!r}" for label, want, ok in checks if not ok]
    gate = case.get("expected_tier") is not None and case["expected_tier"] != answer.tier_used
    if gate:
        failures.append(f"expected tier {case['expected_tier']}, got {answer.tier_used}")
    met = sum(ok for *_, ok in checks)
    content = met / len(checks) if checks else 0.0
    return {"score": 0.0 if gate or not checks else content, "content_score": content, "hard_gate_failed": gate, "checks_total": len(checks), "checks_matched": met, "failures": failures or ([] if checks else ["case has no expectations"])}


def run_suite(spark: SparkSession, suite: dict[str, Any], root: str, max_tokens: int | None = None, reconstruction: str | None = None, max_steps: int | None = None, engine: MemoryEngine | None = None) -> dict[str, Any]:
    """Append, project and ask case by case, in order; returns the report."""
    validate_suite(suite)
    engine = engine or MemoryEngine(spark, root)
    reports, projected = [], Counter()
    for i, case in enumerate(suite["cases"]):
        engine.append(spark.createDataFrame(case_events(suite, i), _ROW))
        projected.update(engine.project(clock_unix_ms=0))
        tenant, project, env = case_scope(suite, case)
        options = case.get("reconstruction") or {}
        query = Query(
            case["question"], tenant, project, env, case.get("as_of_unix_ms"), case.get("known_at_unix_ms"), max_tokens or case.get("max_tokens") or 1_200, case.get("modes"), bool(case.get("require_fresh")),
            reconstruction or options.get("mode", "off"), max_steps or options.get("max_steps", 4), options.get("max_tokens", 2_000),
        )
        answer = engine.ask(query)
        reports.append({"id": case["id"], "ability": case.get("ability", "information_extraction"), "tier": answer.tier_used, "baseline": case.get("baseline_full_context_score"), "evidence_tokens": sum(e["token_estimate"] for e in answer.evidence), "answer_tokens": tokens(answer.answer)} | judge(case, answer))
    table = spark.createDataFrame([(r["id"], r["ability"], r["tier"], r["baseline"], r["score"], r["checks_total"], r["checks_matched"], not r["failures"], r["evidence_tokens"], r["answer_tokens"]) for r in reports], CASES)
    rows = lambda df: [r.asDict() for r in df.collect()]
    return summary(table).first().asDict() | economics(projected) | {"ability_scores": rows(by_ability(table)), "tiers": rows(by_tier(table)), "projection": dict(projected), "cases_": reports}


def economics(projected: dict[str, int]) -> dict[str, float]:
    """What memory costs in tokens, from a projection's report: source and projected tokens for each memory touched, and projected for each source token."""
    source, made, touched = (projected.get(n, 0) for n in ("source_token_estimate", "projected_memory_token_estimate", "stored_memories_touched"))
    return {
        "source_tokens_per_stored_memory": source / max(touched, 1), "projected_tokens_per_stored_memory": made / max(touched, 1), "projected_to_source_token_ratio": made / source if source else 0.0,
    }


CASES = "id string, ability string, tier string, baseline double, score double, checks_total int, checks_matched int, passed boolean, evidence_tokens int, answer_tokens int"


def summary(cases: DataFrame) -> DataFrame:
    """Score, counts and the gap to the full-context baseline over the cases that have one."""
    based = F.col("baseline").isNotNull()
    gap = F.greatest(F.avg(F.when(based, F.col("baseline"))) - F.avg(F.when(based, F.col("score"))), F.lit(0.0))
    return cases.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.avg("score").alias("score"), F.sum("checks_total").alias("checks_total"), F.sum("checks_matched").alias("checks_matched"),
        F.avg("baseline").alias("baseline_full_context_score"), F.when(F.count("baseline") > 0, gap).alias("context_saturation_gap"), F.sum("evidence_tokens").alias("evidence_tokens_total"), F.sum("answer_tokens").alias("answer_tokens_total"),
    )


def by_ability(cases: DataFrame) -> DataFrame:
    return cases.groupBy("ability").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg("score").alias("score"))


def by_tier(cases: DataFrame) -> DataFrame:
    return cases.groupBy("tier").agg(F.count("*").alias("requests"), F.sum("evidence_tokens").alias("tokens_into_context"))


def judged(expected: DataFrame, told: DataFrame) -> DataFrame:
    """case_id, score over many cases at once. expected: case_id, field, wanted; told: case_id, field, text."""
    hit = ascii_lower(F.col("text")).contains(ascii_lower(F.col("wanted")))
    rows = expected.join(told, ["case_id", "field"], "left").groupBy("case_id", "field", "wanted").agg(F.max(F.coalesce(hit, F.lit(False))).alias("ok"))
    return rows.groupBy("case_id").agg(F.avg(F.col("ok").cast("double")).alias("score"), F.count("*").alias("checks_total"), F.count_if("ok").alias("checks_matched"))

"""Contracts with outside models: distillation and reconstruction by strict JSON over a command's standard streams.

Provider output is checked before it is used; unknown fields, missing spans and targets out of view are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import signal
import subprocess
from dataclasses import dataclass, field
from typing import Any, Protocol

from chronolith.functions.classify import KINDS
from chronolith.operators.fold import tokens

OPS = {"add": "add", "ADD": "add", "update": "update", "UPDATE": "update", "invalidate": "invalidate", "INVALIDATE": "invalidate", "delete": "invalidate", "DELETE": "invalidate", "noop": "noop", "NOOP": "noop", "no_op": "noop"}
RELATIONS = ["caused_by", "fixes", "before", "after", "part_of", "blocks", "enables"]
TIMEOUT_S = 25.0


class ProviderError(Exception):
    """The provider could not be run or timed out."""


class SchemaError(ValueError):
    """The provider's output breaks the contract."""


class DistillationProvider(Protocol):
    def distill(self, prompt: dict[str, Any]) -> str: ...

    def repair(self, prompt: dict[str, Any]) -> str: ...


class ReconstructionProvider(Protocol):
    def decide(self, step: dict[str, Any]) -> str: ...


@dataclass
class CommandProvider:
    """Runs a command for each call: JSON on its standard input, JSON from its standard output.

    The command gets its own process group, which is killed as a whole when time is up.
    """

    command: list[str]
    timeout_s: float = TIMEOUT_S

    def _call(self, message: dict[str, Any]) -> str:
        try:
            run = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
        except OSError as e:
            raise ProviderError(str(e)) from e
        try:
            out, err = run.communicate(json.dumps(message).encode(), timeout=self.timeout_s)
        except subprocess.TimeoutExpired as e:
            os.killpg(run.pid, signal.SIGKILL)
            run.wait()
            raise ProviderError(f"no answer within {self.timeout_s} s") from e
        if run.returncode:
            raise ProviderError(err.decode(errors="replace")[:500])
        try:
            return out.decode()
        except UnicodeDecodeError as e:
            raise ProviderError("output is not UTF-8") from e

    def distill(self, prompt: dict[str, Any]) -> str:
        return self._call(prompt | {"task": "distill"})

    def repair(self, prompt: dict[str, Any]) -> str:
        return self._call(prompt | {"task": "repair"})

    def decide(self, step: dict[str, Any]) -> str:
        return self._call(step)


def command_distiller(command: list[str], timeout_s: float = TIMEOUT_S, max_repairs: int = 1):
    """A distiller that runs a command; its batches are kept under a fingerprint of what decides its output."""
    from chronolith.operators.fold import provider_distiller

    _command(command, timeout_s)
    if max_repairs < 0:
        raise ValueError("max_repairs must not be negative")
    return provider_distiller(CommandProvider(command, timeout_s), max_repairs, hashlib.sha256(json.dumps([command, max_repairs]).encode()).hexdigest()[:16])


def command_policy(command: list[str], timeout_s: float = TIMEOUT_S):
    """A reconstruction policy that runs a command for each step."""
    from chronolith.operators.reconstruct import provider_policy

    _command(command, timeout_s)
    return provider_policy(CommandProvider(command, timeout_s))


def _command(command: list[str], timeout_s: float) -> None:
    if not command or not command[0].strip():
        raise ValueError("a provider's command must not be empty")
    if timeout_s <= 0:
        raise ValueError("a provider's timeout must be greater than 0")


def _only(value: Any, names: set[str], what: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise SchemaError(f"{what} must be an object")
    if extra := set(value) - names:
        raise SchemaError(f"{what} has unknown fields {sorted(extra)}")
    return value


def _identifier(value: Any, what: str) -> str:
    if not isinstance(value, str) or not value.strip() or value != value.strip():
        raise SchemaError(f"{what} must be a name without surrounding white space")
    return value


def parse_distillation(raw: str) -> list[dict[str, Any]]:
    """The memories of a provider's output; raises SchemaError."""
    try:
        out = _only(json.loads(raw), {"memories"}, "output")
    except ValueError as e:
        raise SchemaError(f"invalid provider JSON: {e}") from e
    memories = out.get("memories")
    if not isinstance(memories, list) or not memories:
        raise SchemaError("provider output must include at least one memory")
    return [check_memory(m, i) for i, m in enumerate(memories)]


def check_memory(memory: Any, index: int = 0) -> dict[str, Any]:
    what = f"memory {index}"
    m = _only(memory, {"op", "node_kind", "text", "target_node_id", "relation_edges", "cited_spans"}, what)
    if m.get("op") not in OPS:
        raise SchemaError(f"{what}: unknown op {m.get('op')!r}")
    op = OPS[m["op"]]
    if m.get("node_kind") not in KINDS:
        raise SchemaError(f"{what}: unknown node_kind {m.get('node_kind')!r}")
    if not isinstance(m.get("text"), str):
        raise SchemaError(f"{what}: text must be a string")
    target, edges, spans = m.get("target_node_id"), m.get("relation_edges") or [], m.get("cited_spans")
    if not isinstance(spans, list) or not spans:
        raise SchemaError(f"{what}: cited_spans must not be empty")
    for span in spans:
        s = _only(span, {"tenant_id", "project_id", "trace_id", "span_id", "seq"}, f"{what}: cited span")
        for name in ("tenant_id", "project_id", "trace_id", "span_id"):
            _identifier(s.get(name), f"{what}: {name}")
        if not isinstance(s.get("seq"), int) or s["seq"] < 1:
            raise SchemaError(f"{what}: seq must be greater than 0")
    if target is not None:
        _identifier(target, f"{what}: target_node_id")
    for edge in edges:
        e = _only(edge, {"kind", "target_node_id"}, f"{what}: relation edge")
        _identifier(e.get("target_node_id"), f"{what}: relation edge target")
        if e.get("kind") not in RELATIONS:
            raise SchemaError(f"{what}: relation_edges must use {', '.join(RELATIONS)}")
    blank = not m["text"].strip()
    if op in ("add", "update") and blank:
        raise SchemaError(f"{what}: text must not be empty")
    if op == "invalidate" and blank and (target is None or edges):
        raise SchemaError(f"{what}: an invalidation needs text, or a target and no relation edges")
    if op == "noop" and (target is not None or edges):
        raise SchemaError(f"{what}: a noop has neither target nor relation edges")
    return {"op": op, "node_kind": m["node_kind"], "text": m["text"], "target_node_id": None if op == "add" else target, "relation_edges": edges, "cited_spans": spans}


@dataclass
class Distilled:
    memories: list[dict[str, Any]] = field(default_factory=list)
    rejected: bool = False
    metrics: dict[str, int] = field(default_factory=lambda: dict.fromkeys("provider_calls provider_errors schema_errors repair_attempts repair_successes rejected_outputs input_tokens output_tokens".split(), 0))


def distill_with(provider: DistillationProvider, event: dict[str, Any], neighbours: list[dict[str, Any]], max_repairs: int = 1) -> Distilled:
    """One call, then up to ``max_repairs`` calls that show the provider its error; rejected if that does not help."""
    out, size = Distilled(), tokens(event["text"]) + sum(tokens(n["text"]) for n in neighbours)
    prompt = {"event": event, "neighbors": neighbours}
    call, m, repairs = lambda: provider.distill(prompt), out.metrics, 0
    m["input_tokens"] += size
    while True:
        m["provider_calls"] += 1
        try:
            raw = call()
        except ProviderError:
            m["provider_errors"] += 1
            m["rejected_outputs"] += 1
            out.rejected = True
            return out
        m["output_tokens"] += tokens(raw)
        try:
            out.memories = parse_distillation(raw)
            m["repair_successes"] += repairs > 0
            return out
        except SchemaError as e:
            m["schema_errors"] += 1
            if repairs >= max_repairs:
                m["rejected_outputs"] += 1
                out.rejected = True
                return out
            repairs += 1
            m["repair_attempts"] += 1
            m["input_tokens"] += size + tokens(raw) + tokens(str(e))
            call = lambda raw=raw, e=e: provider.repair(prompt | {"raw_output": raw, "error": str(e)})


def parse_decision(raw: str, candidates: list[str]) -> tuple[str, str | None]:
    """accept or prune with a candidate, or stop without one; raises SchemaError."""
    try:
        out = _only(json.loads(raw), {"decision", "node_id"}, "output")
    except ValueError as e:
        raise SchemaError(f"invalid provider JSON: {e}") from e
    decision, node = out.get("decision"), out.get("node_id")
    if decision not in ("accept", "prune", "stop"):
        raise SchemaError(f"unknown decision {decision!r}")
    if decision == "stop":
        if node is not None:
            raise SchemaError("stop decision must not include node_id")
        return "stop", None
    if node not in candidates:
        raise SchemaError(f"{decision} decision node_id {node!r} is not in candidates")
    return decision, node

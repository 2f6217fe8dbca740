"""Projection with revisions: an ordered fold of each scope's events.

An event sees the neighbours that earlier ones made, so updates and invalidations have no join form; scopes are
independent and run in parallel.  The specification is the fold in order of (observed, arrival); a late event
gives the same graph as if it had come in time, since its scope is folded again.  Within a scope the
neighbours of an event are found by an inverted index of cue terms.
"""

from __future__ import annotations

import json
import re
import time
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chronolith.functions.classify import DECLARED, KIND_MARKERS, OP_MARKERS
from chronolith.functions.text import STOP_WORDS
from chronolith.operators.project import BODY_LIMIT, CUES
from chronolith.operators.retrieve import CUE_TERMS

# Neighbours looked at, overlaps that revise, targets of an invalidation.
NEIGHBOURS, UPDATE_OVERLAP, INVALIDATE_OVERLAP, TARGETS = 24, 0.35, 0.12, 3
_STOP = frozenset(STOP_WORDS)
_OTHER = re.compile(r"[^A-Za-z0-9_./-]+")
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def normalize(text: str) -> str:
    return _OTHER.sub(" ", text).lower().strip(" ")


def terms(text: str) -> list[str]:
    found = {t.strip(".-/") for t in normalize(text).split(" ")}
    return sorted(t for t in found if len(t) >= 3 and t not in _STOP and not re.fullmatch("[0-9]+", t))


def top_terms(text: str, limit: int) -> list[str]:
    weight = lambda t: len(t) + 4 * ("." in t) + 4 * ("/" in t) + 2 * ("_" in t) + 2 * ("-" in t)
    return sorted(terms(text), key=lambda t: (-weight(t), t))[:limit]


def fnv_state(*parts: str, h: int = 0xCBF29CE484222325) -> int:
    for p in parts:
        for b in p.encode() + b"\xff":
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv(*parts: str) -> str:
    return f"{fnv_state(*parts):016x}"


def canonical_key(kind: str, text: str) -> str:
    normal = normalize(text)
    top = " ".join(top_terms(normal, 12))
    return f"{kind}:{top or 'empty_' + fnv(normal)}"


def tokens(text: str) -> int:
    return max(-(-sum(map(len, text.split())) // 4), 1 if text else 0)


def clip(text: str, limit: int) -> str:
    text = " ".join(text.split())
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit].decode(errors="ignore").rstrip() + "..."


def merged(old: str, new: str) -> str:
    new = new.strip()
    if not new or new in old:
        return old
    return f"{old.strip()} {new}" if old.strip() else new


def kind_of(name: str, text: str) -> str:
    name, text = name.translate(_ASCII_LOWER), text.translate(_ASCII_LOWER)
    for kind, names in DECLARED.items():
        if name in names:
            return kind
    return next((kind for kind, marks in KIND_MARKERS if any(m in text for m in marks)), "fact")


def op_of(text: str) -> str:
    text = text.translate(_ASCII_LOWER)
    return next((op for op, marks in OP_MARKERS if any(m in text for m in marks)), "add")


@dataclass
class Node:
    id: str
    kind: str
    text: str
    key: str
    family: str
    valid_from: int
    first_at: tuple[int, int]
    valid_to: int | None = None
    closed_by: int | None = None
    observations: int = 1
    spans: dict = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    terms: frozenset = frozenset()

    @property
    def confidence(self) -> float:
        return min(0.65 + 0.05 * (self.observations - 1), 1.0)


class Scope:
    """The graph of one scope while its events are folded in order."""

    def __init__(self, tenant: str, project: str, env: str):
        self.place = (tenant, project, env)
        self.nodes: dict[str, Node] = {}
        self.families: dict[tuple[str, str], list[Node]] = {}
        self.index: dict[str, list[tuple]] = {}
        self.edges: dict[tuple[str, str, str], list] = {}
        self.repaired = 0

    # -- nodes ------------------------------------------------------------------------
    def _unindex(self, node: Node) -> None:
        """Take a node from the index; a closed one is never active again, as events come in order of time."""
        for t, w in node.words.items():
            rows = self.index[t]
            del rows[bisect_left(rows, (-w, -node.valid_from, -node.first_at[1], node.id))]
        node.words = {}

    def _index(self, node: Node) -> None:
        self._unindex(node)
        found, weight = terms(node.text), 1.0
        node.terms = frozenset(found)
        for t in found[:CUE_TERMS]:
            node.words[t] = weight
            insort(self.index.setdefault(t, []), (-weight, -node.valid_from, -node.first_at[1], node.id))
            weight = max(weight * 0.97, 0.2)

    def _insert(self, kind: str, base: str, key: str, text: str, at: int, event: dict) -> Node:
        node = Node("node_" + fnv(*self.place, kind, key), kind, text, key, base, at, (at, event["id"]))
        self.nodes[node.id] = node
        self.families.setdefault((kind, base), []).append(node)
        node.spans[event["span"]] = None
        self._index(node)
        return node

    def version_at(self, kind: str, base: str, at: int) -> Node | None:
        """The latest version of a family that began at a time; families grow in order of time, so it stands at the end."""
        family = self.families.get((kind, base))
        return family[-1] if family and family[-1].valid_from == at else None

    def upsert(self, kind: str, text: str, event: dict, base: str | None = None, successor: bool = False) -> tuple[Node, bool]:
        """Add a memory to a family; returns its version and whether it is new."""
        at = event["at"]
        if base is None:
            base = "episode:{}:{}:{}".format(*event["span"]) if kind == "episode" else canonical_key(kind, text)
        same = self.version_at(kind, base, at)
        if same is None:
            for n in reversed(self.families.get((kind, base), ())):
                if n.valid_to is not None and n.valid_to <= at:
                    break  # its predecessors were closed when it began
                n.valid_to, n.closed_by = at, event["id"]
                self._unindex(n)
            return self._insert(kind, base, base if kind == "episode" else f"{base}|rev:{at}", text, at, event), True
        if event["id"] > same.first_at[1]:
            if successor and kind != "episode":
                self.close(same, at, event["id"])
                return self._insert(kind, base, f"{base}|rev:{at}:event:{event['id']}", text, at, event), True
            same.spans[event["span"]] = None
            return same, False
        same.text = merged(same.text, text)
        same.observations += 1
        same.spans[event["span"]] = None
        self._index(same)
        return same, False

    def close(self, node: Node, at: int, event_id: int) -> bool:
        if node.valid_from > at:
            return False
        if node.valid_to is None or node.valid_to > at or node.valid_to == at and (node.closed_by is None or node.closed_by > event_id):
            node.valid_to, node.closed_by = at, event_id
            self._unindex(node)
            return True
        return False

    def neighbours(self, text: str, at: int, limit: int = NEIGHBOURS) -> list[Node]:
        out: dict[str, Node] = {}
        for t in terms(text):
            n = 0
            for *_, id_ in self.index.get(t, ()):
                node = self.nodes[id_]
                if node.valid_from <= at and (node.valid_to is None or node.valid_to > at):
                    out.setdefault(id_, node)
                    n += 1
                    if n == limit:
                        break
        return list(out.values())[:limit]

    # -- edges ------------------------------------------------------------------------
    def link(self, a: Node, b: Node, kind: str, weight: float, event: dict) -> bool:
        if a.id == b.id:
            return False
        edge = self.edges.get((a.id, b.id, kind))
        if edge is not None:
            return False
        self.edges[a.id, b.id, kind] = [weight, event["at"], event["id"]]
        return True

    def cues(self, node: Node, event: dict) -> None:
        for word in top_terms(node.text, CUES):
            cue, _ = self.upsert("entity_cue", word, event)
            self.link(node, cue, "mentions", 0.55, event)

    # -- events ------------------------------------------------------------------------
    @staticmethod
    def overlap(a: frozenset, b: frozenset) -> float:
        return len(a & b) / len(a | b) if a and b else 0.0

    def heuristic(self, event: dict, near: list[Node]) -> list[dict]:
        """What an event says by markers alone: its episode, then one typed memory that may revise a neighbour."""
        body = clip(event["text"], BODY_LIMIT)
        if not body.strip():
            return []
        kind, op, said = kind_of(event["name"], body), op_of(body), frozenset(terms(body))
        target = None
        if op != "add" and kind != "episode":
            least = UPDATE_OVERLAP if op == "update" else INVALIDATE_OVERLAP
            fit = [(s, i, n) for i, n in enumerate(near) if n.kind == kind and (s := self.overlap(said, n.terms)) >= least]
            target = max(fit, key=lambda x: x[:2])[2].id if fit else None  # the last of the best
        episode = {"op": "add", "node_kind": "episode", "text": f"{event['span_kind']} {event['name']}: {body}", "target_node_id": None}
        return [episode, {"op": op, "node_kind": kind, "text": body, "target_node_id": target}]

    def check(self, memory: dict, near: dict[str, Node]) -> None:
        """Raises ValueError unless targets are neighbours that a memory may revise or point to."""
        target = memory.get("target_node_id")
        if target is not None:
            node = near.get(target)
            if node is None or node.kind != memory["node_kind"] or node.kind in ("episode", "entity_cue"):
                raise ValueError(f"target_node_id {target!r} must reference a typed neighbour of the same kind")
            if memory["text"].strip() and self.overlap(frozenset(terms(memory["text"])), node.terms) < INVALIDATE_OVERLAP:
                raise ValueError(f"target_node_id {target!r} does not overlap the memory's text")
        for edge in memory.get("relation_edges") or []:
            node = near.get(edge["target_node_id"])
            if node is None or node.kind in ("episode", "entity_cue"):
                raise ValueError(f"relation edge target {edge['target_node_id']!r} must reference a typed neighbour")

    def _targets(self, memory: dict, near: dict[str, Node]) -> list[Node]:
        """The neighbours that a memory revises: its target, else what overlaps enough."""
        if memory["op"] in ("add", "noop"):
            return []
        if memory.get("target_node_id") is not None:
            return [near[memory["target_node_id"]]]
        said = frozenset(terms(memory["text"]))
        scored = [(self.overlap(said, n.terms), n) for n in near.values() if n.kind == memory["node_kind"]]
        if memory["op"] == "invalidate":
            return [n for s, n in scored if s >= INVALIDATE_OVERLAP][:TARGETS]
        typed = [(s, n) for s, n in scored if s >= UPDATE_OVERLAP and n.kind not in ("episode", "entity_cue")]
        return [max(typed, key=lambda x: x[0])[1]] if typed else []  # the first of the best

    def apply(self, event: dict, distiller=None, stored: str | None = None) -> dict:
        """Fold one event; returns what it did: ``COUNTERS``, the op of its last memory and the memories that are worth keeping.

        ``distiller``: (event, neighbours) -> memories, a ``Distilled``, or None to leave the event out.  ``stored``: memories that were accepted before, as JSON;
        nobody is asked then.  Raises ValueError, with nothing done, if memories from outside revise what they may not.
        """
        r = dict.fromkeys(COUNTERS, 0) | {"op": "noop", "memories": None, "seen": 1, "source_tokens": tokens(event["text"])}
        near_list, began = self.neighbours(event["text"], event["at"]), time.monotonic()
        if stored is not None:
            memories, r["replayed"] = json.loads(stored), 1
        elif distiller is None:
            memories = self.heuristic(event, near_list)
        else:
            memories = distiller(event, near_list)
            for name, n in getattr(memories, "metrics", {}).items():
                r["rejections" if name == "rejected_outputs" else name] += n
            memories = getattr(memories, "memories", memories) if not getattr(memories, "rejected", False) else None
        r["elapsed_ms"] = int(1000 * (time.monotonic() - began)) if distiller is not None else 0
        if memories is None:
            return r | {"skipped": 1}
        near, said = {n.id: n for n in near_list}, []
        for m in memories:
            self.check(m, near)
            targets = self._targets(m, near)
            op = m["op"]
            if op in ("update", "invalidate") and not targets:
                op = "add"
                self.repaired += 1
            said.append((op, m, targets))
        r["projected"], r["outputs"] = 1, len(said)
        if distiller is not None and stored is None:
            r["memories"] = json.dumps(memories, ensure_ascii=False)
        made: list[Node] = []
        for op, m, targets in said:
            node = self._write(op, m["node_kind"], m["text"], targets, event, r)
            if node is None:
                continue
            for edge in m.get("relation_edges") or []:
                r["edges"] += self.link(node, near[edge["target_node_id"]], edge["kind"], 1.0, event)
            made.append(node)
            r["touched"] += 1
            r["projected_tokens"] += tokens(node.text)
        for a, b in zip(made, made[1:]):
            r["edges"] += self.link(b, a, "derived_from", 0.8, event)
            if a.kind == "episode":
                r["edges"] += self.link(b, a, "observed_in", 0.9, event)
        return r | {"op": said[-1][0] if said else "noop"}

    def _write(self, op: str, kind: str, text: str, targets: list[Node], event: dict, r: dict) -> Node | None:
        if op == "noop":
            r["nooped"] += 1
            return None
        if op == "add":
            node, new = self.upsert(kind, text, event)
            r["added" if new else "updated"] += 1
            self.cues(node, event)
            return node
        if op == "update":
            node, new = self.upsert(kind, text, event, base=targets[0].family, successor=True)
            if new:
                self.cues(node, event)
            r["updated"] += 1
            r["edges"] += self.link(node, targets[0], "supersedes", 1.0, event)
            return node
        node = None
        if text.strip():
            node = self.version_at(kind, canonical_key(kind, text), event["at"])
            if node is None:
                node, new = self.upsert(kind, text, event)
                if new:
                    self.cues(node, event)
        for old in targets:
            if (node is None or old.id != node.id) and self.close(old, event["at"], event["id"]):
                r["invalidated"] += 1
                r["touched"] += 1
                if node is not None:
                    r["edges"] += self.link(node, old, "supersedes", 1.0, event)
                    r["edges"] += self.link(node, old, "contradicts", 0.8, event)
        return node


#: What an event does to the graph, and what it took to distil it; the sums over events are the report of a projection.
COUNTERS = (
    "seen projected skipped source_tokens projected_tokens touched outputs provider_calls provider_errors schema_errors repair_attempts repair_successes rejections replayed "
    "input_tokens output_tokens elapsed_ms added updated invalidated nooped edges"
).split()


class provider_distiller:  # noqa: N801 - used like a function
    """A distiller that asks an outside provider; events whose output stays invalid are left out.

    ``kind`` and ``fingerprint`` say whose batches are kept for replay; without a fingerprint none are.
    With one, an update or invalidation must name its target, since a replay can't ask what was meant.
    """

    kind = "command"

    def __init__(self, provider, max_repairs: int = 1, fingerprint: str | None = None):
        self.provider, self.max_repairs, self.fingerprint = provider, max_repairs, fingerprint

    def __call__(self, event: dict, near: list[Node]):
        from chronolith.providers import distill_with

        seen = {"trace_id": event["span"][0], "span_id": event["span"][1], "seq": event["span"][2], "span_kind": event["span_kind"], "name": event["name"], "text": event["text"], "observed_at_unix_ms": event["at"]}
        out = distill_with(self.provider, seen, [{"id": n.id, "kind": n.kind, "text": n.text, "canonical_key": n.key} for n in near], self.max_repairs)
        if any((s["trace_id"], s["span_id"], s["seq"]) != event["span"] for m in out.memories for s in m["cited_spans"]):
            out.rejected = True
        if self.fingerprint is not None and any(m["op"] in ("update", "invalidate") and m.get("target_node_id") is None for m in out.memories):
            out.rejected = True
        return out


def stored_only(event: dict, near: list[Node]) -> None:
    """A distiller that asks nobody: events without stored memories are left out."""
    return None


NODE_COLUMNS = (
    "id string, tenant_id string, project_id string, environment_id string, kind string, text string, canonical_key string, valid_from_unix_ms long, valid_to_unix_ms long, "
    "valid_to_event_id long, confidence double, token_estimate int, observation_count int, spans array<struct<trace_id:string,span_id:string,seq:long>>, "
    "edges array<struct<to_node_id:string,kind:string,weight:double,created_at_unix_ms:long,source_event_id:long>>, "
    "event struct<event_id:long,op:string,memories:string," + ",".join(f"{c}:long" for c in COUNTERS) + ">"
)


def fold_scope(events: pd.DataFrame, distiller=None) -> pd.DataFrame:
    """Nodes of one scope, each with its citations and outgoing edges, and one row for each event with nothing but what it did."""
    events = events.sort_values(["observed_at_unix_ms", "id"])
    first = events.iloc[0]
    env = first["environment_id"] if isinstance(first["environment_id"], str) else None
    scope = Scope(first["tenant_id"], first["project_id"], env or "")
    done = []
    for e in events.itertuples(index=False):
        event = {"id": int(e.id), "at": int(e.observed_at_unix_ms), "span": (e.trace_id, e.span_id, int(e.seq)), "span_kind": e.span_kind, "name": e.name, "text": e.text or ""}
        stored = e.memories if isinstance(e.memories, str) else None
        try:
            did = scope.apply(event, distiller, stored)
        except ValueError:
            if distiller is None and stored is None:
                raise
            did = dict.fromkeys(COUNTERS, 0) | {"op": "noop", "memories": None, "seen": 1, "skipped": 1, "rejections": 1, "source_tokens": tokens(event["text"])}
        done.append({"event_id": event["id"]} | did)
    out: dict[str, list] = {n.id: [] for n in scope.nodes.values()}
    for (a, b, kind), (w, at, source) in scope.edges.items():
        out[a].append({"to_node_id": b, "kind": kind, "weight": w, "created_at_unix_ms": at, "source_event_id": source})
    rows = [
        (n.id, scope.place[0], scope.place[1], env, n.kind, n.text, n.key, n.valid_from, n.valid_to, n.closed_by, round(n.confidence, 6), tokens(n.text), n.observations,
         [{"trace_id": t, "span_id": s, "seq": q} for t, s, q in n.spans], out[n.id], None)
        for n in scope.nodes.values()
    ]
    rows += [(None, *scope.place[:2], env, None, None, None, None, None, None, None, None, None, None, None, did) for did in done]
    frame = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in re.split(r",\s+(?=\w+ )", NODE_COLUMNS)], dtype=object)
    for c in ("valid_from_unix_ms", "valid_to_unix_ms", "valid_to_event_id", "token_estimate", "observation_count"):
        frame[c] = frame[c].astype("Int64")
    frame["confidence"] = frame["confidence"].astype("Float64")
    return frame


def fold(ledger: DataFrame, distiller=None) -> DataFrame:
    """The graph of a ledger: one row a node with citations and outgoing edges, and one row an event. A distiller must be picklable; it runs where the scope is folded.

    ledger: may carry ``memories``, JSON of what was accepted for an event before; those are replayed.
    """
    memories = F.col("memories") if "memories" in ledger.columns else F.lit(None).cast("string")
    rows = ledger.withColumn("env", F.coalesce("environment_id", F.lit(""))).select("tenant_id", "project_id", "env", "environment_id", "id", "observed_at_unix_ms", "trace_id", "span_id", "seq", "span_kind", "name", "text", memories.alias("memories"))
    return rows.groupBy("tenant_id", "project_id", "env").applyInPandas(lambda events: fold_scope(events, distiller), NODE_COLUMNS)


def fold_events(folded: DataFrame) -> DataFrame:
    """event_id, op, memories and counters of every event."""
    return folded.filter("event IS NOT NULL").select("event.*")


def fold_nodes(folded: DataFrame) -> DataFrame:
    return folded.filter("event IS NULL").drop("spans", "edges", "event")


def fold_edges(folded: DataFrame) -> DataFrame:
    return folded.select("tenant_id", "project_id", "environment_id", F.col("id").alias("from_node_id"), F.inline("edges"))


def fold_spans(folded: DataFrame) -> DataFrame:
    return folded.select(F.col("id").alias("node_id"), "tenant_id", "project_id", F.inline("spans"))

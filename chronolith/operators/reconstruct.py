"""Active reconstruction: a bounded walk from selected evidence to its neighbours in the graph.

Each question's visible sub-graph (bounded by the retrieval limits) goes to one task; the walk takes at most
``max_steps`` steps and ``max_tokens`` tokens.  The policy is deterministic or an outside provider; a provider that
fails or breaks the contract stops the walk and never the query.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chronolith.functions.classify import accepted

MAX_STEPS, MAX_TOKENS = 4, 2_000
Policy = Callable[[dict[str, Any]], tuple[str, str | None]]


def best_candidate(step: dict[str, Any]) -> tuple[str, str | None]:
    """Accept the best candidate that fits, the last of equals; stop if there is none."""
    fit = [c for c in step["candidates"] if c["token_estimate"] <= step["remaining_tokens"]]
    if not fit:
        return "stop", None
    top = max(c["score"] for c in fit)
    return "accept", [c["node_id"] for c in fit if c["score"] == top][-1]


def provider_policy(provider: Any, metrics: dict[str, int] | None = None) -> Policy:
    from chronolith.providers import ProviderError, SchemaError, parse_decision

    m = metrics if metrics is not None else {}

    def decide(step: dict[str, Any]) -> tuple[str, str | None]:
        m["provider_calls"] = m.get("provider_calls", 0) + 1
        try:
            return parse_decision(provider.decide(step), [c["node_id"] for c in step["candidates"]])
        except ProviderError:
            m["provider_errors"] = m.get("provider_errors", 0) + 1
        except SchemaError:
            m["schema_errors"] = m.get("schema_errors", 0) + 1
        return "stop", None

    decide.provider = provider
    return decide


def walk(nodes: list[dict[str, Any]], edges: list[tuple[str, str, float]], selected: list[str], question: str, policy: Policy = best_candidate, max_steps: int = MAX_STEPS, max_tokens: int = MAX_TOKENS) -> dict[str, Any]:
    """nodes: node_id, text, token_estimate, lexical, eligible, in node order. edges: from, to, typed weight, in edge order."""
    by_id = {n["node_id"]: n for n in nodes}
    around: dict[str, list[tuple[str, float]]] = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
        if a != b:
            around.setdefault(b, []).append((a, w))
    chosen = set(selected)
    frontier = deque(sorted(chosen))
    if not frontier:
        frontier.extend(n["node_id"] for n in [next((n for n in nodes if n["eligible"] and n["lexical"] > 0), None)] if n)
    expanded: list[str] = []
    accepted_, pruned, spent, scores = [], [], 0, {}
    for index in range(max_steps):
        at = None
        while frontier and at is None:
            at = frontier.popleft()
            if at in expanded or at in pruned:
                at = None
        if at is None:
            break
        expanded.append(at)
        left = max_tokens - spent
        found: dict[str, float] = {}
        for other, w in around.get(at, ()):
            n = by_id.get(other)
            if n is None or not n["eligible"] or other in chosen or other in expanded or other in pruned:
                continue
            score = min(max(0.6 * w + 0.4 * n["lexical"], 0.0), 1.0)
            if score > 0.02:
                found[other] = score  # the last edge counts
        used, candidates = 0, []
        for id_, score in sorted(sorted(found.items()), key=lambda x: -x[1]):
            size = by_id[id_]["token_estimate"]
            if used + size > left:
                pruned.append(id_)
                continue
            used += size
            candidates.append({"node_id": id_, "kind": by_id[id_].get("kind"), "text": by_id[id_].get("text", ""), "score": score, "token_estimate": size})
        if left == 0:
            break
        decision, id_ = policy({"question": question, "step_index": index, "expanded_node_id": at, "remaining_tokens": left, "candidates": candidates})
        if decision == "stop":
            break
        if id_ not in found or id_ in pruned:
            continue
        if decision == "accept":
            spent += by_id[id_]["token_estimate"]
            chosen.add(id_)
            accepted_.append(id_)
            scores[id_] = found[id_]
            frontier.appendleft(id_)
        else:
            pruned.append(id_)
    return {"steps_used": len(expanded), "tokens_spent": spent, "expanded": expanded, "accepted": accepted_, "pruned": pruned, "scores": scores}


RESULT = "query_id {id}, steps_used int, tokens_spent int, expanded array<string>, accepted array<string>, pruned array<string>, accepted_scores array<double>"


def reconstruct(questions: DataFrame, ctx: DataFrame, seen: DataFrame, picked: DataFrame, policy: Policy = best_candidate, max_steps: int = MAX_STEPS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """query_id and what the walk of each question did. Modes of the context decide which kinds it may accept."""
    mark = picked.select("query_id", "node_id", F.lit(True).alias("picked"))
    eligible = (F.col("kind") != "entity_cue") & accepted(F.col("modes"), F.col("kind"))
    nodes = ctx.filter("NOT stale").join(mark, ["query_id", "node_id"], "left").join(questions.select("query_id", "question"), "query_id")
    nodes = nodes.select("query_id", "question", "node_id", "kind", "text", "token_estimate", "lexical", "node_order", eligible.alias("eligible"), F.coalesce("picked", F.lit(False)).alias("picked"))
    edges = seen.filter("ranking").select("query_id", "edge_id", "from_node_id", "to_node_id", "typed")

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if n.empty:
            return pd.DataFrame(columns=["query_id", "steps_used", "tokens_spent", "expanded", "accepted", "pruned", "accepted_scores"])
        n, e = n.sort_values("node_order"), e.sort_values("edge_id")
        out = walk(n.to_dict("records"), list(zip(e["from_node_id"], e["to_node_id"], e["typed"])), n.loc[n["picked"], "node_id"].tolist(), n["question"].iloc[0], policy, max_steps, max_tokens)
        return pd.DataFrame([{"query_id": key[0], "steps_used": out["steps_used"], "tokens_spent": out["tokens_spent"], "expanded": out["expanded"], "accepted": out["accepted"], "pruned": out["pruned"], "accepted_scores": [float(out["scores"][a]) for a in out["accepted"]]}])

    return nodes.groupBy("query_id").cogroup(edges.groupBy("query_id")).applyInPandas(run, RESULT.format(id=dict(nodes.dtypes)["query_id"]))

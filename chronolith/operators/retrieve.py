"""From questions to evidence: route, seed, rank by activation, fit a token budget, annotate.

Many questions are answered by one plan, keyed by (query_id, node_id).  Questions: query_id, tenant_id,
project_id, environment_id, question, as_of, known_at (null: everything known).  A question sees the nodes of its
scope only; scopes are equi-joined, and no table is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronolith.functions.classify import COMPOSITIONAL, accepted, ascii_lower, contains_any, kinds_for, route
from chronolith.functions.text import concise, estimate_tokens, merge_texts, overlap, terms, top_terms
from chronolith.operators.bitemporal import REVISION_KINDS

# Strength of an edge by kind.
EDGE_WEIGHTS = {
    "mentions": 0.7, "caused_by": 1.0, "fixes": 1.0, "contradicts": 0.9, "supersedes": 0.95, "before": 0.55, "after": 0.55,
    "part_of": 0.8, "derived_from": 0.75, "blocks": 0.9, "enables": 0.9, "observed_in": 0.6,
}
# Limits and weights of retrieval.
SEEDS, HISTORY, CUE_TERMS = 64, 10_000, 64
STEPS, DAMPING, RESTART, BACKWARD = 12, 0.82, 0.18, 0.65
BLEND = {"ppr": 0.45, "base": 0.30, "edge": 0.15, "fresh": 0.10}
MAX_TOKENS = 1_200
DAY_MS = 86_400_000

SCOPE = ["tenant_id", "project_id", "env"]


def kind_weight(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for k, w in EDGE_WEIGHTS.items():
        out = out.when(kind == k, w)
    return out.otherwise(0.0)


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def base_level(observations: Column, updated: Column, as_of: Column) -> Column:
    age = F.greatest(as_of - updated, F.lit(0)) / DAY_MS
    return clamp(F.log(observations + 1) / 4 * F.pow(1 + age, F.lit(-0.28)))


def freshness(updated: Column, as_of: Column) -> Column:
    age = F.greatest(as_of - updated, F.lit(0)) / DAY_MS
    return clamp(1 / (1 + age / 45))


def with_scope(df: DataFrame) -> DataFrame:
    return df.withColumn("env", F.coalesce("environment_id", F.lit("")))


def cue_index(nodes: DataFrame) -> DataFrame:
    """term, node_id, scope and weight: 0.97 to the power of the term's alphabetical place, not below 0.2."""
    rows = nodes.select(F.col("id").alias("node_id"), "tenant_id", "project_id", "environment_id", F.posexplode(F.slice(terms(F.col("text")), 1, CUE_TERMS)).alias("pos", "term"))
    return rows.select("term", "node_id", "tenant_id", "project_id", "environment_id", F.greatest(F.pow(F.lit(0.97), F.col("pos")), F.lit(0.2)).alias("weight"))


def prepared(questions: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """Questions with terms, routed modes, reason, confidence and the kinds to look up."""
    rows = with_scope(questions).withColumn("q_terms", terms(F.col("question"))).withColumn("r", route(F.col("question"), modes))
    return rows.withColumn("modes", F.col("r.modes")).withColumn("reason", F.col("r.reason")).withColumn("confidence", F.col("r.confidence")).withColumn("kinds", kinds_for(F.col("r.modes"))).drop("r")


def _known(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs whose node has a source observed by as_of and ingested by known_at."""
    s = sources.select("node_id", "observed", "ingested")
    on = (pairs["node_id"] == s["node_id"]) & (s["observed"] <= pairs["as_of"]) & (s["ingested"] <= pairs["known_at"])
    known = pairs.filter("known_at IS NOT NULL").join(s, on, "left_semi")
    return known.unionByName(pairs.filter("known_at IS NULL"))


def seed_nodes(questions: DataFrame, nodes: DataFrame, sources: DataFrame, first: DataFrame, limit: int = SEEDS) -> DataFrame:
    """query_id, node_id, seed_rank: up to ``limit`` nodes a question by its cue terms.

    Each term's best nodes (weight, newest, latest first event, id) follow each other in the order of terms.
    """
    q = questions.select("query_id", *SCOPE, "as_of", "known_at", "kinds", F.explode("q_terms").alias("term"))
    cues = with_scope(cue_index(nodes)).select("term", "node_id", *SCOPE, "weight")
    facts = nodes.select(F.col("id").alias("node_id"), "kind", "valid_from_unix_ms")
    rows = q.join(cues, [*SCOPE, "term"]).join(facts, "node_id")
    rows = rows.filter((F.col("valid_from_unix_ms") <= F.col("as_of")) & F.array_contains("kinds", F.col("kind")))
    rows = _known(rows, sources).join(first, "node_id", "left")
    order = [F.col("weight").desc(), F.col("valid_from_unix_ms").desc(), F.coalesce("first_event_id", F.lit(0)).desc(), F.col("node_id")]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(*order))).filter(F.col("nth") <= limit)
    best = rows.groupBy("query_id", "node_id").agg(F.min(F.struct("term", "nth")).alias("place"))
    return best.withColumn("seed_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter(F.col("seed_rank") <= limit).select("query_id", "node_id", "seed_rank")


def neighbours(asking: DataFrame, nodes: DataFrame, first: DataFrame, limit: int = 24) -> DataFrame:
    """query_id, node_id, place: active nodes near a text in its scope, by cue terms as seeds are. asking: query_id, scope, at, q_terms."""
    q = with_scope(asking).select("query_id", *SCOPE, "at", F.explode("q_terms").alias("term"))
    cues = with_scope(cue_index(nodes)).select("term", "node_id", *SCOPE, "weight")
    facts = nodes.select(F.col("id").alias("node_id"), "valid_from_unix_ms", "valid_to_unix_ms")
    rows = q.join(cues, [*SCOPE, "term"]).join(facts, "node_id")
    rows = rows.filter((F.col("valid_from_unix_ms") <= F.col("at")) & (F.col("valid_to_unix_ms").isNull() | (F.col("valid_to_unix_ms") > F.col("at")))).join(first, "node_id", "left")
    order = [F.col("weight").desc(), F.col("valid_from_unix_ms").desc(), F.coalesce("first_event_id", F.lit(0)).desc(), F.col("node_id")]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(*order))).filter(F.col("nth") <= limit)
    best = rows.groupBy("query_id", "node_id").agg(F.min(F.struct("term", "nth")).alias("best"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("best"))).filter(F.col("place") <= limit).select("query_id", "node_id", "place")


def revision_targets(asking: DataFrame, nodes: DataFrame, near: DataFrame, update: float = 0.35, invalidate: float = 0.12, targets: int = 3) -> DataFrame:
    """Neighbours of the text's own kind (``mkind``) that overlap enough to be updated or, the first three, invalidated."""
    facts = nodes.select(F.col("id").alias("node_id"), "kind", F.col("text").alias("node_text"))
    rows = near.join(asking.select("query_id", "q_terms", "mkind"), "query_id").join(facts, "node_id").filter(F.col("kind") == F.col("mkind"))
    rows = rows.withColumn("overlap", overlap(F.col("q_terms"), terms(F.col("node_text")))).filter(F.col("overlap") >= invalidate)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return rows.select("query_id", "node_id", "overlap", (F.col("overlap") >= update).alias("updates"), (nth <= targets).alias("invalidates"))


def history(questions: DataFrame, nodes: DataFrame, sources: DataFrame, first: DataFrame, limit: int = HISTORY) -> DataFrame:
    """query_id, node_id, node_order: the newest nodes of a question's scope and kinds, closed ones too."""
    q = questions.select("query_id", *SCOPE, "as_of", "known_at", "kinds")
    n = with_scope(nodes).select(F.col("id").alias("node_id"), *SCOPE, "kind", "valid_from_unix_ms")
    rows = q.join(n, SCOPE).filter((F.col("valid_from_unix_ms") <= F.col("as_of")) & F.array_contains("kinds", F.col("kind")))
    rows = _known(rows.drop("kinds"), sources).join(first, "node_id", "left")
    order = [F.col("valid_from_unix_ms").desc(), F.coalesce("first_event_id", F.lit(0)).desc(), F.col("node_id")]
    rows = rows.withColumn("node_order", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("node_order") <= limit)
    return rows.select("query_id", "node_id", "node_order")


def context(questions: DataFrame, nodes: DataFrame, sources: DataFrame, ledger: DataFrame, first: DataFrame) -> DataFrame:
    """One row for each question and node it may consult: text as known, tokens, counts, ``stale`` and ``lexical``."""
    seeds = seed_nodes(questions, nodes, sources, first)
    past = history(questions, nodes, sources, first)
    rows = past.join(seeds, ["query_id", "node_id"], "full").select("query_id", "node_id", F.coalesce(F.col("node_order"), F.lit(HISTORY) + F.col("seed_rank")).alias("node_order"))
    closing = ledger.select(F.col("id").alias("valid_to_event_id"), F.col("ingested_at_unix_ms").alias("closed_ingested"))
    facts = nodes.join(closing, "valid_to_event_id", "left").select(
        F.col("id").alias("node_id"), "kind", "text", "canonical_key", "created_at_unix_ms", "updated_at_unix_ms", "valid_from_unix_ms", "valid_to_unix_ms", "closed_ingested", "token_estimate", "observation_count"
    )
    rows = rows.join(questions.select("query_id", "as_of", "known_at", "q_terms", "modes", *SCOPE), "query_id").join(facts, "node_id")
    # what the sources known by then tell
    s = sources.select("node_id", "observed", "ingested", "event_id", "event_text")
    pairs = rows.select("query_id", "node_id", "as_of", "known_at").filter("known_at IS NOT NULL")
    told = pairs.join(s, "node_id").filter((F.col("observed") <= F.col("as_of")) & (F.col("ingested") <= F.col("known_at")))
    told = told.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("observed", "event_id", "event_text"))).alias("e"), F.count("*").cast("int").alias("told_n"), F.max("observed").alias("told_at"))
    told = told.withColumn("told_text", merge_texts(F.transform("e", lambda x: x["event_text"]))).drop("e")
    rows = rows.join(told, ["query_id", "node_id"], "left").filter(F.col("known_at").isNull() | (F.trim("told_text") != ""))
    fresh = F.col("known_at").isNotNull()
    pick = lambda new, old: F.when(fresh, new).otherwise(F.col(old))
    ended = F.col("valid_to_unix_ms").isNotNull() & (F.col("valid_to_unix_ms") <= F.col("as_of"))
    rows = rows.withColumn("stale", ended & F.when(fresh, F.coalesce(F.col("closed_ingested") <= F.col("known_at"), F.lit(False))).otherwise(F.lit(True)))
    rows = (
        rows.withColumn("updated_at_unix_ms", pick(F.greatest("created_at_unix_ms", "told_at"), "updated_at_unix_ms"))
        .withColumn("observation_count", pick(F.col("told_n"), "observation_count"))
        .withColumn("token_estimate", pick(estimate_tokens(F.col("told_text")), "token_estimate"))
        .withColumn("text", pick(F.col("told_text"), "text"))
    )
    return rows.withColumn("lexical", overlap(F.col("q_terms"), terms(F.col("text")))).drop("told_text", "told_n", "told_at", "created_at_unix_ms")


def seen_edges(ctx: DataFrame, edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """query_id, edge columns, weight times kind (``typed``) and ``ranking``: whether both ends are visible."""
    source = ledger.select(F.col("id").alias("source_event_id"), F.col("ingested_at_unix_ms").alias("source_ingested"))
    e = edges.select("id", "from_node_id", "to_node_id", "kind", "weight", F.col("created_at_unix_ms").alias("created"), "source_event_id").join(source, "source_event_id", "left")
    e = e.withColumnRenamed("kind", "edge_kind")
    a = ctx.select("query_id", F.col("node_id").alias("from_node_id"), F.col("stale").alias("from_stale"), "as_of", "known_at")
    b = ctx.select("query_id", F.col("node_id").alias("to_node_id"), F.col("stale").alias("to_stale"))
    rows = a.join(e, "from_node_id").join(b, ["query_id", "to_node_id"], "left")
    ordinary = (F.col("created") <= F.col("as_of")) & (F.col("known_at").isNull() | ((F.col("source_ingested") <= F.col("known_at")) & ~F.col("from_stale") & ~F.col("to_stale")))
    seen = F.when(F.col("edge_kind").isin(REVISION_KINDS), ~F.col("from_stale") & F.col("to_stale")).otherwise(ordinary)
    rows = rows.filter(F.coalesce(seen, F.lit(False)))
    ranking = F.coalesce(~F.col("from_stale") & ~F.col("to_stale"), F.lit(False))
    return rows.select("query_id", F.col("id").alias("edge_id"), "from_node_id", "to_node_id", "edge_kind", (F.col("weight") * kind_weight(F.col("edge_kind"))).alias("typed"), ranking.alias("ranking"))


def edge_strength(seen: DataFrame) -> DataFrame:
    """query_id, node_id, strength: the strongest edge out of a node, or 0.8 of the strongest into it."""
    ends = F.explode(F.array(F.struct(F.col("from_node_id").alias("n"), F.col("typed").alias("w")), F.struct(F.col("to_node_id").alias("n"), (F.col("typed") * 0.8).alias("w"))))
    return seen.select("query_id", ends.alias("x")).groupBy("query_id", F.col("x.n").alias("node_id")).agg(F.max("x.w").alias("strength"))


def _pagerank(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Personalized PageRank of one question's visible nodes; at most HISTORY + SEEDS of them."""
    nodes = nodes.sort_values("node_order", kind="stable")
    n = len(nodes)
    seed = np.where(nodes["lexical"] > 0, np.maximum(nodes["lexical"], 0.05), 0.0)
    if not seed.any():
        seed[:32] = 1.0 / max(n, 1)
    out = pd.DataFrame({"query_id": nodes["query_id"], "node_id": nodes["node_id"], "ppr": 0.0})
    if not n:
        return out
    seed = seed / seed.sum()
    at = pd.Series(np.arange(n), index=nodes["node_id"].to_numpy())
    f, t = at.reindex(edges["from_node_id"]).to_numpy(), at.reindex(edges["to_node_id"]).to_numpy()
    ok = ~(np.isnan(f) | np.isnan(t)) if len(f) else np.zeros(0, bool)
    f, t, w = f[ok].astype(int), t[ok].astype(int), edges["typed"].to_numpy(float)[ok]
    src, dst, wt = np.concatenate([f, t]), np.concatenate([t, f]), np.concatenate([w, w * BACKWARD])
    total = np.maximum(np.bincount(src, wt, n), 1e-4)
    share = wt / total[src]
    rank = seed
    for _ in range(STEPS):
        nxt = RESTART * seed + np.bincount(dst, DAMPING * rank[src] * share, n)
        rank = np.clip(nxt / nxt.sum(), 0.0, 1.0)
    out["ppr"] = rank
    return out


def pagerank(ctx: DataFrame, seen: DataFrame) -> DataFrame:
    """query_id, node_id, ppr. One task takes one question: its nodes are bounded by HISTORY."""
    nodes = ctx.filter("NOT stale").select("query_id", "node_id", "node_order", "lexical")
    edges = seen.filter("ranking").select("query_id", "from_node_id", "to_node_id", "typed")
    types = dict(nodes.dtypes)
    return nodes.groupBy("query_id").cogroup(edges.groupBy("query_id")).applyInPandas(_pagerank, f"query_id {types['query_id']}, node_id string, ppr double")


def scored(ctx: DataFrame, seen: DataFrame, blend: dict[str, float] = BLEND) -> DataFrame:
    """Evidence before the budget: visible nodes of an accepted kind with ppr, parts and score."""
    rows = ctx.filter("NOT stale").join(pagerank(ctx, seen), ["query_id", "node_id"], "left").join(edge_strength(seen), ["query_id", "node_id"], "left")
    rows = rows.withColumn("ppr", F.coalesce("ppr", F.lit(0.0))).withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    rows = rows.filter((F.col("kind") != "entity_cue") & accepted(F.col("modes"), F.col("kind")))
    rows = rows.filter((F.col("ppr") > 0.001) | (F.col("lexical") > 0.001) | (F.size("q_terms") == 0))
    rows = rows.withColumn("base", base_level(F.col("observation_count"), F.col("updated_at_unix_ms"), F.col("as_of"))).withColumn("fresh", freshness(F.col("updated_at_unix_ms"), F.col("as_of")))
    score = blend["ppr"] * F.greatest("ppr", F.col("lexical") * 0.65) + blend["base"] * F.col("base") + blend["edge"] * F.col("strength") + blend["fresh"] * F.col("fresh")
    return rows.withColumn("score", clamp(score)).filter("score > 0.02")


def within_budget(evidence: DataFrame, max_tokens: int = MAX_TOKENS, order: list[Column] | None = None) -> DataFrame:
    """query_id, node_id, place: greedy by score; what does not fit is skipped and smaller evidence still taken.

    A budget of B tokens takes at most B items, so the fold's state stays small.
    """
    item = F.struct((-F.round("score", 12)).alias("s"), F.col("node_order").alias("o"), F.col("token_estimate").alias("t"), F.col("node_id").alias("n"))
    lists = evidence.filter(F.col("token_estimate") <= max_tokens).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["t"] <= max_tokens
        return F.when(fits, F.struct((acc["used"] + x["t"]).alias("used"), F.array_append(acc["taken"], x["n"]).alias("taken"))).otherwise(acc)

    taken = F.aggregate("items", start, step, lambda acc: acc["taken"])
    return lists.select("query_id", F.posexplode(taken).alias("place", "node_id"))


def contradictions(seen: DataFrame, selected: DataFrame, ctx: DataFrame) -> DataFrame:
    """query_id, older_node_id, newer_node_id, summary of revisions that touch selected evidence."""
    rev = seen.filter(F.col("edge_kind").isin(REVISION_KINDS)).select("query_id", F.col("from_node_id").alias("newer_node_id"), F.col("to_node_id").alias("older_node_id")).distinct()
    pick = selected.select("query_id", "node_id")
    touched = rev.join(pick.withColumnRenamed("node_id", "newer_node_id"), ["query_id", "newer_node_id"], "left_semi").unionByName(rev.join(pick.withColumnRenamed("node_id", "older_node_id"), ["query_id", "older_node_id"], "left_semi")).distinct()
    texts = ctx.select("query_id", "node_id", "text")
    rows = touched.join(texts.withColumnsRenamed({"node_id": "newer_node_id", "text": "newer"}), ["query_id", "newer_node_id"]).join(texts.withColumnsRenamed({"node_id": "older_node_id", "text": "older"}), ["query_id", "older_node_id"])
    return rows.select("query_id", "older_node_id", "newer_node_id", F.concat(concise(F.col("newer"), 120), F.lit(" conflicts with "), concise(F.col("older"), 120)).alias("summary"))


def stale_assumptions(ctx: DataFrame, contradicted: DataFrame) -> DataFrame:
    """query_id, node_id, summary, invalidated_at: contradicted nodes, and closed ones that match a question and have no visible successor."""
    old = contradicted.select("query_id", F.col("older_node_id").alias("node_id")).distinct()
    family = F.substring_index("canonical_key", "|rev:", 1)
    rows = ctx.withColumn("family", family)
    closed = rows.filter("stale")
    nxt = rows.filter("NOT stale").select("query_id", F.col("kind").alias("k2"), F.col("family").alias("f2"), F.col("valid_from_unix_ms").alias("from2"), F.col("node_id").alias("n2"))
    asked = closed.filter((F.col("kind") != "entity_cue") & accepted(F.col("modes"), F.col("kind")) & (F.col("lexical") > 0.001))
    on = (asked["query_id"] == nxt["query_id"]) & (asked["kind"] == nxt["k2"]) & (asked["family"] == nxt["f2"]) & (nxt["from2"] >= asked["valid_to_unix_ms"]) & (nxt["n2"] != asked["node_id"])
    lone = asked.join(nxt, on, "left_anti")
    both = closed.join(old, ["query_id", "node_id"], "left_semi").unionByName(lone).dropDuplicates(["query_id", "node_id"])
    return both.select("query_id", "node_id", concise(F.col("text"), 180).alias("summary"), F.col("valid_to_unix_ms").alias("invalidated_at_unix_ms"))


def escalation(questions: DataFrame, picked: DataFrame) -> DataFrame:
    """query_id, escalation: why automatic reconstruction would start; null if it would not. picked: selected evidence with score."""
    top = picked.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"))
    rows = questions.select("query_id", "question").join(top, "query_id", "left")
    first, second = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    reason = (
        F.when(F.col("s").isNull(), "empty_evidence").when(first < 0.18, "low_confidence").when((second > 0) & (first - second < 0.03), "ambiguous_evidence")
        .when(contains_any(ascii_lower(F.col("question")), COMPOSITIONAL), "compositional_query")
    )
    return rows.select("query_id", reason.alias("escalation"))


def suggested(questions: DataFrame, picked: DataFrame) -> DataFrame:
    """query_id, suggestions: up to three follow-up questions from the question's terms, then the evidence's. picked: place, text."""
    lists = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("e"))
    rows = questions.select("query_id", "question").join(lists, "query_id", "left")
    more = F.flatten(F.transform(F.coalesce("e", F.array().cast("array<struct<place:int,text:string>>")), lambda x: top_terms(x["text"], 2)))
    found = F.slice(F.array_distinct(F.concat(top_terms(F.col("question"), 3), more)), 1, 3)
    return rows.select("query_id", F.transform(found, lambda t: F.concat(F.lit("what should I remember about "), t, F.lit("?"))).alias("suggestions"))


def answers(questions: DataFrame, picked: DataFrame, contradicted: DataFrame) -> DataFrame:
    """query_id, answer: the first eight pieces of evidence as lines, and a warning if premises were revised."""
    line = F.concat(F.lit("- ["), F.col("kind"), F.lit(" score "), F.format_string("%.2f", F.col("score")), F.lit("] "), concise(F.col("text"), 260))
    lists = picked.filter("place < 8").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    warned = contradicted.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = questions.select("query_id").join(lists, "query_id", "left").join(warned, "query_id", "left")
    warning = F.when(F.col("n") > 0, F.array(F.concat(F.lit("Warning: "), F.col("n").cast("string"), F.lit(" contradiction(s) or superseded premise(s) were surfaced.")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.lit("Relevant memory:")), F.transform("l", lambda x: x["line"]), warning), "\n")
    return rows.select("query_id", F.when(F.col("l").isNull(), "No matching memory was found for this scope.").otherwise(text).alias("answer"))



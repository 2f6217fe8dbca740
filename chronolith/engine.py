"""The memory engine: remember, import, project, ask, keep house.

A thin layer over the operators: it validates requests, keeps a store directory and turns plans into answers.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolith.functions.classify import KINDS, MODES
from chronolith.operators import bitemporal as B, fold as W, maintenance as M, retrieve as R
from chronolith.operators.reconstruct import MAX_STEPS, MAX_TOKENS, Policy, best_candidate, reconstruct
from chronolith.runtime import materialize
from chronolith.sources import ledger as L, spans as S
from chronolith.store import Store


#: The report of a projection: counters of the fold and their names.
REPORT = {
    "seen": "events_seen", "projected": "events_projected", "skipped": "events_skipped", "source_tokens": "source_token_estimate", "projected_tokens": "projected_memory_token_estimate", "touched": "stored_memories_touched",
    "outputs": "distillation_outputs", **{c: f"distillation_{c}" for c in ("provider_calls", "provider_errors", "schema_errors", "repair_attempts", "repair_successes", "rejections")}, "replayed": "distillation_replayed_batches",
    "input_tokens": "distillation_input_tokens", "output_tokens": "distillation_output_tokens", "elapsed_ms": "distillation_elapsed_ms",
    **{c: f"memories_{c}" for c in ("added", "updated", "invalidated", "nooped")}, "edges": "edges_added",
}


class InvalidInput(ValueError):
    """A request that breaks the contract."""


def _identifier(name: str, value: str | None) -> None:
    if value is None or not value.strip():
        raise InvalidInput(f"{name} must not be empty")
    if value != value.strip():
        raise InvalidInput(f"{name} must not have leading or trailing whitespace")


@dataclass
class Query:
    question: str
    tenant_id: str = "local"
    project_id: str = "default"
    environment_id: str | None = None
    as_of_unix_ms: int | None = None
    known_at_unix_ms: int | None = None
    max_tokens: int = R.MAX_TOKENS
    modes: list[str] | None = None
    require_fresh: bool = False
    reconstruction: str = "off"
    max_steps: int = MAX_STEPS
    max_reconstruction_tokens: int = MAX_TOKENS

    def validate(self) -> None:
        _identifier("tenant_id", self.tenant_id)
        _identifier("project_id", self.project_id)
        if self.environment_id is not None:
            _identifier("environment_id", self.environment_id)
        if not self.question.strip():
            raise InvalidInput("question must not be empty")
        for name in ("as_of_unix_ms", "known_at_unix_ms"):
            if (getattr(self, name) or 0) < 0:
                raise InvalidInput(f"{name} must be non-negative")
        for name in ("max_tokens", "max_steps", "max_reconstruction_tokens"):
            if getattr(self, name) <= 0:
                raise InvalidInput(f"{name} must be greater than 0")
        if self.modes is not None and (not self.modes or set(self.modes) - set(MODES)):
            raise InvalidInput(f"modes must be some of {', '.join(MODES)}")
        if self.reconstruction not in ("off", "auto", "force"):
            raise InvalidInput("reconstruction must be off, auto or force")


@dataclass
class Answer:
    answer: str
    evidence: list[dict[str, Any]] = field(default_factory=list)
    cited_spans: list[dict[str, Any]] = field(default_factory=list)
    contradictions: list[dict[str, Any]] = field(default_factory=list)
    stale_assumptions: list[dict[str, Any]] = field(default_factory=list)
    suggested_next_queries: list[str] = field(default_factory=list)
    token_estimate: int = 0
    tier_used: str = "activation"
    routing: dict[str, Any] = field(default_factory=dict)
    reconstruction: dict[str, Any] | None = None


class Graph:
    """The tables a read needs."""

    def __init__(self, ledger: DataFrame, nodes: DataFrame, edges: DataFrame, spans: DataFrame):
        self.ledger, self.nodes, self.edges, self.spans = ledger, nodes, edges, spans
        self.sources = B.node_events(spans, ledger)
        self.first = B.first_events(self.sources)

    def retrieve(self, questions: DataFrame, max_tokens: int, blend: dict[str, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Context, seen edges and selected evidence of prepared questions."""
        ctx = materialize(R.context(questions, self.nodes, self.sources, self.ledger, self.first), "context")
        seen = materialize(R.seen_edges(ctx, self.edges, self.ledger), "edges")
        scored = materialize(R.scored(ctx, seen, blend).select("query_id", "node_id", "node_order", "kind", "text", "score", "token_estimate"), "scored")
        picked = materialize(R.within_budget(scored, max_tokens).join(scored, ["query_id", "node_id"]), "picked")
        return ctx, seen, picked


class MemoryEngine:
    def __init__(self, spark: SparkSession, root: str, blend: dict[str, float] | None = None, policy: Policy = best_candidate, distiller=None):
        self.spark, self.store, self.blend, self.policy = spark, Store(spark, root), blend or R.BLEND, policy
        self.distiller = distiller  # None: by markers; see operators.fold.provider_distiller

    # -- writing ------------------------------------------------------------------------
    def append(self, events: DataFrame) -> dict[str, int]:
        """Append events that are new; refuses the batch if one is invalid."""
        events = L.validated(events.select([F.col(c) if c in events.columns else F.lit(None).alias(c) for c in self.store.read("ledger").columns if c != "id"]))
        bad = events.filter("rejected IS NOT NULL").select("rejected").first()
        if bad is not None:
            raise InvalidInput(bad["rejected"])
        seen = events.count()
        start = self.store.manifest["next_id"]
        numbered = events.drop("rejected").withColumn("id", F.monotonically_increasing_id())
        new = L.append(self.store.read("ledger"), numbered)
        ranked = materialize(new.select("id", *[c for c in new.columns if c != "id"]), "append")
        # arrival numbers without a global sort: offsets of the partitions' counts, whose number is that of tasks
        block = F.shiftright("id", 33)
        sizes = {r["b"]: r["n"] for r in ranked.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect()}
        offset, at = {}, start
        for b in sorted(sizes):
            offset[b], at = at, at + sizes[b]
        if not sizes:
            return {"rows_seen": seen, "events_inserted": 0, "events_duplicate": seen}
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy(block).orderBy("id")) - 1
        base = F.element_at(F.create_map(*[x for b, o in offset.items() for x in (F.lit(b), F.lit(o))]), block)
        rows = ranked.withColumn("id", (base + place).cast("long"))
        self.store.write(ledger=rows.selectExpr(*[f"cast({c.split()[0]} AS {c.split()[1]})" for c in L.LEDGER_SCHEMA.split(", ")]))
        self.store.publish(next_id=at)
        return {"rows_seen": seen, "events_inserted": at - start, "events_duplicate": seen - (at - start)}

    def remember(self, text: str, kind: str = "fact", tenant_id: str = "local", project_id: str = "default", environment_id: str | None = None, now_unix_ms: int | None = None, idempotency_key: str | None = None) -> dict[str, int]:
        if kind not in KINDS:
            raise InvalidInput(f"unknown memory kind {kind!r}")
        now = now_unix_ms if now_unix_ms is not None else int(time.time() * 1000)
        row = self.spark.createDataFrame([(tenant_id, project_id, environment_id, kind, text, now)], "tenant_id string, project_id string, environment_id string, kind string, text string, now_unix_ms long")
        event = L.direct_write(row)
        return self.append(event if idempotency_key is None else L.with_idempotency_key(event, F.lit(idempotency_key)))

    def import_jsonl(self, path: str, now_unix_ms: int | None = None, **given: str) -> dict[str, int]:
        now = now_unix_ms if now_unix_ms is not None else int(time.time() * 1000)
        return self.append(S.import_jsonl(self.spark, path, now, **given))

    def import_journal(self, path: str, tenant_id: str, project_id: str, environment_id: str | None = None, now_unix_ms: int | None = None) -> dict[str, int]:
        runs, steps = S.read_journal(self.spark, path)
        now = now_unix_ms if now_unix_ms is not None else int(time.time() * 1000)
        events = S.journal_events(runs, steps, tenant_id, project_id, environment_id, now).orderBy("created_at", "seq")
        out = self.append(events)
        seen = steps.join(runs, steps.run_id == runs.id, "left_semi").count()
        return out | {"rows_seen": seen, "rows_skipped": seen - out["rows_seen"]}

    # -- projection ------------------------------------------------------------------------
    def ledger(self) -> DataFrame:
        """The ledger with the mark of every event that was projected."""
        marks = L.latest_marks(self.store.read("projected"))
        return self.store.read("ledger").drop("projected_at_unix_ms").join(marks, "id", "left").select(*[c.split()[0] for c in L.LEDGER_SCHEMA.split(", ")])

    @property
    def _replay(self) -> tuple[str, str] | None:
        """Kind and fingerprint of a distiller whose accepted output is kept."""
        fingerprint = getattr(self.distiller, "fingerprint", None)
        return (self.distiller.kind, fingerprint) if fingerprint is not None else None

    def project(self, clock_unix_ms: int | None = None, limit: int | None = None) -> dict[str, int]:
        """Fold pending events, at most ``limit`` in order of observation and arrival, and publish the graph, the marks and the batches together.

        The scopes that they touch are folded again from all that is or becomes projected there; events whose memories are kept are replayed from
        them, so a provider is asked once for each event.  Returns the report: the sums of what the new events did.
        """
        return self._project(clock_unix_ms, self.ledger(), limit)

    manage = project

    def _project(self, clock_unix_ms: int | None, ledger: DataFrame, limit: int | None, afresh: bool = False) -> dict[str, int]:
        clock = clock_unix_ms if clock_unix_ms is not None else int(time.time() * 1000)
        if afresh:
            ledger = ledger.withColumn("projected_at_unix_ms", F.lit(None).cast("long"))
        fresh = materialize(L.pending(ledger, limit) if limit is not None else ledger.filter("projected_at_unix_ms IS NULL"), "pending")
        if fresh.isEmpty():
            return dict.fromkeys(REPORT.values(), 0)
        scope = ["tenant_id", "project_id", "env"]
        touched = materialize(R.with_scope(fresh).select(*scope).distinct(), "touched")
        there = ledger.filter("projected_at_unix_ms IS NOT NULL")
        mine = R.with_scope(there).join(touched, scope, "left_semi").drop("env").unionByName(fresh)
        distiller = self.distiller
        if self._replay is not None:
            kept = L.batches_of(self.store.read("batches"), *self._replay).withColumnRenamed("ledger_event_id", "id")
            mine = mine.join(kept, "id", "left")
            distiller = W.stored_only if afresh else distiller
        folded = materialize(W.fold(mine, distiller), "fold")
        did = W.fold_events(folded).join(fresh.select(F.col("id").alias("event_id")), "event_id", "left_semi")
        report = did.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in REPORT.items()]).first().asDict()
        old = lambda t: self.store.read(t) if not afresh else self.store.read(t).filter("false")
        kept_rows = lambda t: R.with_scope(old(t)).join(touched, scope, "left_anti").drop("env")
        nodes = W.fold_nodes(folded).withColumn("created_at_unix_ms", F.lit(clock).cast("long")).withColumn("updated_at_unix_ms", F.lit(clock).cast("long"))
        edges = W.fold_edges(folded).withColumn("id", F.xxhash64("from_node_id", "to_node_id", "kind"))
        spans = old("spans").join(kept_rows("nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi")
        order = lambda df, t: df.select(*self.store.read(t).columns)
        tables = {
            "nodes": order(nodes, "nodes").unionByName(order(kept_rows("nodes"), "nodes")), "edges": order(edges, "edges").unionByName(order(kept_rows("edges"), "edges")),
            "spans": order(W.fold_spans(folded), "spans").unionByName(order(spans, "spans")),
            "projected": did.filter("projected = 1").select(F.col("event_id").alias("ledger_event_id"), F.lit(clock).cast("long").alias("projected_at_unix_ms")),
        }
        if self._replay is not None and not afresh:
            kind, fingerprint = self._replay
            tables["batches"] = did.filter("memories IS NOT NULL").select(
                F.col("event_id").alias("id"), F.col("event_id").alias("ledger_event_id"), F.lit(kind).alias("distiller_kind"), F.lit(fingerprint).alias("distiller_fingerprint"), "memories", F.lit(clock).cast("long").alias("created_at_unix_ms")
            )
        self.store.write(replace={"nodes", "edges", "spans"} | ({"projected"} if afresh else set()), **tables)
        return report

    def rebuild(self, clock_unix_ms: int | None = None, limit: int | None = None) -> dict[str, int]:
        """Fold the ledger again from nothing and publish the new graph in one step.

        With a provider whose batches are kept nobody is asked: the batches are replayed, and all projected events must have one.
        """
        ledger = self.ledger()
        if self._replay is not None:
            missing = L.missing_batches(ledger, self.store.read("batches"), *self._replay).count()
            if missing:
                raise InvalidInput(f"a rebuild needs the stored batch of every projected event; {missing} are missing")
        return self._project(clock_unix_ms, ledger, limit, afresh=True)

    # -- reading ------------------------------------------------------------------------
    def graph(self) -> Graph:
        return Graph(self.store.read("ledger"), self.store.read("nodes"), self.store.read("edges"), self.store.read("spans"))

    def ask(self, query: Query) -> Answer:
        query.validate()
        as_of = query.as_of_unix_ms if query.as_of_unix_ms is not None else int(time.time() * 1000)
        schema = "query_id long, tenant_id string, project_id string, environment_id string, question string, as_of long, known_at long"
        asked = self.spark.createDataFrame([(0, query.tenant_id, query.project_id, query.environment_id, query.question, as_of, query.known_at_unix_ms)], schema)
        graph = self.graph()
        routed = R.prepared(asked, query.modes)
        allowed = list(dict.fromkeys(query.modes or MODES))
        everything = routed.withColumn("modes", F.array(*map(F.lit, allowed))).withColumn("kinds", R.kinds_for(F.array(*map(F.lit, allowed))))
        head = routed.select("modes", "reason", "confidence").first()
        routing = {"allowed_modes": allowed, "routed_modes": head["modes"], "reason": head["reason"], "confidence": head["confidence"], "reconstruction_modes": None}
        ctx, seen, picked = graph.retrieve(routed, query.max_tokens, self.blend)
        rows = [r.asDict() for r in picked.orderBy("place").collect()]  # at most max_tokens rows
        questions = routed
        if not rows and routing["routed_modes"] != allowed:
            routing |= {"routed_modes": allowed, "reason": "empty_route_fallback", "confidence": 0.0}
            questions = everything
            ctx, seen, picked = graph.retrieve(everything, query.max_tokens, self.blend)
            rows = [r.asDict() for r in picked.orderBy("place").collect()]
        reason = {"off": None, "force": "forced"}.get(query.reconstruction, "auto")
        if reason == "auto":
            reason = R.escalation(questions, picked).first()["escalation"]
        walked = None
        if reason is not None:
            if routing["routed_modes"] != allowed:
                ctx, seen, _ = graph.retrieve(everything, query.max_tokens, self.blend)
                questions = everything
            routing["reconstruction_modes"] = allowed
            found = reconstruct(questions, ctx, seen, picked, self.policy, query.max_steps, query.max_reconstruction_tokens).first()
            walked = {"mode": query.reconstruction, "reason": reason, "steps_used": 0, "tokens_spent": 0, "expanded": [], "accepted": [], "pruned": []} | ({k: v for k, v in found.asDict().items() if k != "query_id"} if found else {})
            if walked["accepted"]:
                more = {r["node_id"]: r.asDict() for r in ctx.filter(F.col("node_id").isin(walked["accepted"])).select("node_id", "kind", "text", "token_estimate").collect()}
                rows += [more[a] | {"score": s} for a, s in zip(walked["accepted"], walked["accepted_scores"]) if a in more]
            used, fit = 0, []
            for r in sorted(rows, key=lambda r: -r["score"]):
                if used + r["token_estimate"] <= query.max_tokens:
                    used += r["token_estimate"]
                    fit.append(r)
            rows = fit
        evidence = [{k: r[k] for k in ("node_id", "kind", "text", "score", "token_estimate")} for r in rows]
        schema = "query_id long, node_id string, place int, kind string, text string, score double, token_estimate int"
        chosen = self.spark.createDataFrame([(0, r["node_id"], i, r["kind"], r["text"], float(r["score"]), r["token_estimate"]) for i, r in enumerate(rows)], schema)
        contra = R.contradictions(seen, chosen, ctx)
        spans = B.cited_spans(graph.spans.filter(F.col("node_id").isin([r["node_id"] for r in rows])), graph.ledger, as_of, query.known_at_unix_ms).collect() if rows else []
        cited = {":".join(map(str, (s["tenant_id"], s["project_id"], s["trace_id"], s["span_id"], s["seq"]))): {k: s[k] for k in L.EXACT_KEY} for s in spans}
        for e in evidence:
            e["cited_spans"] = [{k: s[k] for k in L.EXACT_KEY} for s in sorted(spans, key=lambda s: s["seq"]) if s["node_id"] == e["node_id"]]
        text = R.answers(questions, chosen, contra).first()["answer"]
        strip = lambda df: [{k: v for k, v in r.asDict().items() if k != "query_id"} for r in df.collect()]
        return Answer(
            answer=text, evidence=evidence, cited_spans=[cited[k] for k in sorted(cited)], contradictions=sorted(strip(contra), key=lambda c: c["older_node_id"]),
            stale_assumptions=sorted(strip(R.stale_assumptions(ctx, contra)), key=lambda s: s["node_id"]), suggested_next_queries=R.suggested(questions, chosen).first()["suggestions"],
            token_estimate=W.tokens(text) + sum(e["token_estimate"] for e in evidence), tier_used="active_reconstruction" if walked else "activation", routing=routing, reconstruction=walked,
        )

    # -- housekeeping ------------------------------------------------------------------------
    def stats(self, now_unix_ms: int | None = None) -> dict[str, int]:
        now = now_unix_ms if now_unix_ms is not None else int(time.time() * 1000)
        counts = M.stats(self.ledger(), self.store.read("nodes"), self.store.read("edges"), now, self.store.read("audit")).collect()
        row = {r["metric"]: r["value"] for r in counts}
        return row

    def health(self) -> dict:
        return self.store.health()

    def audit(self, actor: str, action: str, outcome: str, route: str | None = None, status_code: int | None = None, detail: str = "{}", now_unix_ms: int | None = None) -> None:
        for name, value in (("actor", actor), ("action", action), ("outcome", outcome)):
            _identifier(name, value)
        now = now_unix_ms if now_unix_ms is not None else int(time.time() * 1000)
        next_id = self.store.manifest.get("next_audit_id", 1)
        self.store.write(audit=self.spark.createDataFrame([(next_id, now, actor, action, outcome, route, status_code, detail)], M.AUDIT_SCHEMA))
        self.store.publish(next_audit_id=next_id + 1)

    def maintenance(self, repair_orphans: bool = False, compact: bool = False, prune_audit_before_unix_ms: int | None = None, retain_latest_audit_events: int | None = None) -> dict:
        before = self.health()["integrity"]
        audit_before = self.store.read("audit").count()
        if repair_orphans:
            nodes = self.store.read("nodes")
            edges, spans, _ = M.without_orphans(nodes, self.store.read("edges"), self.store.read("spans"), R.cue_index(nodes))
            self.store.write(replace=True, edges=edges.select(*self.store.read("edges").columns), spans=spans.select(*self.store.read("spans").columns))
        if prune_audit_before_unix_ms is not None or retain_latest_audit_events is not None:
            self.store.write(replace=True, audit=M.audit_pruned(self.store.read("audit"), prune_audit_before_unix_ms, retain_latest_audit_events))
        if compact:
            for t in list(self.store.manifest["parts"]):
                self.store.compact(t)
        return {"integrity_before": before, "integrity_after": self.health()["integrity"], "audit_events_removed": audit_before - self.store.read("audit").count(), "compacted": compact}

"""What kind of memory a text is, what it does to earlier ones, and which stores a question needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

MODES = ["semantic", "episodic", "procedural", "gotcha", "state"]
KINDS = ["episode", "fact", "entity_cue", "tag", "procedure", "state", "gotcha", "anti_memory", "topic"]

# Which kinds a mode accepts, and which it looks up.
ACCEPTS = {"semantic": ["fact", "entity_cue", "tag", "topic"], "episodic": ["episode"], "procedural": ["procedure"], "gotcha": ["gotcha", "anti_memory"], "state": ["state"]}
LOOKS_UP = {"semantic": ["fact", "tag", "topic"], "episodic": ["episode"], "procedural": ["procedure"], "gotcha": ["gotcha", "anti_memory"], "state": ["state"]}

# Declared names of a kind.
DECLARED = {
    "fact": ["fact", "semantic"],
    "episode": ["episode", "episodic"],
    "procedure": ["procedure", "runbook", "workflow"],
    "state": ["state"],
    "gotcha": ["gotcha", "failure"],
    "anti_memory": ["anti_memory", "anti-memory"],
}
# Markers of a kind, first group that occurs.
KIND_MARKERS = [
    ("anti_memory", ["do not use", "looked relevant", "misleading", "red herring"]),
    ("gotcha", ["error", "failed", "failure", "panic", "regression", "gotcha", "blocked"]),
    ("procedure", ["run ", "command", "step", "fix by", "workaround", "procedure"]),
    ("state", ["current ", "configured", "environment", "state", "uses "]),
]
# Markers of a revision.
OP_MARKERS = [
    ("invalidate", ["no longer", "deprecated", "invalidated", "stale", "not true", "replace ", "instead of", "do not use"]),
    ("update", ["update", "changed", "now ", "new "]),
]
# Markers of what a question is after, with its modes, reason and confidence.
ROUTES = [
    (["current", "state", "config", "setting", "environment", "now"], ["state"], "state_intent", 0.85),
    (["fix", "failure", "fails", "error", "bug", "gotcha", "blocked", "broken"], ["gotcha", "procedural"], "gotcha_intent", 0.75),
    (["procedure", "runbook", "workflow", "steps", "step-by-step", "how to"], ["procedural"], "procedural_intent", 0.85),
    (["when", "timeline", "history", "episode", "trace", "span", "happened"], ["episodic", "semantic"], "episodic_intent", 0.75),
    (["what", "which", "where", "who", "fact", "token", "remember about"], ["semantic"], "semantic_intent", 0.65),
]
# Markers of a question that joins several memories.
COMPOSITIONAL = ["because", "caused", "connected", "depends", "related", "why", "what led", "after", "before", "chain", "path", "multi-hop"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def contains_any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def memory_kind(name: Column, text: Column) -> Column:
    """The declared kind, else the first marker group that occurs, else a fact."""
    declared, lower = ascii_lower(name), ascii_lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for kind, names in DECLARED.items():
        out = out.when(declared.isin(names), kind)
    for kind, markers in KIND_MARKERS:
        out = out.when(contains_any(lower, markers), kind)
    return out.otherwise("fact")


def revision_op(text: Column) -> Column:
    lower = ascii_lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for op, markers in OP_MARKERS:
        out = out.when(contains_any(lower, markers), op)
    return out.otherwise("add")


# Spellings of a kind that imports allow.
KIND_ALIASES = {"semantic": "fact", "episodic": "episode", "runbook": "procedure", "workflow": "procedure", "failure": "gotcha", "entity": "entity_cue", "cue": "entity_cue", "procedural": "procedure", "antimemory": "anti_memory", "anti-memory": "anti_memory"}


def parse_kind(value: Column) -> Column:
    """A kind from the spellings that imports allow; null if it is none."""
    v = ascii_lower(F.btrim(value))
    out = F.when(v.isin(KINDS), v)
    for spelled, kind in KIND_ALIASES.items():
        out = out.when(v == spelled, kind)
    return out


def route(question: Column, allowed: list[str] | None = None) -> Column:
    """struct<modes, reason, confidence>. Modes that are given are taken as they are, all of them too; only a question without modes is routed."""
    chosen = list(dict.fromkeys(allowed or MODES))
    result = lambda modes, reason, confidence: F.struct(modes.alias("modes"), reason.alias("reason"), confidence.alias("confidence"))
    everything = F.array(*map(F.lit, chosen))
    if allowed is not None:
        return result(everything, F.lit("ambiguous_fallback"), F.lit(0.2))
    lower = ascii_lower(question)
    hits = [contains_any(lower, markers) for markers, *_ in ROUTES]
    none = F.array().cast("array<string>")
    modes = F.array_distinct(F.concat(*[F.when(hit, F.array(*map(F.lit, m))).otherwise(none) for hit, (_, m, *_) in zip(hits, ROUTES)]))
    n = sum((F.when(h, 1).otherwise(0) for h in hits), F.lit(0))
    reason, confidence = F.when(n != 1, "ambiguous_fallback"), F.when(n == 0, 0.2).when(n > 1, 0.55)
    for hit, (_, _, r, c) in zip(hits, ROUTES):
        reason, confidence = reason.when(hit, r), confidence.when(hit, c)
    return result(F.when(n == 0, everything).otherwise(modes), reason, confidence)


def kinds_for(modes: Column) -> Column:
    """The node kinds that a question's modes look up, entity cues first."""
    pick = [F.when(F.array_contains(modes, m), F.array(*map(F.lit, LOOKS_UP[m]))).otherwise(F.array().cast("array<string>")) for m in MODES]
    return F.array_distinct(F.concat(F.array(F.lit("entity_cue")), *pick))


def accepted(modes: Column, kind: Column) -> Column:
    """Whether a kind may be evidence under the modes."""
    return reduce(lambda a, b: a | b, [F.array_contains(modes, m) & kind.isin(ACCEPTS[m]) for m in MODES])

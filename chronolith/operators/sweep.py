"""Projection with revisions by markers alone: the fold of ``operators.fold`` in one sweep over the events of each scope.

The graph is the one that ``fold`` makes of the same events without a distiller; here it costs about the same for each event, however large the scope:
events arrive sorted and are read batch by batch, a node is written when it is closed and the rest at the end of the scope, and what is kept is what a later event can see.

* Neighbours are asked for only by events that revise.  The index has a list for each term and weight, in order of time; it is read from its end, where closed nodes are dropped as they are met.
* Of a cue only the latest version is open, so cues are no part of the index: the one of a term is merged into its heaviest list.
* Identifiers break ties only between nodes of one event and are computed there; those of rows are computed by whole batches.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronolith.functions.classify import DECLARED, KIND_MARKERS, OP_MARKERS
from chronolith.functions.text import fnv1a64_ids
from chronolith.operators.fold import _ASCII_LOWER, _OTHER, _STOP, INVALIDATE_OVERLAP, NEIGHBOURS, TARGETS, UPDATE_OVERLAP, clip, fnv, fnv_state, normalize, tokens
from chronolith.operators.project import BODY_LIMIT, CUES
from chronolith.operators.retrieve import CUE_TERMS

#: Rows that are written at once; words that are remembered.
BATCH, WORDS = 20_000, 200_000
EDGE_KINDS = ["mentions", "derived_from", "observed_in", "supersedes", "contradicts"]
EDGE_WEIGHTS = [0.55, 0.8, 0.9, 1.0, 0.8]
_MENTIONS, _DERIVED, _OBSERVED, _SUPERSEDES, _CONTRADICTS = range(5)
EVENT = ["tenant_id", "project_id", "env", "environment_id", "id", "observed_at_unix_ms", "trace_id", "span_id", "seq", "span_kind", "name", "text"]
PLACE = "tenant_id string, project_id string, environment_id string, "
NODES = "id string, " + PLACE + "kind string, text string, canonical_key string, valid_from_unix_ms long, valid_to_unix_ms long, valid_to_event_id long, confidence double, token_estimate int, observation_count int"
EDGES = PLACE + "from_node_id string, to_node_id string, kind string, weight double, created_at_unix_ms long, source_event_id long"


def _classes() -> list[int]:
    """The weight class of each place among the cue terms of a text: weights fall to a floor, from which on all are equal."""
    out, weight = [0], 1.0
    while len(out) < CUE_TERMS:
        lower = max(weight * 0.97, 0.2)
        out.append(out[-1] + (lower < weight))
        weight = lower
    return out


CLASS = _classes()


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= WORDS:
            self.clear()
        out = self[key] = self.make(key)
        return out


def _term(raw: str) -> str:
    t = raw.strip(".-/")
    return t if len(t) >= 3 and t not in _STOP and not t.isdigit() else ""


_TERM = _Remembered(_term)
_RANK = _Remembered(lambda t: (-(len(t) + 4 * ("." in t) + 4 * ("/" in t) + 2 * ("_" in t) + 2 * ("-" in t)), t))
_NAMED = _Remembered(lambda name: next((kind for kind, names in DECLARED.items() if name.translate(_ASCII_LOWER) in names), None))
_HEAD = _Remembered(lambda key: (head := f"{key[0]} {key[1]}: ", frozenset(_terms(head))))


def _terms(text: str) -> set[str]:
    found = {_TERM[w] for w in _OTHER.sub(" ", text).lower().split()}
    found.discard("")
    return found


def _marked(groups: list, text: str, other: str) -> str:
    for what, marks in groups:
        for m in marks:
            if m in text:
                return what
    return other


class _Node:
    """A version of an episode or of a typed memory; its text is ``head + body``."""

    __slots__ = ("kind", "head", "body", "family", "at", "event", "later", "to", "by", "seen", "words", "id")

    def __init__(self, kind, head, body, family, at, event, later, words):
        self.kind, self.head, self.body, self.family, self.at, self.event, self.later, self.words = kind, head, body, family, at, event, later, words
        self.to = self.by = self.id = None
        self.seen = 1

    @property
    def key(self) -> str:
        if self.kind == "episode":
            return self.family
        return f"{self.family}|rev:{self.at}:event:{self.event}" if self.later else f"{self.family}|rev:{self.at}"

    def overlap(self, said: set[str]) -> float:
        words = self.words
        if words is None:  # an episode's are rarely asked for
            words = self.words = tuple(_terms(self.head + self.body))
        both = len(said.intersection(words))
        return both / (len(said) + len(words) - both) if said and words else 0.0


class _Cue:
    """The latest version of an entity cue."""

    __slots__ = ("word", "at", "event", "seen", "id")
    kind = "entity_cue"

    def __init__(self, word, at, event):
        self.word, self.at, self.event, self.seen, self.id = word, at, event, 1, None

    @property
    def key(self) -> str:
        return f"entity_cue:{self.word}|rev:{self.at}"


class NodeRows:
    """Nodes on their way out."""

    def __init__(self):
        self.rows: list[tuple] = []

    def __len__(self):
        return len(self.rows)

    def flush(self) -> pa.RecordBatch:
        place, kind, text, key, at, to, by, seen = zip(*self.rows)
        self.rows = []
        many = {n: round(min(0.65 + 0.05 * (n - 1), 1.0), 6) for n in set(seen)}
        return pa.RecordBatch.from_arrays([
            pa.array(fnv1a64_ids("node_", [p.seeds[k] for p, k in zip(place, kind)], key)), *_places(place), pa.array(kind, pa.string()), pa.array(text, pa.string()), pa.array(key, pa.string()),
            pa.array(at, pa.int64()), pa.array(to, pa.int64()), pa.array(by, pa.int64()), pa.array([many[n] for n in seen], pa.float64()),
            pa.array([-(-len(t) // 4) if k == "entity_cue" else tokens(t) for k, t in zip(kind, text)], pa.int32()), pa.array(seen, pa.int32()),
        ], [c.split(" ")[0] for c in NODES.split(", ")])


class EdgeRows:
    """Edges on their way out, between places in a list of the nodes they join."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.keys: list[str] = []
        self.seeds: list[int] = []

    def __len__(self):
        return len(self.rows)

    def end(self, place: _Place, kind: str, key: str) -> int:
        self.keys.append(key)
        self.seeds.append(place.seeds[kind])
        return len(self.keys) - 1

    def flush(self) -> pa.RecordBatch:
        place, a, b, kind, at, event = zip(*self.rows)
        ids = fnv1a64_ids("node_", self.seeds, self.keys)
        self.rows, self.keys, self.seeds = [], [], []
        return pa.RecordBatch.from_arrays([
            *_places(place), ids.take(pa.array(a, pa.int32())), ids.take(pa.array(b, pa.int32())), pa.array(EDGE_KINDS, pa.string()).take(pa.array(kind, pa.int8())),
            pa.array(np.array(EDGE_WEIGHTS)[list(kind)]), pa.array(at, pa.int64()), pa.array(event, pa.int64()),
        ], [c.split(" ")[0] for c in EDGES.split(", ")])


class _Place:
    """tenant, project and environment of a scope, and what the identifiers of its nodes begin with."""

    __slots__ = ("names", "environment_id", "seeds")

    def __init__(self, names: tuple[str, str, str], environment_id: str | None):
        self.names, self.environment_id = names, environment_id
        self.seeds = _Remembered(lambda kind: fnv_state(*names, kind))


def _places(places: tuple[_Place, ...]) -> list[pa.Array]:
    return [pa.array([p.names[0] for p in places], pa.string()), pa.array([p.names[1] for p in places], pa.string()), pa.array([p.environment_id for p in places], pa.string())]


class Sweep:
    """The graph of one scope while its events pass in order."""

    def __init__(self, place: _Place, nodes: NodeRows | None, edges: EdgeRows | None):
        self.place, self.nodes, self.edges = place, nodes, edges
        self.made: list[_Node] = []
        self.families: dict[str, _Node] = {}  # the last version of each; only it may be open
        self.cues: dict[str, _Cue] = {}
        self.index: list[dict] = [{} for _ in range(CLASS[-1] + 1)]  # by weight: term -> the node or nodes that have it, in order of time

    def _id(self, x: _Node | _Cue) -> str:
        if x.id is None:
            x.id = f"{fnv_state(x.key, h=self.place.seeds[x.kind]):016x}"
        return x.id

    def _insert(self, node: _Node, found: list[str]) -> None:
        if self.nodes is not None:
            self.made.append(node)
        for t, n in zip(found, CLASS):
            rows = self.index[n].get(t)
            if rows is None:
                self.index[n][t] = node
            elif type(rows) is list:
                rows.append(node)
            else:
                self.index[n][t] = [rows, node]

    def _close(self, node: _Node, at: int, event: int) -> None:
        node.to, node.by = at, event
        if self.nodes is not None:
            self.nodes.rows.append(self._row(node))

    def _row(self, n: _Node) -> tuple:
        return self.place, n.kind, n.head + n.body, n.key, n.at, n.to, n.by, n.seen

    @staticmethod
    def _live(rows: list[_Node], limit: int) -> list[_Node]:
        """The newest open nodes of a list, newest first, and all of the last one's event."""
        found, i, closed = [], len(rows), False
        while i:
            x = rows[i - 1]
            if x.to is not None:
                closed = True
            elif len(found) >= limit and x.event != found[-1].event:
                break
            else:
                found.append(x)
            i -= 1
        if closed:
            rows[i:] = found[::-1]
        return found

    def neighbours(self, found: list[str]) -> list[_Node | _Cue]:
        out: dict[int, _Node | _Cue] = {}
        for t in found:
            n, cue = 0, self.cues.get(t)
            for words in self.index:
                rows = words.get(t)
                if rows is None and cue is None:
                    continue
                near = [] if rows is None else self._live(rows if type(rows) is list else [rows], NEIGHBOURS - n)
                if cue is not None:
                    near.append(cue)
                    cue = None
                if len(near) > 1:
                    near.sort(key=lambda x: (-x.at, -x.event))
                    if any(a.event == b.event for a, b in zip(near, near[1:])):
                        near.sort(key=lambda x: (-x.at, -x.event, self._id(x)))
                for x in near[: NEIGHBOURS - n]:
                    out[id(x)] = x
                    n += 1
                if n == NEIGHBOURS or len(out) >= NEIGHBOURS:
                    break
            if len(out) >= NEIGHBOURS:
                break
        return list(out.values())[:NEIGHBOURS]

    def _targets(self, op: str, kind: str, said: set[str], found: list[str]) -> list[_Node]:
        """What an event revises: of its kind the last neighbour of most overlap; an episode that invalidates, the first few that overlap enough."""
        if op == "update" and kind == "episode":
            return []
        least = UPDATE_OVERLAP if op == "update" else INVALIDATE_OVERLAP
        best, most, some = None, 0.0, []
        for x in self.neighbours(found):
            if x.kind == kind and (s := x.overlap(said)) >= least:
                some.append(x)
                if s >= most:
                    best, most = x, s
        return some[:TARGETS] if kind == "episode" else [best] if best is not None else []

    def _cite(self, words: list[str], at: int, event: int) -> None:
        """New versions of entity cues, or one more mention by the event that made them."""
        for word in words:
            cue = self.cues.get(word)
            if cue is None:
                self.cues[word] = _Cue(word, at, event)
            elif cue.at != at:
                if self.nodes is not None:
                    self.nodes.rows.append((self.place, "entity_cue", word, cue.key, cue.at, at, event, cue.seen))
                cue.at, cue.event, cue.seen, cue.id = at, event, 1, None
            elif cue.event == event:
                cue.seen += 1

    def apply(self, event: int, at: int, trace: str, span: str, seq: int, span_kind: str, name: str, text: str | None) -> None:
        body = clip(text or "", BODY_LIMIT)
        if not body:
            return
        low = body.lower() if body.isascii() else body.translate(_ASCII_LOWER)
        op = _marked(OP_MARKERS, low, "add")
        kind = _NAMED[name] or _marked(KIND_MARKERS, low, "fact")
        said = _terms(body)
        found = sorted(said)
        head, head_terms = _HEAD[span_kind, name]
        targets = self._targets(op, kind, said, found) if op != "add" else []

        said_all = said | head_terms
        episode_cues = sorted(said_all, key=_RANK.__getitem__)[:CUES]
        episode = _Node("episode", head, body, f"episode:{trace}:{span}:{seq}", at, event, False, None)
        self._insert(episode, sorted(said_all)[:CUE_TERMS])
        self._cite(episode_cues, at, event)
        if kind == "episode":  # the typed memory is the episode again
            episode.seen = 2
            if not targets:
                self._cite(episode_cues, at, event)
            node, cues = episode, []
        else:
            top = sorted(said, key=_RANK.__getitem__)
            base = targets[0].family if op == "update" and targets else f"{kind}:{' '.join(top[:12]) or 'empty_' + fnv(normalize(body))}"
            last, cues = self.families.get(base), []
            if last is not None and last.at == at and not (op == "update" and targets):
                node = last
            else:
                if last is not None and last.to is None:
                    self._close(last, at, event)
                node = self.families[base] = _Node(kind, "", body, base, at, event, last is not None and last.at == at, tuple(found))
                self._insert(node, found[:CUE_TERMS])
                cues = top[:CUES]
                self._cite(cues, at, event)
        if op == "invalidate":
            closed = [x for x in targets if x is not node and x.to is None]
            for x in closed:
                self._close(x, at, event)
        if self.edges is not None:
            self._link(episode, episode_cues, node, cues, closed if op == "invalidate" else targets, op, at, event)

    def _link(self, episode: _Node, episode_cues: list[str], node: _Node, cues: list[str], older: list[_Node], op: str, at: int, event: int) -> None:
        """The edges of an event.  Each is new, as one of its ends is new or was closed just now."""
        out, place = self.edges, self.place
        cue_at = {w: out.end(place, "entity_cue", f"entity_cue:{w}|rev:{at}") for w in {*episode_cues, *cues}}
        a = b = out.end(place, "episode", episode.family)
        rows = out.rows
        for w in episode_cues:
            rows.append((place, a, cue_at[w], _MENTIONS, at, event))
        if node is not episode:
            b = out.end(place, node.kind, node.key)
            for w in cues:
                rows.append((place, b, cue_at[w], _MENTIONS, at, event))
            rows.append((place, b, a, _DERIVED, at, event))
            rows.append((place, b, a, _OBSERVED, at, event))
        for x in older:
            c = out.end(place, x.kind, x.key)
            rows.append((place, b, c, _SUPERSEDES, at, event))
            if op == "invalidate":
                rows.append((place, b, c, _CONTRADICTS, at, event))

    def rest(self) -> Iterator[tuple]:
        """The rows of the nodes that are still open."""
        for n in self.made:
            if n.to is None:
                yield self._row(n)
        for word, cue in self.cues.items():
            yield self.place, "entity_cue", word, cue.key, cue.at, None, None, cue.seen


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, but faster; numbers with nulls would become floats."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _sweep(batches: Iterator[pa.RecordBatch], part: str) -> Iterator[pa.RecordBatch]:
    """batches: events sorted by scope, time and arrival."""
    nodes, edges = (NodeRows(), None) if part == "nodes" else (None, EdgeRows())
    out, scope = nodes if nodes is not None else edges, None

    def rest():
        for row in scope.rest() if scope is not None and nodes is not None else ():
            out.rows.append(row)
            if len(out) >= BATCH:
                yield out.flush()

    on = gc.isenabled()
    gc.disable()  # millions of nodes and no cycles among them
    try:
        for batch in batches:
            for tenant, project, env, environment_id, event, at, trace, span, seq, span_kind, name, text in zip(*map(_values, batch.columns)):
                if scope is None or scope.place.names != (tenant, project, env):
                    yield from rest()
                    scope = Sweep(_Place((tenant, project, env), environment_id), nodes, edges)
                scope.apply(event, at, trace, span, seq, span_kind, name, text)
                if len(out) >= BATCH:
                    yield out.flush()
        yield from rest()
        if len(out):
            yield out.flush()
    finally:
        if on:
            gc.enable()


def sweep(ledger: DataFrame, part: str) -> DataFrame:
    """``fold_nodes`` or ``fold_edges`` (part: nodes, edges) of ``fold(ledger)``. ledger: first copies, each message once."""
    rows = ledger.withColumn("env", F.coalesce("environment_id", F.lit(""))).select(*EVENT)
    rows = rows.repartition("tenant_id", "project_id", "env").sortWithinPartitions("tenant_id", "project_id", "env", "observed_at_unix_ms", "id")
    return rows.mapInArrow(lambda batches: _sweep(batches, part), NODES if part == "nodes" else EDGES)

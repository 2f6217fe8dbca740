"""DuckDB expressions that say the same as the column functions, for the side-by-side check."""

from __future__ import annotations

from chronolith.functions.classify import ACCEPTS, COMPOSITIONAL, DECLARED, KIND_MARKERS, LOOKS_UP, MODES, OP_MARKERS, ROUTES
from chronolith.functions.text import STOP_WORDS
from chronolith.operators.retrieve import EDGE_WEIGHTS
from chronolith.sources.ledger import IDENTIFIERS


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def normalize(x: str) -> str:
    return f"trim(lower(regexp_replace({x}, '[^A-Za-z0-9_./-]+', ' ', 'g')), ' ')"


def terms(x: str) -> str:
    return f"""list_sort(list_distinct(list_filter(list_transform(string_split({normalize(x)}, ' '), lambda t: trim(t, '.-/')),
        lambda t: length(t) >= 3 AND t NOT IN ({quoted(STOP_WORDS)}) AND NOT regexp_full_match(t, '[0-9]+'))))"""


def top_terms(x: str, n: int) -> str:
    weight = "length(t) + 4 * contains(t, '.')::INT + 4 * contains(t, '/')::INT + 2 * contains(t, '_')::INT + 2 * contains(t, '-')::INT"
    return f"list_transform(list_sort(list_transform({terms(x)}, lambda t: {{'w': -({weight}), 't': t}}))[1:{n}], lambda s: s.t)"


_SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'), ' ')"


def rejection() -> str:
    """The first rule that an event breaks, or null."""
    blank = lambda c: f"({c} IS NULL OR regexp_full_match({c}, '{_SPACE}*'))"
    padded = lambda c: f"regexp_matches({c}, '^{_SPACE}|{_SPACE}$')"
    rules = [(test(c), f"{c} {said}") for c in IDENTIFIERS for test, said in ((blank, "must not be empty"), (padded, "must not have leading or trailing whitespace"))]
    rules += [(f"environment_id IS NOT NULL AND {test('environment_id')}", f"environment_id {said}") for test, said in ((blank, "must not be empty"), (padded, "must not have leading or trailing whitespace"))]
    rules += [(blank("text"), "text must not be empty"), ("seq IS NULL OR seq <= 0", "seq must be greater than 0")]
    rules += [(f"{c} IS NULL OR {c} < 0", f"{c} must be non-negative") for c in ("observed_at_unix_ms", "ingested_at_unix_ms")] + [("projected_at_unix_ms < 0", "projected_at_unix_ms must be non-negative")]
    return "CASE " + " ".join(f"WHEN {test} THEN '{said}'" for test, said in rules) + " END"


def tokens(x: str) -> str:
    return f"greatest(ceil(length(regexp_replace({x}, '{_SPACE}', '', 'g')) / 4)::INT, CASE WHEN {x} = '' THEN 0 ELSE 1 END)"


def clip(x: str, n: int) -> str:
    """The longest prefix of at most n bytes, by characters."""
    return f"""CASE WHEN strlen({x}) <= {n} THEN {x} ELSE rtrim(left({x}, list_max(list_filter(range({n} // 4, {n} + 1), lambda k: strlen(left({x}, k)) <= {n}))::BIGINT), ' ') || '...' END"""


def concise(x: str, n: int) -> str:
    """Clips a squashed text; x must be a plain column of it."""
    return clip(x, n)


def fnv(*parts: str) -> str:
    data = " || ".join(f"hex(encode({p})) || 'FF'" for p in parts)
    byte = f"list_transform(range(0, length({data}) // 2), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::UBIGINT)"
    step = "lambda a, b: ((xor(a, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::UBIGINT, {byte}), {step}))), 16, '0')"


def stable_id(prefix: str, *parts: str) -> str:
    return f"('{prefix}_' || {fnv(*parts)})"


def canonical_key(kind: str, x: str) -> str:
    top = f"array_to_string({top_terms(normalize(x), 12)}, ' ')"
    return f"({kind} || ':' || CASE WHEN {top} = '' THEN {stable_id('empty', normalize(x))} ELSE {top} END)"


def overlap(a: str, b: str) -> str:
    both = f"length(list_intersect({a}, {b}))"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE {both} / (length({a}) + length({b}) - {both})::DOUBLE END"


def any_of(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def memory_kind(name: str, text: str) -> str:
    declared = " ".join(f"WHEN {ascii_lower(name)} IN ({quoted(n)}) THEN '{k}'" for k, n in DECLARED.items())
    marked = " ".join(f"WHEN {any_of(ascii_lower(text), m)} THEN '{k}'" for k, m in KIND_MARKERS)
    return f"CASE {declared} {marked} ELSE 'fact' END"


def revision_op(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(ascii_lower(text), m)} THEN '{k}'" for k, m in OP_MARKERS) + " ELSE 'add' END"


def route_modes(q: str) -> str:
    q = ascii_lower(q)
    parts = ", ".join(f"CASE WHEN {any_of(q, m)} THEN [{quoted(modes)}] ELSE [] END" for m, modes, *_ in ROUTES)
    none = " AND ".join(f"NOT {any_of(q, m)}" for m, *_ in ROUTES)
    return f"CASE WHEN {none} THEN [{quoted(MODES)}] ELSE flatten([{parts}]) END"


def route_reason(q: str) -> tuple[str, str]:
    q = ascii_lower(q)
    n = " + ".join(f"{any_of(q, m)}::INT" for m, *_ in ROUTES)
    reason = " ".join(f"WHEN {any_of(q, m)} THEN '{r}'" for m, _, r, _ in ROUTES)
    conf = " ".join(f"WHEN {any_of(q, m)} THEN {c}" for m, _, _, c in ROUTES)
    return f"CASE WHEN {n} <> 1 THEN 'ambiguous_fallback' {reason} END", f"CASE WHEN {n} = 0 THEN 0.2 WHEN {n} > 1 THEN 0.55 {conf} END::DOUBLE"


def kinds_for(modes: str) -> str:
    return f"flatten([['entity_cue'], {', '.join(f'''CASE WHEN list_contains({modes}, '{m}') THEN [{quoted(LOOKS_UP[m])}] ELSE [] END''' for m in MODES)}])"


def accepted(modes: str, kind: str) -> str:
    return "(" + " OR ".join(f"(list_contains({modes}, '{m}') AND {kind} IN ({quoted(ACCEPTS[m])}))" for m in MODES) + ")"


def compositional(q: str) -> str:
    return any_of(ascii_lower(q), COMPOSITIONAL)


def kind_weight(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {w}" for k, w in EDGE_WEIGHTS.items()) + " ELSE 0 END"


#: The ledger with the first arrival of each exact message key.
LEDGER = """ledger AS (
  SELECT * FROM ledger_events QUALIFY row_number() OVER (PARTITION BY tenant_id, project_id, trace_id, span_id, seq ORDER BY id) = 1)"""

SOURCES = """sources AS (
  SELECT DISTINCT s.node_id, e.id AS event_id, e.observed_at_unix_ms AS observed, e.ingested_at_unix_ms AS ingested, e.text AS event_text
  FROM node_spans s JOIN ledger e USING (tenant_id, project_id, trace_id, span_id, seq))"""

FIRST = "firsts AS (SELECT node_id, arg_min(event_id, (observed, event_id)) AS first_event_id FROM sources GROUP BY node_id)"

"""The text kernel as Catalyst expressions: normal form, terms, keys, ids, overlap, clipping, tokens.

All of it stays in the JVM but for the hash of ids, which takes whole Arrow batches; every function takes and returns columns.  Null text gives null unless noted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Words that carry no cue.
STOP_WORDS = (
    "a about after all also an and are as at be by can for from had has have if in into is it its of on or our "
    "should so that the their then there this to use was we when where with without you your"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def normalize_text(text: Column) -> Column:
    """ASCII letters, digits and ``_ . / -`` in lower case; runs of anything else are one space."""
    return F.btrim(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_./-]+", " ")), F.lit(" "))


def terms(text: Column) -> Column:
    """Distinct sorted cue terms: three characters or more, no stop words, not only digits."""
    words = F.transform(F.split(normalize_text(text), " "), lambda t: F.btrim(t, F.lit(".-/")))
    keep = lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$")
    return F.array_sort(F.array_distinct(F.filter(words, keep)))


def top_terms(text: Column, limit: int) -> Column:
    """The most specific terms: long ones and those with . / _ or - first, then by name."""

    def weight(t: Column) -> Column:
        extra = sum((F.when(F.contains(t, F.lit(mark)), points).otherwise(0) for mark, points in ((".", 4), ("/", 4), ("_", 2), ("-", 2))), F.lit(0))
        return F.struct((-(F.length(t) + extra)).alias("w"), t.alias("t"))

    return F.transform(F.slice(F.array_sort(F.transform(terms(text), weight)), 1, limit), lambda x: x["t"])


#: Unicode white space, for a Java character class.
_SPACE = r"\p{IsWhite_Space}"


def squash(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, _SPACE + "+", " "), F.lit(" "))


def clip_bytes(text: Column, limit: int) -> Column:
    """Text of more than ``limit`` UTF-8 bytes, cut at a character and marked with three dots."""

    def cut(t: Column) -> Column:
        raw = F.encode(t, "UTF-8")
        # the last character that fits ends where the byte after the cut is no continuation
        at = F.array_max(F.filter(F.sequence(F.lit(limit - 3), F.lit(limit)), lambda k: ~F.hex(F.substring(raw, k + 1, F.lit(1))).rlike("^[89AB]")))
        return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.decode(F.substring(raw, F.lit(1), at), "UTF-8")), F.lit("...")))

    return let(text, cut)


def concise(text: Column, limit: int) -> Column:
    return clip_bytes(squash(text), limit)


def excerpt(text: Column, limit: int = 240) -> Column:
    return clip_bytes(text, limit)


_HEX = "0123456789ABCDEF"


def fnv1a64_expr(*parts: Column) -> Column:
    """FNV-1a over the parts, each followed by a byte 255, as 16 hex digits.

    This is the form for use inside lambdas; over whole tables ``fnv1a64`` is far cheaper.  The state is two
    32-bit limbs, so no product leaves the range of a long.
    """
    data = F.hex(F.concat(*[x for p in parts for x in (F.encode(p, "UTF-8"), F.unhex(F.lit("FF")))]))
    # split once into bytes: a lambda would compute anything else that it reads again for every byte
    pairs = F.split(data, r"(?<=\G..)")
    digit = lambda x, at: F.instr(F.lit(_HEX), F.substring(x, at, 1)) - 1
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc: Column, x: Column) -> Column:
        y = acc["lo"].bitwiseXOR((digit(x, 1) * 16 + digit(x, 2)).cast("long"))
        hi = (acc["hi"] * 435 + F.shiftright(y * 435, 32) + F.shiftleft(y, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(x == "", acc).otherwise(F.struct(hi.alias("hi"), (y * 435).bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo")))

    limb = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(pairs, start, step, lambda acc: F.concat(limb(acc["hi"]), limb(acc["lo"])))


def _fnv_states(data: pa.Array, start: np.ndarray | None = None) -> np.ndarray:
    """FNV-1a of each binary, byte position by byte position over all rows that are long enough. start: the states that they go on from."""
    data = data.cast(pa.large_binary())
    n = len(data)
    offsets = np.frombuffer(data.buffers()[1], np.int64, n + 1, data.offset * 8)
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] else np.empty(0, np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    first, left = offsets[:-1][order], -size[order]
    h = np.full(n, 0xCBF29CE484222325, np.uint64) if start is None else start[order]
    prime = np.uint64(0x100000001B3)
    for j in range(int(size.max(initial=0))):
        live = np.searchsorted(left, -j, "left")  # the rows of more than j bytes
        h[:live] = (h[:live] ^ raw[first[:live] + j]) * prime
    out = np.empty(n, np.uint64)
    out[order] = h
    return out


def _fnv_batch(data: pa.Array) -> pa.Array:
    hexed = pa.array([f"{x:016x}" for x in _fnv_states(data).tolist()], pa.string())
    return pc.if_else(data.is_valid(), hexed, None)


def fnv1a64_ids(prefix: str, starts: list[int], parts: Sequence[str]) -> pa.Array:
    """prefix and the digits of each part, going on from the state that the parts before it gave."""
    states = _fnv_states(pa.array([p.encode() + b"\xff" for p in parts], pa.large_binary()), np.array(starts, np.uint64))
    head, digits = np.frombuffer(prefix.encode(), np.uint8), np.frombuffer(states.astype(">u8").tobytes().hex().encode(), np.uint8).reshape(-1, 16)
    text = np.hstack([np.broadcast_to(head, (len(digits), len(head))), digits])
    return pa.StringArray.from_buffers(len(text), pa.py_buffer(np.arange(0, text.size + 1, text.shape[1], np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


@lru_cache(maxsize=1)
def _fnv_udf():
    def fnv(data: pa.Array) -> pa.Array:
        return _fnv_batch(data)

    return F.arrow_udf(fnv, StringType())


def fnv1a64(*parts: Column) -> Column:
    """As ``fnv1a64_expr``, by whole Arrow batches: about one microsecond a row, where the expression takes one a byte."""
    return _fnv_udf()(F.concat(*[x for p in parts for x in (F.encode(p, "UTF-8"), F.unhex(F.lit("FF")))]))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), fnv1a64(*parts))


def canonical_key(kind: Column, text: Column) -> Column:
    """kind and the top twelve terms; texts without terms are told apart by the hash of their normal form."""
    top = F.array_join(top_terms(text, 12), " ")
    key = let(top, lambda t: F.when(t == "", F.concat(F.lit("empty_"), fnv1a64_expr(normalize_text(text)))).otherwise(t))
    return F.concat(kind, F.lit(":"), key)


def overlap(left_terms: Column, right_terms: Column) -> Column:
    """Jaccard of two term arrays; 0 if one is empty."""

    def ratio(x: Column) -> Column:
        a, b = F.size(x["a"]), F.size(x["b"])
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both / (a + b - both))

    return let(F.struct(left_terms.alias("a"), right_terms.alias("b")), ratio)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters that are no white space, rounded up; at least 1 unless the text is empty."""
    visible = F.length(F.regexp_replace(text, _SPACE, ""))
    return F.greatest(F.ceil(visible / 4), F.when(text == "", 0).otherwise(1)).cast("int")


def merge_text(existing: Column, incoming: Column) -> Column:
    """Append a text unless it is blank or contained already."""
    new = F.btrim(incoming)
    return (
        F.when((new == "") | F.contains(existing, new), existing)
        .when(F.btrim(existing) == "", new)
        .otherwise(F.concat(F.btrim(existing), F.lit(" "), new))
    )


def merge_texts(texts: Column) -> Column:
    """Fold of an ordered array of texts."""
    return F.aggregate(texts, F.lit(""), merge_text)


#: Keys that name where a record belongs, not what it says.
_PLACE_KEYS = "trace_id span_id parent_span_id tenant_id project_id environment_id schema_version normalizer_version".split()


@lru_cache(maxsize=1)
def _words_udf():
    from chronolith.functions.jsontext import parse, storable, words

    without = frozenset(_PLACE_KEYS)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return storable(words(parse(text), without))
        except ValueError:
            return None

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(batch, StringType())


def json_text(text: Column) -> Column:
    """A JSON text as plain words: values, after their keys, in the order of sorted keys; null if it is no JSON. Built from the leaves upwards, which has no column form: by whole Arrow batches."""
    return _words_udf()(text)

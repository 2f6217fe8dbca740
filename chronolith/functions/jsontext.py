"""JSON text as Python values, however deep: for Arrow batches where the JVM's parser, which stops at a thousand levels, can't serve."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_SURROGATE = re.compile("[\ud800-\udfff]")
_NAMES = {"true": True, "false": False, "null": None}


class Number(str):
    """A number as it is written."""

    __slots__ = ()

    @property
    def whole(self) -> bool:
        return not ("." in self or "e" in self or "E" in self)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def storable(text: str) -> str:
    """A string that UTF-8 can hold: surrogates without their partner are replaced."""
    return text if text.isascii() or not _SURROGATE.search(text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)


def parse(text: str) -> Any:
    """The value of a JSON text, numbers as ``Number``; raises ValueError. Text after the value is refused; of a repeated key the last counts."""
    try:
        return _DECODER.decode(text.strip(" \t\n\r"))
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """As ``parse``, with a stack of its own."""
    top: list[Any] = []
    stack: list[tuple[Any, str | None]] = []  # open containers, with the key that waits for its value
    into: Any = top
    key: str | None = None
    at = _SPACE.match(text, 0).end()
    while True:
        c = text[at : at + 1]
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in ("{", "["):
            value = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                stack.append((into, key))
                into = value
                if c == "{":
                    key, at = _key(text, at)
                continue
        elif (m := _NUMBER.match(text, at)) and m.end() > at:
            value, at = Number(m[0]), m.end()
        else:
            name = next((n for n in _NAMES if text.startswith(n, at)), None)
            if name is None:
                raise ValueError(f"no value at {at}")
            value, at = _NAMES[name], at + len(name)
        # the value is whole: put it into its container, and close what ends here
        while True:
            if isinstance(into, dict):
                into[key] = value
            else:
                into.append(value)
            at = _SPACE.match(text, at).end()
            if not stack:
                if at < len(text):
                    raise ValueError(f"text after the value at {at}")
                return top[0]
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(into, dict):
                    key, at = _key(text, at)
                break
            if c != ("}" if isinstance(into, dict) else "]"):
                raise ValueError(f"a comma or an end is missing at {at}")
            at += 1
            value = into
            into, key = stack.pop()


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"a key is missing at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"a colon is missing at {at}")
    return key, _SPACE.match(text, at + 1).end()


def written(value: Any) -> str:
    """A value as JSON text again, by a stack."""
    out: list[str] = []
    stack: list[Any] = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, _Mark):
            out.append(v.text)
        elif isinstance(v, Number):
            out.append(v)
        elif isinstance(v, dict):
            stack.append(_Mark("}"))
            for i, (k, x) in reversed(list(enumerate(v.items()))):
                stack += [x, _Mark(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":")]
            out.append("{")
        elif isinstance(v, list):
            stack.append(_Mark("]"))
            for i, x in reversed(list(enumerate(v))):
                stack += [x, _Mark("," if i else "")]
            out.append("[")
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


class _Mark:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def words(value: Any, without: frozenset[str] = frozenset()) -> str:
    """A value as plain words: the values after their keys, in the order of sorted keys; objects say nothing of keys ``without`` or with nothing to say."""
    done: list[str] = []  # finished texts of the open containers' members, innermost last
    stack: list[tuple[str, Any]] = [("open", value)]
    while stack:
        what, v = stack.pop()
        if what == "open":
            if isinstance(v, dict):
                keys = [k for k in sorted(v) if k not in without]
                stack.append(("object", keys))
                stack.extend(("open", v[k]) for k in reversed(keys))
            elif isinstance(v, list):
                stack.append(("array", len(v)))
                stack.extend(("open", x) for x in reversed(v))
            elif isinstance(v, Number):
                done.append(str(v) if v.whole else repr(float(v)))
            elif isinstance(v, bool):
                done.append("true" if v else "false")
            else:
                done.append(v or "")
        else:
            n = len(v) if what == "object" else v
            parts = done[len(done) - n :]
            del done[len(done) - n :]
            done.append(" ".join(f"{k}: {t}" for k, t in zip(v, parts) if t) if what == "object" else " ".join(parts))
    return done[0]

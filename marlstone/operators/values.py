"""JSON values in Python with exact numbers: reading, writing, types and equality."""

from __future__ import annotations

import json
import re
import sys
from decimal import Decimal
from typing import Any

#: Arrays and objects may lie this deep in each other, here as in the engine's own parser.
DEPTH = 1_000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEPTH))  # paths and schemas walk values by recursion

_NESTING = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{\]}]', re.S)


class Nothing:
    """The absence of a value, which is not null; there is one, wherever it is sent."""

    def __repr__(self) -> str:
        return "NOTHING"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self) -> str:
        return "NOTHING"


NOTHING = Nothing()


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is no JSON")


def _integer(digits: str) -> int | Decimal:
    return int(digits) if len(digits) <= 4_000 else Decimal(digits)


_DECODER = json.JSONDecoder(parse_float=Decimal, parse_int=_integer, parse_constant=_no_constant)


def depth(text: str) -> int:
    """How deep arrays and objects of a JSON text lie in each other."""
    most = now = 0
    for m in _NESTING.finditer(text):
        now += 1 if m[0] in "[{" else -1 if m[0] in "]}" else 0
        most = max(most, now)
    return most


def read(text: str) -> Any:
    """A JSON text's first value, as the engine's parser takes it: what follows is not looked at.

    Numbers are exact decimals or integers of any length. Of a repeated member the last counts.
    Raises ValueError, also for texts of more than DEPTH levels.
    """
    if text.count("[") + text.count("{") > DEPTH and depth(text) > DEPTH:
        raise ValueError("nested too deep")
    return _DECODER.raw_decode(text.lstrip(" \t\r\n"))[0]


def write(value: Any) -> str:
    """Compact JSON; decimals keep their digits, bytes become base 64."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return json.dumps(value)
    if isinstance(value, Decimal):
        return format(value, "f") if -20 < value.adjusted() < 40 else str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, bytes):
        import base64

        return json.dumps(base64.b64encode(value).decode())
    if isinstance(value, dict):
        return "{" + ",".join(f"{write(k if isinstance(k, str) else write(k))}:{write(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(write, value)) + "]"


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def kind(value: Any) -> str:
    """null, bool, number, bytes, string, array or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if is_number(value):
        return "number"
    return {bytes: "bytes", str: "string", list: "array", dict: "object"}[type(value)]


def same(a: Any, b: Any) -> bool:
    """Deep equality: numbers by value, objects by their sets of members, never across types."""
    ka = kind(a)
    if ka != kind(b):
        return False
    if ka == "array":
        return len(a) == len(b) and all(map(same, a, b))
    if ka == "object":
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def canonical(value: Any) -> Any:
    """A hashable form that is equal exactly where same() holds."""
    k = kind(value)
    if k == "array":
        return k, tuple(map(canonical, value))
    if k == "object":
        return k, frozenset((n, canonical(v)) for n, v in value.items())
    return k, value

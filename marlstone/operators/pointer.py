"""JSON Pointer (RFC 6901) and relative pointers: algebra on the driver, reading as expressions, writing in Python."""

from __future__ import annotations

import re
from copy import deepcopy
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.operators.values import NOTHING, read, write
from marlstone.plans.jsonpath import Path, PathError, normalized


class PointerError(ValueError):
    pass


@dataclass(frozen=True)
class Pointer:
    """Reference tokens, decoded."""

    tokens: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str, strict: bool = True) -> Pointer:
        if text and not text.startswith("/") or strict and re.search(r"~(?![01])", text):
            raise PointerError(f"not a pointer: {text!r}")
        return cls(tuple(t.replace("~1", "/").replace("~0", "~") for t in text.split("/")[1:]))

    @classmethod
    def of_path(cls, path: str | Path) -> Pointer | None:
        """The pointer of a normal path, or None."""
        p = path if isinstance(path, Path) else Path(path)
        return cls(tuple(map(str, p.location))) if p.is_normal else None

    @property
    def encoded(self) -> str:
        return "".join("/" + t.replace("~", "~0").replace("/", "~1") for t in self.tokens)

    def __str__(self) -> str:
        return self.encoded

    def __truediv__(self, other: Pointer | str | int) -> Pointer:
        return Pointer(self.tokens + (other.tokens if isinstance(other, Pointer) else (str(other),)))

    @property
    def parent(self) -> Pointer:
        return Pointer(self.tokens[:-1])

    def dropping(self, n: int) -> Pointer:
        return Pointer(self.tokens[n:])

    def descend(self) -> tuple[str, Pointer] | None:
        return (self.tokens[0], Pointer(self.tokens[1:])) if self.tokens else None

    def get(self, value: Any) -> Any:
        """What stands there, or NOTHING; `-` and places beyond an array's end are nothing."""
        for t in self.tokens:
            if isinstance(value, dict) and t in value:
                value = value[t]
            elif isinstance(value, list) and re.fullmatch(r"0|[1-9]\d*", t) and int(t) < len(value):
                value = value[int(t)]
            else:
                return NOTHING
        return value

    def put(self, value: Any, new: Any) -> Any:
        """A copy with `new` there: members are set, elements replaced, `-` appends, NOTHING removes. Places that do not exist leave the value as it is."""
        if not self.tokens:
            return value if new is NOTHING else new
        out = deepcopy(value)
        at = self.parent.get(out)
        last = self.tokens[-1]
        if isinstance(at, dict):
            if new is NOTHING:
                at.pop(last, None)
            else:
                at[last] = new
        elif isinstance(at, list):
            if last == "-" and new is not NOTHING:
                at.append(new)
            elif re.fullmatch(r"0|[1-9]\d*", last) and int(last) < len(at):
                if new is NOTHING:
                    del at[int(last)]
                else:
                    at[int(last)] = new
        return out


@dataclass(frozen=True)
class RelativePointer:
    """Steps up, then a pointer down, or the key of the place (#)."""

    up: int
    down: Pointer | None

    @classmethod
    def parse(cls, text: str) -> RelativePointer:
        m = re.fullmatch(r"(0|[1-9]\d*)(#|(?:/.*)?)", text, re.S)
        if not m:
            raise PointerError(f"not a relative pointer: {text!r}")
        return cls(int(m[1]), None if m[2] == "#" else Pointer.parse(m[2]))

    def apply(self, base: Pointer) -> Pointer:
        """The pointer that this leads to from base; with #, the place whose key is meant."""
        if self.up > len(base.tokens):
            raise PointerError("above the root")
        place = Pointer(base.tokens[: len(base.tokens) - self.up])
        return place if self.down is None else place / self.down


def with_fragment(uri: Column, pointer: Pointer) -> Column:
    """uri with a pointer as its fragment."""
    from marlstone.functions.uri import updating

    return updating(uri, fragment=F.lit(pointer.encoded))


def get(document: Column, pointer: str | Pointer) -> Column:
    """VARIANT at a pointer in a VARIANT column, or null.

    A numeric token is read as an index of an array or a name of an object, whichever is there.
    """
    p = pointer if isinstance(pointer, Pointer) else Pointer.parse(pointer)
    v = document
    for t in p.tokens:
        plain = not re.search(r"['\"\\]", t)
        member = F.try_variant_get(v, f"$['{t}']", "variant") if plain else F.try_element_at(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")), F.lit(t))
        if re.fullmatch(r"0|[1-9]\d{0,8}", t):
            member = F.coalesce(F.try_variant_get(v, f"$[{t}]", "variant"), member)
        v = member
    return v


def put(document: Column, pointer: str | Pointer, new: Column | None) -> Column:
    """JSON text with another JSON value at a pointer; without a value, the place is removed."""
    p = pointer if isinstance(pointer, Pointer) else Pointer.parse(pointer)

    def one(d: str | None, v: str | None) -> str | None:
        try:
            return None if d is None else write(p.put(read(d), NOTHING if v is None else read(v)))
        except ValueError:
            return None

    if new is None:

        @F.pandas_udf("string")
        def removed(docs: pd.Series) -> pd.Series:
            return pd.Series([one(d, None) for d in docs], dtype=object)

        return removed(document)

    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([one(d, None if v is None or v != v else v) for d, v in zip(docs, values, strict=True)], dtype=object)

    return run(document, new)


def is_pointer(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(?:/(?:[^/~]|~[01])*)*\z"), F.lit(False))


def is_relative_pointer(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^(?:0|[1-9]\d*)(?:#|(?:/(?:[^/~]|~[01])*)*)\z"), F.lit(False))


def encode_token(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def decode_token(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def to_path(pointer: str | Pointer) -> str:
    """The normalized path of a pointer; numeric tokens become indices."""
    p = pointer if isinstance(pointer, Pointer) else Pointer.parse(pointer)
    return normalized(tuple(int(t) if re.fullmatch(r"0|[1-9]\d*", t) else t for t in p.tokens))


def of_paths(path: Column) -> Column:
    """The pointers of a column of paths; null for paths that are not normal."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                p = Pointer.of_path(t)
            except PathError:
                return None
            return None if p is None else p.encoded

        return s.map(one, na_action="ignore")

    return run(path)


def is_normal_path(path: Column) -> Column:
    """Whether texts are normalized paths: names in single quotes and indices, written in the one way."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            try:
                p = Path(t)
            except PathError:
                return False
            return p.is_normal and normalized(p.location) == t

        return s.map(one, na_action="ignore")

    return run(path)

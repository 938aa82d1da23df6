"""CBOR (RFC 8949) as a codec between binary columns and JSON text.

Byte strings are written to JSON as base 64; integers and decimals of any size keep their digits;
tags 2 to 5 give numbers, other tags the value they stand before, or, if asked, an object of tag
and value.
"""

from __future__ import annotations

import math
import struct
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.operators.values import read, write


class CborError(ValueError):
    pass


_BREAK = object()
MOST_DEPTH = 512


class Decoder:
    """Reads one item; `undefined` is null unless strict, unknown tags are passed over unless keep_tags."""

    def __init__(self, data: bytes, strict: bool = False, keep_tags: bool = False):
        self.data, self.at, self.strict, self.keep_tags = data, 0, strict, keep_tags

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CborError("the data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def size(self, low: int) -> int | None:
        """The argument of a head; None for an indefinite length."""
        if low < 24:
            return low
        if low <= 27:
            return int.from_bytes(self.take(1 << (low - 24)), "big")
        if low == 31:
            return None
        raise CborError("reserved head")

    def string(self, major: int, low: int) -> bytes:
        n = self.size(low)
        if n is not None:
            return self.take(n)
        out = []
        while (head := self.take(1)[0]) != 0xFF:
            if head >> 5 != major or head & 31 == 31:
                raise CborError("wrong part of a string")
            out.append(self.take(self.size(head & 31)))
        return b"".join(out)

    def item(self, depth: int = 0) -> Any:
        if depth > MOST_DEPTH:
            raise CborError("nested too deeply")
        head = self.take(1)[0]
        major, low = head >> 5, head & 31
        if major in (0, 1):
            n = self.size(low)
            if n is None:
                raise CborError("an integer has no indefinite length")
            return n if major == 0 else -1 - n
        if major == 2:
            return self.string(2, low)
        if major == 3:
            try:
                return self.string(3, low).decode()
            except UnicodeDecodeError as e:
                raise CborError("text that is not UTF-8") from e
        if major == 4:
            n = self.size(low)
            out: list = []
            while n is None or len(out) < n:
                v = self.item(depth + 1)
                if v is _BREAK:
                    if n is None:
                        return out
                    raise CborError("unexpected break")
                out.append(v)
            return out
        if major == 5:
            n, found = self.size(low), {}
            k = 0
            while n is None or k < n:
                key = self.item(depth + 1)
                if key is _BREAK:
                    if n is None:
                        return found
                    raise CborError("unexpected break")
                value = self.item(depth + 1)
                if value is _BREAK:
                    raise CborError("a key without value")
                found[key if isinstance(key, str) else write(key)] = value
                k += 1
            return found
        if major == 6:
            return self.tagged(self.size(low), self.item(depth + 1))
        if low == 31:
            return _BREAK
        if low in (20, 21):
            return low == 21
        if low == 22:
            return None
        if low == 23:
            if self.strict:
                raise CborError("undefined")
            return None
        if low in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], self.take(1 << (low - 24)))[0]
        raise CborError("unassigned simple value")

    def tagged(self, tag: int | None, value: Any) -> Any:
        if tag in (2, 3) and isinstance(value, bytes):
            n = int.from_bytes(value, "big")
            return n if tag == 2 else -1 - n
        if tag in (4, 5) and isinstance(value, list) and len(value) == 2 and all(isinstance(v, int) for v in value):
            exponent, mantissa = value
            if abs(exponent) > 100_000:
                raise CborError("exponent out of range")
            if tag == 4:
                return Decimal(mantissa).scaleb(exponent)
            return Decimal(mantissa) * Decimal(2) ** exponent if exponent >= 0 else Decimal(mantissa) / Decimal(2) ** -exponent
        return {"tag": tag, "value": value} if self.keep_tags else value


def decode(data: bytes, **options: bool) -> Any:
    """The value of one item that fills the data."""
    d = Decoder(data, **options)
    value = d.item()
    if value is _BREAK or d.at != len(data):
        raise CborError("more than one item")
    return value


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for low, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * width):
            return bytes([major << 5 | low]) + n.to_bytes(width, "big")
    raise CborError("too large a head")


def _integer(n: int) -> bytes:
    if -(1 << 64) <= n < 1 << 64:
        return _head(0, n) if n >= 0 else _head(1, -1 - n)
    m = n if n >= 0 else -1 - n
    body = m.to_bytes((m.bit_length() + 7) // 8, "big")
    return _head(6, 2 if n >= 0 else 3) + _head(2, len(body)) + body


def _float(x: float) -> bytes:
    """The shortest float that keeps the value."""
    if math.isnan(x):
        return b"\xf9\x7e\x00"
    for code, mark in ((">e", 0xF9), (">f", 0xFA)):
        try:
            packed = struct.pack(code, x)
        except OverflowError:
            continue
        if struct.unpack(code, packed)[0] == x:
            return bytes([mark]) + packed
    return b"\xfb" + struct.pack(">d", x)


def encode(value: Any, deterministic: bool = True) -> bytes:
    """CBOR of a value; deterministic sorts map keys by their encoded bytes."""
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _integer(value)
    if isinstance(value, float):
        return _float(value)
    if isinstance(value, Decimal):
        if not value.is_finite():
            return _float(float(value))
        sign, digits, exponent = value.as_tuple()
        m = int("".join(map(str, digits)) or "0") * (-1 if sign else 1)
        if exponent >= 0:
            return _integer(m * 10**exponent)
        return _head(6, 4) + _head(4, 2) + _integer(exponent) + _integer(m)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        data = value.encode()
        return _head(3, len(data)) + data
    if isinstance(value, list):
        return _head(4, len(value)) + b"".join(encode(v, deterministic) for v in value)
    pairs = [(encode(k, deterministic), encode(v, deterministic)) for k, v in value.items()]
    return _head(5, len(pairs)) + b"".join(k + v for k, v in (sorted(pairs) if deterministic else pairs))


def from_cbor(data: Column, strict: bool = False, keep_tags: bool = False) -> Column:
    """JSON text of a CBOR item; null if the bytes are none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(d: bytes) -> str | None:
            try:
                return write(decode(d, strict=strict, keep_tags=keep_tags))
            except (CborError, RecursionError):
                return None

        return s.map(one, na_action="ignore")

    return run(data)


def to_cbor(text: Column, deterministic: bool = True) -> Column:
    """CBOR of a JSON text; null if it is none."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str) -> bytes | None:
            try:
                return encode(read(t), deterministic)
            except (ValueError, RecursionError):
                return None

        return s.map(one, na_action="ignore")

    return run(text)

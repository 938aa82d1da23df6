"""UUIDs of all versions as expressions over hexadecimal digits, their fields, and plain ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import encoding

# The namespaces of RFC 9562.
NAMESPACES = {"dns": uuid.NAMESPACE_DNS, "url": uuid.NAMESPACE_URL, "oid": uuid.NAMESPACE_OID, "x500": uuid.NAMESPACE_X500}
#: Ticks of 100 ns from 1582-10-15 to 1970-01-01.
GREGORIAN = 0x01B21DD213814000


def _dashed(digits: Column) -> Column:
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(digits, a, n) for a, n in at))


def _stamp(digits: Column, version: int) -> Column:
    """32 digits with the version's and the variant's bits put in."""
    variant = F.translate(F.substring(digits, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return _dashed(F.concat(F.substring(digits, 1, 12), F.lit(f"{version:x}"), F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15)))


def _named(name: Column, namespace: str | uuid.UUID, version: int) -> Column:
    space = NAMESPACES.get(namespace, namespace) if isinstance(namespace, str) else namespace
    data = F.concat(F.lit(uuid.UUID(str(space)).bytes), name.cast("binary"))
    return _stamp(F.substring(F.md5(data) if version == 3 else F.sha1(data), 1, 32), version)


def uuid_v3(name: Column, namespace: str | uuid.UUID) -> Column:
    return _named(name, namespace, 3)


def uuid_v5(name: Column, namespace: str | uuid.UUID) -> Column:
    return _named(name, namespace, 5)


def uuid_v4() -> Column:
    return F.uuid()


def _hex(n: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(n), width, "0"))


def _random(width: int) -> Column:
    return F.substring(F.sha2(F.uuid().cast("binary"), 256), 1, width)


def _ticks(ts: Column) -> Column:
    return F.unix_micros(ts) * 10 + GREGORIAN


def uuid_v1(ts: Column, clock_sequence: Column | None = None, node: Column | None = None) -> Column:
    """Time-based: low, middle and high ticks; the sequence and the node (12 digits) are random unless given."""
    t = _hex(_ticks(ts), 16)
    clock = _hex(clock_sequence.bitwiseAND(F.lit(0x3FFF)), 4) if clock_sequence is not None else _random(4)
    return _stamp(F.concat(F.substring(t, 9, 8), F.substring(t, 5, 4), F.lit("1"), F.substring(t, 2, 3), clock, node if node is not None else _random(12)), 1)


def uuid_v6(ts: Column, clock_sequence: Column | None = None, node: Column | None = None) -> Column:
    """As version 1, with the ticks in order, so ids sort by time."""
    t = _hex(_ticks(ts), 16)
    clock = _hex(clock_sequence.bitwiseAND(F.lit(0x3FFF)), 4) if clock_sequence is not None else _random(4)
    return _stamp(F.concat(F.substring(t, 2, 12), F.lit("6"), F.substring(t, 14, 3), clock, node if node is not None else _random(12)), 6)


def uuid_v7(ts: Column, tail: Column | None = None) -> Column:
    """Milliseconds, then twelve bits of their fraction, then random digits (16) unless they are given."""
    micros = F.unix_micros(ts)
    millis = F.floor(micros / 1000).cast("bigint")
    fraction = F.floor((micros - millis * 1000) * 4096 / 1000).cast("bigint")
    return _stamp(F.concat(_hex(millis, 12), F.lit("7"), _hex(fraction, 3), tail if tail is not None else _random(16)), 7)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"), F.lit(False))


def version(text: Column) -> Column:
    return F.when(is_uuid(text), F.conv(F.substring(text, 15, 1), 16, 10).cast("int"))


def variant(text: Column) -> Column:
    """ncs, rfc, microsoft or future, by the leading bits of the ninth byte."""
    n = F.conv(F.substring(text, 20, 1), 16, 10).cast("int")
    return F.when(is_uuid(text), F.when(n < 8, F.lit("ncs")).when(n < 12, F.lit("rfc")).when(n < 14, F.lit("microsoft")).otherwise(F.lit("future")))


def timestamp(text: Column) -> Column:
    """When a UUID of version 1, 6 or 7 was made; null for others."""
    digits = F.replace(text, F.lit("-"), F.lit(""))
    number = lambda c: F.conv(c, 16, 10).cast("bigint")
    one = number(F.concat(F.substring(digits, 14, 3), F.substring(digits, 9, 4), F.substring(digits, 1, 8)))
    six = number(F.concat(F.substring(digits, 1, 12), F.substring(digits, 14, 3)))
    v = version(text)
    ticks = F.when(v == 1, one).when(v == 6, six)
    micros = F.when(v == 7, number(F.substring(digits, 1, 12)) * 1000).otherwise(F.floor((ticks - GREGORIAN) / 10).cast("bigint"))
    return F.timestamp_micros(micros)


def to_bytes(text: Column) -> Column:
    return F.when(is_uuid(text), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))


def from_bytes(data: Column) -> Column:
    return F.when(F.octet_length(data) == 16, _dashed(F.lower(F.hex(data))))


def encoded(text: Column, kind: str = "base32crockford") -> Column:
    """A UUID's bytes in an alphabet of marlstone.functions.encoding, without padding."""
    return encoding.encode(to_bytes(text), kind, padded=False)


def decoded(text: Column, kind: str = "base32crockford") -> Column:
    """The UUID of such a text; null if it is none."""
    return from_bytes(encoding.decode(text, kind, strict=False))


def counter() -> Column:
    """Increasing ids, unique in a DataFrame."""
    return F.monotonically_increasing_id()


def random_id(bits: int) -> Column:
    """Random ids of 8 to 128 bits, as hexadecimal digits."""
    if not 8 <= bits <= 128 or bits % 4:
        raise ValueError("bits must be a multiple of 4 from 8 to 128")
    return _random(bits // 4)

"""Digests, keyed digests, compression, sealed boxes, and privacy of logged values."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import lzma
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def digest(data: Column, kind: str = "sha256") -> Column:
    """Lower-case hexadecimal digest: md5, sha1, sha256, sha384 or sha512."""
    data = data.cast("binary")
    return F.md5(data) if kind == "md5" else F.sha1(data) if kind == "sha1" else F.sha2(data, int(kind[3:]))


def _xor_pad(key: bytes, block: int, value: int) -> bytes:
    return bytes(b ^ value for b in key.ljust(block, b"\0"))


def hmac(data: Column, key: bytes, kind: str = "sha256") -> Column:
    """Keyed digest with a constant key: two nested digests, all in built-in functions."""
    block = 128 if kind in ("sha384", "sha512") else 64
    if len(key) > block:
        key = hashlib.new(kind, key).digest()
    inner = digest(F.concat(F.lit(_xor_pad(key, block, 0x36)), data.cast("binary")), kind)
    return digest(F.concat(F.lit(_xor_pad(key, block, 0x5C)), F.unhex(inner)), kind)


@F.pandas_udf(StringType())
def hmac_keyed(data: pd.Series, key: pd.Series, kind: pd.Series) -> pd.Series:
    """Keyed digest with a key from a column."""
    return pd.Series([None if d is None or k is None else _hmac.new(k, d, n).hexdigest() for d, k, n in zip(data, key, kind, strict=True)], dtype=object)


def compress(data: Column, kind: str = "zlib") -> Column:
    """Compressed bytes: zlib, gzip or lzma."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        pack = {"zlib": zlib.compress, "gzip": lambda d: zlib.compress(d, wbits=31), "lzma": lzma.compress}[kind]
        return s.map(pack, na_action="ignore")

    return run(data.cast("binary"))


def decompress(data: Column, kind: str = "zlib") -> Column:
    """Bytes of a compressed value; null if it is damaged."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        unpack = {"zlib": zlib.decompress, "gzip": lambda d: zlib.decompress(d, wbits=31), "lzma": lzma.decompress}[kind]

        def one(d: bytes) -> bytes | None:
            try:
                return unpack(d)
            except (zlib.error, lzma.LZMAError, EOFError):
                return None

        return s.map(one, na_action="ignore")

    return run(data.cast("binary"))


def seal(data: Column, key: Column, index: int = 0, final: bool = True) -> Column:
    """AES-GCM box of a chunk; its place in the stream, and whether it is the last, are authenticated."""
    aad = F.lit(index.to_bytes(8, "big") + bytes([final]))
    return F.aes_encrypt(data.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def unseal(box: Column, key: Column, index: int = 0, final: bool = True) -> Column:
    """Bytes of a box; null if key, place or content is not what was sealed."""
    return F.try_aes_decrypt(box, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(index.to_bytes(8, "big") + bytes([final])))


def redact(text: Column) -> Column:
    """Asterisks of the same length in brackets."""
    return F.concat(F.lit("["), F.repeat(F.lit("*"), F.char_length(text)), F.lit("]"))


def obscure(text: Column) -> Column:
    """The first eight bytes of the SHA-256, in hexadecimal."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def private(text: Column, argument: str, allowed: str) -> Column:
    """A logged value by its own privacy and by what the log allows: public, sensitive or private.

    A log that allows private values shows all; a public value shows everywhere; a sensitive one
    is obscured where sensitive values are allowed; the rest is redacted.
    """
    if allowed == "private" or argument == "public":
        return text
    return obscure(text) if allowed == argument == "sensitive" else redact(text)


def left_pad(text: Column, width: int, filler: str = " ") -> Column:
    """Text filled on the left to a width; longer texts stay whole."""
    return F.when(F.char_length(text) >= width, text).otherwise(F.lpad(text, width, filler))


def right_pad(text: Column, width: int, filler: str = " ") -> Column:
    return F.when(F.char_length(text) >= width, text).otherwise(F.rpad(text, width, filler))


def joined_to_list(items: Column, prefix: str) -> Column:
    """A list in words: prefix 'a', 'b' or 'c'."""
    quoted = F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(quoted, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" or "), F.try_element_at(quoted, F.lit(-1)))
    return F.when(n == 0, F.lit(prefix)).otherwise(F.concat(F.lit(prefix + " "), F.when(n == 1, F.try_element_at(quoted, F.lit(1))).otherwise(many)))

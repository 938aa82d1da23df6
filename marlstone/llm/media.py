"""Operator 5: media columns whose types are found by their signatures.

An Aho-Corasick automaton over the magic bytes of all formats finds every place of a payload
where a file may begin, in one pass. A validator for the format then walks the structure from
there - chunk sizes, check sums, markers - and gives the length, or rejects the place. What
stands at the start decides the true type, which corrects the declared one; what stands
elsewhere is embedded media, carved by offset and length.

Null payloads count as empty and have the type application/octet-stream. Equal payloads give
equal results. Very long payloads are held whole, one at a time; where no end mark follows, its
absence is found once, not at each place. Further columns are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import as_bytes, scratch_path, slices

UNKNOWN = "application/octet-stream"

# Magic bytes of the formats, where they stand in a file, and the media type.
SIGNATURES = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS", 0, "audio/ogg"),
    (b"fLaC", 0, "audio/flac"),
    (b"ftyp", 4, "video/mp4"),
    (b"II*\x00", 0, "image/tiff"),
    (b"MM\x00*", 0, "image/tiff"),
]

Found = tuple[str, int, frozenset]  # media type, length, and where the format's own signatures stand inside


class Payload(bytes):
    """Bytes that remember where a mark stands next, so places that follow each other search once."""

    def next(self, mark: bytes, at: int) -> int:
        """Where mark stands first from `at` on, or -1; asked for ascending places."""
        known = self.__dict__.setdefault("known", {})
        start, found = known.get(mark, (None, None))
        if start is None or at < start or 0 <= found < at:
            start, found = known[mark] = (at, self.find(mark, at))
        return found

    def archives(self) -> dict[int, list[int]]:
        """Where archives begin, by what the records at their ends say of it, with the places of these records."""
        if "ends" not in self.__dict__:
            self.ends: dict[int, list[int]] = {}
            end = self.find(b"PK\x05\x06")
            while 0 <= end <= len(self) - 22:
                size, offset = struct.unpack_from("<II", self, end + 12)
                self.ends.setdefault(end - size - offset, []).append(end)
                end = self.find(b"PK\x05\x06", end + 1)
        return self.ends

    def unpacked(self, start: int, step: int = 1 << 16) -> int | None:
        """Where packed data that begin at `start` end, check sum and size included; None if they are damaged."""
        known = self.__dict__.setdefault("packed", {})
        if start not in known:
            known[start] = None
            inflate, view, pos, crc, size = zlib.decompressobj(wbits=-15), memoryview(self), start, 0, 0
            try:
                while not inflate.eof and pos < len(self):
                    rest = view[pos : pos + step]
                    while len(rest) and not inflate.eof:  # what comes out is bounded, and thrown away
                        part = inflate.decompress(rest, 1 << 20)
                        crc, size, rest = zlib.crc32(part, crc), size + len(part), inflate.unconsumed_tail
                    pos += step
            except zlib.error:
                return None
            end = min(pos, len(self)) - len(inflate.unused_data)
            if inflate.eof and self[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF):
                known[start] = end + 8
        return known[start]

    def last(self, mark: bytes, end: int) -> int:
        """Where mark stands last before `end`, or -1."""
        known = self.__dict__.setdefault("lasts", {})
        if (mark, end) not in known:
            known.clear()
            known[mark, end] = self.rfind(mark, 0, end)
        return known[mark, end]


NONE: frozenset = frozenset()


def _riff(d: Payload, at: int) -> Found | None:
    if len(d) < at + 12:
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end, kind = at + 8 + size, {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    if kind is None or end > len(d):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, pos)
        if pos + 8 + n > end:
            return None
        seen.add(name)
        pos += 8 + n + (n & 1)
    if kind == "audio/wav" and not {b"fmt ", b"data"} <= seen:
        return None
    return (kind, end - at, NONE) if seen and end <= pos <= end + 1 else None


def _png(d: Payload, at: int) -> Found | None:
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        n, name = struct.unpack_from(">I4s", d, pos)
        if pos + 12 + n > len(d) or first and (name != b"IHDR" or n != 13):
            return None
        if zlib.crc32(d[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", d, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return "image/png", pos - at, NONE
    return None


def _gif(d: Payload, at: int) -> Found | None:
    if len(d) < at + 13:
        return None
    flags = d[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    while pos < len(d):
        if d[pos] == 0x3B:
            return "image/gif", pos + 1 - at, NONE
        if d[pos] == 0x21:
            pos = blocks(pos + 2)
        elif d[pos] == 0x2C and pos + 10 < len(d):
            local = d[pos + 9]
            pos = blocks(pos + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(d: Payload, at: int) -> Found | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(d) and d[pos] == 0xFF:
        mark = d[pos + 1]
        n = struct.unpack_from(">H", d, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(d):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if mark == 0xDA:
            end = d.next(b"\xff\xd9", pos)
            return ("image/jpeg", end + 2 - at, NONE) if frame and end >= 0 else None
    return None


def _pdf(d: Payload, at: int) -> Found | None:
    if len(d) < at + 8 or not d[at + 5 : at + 6].isdigit():
        return None
    end = d.next(b"%%EOF", at)
    return ("application/pdf", end + 5 - at, NONE) if end >= 0 and d.last(b"startxref", end) > at else None


def _zip(d: Payload, at: int) -> Found | None:
    for end in d.archives().get(at, ()):
        entries, size, offset, comment = struct.unpack_from("<HIIH", d, end + 10)
        pos, own = at + offset, set()
        for _ in range(entries):
            if d[pos : pos + 4] != b"PK\x01\x02" or pos + 46 > end:
                break
            lengths, start = struct.unpack_from("<3H", d, pos + 28), struct.unpack_from("<I", d, pos + 42)[0]
            own.add(at + start)
            pos += 46 + sum(lengths)
        if len(own) == entries and pos == end and end + 22 + comment <= len(d):
            return "application/zip", end + 22 + comment - at, frozenset(own)
    return None


def _gzip(d: Payload, at: int) -> Found | None:
    """A header, passed over field by field; then the packed data, of which several headers may claim the same."""
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    flags, pos = d[at + 3], at + 10
    if flags & 4:
        pos += 2 + struct.unpack_from("<H", d, pos)[0]
    for text in (8, 16):  # a name and a remark, each ended by a zero
        if flags & text:
            end = d.next(b"\0", pos)
            if end < 0:
                return None
            pos = end + 1
    pos += 2 if flags & 2 else 0
    end = d.unpacked(pos)
    return ("application/gzip", end - at, NONE) if end else None


def _ogg(d: Payload, at: int) -> Found | None:
    pos, own = at, set()
    while d[pos : pos + 4] == b"OggS" and pos + 27 <= len(d) and d[pos + 4] == 0:
        own.add(pos)
        n = d[pos + 26]
        end = pos + 27 + n + sum(d[pos + 27 : pos + 27 + n])
        if end > len(d):
            return None
        last, pos = d[pos + 5] & 4, end
        if last:
            return "audio/ogg", pos - at, frozenset(own)
    return None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    out, top = [], 1 << bits - 1
    for byte in range(256):
        crc = byte << bits - 8
        for _ in range(8):
            crc = crc << 1 ^ (polynomial if crc & top else 0)
        out.append(crc & (1 << bits) - 1)
    return out


# Polynomials of a frame's header and of the whole frame.
_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(d: bytes, pos: int) -> int | None:
    """Samples of the frame whose header stands at pos, if its check sum is right."""
    if pos + 6 > len(d) or d[pos] != 0xFF or d[pos + 1] & 0xFE != 0xF8:
        return None
    code, rate = d[pos + 2] >> 4, d[pos + 2] & 15
    lead = d[pos + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    end = pos + 5 + max(0, more)
    if not code or rate == 15:
        return None
    size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8 if code > 7 else 0
    if code in (6, 7):
        size, end = int.from_bytes(d[end : end + code - 5], "big") + 1, end + code - 5
    end += (1 if rate == 12 else 2) if rate >= 12 else 0
    if end >= len(d):
        return None
    crc = 0
    for byte in d[pos:end]:
        crc = _CRC8[crc ^ byte]
    return size if crc == d[end] else None


def _flac(d: Payload, at: int) -> Found | None:
    """Blocks of metadata, then frames: each ends where its check sum comes out and the next one, or as many samples as were declared, follow."""
    pos, first, samples = at + 4, True, 0
    while True:
        if pos + 4 > len(d):
            return None
        head, n = d[pos], int.from_bytes(d[pos + 1 : pos + 4], "big")
        if first and (head & 0x7F or n != 34) or pos + 4 + n > len(d):
            return None
        if first:
            samples = int.from_bytes(d[pos + 14 : pos + 22], "big") & (1 << 36) - 1
        pos, first = pos + 4 + n, False
        if head & 0x80:
            break
    seen = 0
    while (size := _flac_frame(d, pos)) is not None:
        seen += size
        crc, end, after = 0, pos, None
        for byte in memoryview(d)[pos:]:
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ byte]
            end += 1
            if not crc and end > pos + 6 and (end == len(d) or (samples and seen >= samples) or _flac_frame(d, end) is not None):
                after = end
                break
        if after is None:
            return None
        pos = after
        if pos == len(d) or samples and seen >= samples:
            return "audio/flac", pos - at, NONE
    return None


def _mp4(d: Payload, at: int) -> Found | None:
    pos, seen = at, set()
    while pos + 8 <= len(d):
        n, name = struct.unpack_from(">I4s", d, pos)
        if n < 8 or pos + n > len(d) or not name.isalnum():
            break
        seen.add(name)
        pos += n
    return ("video/mp4", pos - at, NONE) if {b"ftyp", b"moov"} <= seen else None


def _tiff(d: Payload, at: int) -> Found | None:
    """Directories, the values they point to, and the strips or tiles: the length is the end of the last of these."""
    order = "<" if d[at : at + 2] == b"II" else ">"
    if len(d) < at + 8:
        return None
    widths, far = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}, 8
    ifd, walked = struct.unpack_from(f"{order}I", d, at + 4)[0], set()
    while ifd:
        if ifd < 8 or ifd in walked or at + ifd + 2 > len(d):
            return None
        walked.add(ifd)
        n = struct.unpack_from(f"{order}H", d, at + ifd)[0]
        if not n or at + ifd + 6 + 12 * n > len(d):
            return None
        far, held = max(far, ifd + 6 + 12 * n), {}
        for k in range(n):
            entry = at + ifd + 2 + 12 * k
            tag, kind, count = struct.unpack_from(f"{order}HHI", d, entry)
            size = widths.get(kind, 0) * count
            where = struct.unpack_from(f"{order}I", d, entry + 8)[0] if size > 4 else entry + 8 - at
            if at + where + size > len(d):
                return None
            far = max(far, where + size if size > 4 else 0)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                held[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", d, at + where)
        for offsets, sizes in ((273, 279), (324, 325)):
            far = max([far, *(o + s for o, s in zip(held.get(offsets, ()), held.get(sizes, ()), strict=False))])
        ifd = struct.unpack_from(f"{order}I", d, at + ifd + 2 + 12 * n)[0]
    return ("image/tiff", far, NONE) if walked and at + far <= len(d) else None


VALIDATORS: dict[str, Callable[[Payload, int], Found | None]] = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4, "image/tiff": _tiff}


class Sniffer:
    """Finds media in bytes: one automaton of all magic bytes, then the formats' validators."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for magic, lead, kind in SIGNATURES:
            self.automaton.add_word(magic.decode("latin-1"), (len(magic) + lead, kind))
        self.automaton.make_automaton()

    def places(self, data: bytes) -> list[tuple[int, str]]:
        """(offset, format) of every place where magic bytes stand."""
        return sorted((end + 1 - back, kind) for end, (back, kind) in self.automaton.iter(data.decode("latin-1")) if end + 1 >= back)

    def media(self, data: bytes) -> list[tuple[int, int, str]]:
        """(offset, length, type) of validated media, in order of place, those inside others included.

        Only what a medium's own format has placed in it, such as its pages or entries, is no medium
        of its own.
        """
        out, own, data = [], set(), Payload(data)
        for at, kind in self.places(data):
            if (at, kind) in own:
                continue
            if found := VALIDATORS[kind](data, at):
                out.append((at, found[1], found[0]))
                own.update((p, kind) for p in found[2])
        return out

    def sniff(self, data: bytes, declared: str | None) -> tuple[str, bool, list[tuple[int, int, str]]]:
        """(true type, whether it corrects the declared one, embedded media)."""
        media = self.media(data)
        start = next((m for m in media if m[0] == 0), None)
        kind = start[2] if start else UNKNOWN
        return kind, kind != (declared or UNKNOWN), [m for m in media if m is not start]


def wav(samples: bytes, rate: int = 8_000) -> bytes:
    """Mono 8-bit PCM: a sample for each byte."""
    body = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def wav_samples(data: bytes) -> bytes:
    """The samples of an 8-bit mono file, by its chunks."""
    if not _riff(Payload(data), 0):
        raise ValueError("not a WAVE file")
    pos, out = 12, None
    while pos + 8 <= len(data) and out is None:
        name, n = struct.unpack_from("<4sI", data, pos)
        if name == b"data":
            out = data[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    return out or b""


def pad(data: bytes, unit: int = 576, filler: bytes = b"\xff") -> bytes:
    """data and as many fillers as make a positive multiple of unit."""
    return data + filler * (max(1, -(-len(data) // unit)) * unit - len(data))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, declared): each whole text as samples of a WAVE file, stored in the shared folder and read back."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array((wav(pad(t)) for t in texts), pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")
    out = out.withColumn("declared", F.lit(UNKNOWN))
    path = scratch_path(spark, "media")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path).withColumnRenamed("id", id_col)


def sniff_column(media: DataFrame, id_col: str, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """(id, type, corrected, embedded array<struct<offset, length, type>>) of a column of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        entry = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])
        for b in slices(batches, "media"):
            found = [sniffer.sniff(d or b"", t) for d, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            inner = [[{"offset": o, "length": n, "type": t} for o, n, t in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array(inner, pa.list_(entry))], ["id", "type", "corrected", "embedded"])

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"), F.col(declared_col).alias("declared"))
    return rows.mapInArrow(run, f"id {kind}, type string, corrected boolean, embedded array<struct<offset:bigint,length:bigint,type:string>>").withColumnRenamed("id", id_col)


def carve(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id, offset, type, bytes): a row for each medium embedded elsewhere than at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for b in slices(batches, "media"):
            for i, data in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                parts = sniffer.sniff(data or b"", None)[2]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(parts), b.column(0).type), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[2] for p in parts]), pa.array([data[o : o + n] for o, n, _ in parts], pa.binary())], ["id", "offset", "type", "bytes"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, offset bigint, type string, bytes binary").withColumnRenamed("id", id_col)


def digest_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of stored media, all from the bytes that were read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for b in slices(batches, "media"):
            out = []
            for data, declared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                payload = wav_samples(data)
                kind, corrected, inner = sniffer.sniff(data, declared)
                feature = f"type={kind};declared={declared};corrected={str(corrected).lower()};embedded={','.join(f'{t}@{o}+{n}' for o, n, t in inner)}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    rows = stored.select(F.col(id_col).alias("id"), "n_bytes", "media", "declared")
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("id", id_col)

"""Operator 2: WARC archives as a Spark data source.

`spark.read.format("warc").load(folder)` plans a partition for each archive file (one for each
`split_bytes` range of an uncompressed file), takes predicates on record type and headers, parses
a record's header before anything else, and passes over the payload of a record that is not
wanted: by its length in a plain file, by the member length that this writer stores in the gzip
header of a compressed one. `option("payload", "false")` leaves payloads undecoded for all rows.

`df.write.format("warc").mode("append").save(folder)` writes one archive per task, a gzip member
per record. A list of the files of committed tasks stands beside them; readers go by it, so files
of failed or repeated attempts are never read.

Of records with equal payloads of at least `min_bytes`, the one with the smallest id is a
response and the others are revisits of it. A null payload counts as empty. A null id is larger
than any other; rows that share the smallest id are all responses; where no id is known, all are
responses. Extra columns are ignored. A very long payload is held whole, one at a time, and read
in time in proportion to its length. Addresses come back as they were, line breaks and outer blanks
included. An empty table gives a folder without archives and an empty result.

Foreign archives are read as well: a `.warc.gz` of one member for all records, one for each, or
anything between, and plain files of any version.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from marlstone.llm._shared import left_join_counted, scratch_path

# The format's version line, the profile of revisits, and Spark's columns for a record.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint, content_length bigint, payload binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
ARROW = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])
BEGINNING = re.compile(rb"\r\n\r\nWARC/\d+\.\d+\r\n[!-9;-~]{1,256}:")  # of a record of any version, with its first header
LISTING = "_archives"
LENGTH_FIELD = b"sl"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def address_lines(url: str) -> list[tuple[str, str]]:
    """Header of an address; one that a header line would change stands a second time, as JSON."""
    line = url.replace("\r", "%0D").replace("\n", "%0A").strip()
    return [("WARC-Target-URI", line)] + ([("X-Target-URI-JSON", json.dumps(url))] if line != url else [])


def compose(page_id: int | None, url: str | None, payload: bytes | None, size: int, payload_digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit (payload None) with the payload's size and digest in its headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_urn(page_id, url)), ("WARC-Date", date)]
    if url is not None:
        head += address_lines(url)
    head.append(("WARC-Payload-Digest", f"sha1:{payload_digest}"))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose header tells its own length, so a reader can pass over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = LENGTH_FIELD + struct.pack("<HQ", 8, total)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class Archive(InputPartition):
    uri: str
    start: int
    end: int


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _Bytes:
    """Reading of a file with a window of one chunk, which moves to where bytes are asked for."""

    def __init__(self, source: pa.NativeFile, at: int, chunk: int = 1 << 20):
        self.source, self.at, self.chunk, self.size = source, at, chunk, source.size()
        self.held, self.start = b"", at

    def window(self, ahead: int, n: int) -> bytes:
        """n bytes from `ahead` bytes beyond this place, or what is left of them."""
        a = self.at + ahead
        n = max(0, min(n, self.size - a))
        if not self.start <= a or a + n > self.start + len(self.held):
            self.start, self.held = a, self.source.read_at(min(max(n, self.chunk), self.size - a), a) if n else b""
        return self.held[a - self.start : a - self.start + n]

    def skip(self, n: int) -> None:
        self.at += n

    @property
    def ended(self) -> bool:
        return self.at >= self.size


class _Inflated:
    """The text of the gzip member where a file stands, read forward as it is inflated."""

    def __init__(self, src: _Bytes):
        self.src, self.at, self.used, self.held, self.inflate = src, 0, 0, bytearray(), zlib.decompressobj(wbits=31)

    def _fill(self, n: int, step: int = 1 << 15) -> None:
        while len(self.held) < n and not self.inflate.eof:
            more = self.src.window(self.used, step if self.used else 1024)
            if not more:
                return
            self.held += self.inflate.decompress(more)
            self.used += len(more) - len(self.inflate.unused_data)

    def window(self, ahead: int, n: int) -> bytes:
        self._fill(ahead + n)
        return bytes(memoryview(self.held)[ahead : ahead + n])

    def skip(self, n: int) -> None:
        self.at += n
        while n > 0:
            self._fill(1)
            if not self.held:
                return
            k = min(n, len(self.held))
            del self.held[:k]
            n -= k

    @property
    def ended(self) -> bool:
        self._fill(1)
        return not self.held


def _plain_records(src: _Bytes | _Inflated, upto: float) -> Iterator[tuple[dict[str, str], object]]:
    """(headers, function that reads the block) of records that begin before upto; the function is good until the next record is asked for."""
    while not src.ended and src.at < upto:
        n = 1 << 9
        while (cut := (text := src.window(0, n)).find(b"\r\n\r\n")) < 0:
            if len(text) < n:
                return
            n *= 2
        head = _headers(text[:cut])
        size = int(head.get("content-length", "0"))
        start = cut + 4
        yield head, lambda start=start, size=size: src.window(start, size)
        src.skip(start + size + 4)


def _packed_records(src: _Bytes) -> Iterator[tuple[dict[str, str], object]]:
    """Records of gzip members: of one that tells its length the first, which is its only one; of any other, all."""
    while not src.ended:
        head = src.window(0, 24)
        known = struct.unpack("<Q", head[16:24])[0] if len(head) == 24 and head[3] == 4 and head[12:14] == LENGTH_FIELD else None
        member = _Inflated(src)
        if known:
            yield from islice(_plain_records(member, 1), 1)
            src.skip(known)
        else:
            yield from _plain_records(member, float("inf"))
            while not member.ended:  # what follows a record that is cut short
                member.skip(1 << 20)
            if not member.used:
                return
            src.skip(member.used)


def _row(head: dict[str, str], block, payload: bool, verify: bool) -> tuple:
    kind, known = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    data, size = None, None
    if payload or verify or kind == "revisit":
        body = block()
        cut = body.find(b"\r\n\r\n") + 4 if head.get("content-type", "").startswith("application/http") else 0
        data = body[cut:]
        size = len(data)
        if kind == "revisit":
            size, data = int(_headers(body[:cut]).get("content-length", "0")), None
        elif verify and known and digest(data) != known:
            raise ValueError(f"{head.get('warc-record-id')}: the payload does not match its digest")
    page, refers, address = head.get("x-page-id"), head.get("x-refers-to-page-id"), head.get("x-target-uri-json")
    length = int(head.get("content-length", "0"))
    return head.get("warc-record-id"), kind, json.loads(address) if address else head.get("warc-target-uri"), head.get("warc-date"), int(page) if page else None, int(refers) if refers else None, known, size, length, data if payload else None


class WarcReader(DataSourceReader):
    """Reads archives; filters on the columns that headers give are applied before a payload is touched."""

    HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id"}

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.split = int(options.get("split_bytes", 128 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = self.HEADERS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append(("in", name, (str(f.value),)))
            elif name and isinstance(f, In):
                self.tests.append(("in", name, tuple(map(str, f.value))))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append(("starts", name, f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append(("there", name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.is_file}
        listed = [p for p in found if p.rsplit("/", 1)[-1].startswith(LISTING)]
        names = [n for p in listed for n in json.loads(fs.open_input_stream(p).read())] if listed else [p.rsplit("/", 1)[-1] for p in found if p.endswith((".warc", ".warc.gz"))]
        sizes = {p.rsplit("/", 1)[-1]: n for p, n in found.items()}
        out: list[InputPartition] = []
        for name in sorted(names):
            step = self.split if name.endswith(".warc") else max(1, sizes[name])
            out += [Archive(f"{self.path}/{name}", at, min(at + step, sizes[name])) for at in range(0, sizes[name], step)]
        return out or [Archive("", 0, 0)]

    def wanted(self, head: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            own = json.loads(head["x-target-uri-json"]) if name == "warc-target-uri" and "x-target-uri-json" in head else head.get(name)
            if own is None or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        fs, path = pafs.FileSystem.from_uri(partition.uri)
        with fs.open_input_file(path) as source:
            src = _Bytes(source, max(0, partition.start - 4))
            if path.endswith(".gz"):
                records = _packed_records(src)
            else:
                while partition.start and not src.ended:  # a record begins behind the blank lines of the one before, which may lie before this start
                    window = src.window(0, 1 << 20)
                    if m := BEGINNING.search(window):
                        src.skip(m.start() + 4)
                        break
                    src.skip(len(window) - 512 if len(window) == 1 << 20 else len(window))
                records = _plain_records(src, partition.end)
            rows, held = [], 0
            for head, block in records:
                if self.wanted(head):
                    rows.append(_row(head, block, self.payload, self.verify))
                    held += len(rows[-1][-1] or b"")
                    if len(rows) >= 5_000 or held >= 8 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes columns page_id, url, payload, payload_bytes, payload_digest, refers_to; a null payload makes a revisit."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        sink = name = None
        for b in iterator:
            columns = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
            for i in range(b.num_rows):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                page, url, payload, size, sha, refers = (c[i].as_py() for c in columns)
                sink.write(member(compose(page, url, payload, size, sha, refers, self.date)))
        if sink is not None:
            sink.close()
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{LISTING}-{uuid.uuid4().hex}") as out:
            out.write(json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("warc") known to a session and let it take filters."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages to archives in folder, one record each, with revisits for repeated payloads.

    Only digests and ids are grouped. Digests that occur more than once are joined back: by
    broadcast if their measured size allows it, else by a join that can split a hot digest.
    """
    register(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.encode(html, "UTF-8").alias("body"))
    rows = rows.withColumn("sha", F.sha1("body")).withColumn("payload_bytes", F.octet_length("body").cast("bigint"))
    repeated = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("sha").alias("of"), "first", "n")
    found = left_join_counted(rows.withColumn("of", F.when(F.col("payload_bytes") >= min_bytes, F.col("sha"))), repeated, "of", "n", F.lit(64))
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    out = found.select("page_id", "url", F.when(~again, F.col("body")).alias("payload"), "payload_bytes", _base32(F.col("sha")).alias("payload_digest"), F.when(again, F.col("first")).alias("refers_to"))
    out.write.format("warc").mode("append").save(folder)


def _base32(hex_digest: F.Column) -> F.Column:
    """RFC 4648 base 32 of a 160-bit digest in hexadecimal: 32 letters, no padding."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*(F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)))
    return F.concat(*(F.substring(F.lit(letters), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)))


def read_archives(spark: SparkSession, folder: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(folder)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from archives."""
    folder = scratch_path(pages.sparkSession, "warc")
    archive_pages(pages, folder, min_bytes)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # Each kind of record is asked for by a predicate that the reader takes over: revisits are found
    # without inflating a response's payload, and responses are inflated to be held against their digest.
    spark = pages.sparkSession
    responses = read_archives(spark, folder, payload=False, verify=True).where("record_type = 'response'").select(*columns)
    return responses.unionByName(read_archives(spark, folder, payload=False).where("record_type = 'revisit'").select(*columns))

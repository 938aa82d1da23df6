"""Operator 4: token ids in directly addressable codes, written to and read from binary files.

An id is cut into 8-bit chunks. Level k holds the k-th chunk of every id that has one; a bitmap
beside it says which of those ids go on to level k+1, and a rank directory holds the number of
set bits before each 512-bit block of the bitmap. Token i is found by one byte and one rank at
each level, so any token is read without decoding its neighbours.

File: blocks one after another, then a footer. A block is
    count, levels, (length of level k) ... as unsigned 32-bit integers,
    and for each level: chunks, bitmap (but for the last), rank directory (but for the last).
Footer: for each block its offset and first token, for each document its id and first token,
the three counts, and the magic number. Integers are little-endian.

Inputs: null texts count as empty; each document gets the end id all the same. A null id sorts
first. Rows that share an id follow each other in the order of a hash of their texts. Very long
texts are encoded whole, one at a time, and lie in as many blocks as they need. Further columns
are ignored. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm._shared import materialise, resident, scratch_path, slices
from marlstone.llm.bpe import Chunker, byte_letters

MAGIC = b"DACTOKS1"
RANK_BITS = 512
BLOCK_TOKENS = 1 << 19
NO_ID = -(1 << 63)


def pack(ids: np.ndarray) -> bytes:
    """One block of directly addressable codes."""
    levels: list[tuple[bytes, bytes, bytes]] = []
    lengths: list[int] = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        lengths.append(len(rest))
        low = (rest & 0xFF).astype(np.uint8).tobytes()
        if not more.any():
            levels.append((low, b"", b""))
            break
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS, dtype=np.uint32)
        padded[: len(rest)] = more
        rank = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(axis=1))[:-1]]).astype("<u4")
        levels.append((low, bits.tobytes(), rank.tobytes()))
        rest = rest[more] >> np.uint32(8)
    head = struct.pack(f"<{2 + len(lengths)}I", len(ids), len(levels), *lengths)
    return head + b"".join(chain.from_iterable(levels))


class Block:
    """A packed block: any token by its index, or all of them."""

    def __init__(self, data: bytes | memoryview):
        count, n = struct.unpack_from("<2I", data)
        lengths = struct.unpack_from(f"<{n}I", data, 8)
        self.count, self.levels, at = count, [], 8 + 4 * n
        for k, length in enumerate(lengths):
            low = np.frombuffer(data, np.uint8, length, at)
            at += length
            bits = rank = None
            if k + 1 < n:
                bits = np.frombuffer(data, np.uint8, -(-length // 8), at)
                at += len(bits)
                rank = np.frombuffer(data, "<u4", -(-length // RANK_BITS), at)
                at += 4 * len(rank)
            self.levels.append((low, bits, rank))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for k, (low, bits, rank) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // RANK_BITS
            ones = np.unpackbits(bits[start * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - start * RANK_BITS]
            i = int(rank[start]) + int(ones.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, as unsigned 32-bit integers."""
        low, _, _ = self.levels[-1]
        out = low.astype(np.uint32)
        for low, bits, _ in reversed(self.levels[:-1]):
            more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
            upper, out = out, low.astype(np.uint32)
            out[more] |= upper << np.uint32(8)
        return out


class Writer:
    """Writes documents of ids to one file, a block at a time."""

    def __init__(self, sink: io.IOBase):
        self.sink, self.at, self.tokens = sink, 0, 0
        self.blocks: list[tuple[int, int]] = []
        self.docs: list[tuple[int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, self.tokens))
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_TOKENS:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        first = self.tokens - len(ids)
        cut = len(ids) if whole else len(ids) // BLOCK_TOKENS * BLOCK_TOKENS
        for i in range(0, cut, BLOCK_TOKENS):
            data = pack(ids[i : min(cut, i + BLOCK_TOKENS)])
            self.blocks.append((self.at, first + i))
            self.sink.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(whole=True)
        blocks, docs = np.array(self.blocks, "<i8").reshape(-1, 2), np.array(self.docs, "<i8").reshape(-1, 2)
        self.sink.write(blocks.tobytes() + docs.tobytes() + struct.pack("<3q", len(blocks), len(docs), self.tokens) + MAGIC)
        self.sink.close()


class Reader:
    """Random access to a file: token(i), or documents() in order."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.heads = source, {}
        size = source.size()
        n_blocks, n_docs, self.tokens = struct.unpack("<3q", source.read_at(24, size - 32))
        if source.read_at(8, size - 8) != MAGIC:
            raise ValueError("not a file of token ids")
        self.end = size - 32 - 16 * (n_blocks + n_docs)
        footer = source.read_at(16 * (n_blocks + n_docs), self.end)
        self.blocks = np.frombuffer(footer, "<i8", 2 * n_blocks).reshape(-1, 2)
        self.docs = np.frombuffer(footer, "<i8", 2 * n_docs, 16 * n_blocks).reshape(-1, 2)

    def block(self, k: int) -> Block:
        at = int(self.blocks[k, 0])
        end = int(self.blocks[k + 1, 0]) if k + 1 < len(self.blocks) else self.end
        return Block(self.source.read_at(end - at, at))

    def _levels(self, k: int) -> list[tuple[int, int, int, int]]:
        """(length, where the chunks begin, where the bitmap does, where the rank directory does) of each level of block k, from its header."""
        if k not in self.heads:
            at = int(self.blocks[k, 0])
            _, n = struct.unpack("<2I", self.source.read_at(8, at))
            lengths = struct.unpack(f"<{n}I", self.source.read_at(4 * n, at + 8))
            at, out = at + 8 + 4 * n, []
            for j, length in enumerate(lengths):
                bits = at + length
                ranks = bits + -(-length // 8)
                out.append((length, at, bits, ranks))
                at = ranks + 4 * -(-length // RANK_BITS) if j + 1 < n else bits
            if len(self.heads) >= 256:
                self.heads.clear()
            self.heads[k] = out
        return self.heads[k]

    def token(self, i: int) -> int:
        """Token i, from one chunk, one rank and a part of one bitmap block (64 bytes at most) of each level it has."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        k = int(np.searchsorted(self.blocks[:, 1], i, side="right")) - 1
        i -= int(self.blocks[k, 1])
        levels, value = self._levels(k), 0
        for j, (_, chunks, bits, ranks) in enumerate(levels):
            value |= self.source.read_at(1, chunks + i)[0] << (8 * j)
            if j + 1 == len(levels):
                break
            block = i // RANK_BITS
            first = block * RANK_BITS // 8
            held = int.from_bytes(self.source.read_at((i >> 3) + 1 - first, bits + first), "little")
            place = i - block * RANK_BITS
            if not held >> place & 1:
                break
            i = struct.unpack("<I", self.source.read_at(4, ranks + 4 * block))[0] + (held & ((1 << place) - 1)).bit_count()
        return value

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(document id, its first token in this file, its ids in parts), holding one block at a time."""
        ends = np.append(self.docs[1:, 1], self.tokens)
        k, held, base = -1, np.zeros(0, np.uint32), 0
        for (doc_id, first), end in zip(self.docs.tolist(), ends.tolist(), strict=True):
            parts, at = [], first
            while at < end:
                if at >= base + len(held):
                    k += 1
                    held, base = self.block(k).all(), int(self.blocks[k, 1])
                upto = min(end, base + len(held))
                parts.append(held[at - base : upto - base])
                at = upto
            yield (None if doc_id == NO_ID else doc_id), first, parts


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct pre-token.

    Texts are cut as the byte-level pre-tokenizer cuts them; the library's model gives the ids of
    each piece that is not remembered. Texts with the string of an added token go to the library
    whole.
    """

    def __init__(self, path: str, remember: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.model = self.tokenizer.model
        self._ids = Chunker(self._ask, remember)

    def _ask(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self._ids(text), "u4")


def encoder(path: str) -> LibraryEncoder:
    return resident(f"library {path}", lambda: LibraryEncoder(path))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", encode: Callable | None = None) -> DataFrame:
    """Encode the texts and write files of ids in ascending order of id; returns their manifest.

    The texts are dealt out by ranges of id, so files follow each other as the documents do;
    each task writes one file under a name of its own attempt, and the manifest, which is
    written when all have ended, names the files that count. A repeated task leaves the other
    files as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = (encode or encoder)(path)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        writer = name = None
        least = None
        for b in slices(batches, "text"):
            if writer is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.dac"
                writer = Writer(fs.open_output_stream(f"{root}/{name}"))
                least = b.column(0)[0].as_py()
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                writer.add(doc_id, np.concatenate([to_ids(text), end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [f"{folder}/{name}"], "first_id": pa.array([least], pa.int64()), "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})

    # Rows that share an id are told apart by a hash of their text, and equal ones by their place, so no id fills a range.
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("place")]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).select("id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    manifest = materialise(ordered.mapInArrow(run, "part bigint, file string, first_id bigint, n_docs bigint, n_tokens bigint"), "manifest")
    # One row a file: its number grows with the tables' bytes over the size of a partition.
    return manifest.select("*", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("start"))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files of a manifest, a file to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(root) as source:
                    out: list[tuple] = []
                    reader = Reader(source)
                    for doc_id, first, parts in reader.documents():
                        crc = 0
                        # Each document's last id is read by its address as well.
                        if parts and reader.token(first + sum(map(len, parts)) - 1) != parts[-1][-1]:
                            raise ValueError(f"{file}: the codes of document {doc_id} disagree")
                        for p in parts:
                            crc = zlib.crc32(np.ascontiguousarray(p, "<u4"), crc)
                        out.append((doc_id, base + first, sum(map(len, parts)), crc))
                        if len(out) >= 20_000:
                            yield rows(out)
                            out = []
                    if out:
                        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def store_and_digest(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, path, end_id, id_col, text_col), id_col)

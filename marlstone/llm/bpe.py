"""Operator 1: byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each distinct pre-token is merged once per worker, as long as its memory holds it. Its adjacent
pairs are the leaves of a minimum tree; a leaf holds rank and position in one integer, so the
root is the leftmost pair of the lowest rank. A merge rewrites three leaves in logarithmic time,
and the loop ends when the root says that nothing can be merged. A pre-token of n bytes takes
O(n log n), so one endless word costs no more a byte than prose does. The pre-tokens that a run
of texts brings are merged side by side: a row of an array is the tree of one of them.

Inputs: null texts count as empty and give no ids. Repeated rows give repeated results. Only
the id and the text column are read, so further columns may have any name. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import resident, slices

# The pre-token pattern of the byte-level vocabulary, and Unicode's white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_MARKS = frozenset(".,;:!?")
#: Texts are encoded together until they have this many letters; longer ones are cut between chunks.
LETTERS = 1 << 20

#: Pre-tokens of up to this many bytes are merged side by side, this many in one array.
SHORT, ROWS = 65, 4096

_EDGE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_ODD_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECES = regex.compile(PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Memo(dict):
    """Results by key: two generations of at most `most` keys, of which the elder is dropped.

    Keys of more than 64 letters are not kept, so memory is bounded by the number of keys.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def unknown(self, keys: Iterable[str]) -> list[str]:
        """The distinct keys that are not remembered and would be."""
        old = self.old
        return [k for k in set(keys) if k not in self and k not in old and len(k) <= 64]

    def learn(self, keys: Iterable[str], values: Iterable[bytes]) -> None:
        for key, value in zip(keys, values, strict=True):
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value


class Chunker:
    """Joins what `make` gives, as bytes, for each pre-token of a text; results are remembered by chunk.

    Chunks end where white space follows something else; no pre-token crosses such a place. Where
    every white space is a lone blank or line feed, str.split finds them; else a pattern does.
    """

    def __init__(self, make: Callable[[str], bytes], remember: int, make_all: Callable[[list[str]], Iterable[bytes]] | None = None):
        self.make, self.make_all = make, make_all or (lambda found: map(make, found))
        self.exact = Memo(self._learn, remember // 4)
        self.blank = Memo(self._learn_blank, remember)

    def _learn_blank(self, part: str) -> bytes:
        if part.isalpha():
            return self.make(" " + part)
        if part[-1:] in _MARKS and part[:-1].isalpha():
            return self.blank[part[:-1]] + self.exact[part[-1]]
        return self._learn(part if part[:1] == "\n" else " " + part)

    def _learn(self, chunk: str) -> bytes:
        parts = pieces(chunk)
        if len(parts) == 1:
            return self.make(chunk)
        return self._join(parts)

    def _join(self, parts: list[str]) -> bytes:
        # A piece that begins with a blank is a chunk itself, and known as such.
        return b"".join([self.blank[p[1:]] if p[0] == " " and p[1:2] not in ("", "\n") else self.exact[p] for p in parts])

    @staticmethod
    def _cut(text: str) -> tuple[list[str], list[str]]:
        """Chunks of a text: first those that are known as they are, then those known without their blank."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
            return _CHUNK.findall(text), []
        rest = text.replace("\n", " \n").split(" ")
        first = rest.pop(0)
        return [first] if first else [], rest

    def __call__(self, text: str) -> bytes:
        exact, blank = self._cut(text)
        return b"".join(chain(map(self.exact.__getitem__, exact), map(self.blank.__getitem__, blank)))

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """What each text gives; what about LETTERS letters of them bring anew is made at once."""
        held: list[str] = []
        letters = 0
        for text in texts:
            if letters + len(text) > LETTERS:
                yield from self._together(held)
                held, letters = [], 0
            if len(text) > LETTERS:
                yield b"".join(chain.from_iterable(self._together([part]) for part in stretches(text)))
            else:
                held.append(text)
                letters += len(text)
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        cuts = list(map(self._cut, texts))
        self._prepare(cuts)
        for exact, blank in cuts:
            yield b"".join(chain(map(self.exact.__getitem__, exact), map(self.blank.__getitem__, blank)))

    def _prepare(self, cuts: list[tuple[list[str], list[str]]]) -> None:
        """Learn the chunks that are not known, their pre-tokens all at once."""
        exact, blank = {}, {}  # key: pre-token
        several: list[tuple[Memo, str, list[str]]] = []
        for c in self.blank.unknown(chain.from_iterable(b for _, b in cuts)):
            if c.isalpha():
                blank[c] = " " + c
                continue
            parts = pieces(c if c[:1] == "\n" else " " + c)
            if len(parts) == 1:
                blank[c] = parts[0]
            else:
                several.append((self.blank, c, parts))
        for c in self.exact.unknown(chain.from_iterable(e for e, _ in cuts)):
            parts = pieces(c)
            if len(parts) == 1:
                exact[c] = c
            else:
                several.append((self.exact, c, parts))
        parts = set(chain.from_iterable(p for _, _, p in several))
        spaced = {p for p in parts if p[0] == " " and p[1:2] not in ("", "\n")}
        blank |= {k: " " + k for k in self.blank.unknown(p[1:] for p in spaced)}
        exact |= {k: k for k in self.exact.unknown(parts - spaced)}
        made = iter(self.make_all([*blank.values(), *exact.values()]))
        self.blank.learn(blank, islice(made, len(blank)))
        self.exact.learn(exact, made)
        for memo, c, p in several:
            memo.learn([c], [self._join(p)])


def stretches(text: str) -> Iterator[str]:
    """Parts of a long text, of about LETTERS letters each, cut where white space follows something else."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + LETTERS)
        end = edge.start() if edge else len(text)
        yield text[at:end]
        at = end


def pieces(chunk: str) -> list[str]:
    """Pre-tokens of a chunk; plain words, with or without a mark behind them, need no pattern."""
    first = chunk[:1]
    body = chunk[1:] if first == " " or first == "\n" else chunk
    if body.isalpha():
        return [chunk] if first != "\n" else ["\n", body]
    if body[-1:] in _MARKS and body[:-1].isalpha():
        return [chunk[:-1], body[-1]] if first != "\n" else ["\n", body[:-1], body[-1]]
    return _PIECES.findall(chunk)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 stands for itself, the others for the letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class MergeTree:
    """Merges of one pre-token: leaf i holds rank * width + i of the pair that starts at i."""

    def __init__(self, ids: list[int] | array, ranks: dict[tuple[int, int], int], made: list[int]):
        self.ids, self.ranks, self.made = ids, ranks, made
        self.pairs = len(ids) - 1
        self.width = 1 << max(0, self.pairs - 1).bit_length()
        self.never = never = (len(made) + 1) * self.width
        width, found = self.width, map(ranks.get, zip(ids, islice(ids, 1, None), strict=False))
        leaves = (never if r is None else r * width + i for i, r in enumerate(found))
        if len(ids) <= 256:
            self.next, self.last = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
            level = [*leaves, *[never] * (width - self.pairs)]
            levels = [level]
            while len(level) > 1:
                level = list(map(min, level[::2], level[1::2]))
                levels.append(level)
            self.tree = [never]
            for level in reversed(levels):
                self.tree += level
        else:  # a long word: packed integers, 8 bytes each, where a list takes 40
            self.next, self.last = array("q", range(1, len(ids) + 1)), array("q", range(-1, len(ids) - 1))
            packed = np.full(2 * width, never, np.int64)
            packed[width : width + self.pairs] = np.fromiter(leaves, np.int64, self.pairs)
            while width > 1:
                packed[width // 2 : width] = packed[width : 2 * width].reshape(-1, 2).min(axis=1)
                width //= 2
            self.tree = array("q", packed.tobytes())

    def key(self, i: int, j: int) -> int:
        rank = self.ranks.get((self.ids[i], self.ids[j]))
        return self.never if rank is None else rank * self.width + i

    def put(self, i: int, key: int) -> None:
        tree, i = self.tree, i + self.width
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return  # nothing changes above
            tree[i] = least

    def run(self) -> tuple[int, ...]:
        return tuple(self.merged())

    def merged(self) -> array:
        """Ids that are left when nothing can be merged."""
        ids, n = self.ids, len(self.ids)
        while (root := self.tree[1]) < self.never:
            rank, i = divmod(root, self.width)
            gone = self.next[i]
            after = self.next[gone]
            ids[i] = self.made[rank]
            self.next[i] = after
            if gone < self.pairs:
                self.put(gone, self.never)
            if after < n:
                self.last[after] = i
                self.put(i, self.key(i, after))
            else:
                self.put(i, self.never)
            if (before := self.last[i]) >= 0:
                self.put(before, self.key(before, i))
        out, i = array("I"), 0
        while i < n:
            out.append(ids[i])
            i = self.next[i]
        return out


class PairRanks:
    """Ranks of pairs of ids for whole arrays: a hash table with open addresses."""

    def __init__(self, ranks: dict[tuple[int, int], int], size: int, never: int):
        self.size, self.never, self.bits = size, never, max(4, (4 * len(ranks)).bit_length())
        pairs = np.array(list(ranks), np.int64).reshape(-1, 2)
        todo, rank = pairs[:, 0] * size + pairs[:, 1], np.array(list(ranks.values()), np.int64)
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, never, np.int64)
        slot = self._slot(todo)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = todo[free]  # of several keys for a slot the last one stays
            placed = self.keys[slot] == todo
            self.ranks[slot[placed]] = rank[placed]
            todo, rank, slot = todo[~placed], rank[~placed], self._next(slot[~placed])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or `never`; an id below zero is in no pair."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        found = self.keys[slot]
        other = found != key
        out = np.where(other, self.never, self.ranks[slot])
        far = np.flatnonzero(other & (found >= 0))
        while len(far):
            slot_far = self._next(slot[far])
            slot[far] = slot_far
            found = self.keys[slot_far]
            hit = found == key[far]
            out[far[hit]] = self.ranks[slot_far[hit]]
            far = far[~hit & (found >= 0)]
        return out


class MergeTrees:
    """Merges of many short pre-tokens: row r of `tree` is the minimum tree of one, as MergeTree has it.

    Each round takes the root of every row that can still be merged and rewrites its three leaves.
    """

    def __init__(self, ids: np.ndarray, ranks: PairRanks, made: np.ndarray):
        """ids: a row for each pre-token, filled up with -1; their number is a power of two and one."""
        rows, n = ids.shape
        self.width = width = n - 1
        self.rows, self.ranks, self.made = rows, ranks, made
        self.never = ranks.never * width
        # One column more: what lies behind the last id, and before the first.
        self.stride = n + 1
        self.ids = np.full((rows, self.stride), -1, np.int64)
        self.ids[:, :n] = ids
        self.next = np.tile(np.arange(1, n + 2), (rows, 1))
        self.last = np.tile(np.arange(-1, n), (rows, 1))
        self.tree = np.full((rows, 2 * width), self.never, np.int64)
        place = np.tile(np.arange(width), (rows, 1))
        self.tree[:, width:] = self._keys(ids[:, :-1].ravel(), ids[:, 1:].ravel(), place.ravel()).reshape(rows, width)
        while width > 1:
            self.tree[:, width // 2 : width] = np.minimum(self.tree[:, width : 2 * width : 2], self.tree[:, width + 1 : 2 * width : 2])
            width //= 2

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank == self.ranks.never, self.never, rank * self.width + place)

    def _put(self, rows: np.ndarray, place: np.ndarray, keys: np.ndarray) -> None:
        """Write one leaf of each of the rows, and the nodes above it."""
        tree, base, node = self.tree.reshape(-1), rows * (2 * self.width), place + self.width
        tree[base + node] = keys
        for _ in range(self.width.bit_length() - 1):
            beside = tree[base + (node ^ 1)]
            keys = np.minimum(keys, beside)
            node = node >> 1
            tree[base + node] = keys

    def run(self) -> list[bytes]:
        """For each pre-token the ids that are left when nothing can be merged, as 32-bit integers."""
        ids, after_of, before_of = self.ids.reshape(-1), self.next.reshape(-1), self.last.reshape(-1)
        rows = np.arange(self.rows)
        while True:
            root = self.tree[rows, 1]
            going = root < self.never
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            rank, i = np.divmod(root, self.width)
            base = rows * self.stride
            gone = after_of[base + i]
            after = after_of[base + gone]
            made = self.made[rank]
            ids[base + i] = made
            ids[base + gone] = -1
            after_of[base + i] = after
            before_of[base + after] = i
            before = before_of[base + i]
            leaf = gone < self.width
            self._put(rows[leaf], gone[leaf], np.full(int(leaf.sum()), self.never))
            self._put(rows, i, self._keys(made, ids[base + after], i))
            leaf = before >= 0
            at = before[leaf]
            self._put(rows[leaf], at, self._keys(ids[base[leaf] + at], made[leaf], at))
        left = self.ids >= 0
        ends = (4 * np.cumsum(left.sum(axis=1))).tolist()
        data = self.ids[left].astype(np.uint32).tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Codec:
    """Encoder and decoder of a tokenizer file: byte-level BPE with added tokens."""

    def __init__(self, path: str, remember: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normaliser or added blank is supported")
        vocab, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((vocab[left], vocab[right]), len(self.made))
            self.made.append(vocab[left + right])
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in text)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.digits = [str(i) for i in range(size)]
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._ids = Chunker(self.merge, remember, self.merge_all)
        self._first, self._made = np.array(self.first), np.array(self.made, np.int64)
        self._ranks = PairRanks(self.ranks, size, len(self.made) + 1)

    def merge_all(self, found: list[str]) -> list[bytes]:
        """Ids of each of many pre-tokens, as merge gives them; the short ones of about one length side by side."""
        coded = [p.encode() for p in found]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        out: list[bytes] = [b""] * len(found)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.merge(found[i])
        width = 1
        while width < SHORT:
            least = 0 if width == 1 else width // 2 + 1
            group = np.flatnonzero((sizes > least) & (sizes <= width + 1))
            for at in range(0, len(group), ROWS):
                rows = group[at : at + ROWS].tolist()
                data = np.frombuffer(b"".join([coded[i] for i in rows]), np.uint8)
                ids = np.full((len(rows), width + 1), -1, np.int64)
                ids[np.arange(width + 1) < sizes[rows][:, None]] = self._first[data]
                for i, value in zip(rows, MergeTrees(ids, self._ranks, self._made).run(), strict=True):
                    out[i] = value
            width *= 2
        return out

    def merge(self, piece: str) -> bytes:
        """Ids of one pre-token, as 32-bit integers."""
        first = self.first
        data = piece.encode()
        if len(data) > 256:
            return MergeTree(array("I", map(first.__getitem__, data)), self.ranks, self.made).merged().tobytes()
        ids = [first[b] for b in data]
        return (array("I", ids) if len(ids) < 2 else MergeTree(ids, self.ranks, self.made).merged()).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text, as 32-bit integers; the strings of added tokens become their ids."""
        if not text:
            return b""
        if not self._marked(text):
            return self._ids(text)
        return b"".join(array("I", [self.added[part]]).tobytes() if part in self.added else self._ids(part) if part else b"" for part in self._added.split(text))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, as encode_bytes gives them; new pre-tokens of many texts are merged side by side."""
        marked = [self._marked(t) for t in texts]
        plain = self._ids.each(t or "" for t, m in zip(texts, marked, strict=True) if not m)
        for text, m in zip(texts, marked, strict=True):
            yield self.encode_bytes(text) if m else next(plain)

    def _marked(self, text: str | None) -> bool:
        return bool(text) and any(t in text for t in self.added)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD. Ids outside the vocabulary are left out."""
        known = self.bytes_of
        try:
            return b"".join(map(known.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(known[i] for i in ids if 0 <= i < len(known)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The codec of a file, read once by each worker process of a stage."""
    return resident(f"codec {path}", lambda: Codec(path))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, "text"):
            coded = list(c.encode_all(b.column(1).to_pylist()))
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(sizes)], ["id", "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each array of ids; a null array gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode the ids, digest both.

    One pass that keeps a single document's ids at a time: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, "text"):
            counts, coded, plain = [], [], []
            for raw in c.encode_all(b.column(1).to_pylist()):
                ids = np.frombuffer(raw, "u4").tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                plain.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

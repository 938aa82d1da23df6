import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import dac

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1)), max_size=1500))
def test_block_gives_every_token(ids):
    block = dac.Block(dac.pack(np.array(ids, np.uint32)))
    assert block.all().tolist() == ids
    assert [block[i] for i in range(0, len(ids), 7)] == ids[::7]


def test_file_random_access(monkeypatch):
    monkeypatch.setattr(dac, "BLOCK_TOKENS", 1000)
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 70_000, n).astype(np.uint32)) for i, n in enumerate([0, 5, 0, 2500, 1000, 1])]
    sink = io.BytesIO()
    close, sink.close = sink.close, lambda: None
    w = dac.Writer(sink)
    for doc_id, ids in docs:
        w.add(doc_id, ids)
    w.close()
    r = dac.Reader(pa.BufferReader(sink.getvalue()))
    whole = np.concatenate([d for _, d in docs])
    assert [r.token(i) for i in range(0, len(whole), 97)] == whole[::97].tolist()
    for (doc_id, ids), (found, _, parts) in zip(docs, r.documents(), strict=True):
        assert found == doc_id
        assert (np.concatenate(parts).tolist() if parts else []) == ids.tolist()
    close()


def test_documents(spark, docs_of):
    rows = [(7, "b c"), (-3, None), (5, ""), (7, "a  <|endoftext|>"), (None, "first"), (9, "z" * 9000)]
    out = sorted(dac.store_and_digest(docs_of(rows), PATH).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(PATH), 0
    for r, (doc_id, text) in zip(out, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert dac.store_and_digest(docs_of([]), PATH).count() == 0


def test_tokens_by_address(tmp_path):
    """token(i) equals a whole reading, at every place of a file of several blocks and at all widths, and reads few bytes."""
    import numpy as np
    import pyarrow.fs as pafs

    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << int(b), 3000) for b in (3, 8, 9, 16, 17, 24, 31)]).astype(np.uint32)
    rng.shuffle(ids)
    before, dac.BLOCK_TOKENS = dac.BLOCK_TOKENS, 4096
    try:
        w = dac.Writer(pafs.LocalFileSystem().open_output_stream(str(tmp_path / "t.dac")))
        for i in range(0, len(ids), 500):
            w.add(i, ids[i : i + 500])
        w.close()
    finally:
        dac.BLOCK_TOKENS = before
    read = []

    class Counted:
        def __init__(self, source):
            self.size = source.size
            self.read_at = lambda n, at: (read.append(n), source.read_at(n, at))[1]

    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "t.dac")) as source:
        r = dac.Reader(Counted(source))
        assert [r.token(i) for i in range(len(ids))] == ids.tolist()
        del read[:]
        r.token(12345)
        assert sum(read) <= 4 * (1 + 64 + 4)


def test_rows_of_one_id_and_a_long_text(spark, docs_of):
    import public_tokenizers

    rows = [(1, f"text {k}") for k in range(30)] + [(1, "text 3"), (None, "x"), (2, "word " * 200_000)]
    out = dac.store_and_digest(docs_of(rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(out) == len(rows) and max(r["n_tokens"] for r in out) > 200_000
    spans = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in out)
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and [s[2] for s in spans] == [None, *[1] * 31, 2]


def test_words_of_a_large_vocabulary_are_asked_for_once():
    """As many distinct words as a worker meets in some 20 MB of text, and each with a mark behind it."""
    from itertools import islice, product

    encoder, asked = dac.LibraryEncoder(PATH), []
    encoder._ids.make = lambda piece: (asked.append(piece), b"\1\0\0\0")[1]
    text = "first " + " ".join(map("".join, islice(product("abcdefghijklmnopqrstuvwxyz", repeat=4), 399_000)))
    assert len(encoder(text)) == 399_001 == len(asked)
    assert len(encoder(text)) == 399_001 == len(asked)
    assert len(encoder("first aaab, aaac.")) == 5 and asked[399_001:] == [",", "."]

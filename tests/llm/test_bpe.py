import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import bpe, dac

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "a  b\n\n c\t\td ", "x<|endoftext|>y  <|endoftext|>", "it's I'LL don't", "x\x1c\x1d!\x1f", "日本語 ½²", "ab" * 3000 + "!?" * 500, "\r\n x\r\n", "a  b", "<|endoftext|>"]


@pytest.mark.parametrize("text", ODD)
def test_same_as_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).encode(text) == want
    assert list(dac.encoder(PATH)(text)) == want
    assert bpe.codec(PATH).decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r'sS.,!<|>endoftxt12é日  \x1c\x85​½"), max_size=40))
def test_same_as_library_on_any_text(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).encode(text) == want == list(dac.encoder(PATH)(text))


def naive(ids, ranks, made):
    ids = list(ids)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return tuple(ids)
        ids[best[1] : best[1] + 2] = [made[best[0]]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=60), st.permutations([(a, b) for a in range(6) for b in range(6)]))
def test_tree_takes_leftmost_lowest_rank(ids, pairs):
    ranks = {p: r for r, p in enumerate(pairs[:14])}
    made = [6 + r % 3 for r in range(14)]
    assert bpe.MergeTree(list(ids), ranks, made).run() == naive(ids, ranks, made)


def test_documents(spark, docs_of):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (3, ""), (None, "x" * 50_000)]
    out = bpe.digest_documents(docs_of(rows), PATH).collect()
    assert len(out) == 5
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert want in [tuple(r)[1:] for r in out if r["doc_id"] == doc_id]
    encoded = bpe.encode_documents(docs_of(rows), PATH)
    assert {(r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded, PATH).collect()} == {(i, t or "") for i, t in rows}
    assert bpe.digest_documents(docs_of([]), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=9), min_size=1, max_size=20), st.permutations([(a, b) for a in range(6) for b in range(6)]))
def test_trees_side_by_side_take_leftmost_lowest_rank(rows, pairs):
    ranks = {p: r for r, p in enumerate(pairs[:14])}
    made = [6 + r % 3 for r in range(14)]
    ids = np.array([r + [-1] * (9 - len(r)) for r in rows])
    out = bpe.MergeTrees(ids, bpe.PairRanks(ranks, 9, 15), np.array(made)).run()
    assert [tuple(np.frombuffer(b, "u4").tolist()) for b in out] == [naive(r, ranks, made) for r in rows]


def test_new_words_of_many_texts_are_merged_side_by_side(monkeypatch):
    """No tree of its own for any short pre-token, whatever window a long text is cut at, and the library's ids."""
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshéß日", k=rng.randint(1, 12))) + rng.choice(["", "", ",", ".", "!!", "'s", "7"]) for _ in range(3000)]
    texts = [rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(200)]
    texts += [None, *(t for t in ODD if "<|" not in t), "  ".join(words), " ".join(words), "\t\n ".join(words[:500])]
    long, tree = [], bpe.MergeTree

    class Counted(tree):
        def __init__(self, ids, *rest):
            long.append(len(ids))
            super().__init__(ids, *rest)

    monkeypatch.setattr(bpe, "MergeTree", Counted)
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    for letters in (bpe.LETTERS, 500):
        monkeypatch.setattr(bpe, "LETTERS", letters)
        found = bpe.Codec(PATH).encode_all(texts)
        assert [np.frombuffer(b, "u4").tolist() for b in found] == want
    assert long and min(long) > bpe.SHORT


def test_chunks_that_leave_the_memory_at_once():
    """A memory smaller than one run of texts gives the same."""
    texts = [" ".join(f"w{i * k}x, y{i}" for i in range(300)) for k in range(1, 6)]
    found = bpe.Codec(PATH, remember=40).encode_all(texts)
    assert [np.frombuffer(b, "u4").tolist() for b in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]

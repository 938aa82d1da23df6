import random
import re

import numpy as np
import pytest

from marlstone.llm import neardup
from marlstone.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)], least[find(i)] == doc_id) for i, (doc_id, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([2, 3, 12, 60, 150]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                rows.append("\t".join(copy).upper())
    rows += [None, "", " \n", "One", "one", " x", "É", "é"]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_same_as_all_pairs(spark, docs_of, seed, k, percent):
    rows = corpus(seed)
    out = {r["doc_id"]: tuple(r)[1:] for r in neardup.link(docs_of(rows), k, percent).collect()}
    assert out == brute(rows, k, percent)
    kept = neardup.keep_first(docs_of(rows), k, percent)
    assert kept.columns == docs_of(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, first) in brute(rows, k, percent).items() if first}


def test_pairs_within_a_bucket_of_several_components():
    """Members that the bucket's centre is not linked to are still compared with each other."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(2)]
    sigs = np.stack([neardup.signature(s) for s in (sets[0], sets[0], sets[1])])
    least = neardup.least_matches(0.85, 1e-7)
    assert neardup.survivors(sigs[[0, 0]], sigs[[1, 2]], least).tolist() == [0]


def crowded(components=500, copies=4, words=120, seed=11):
    """Rows that meet in one bucket and stand in many components: families that share half of their words."""
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(words)]
    rows = []
    for c in range(components):
        base = shared + [f"c{c}x{i}" for i in range(words // 2)]
        for m in range(copies):
            copy = list(base)
            copy[-1 - rng.randrange(words // 2)] = f"m{c}y{m}"
            rows.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [64, neardup.BLOCK])
def test_a_bucket_of_many_members_and_components(spark, docs_of, monkeypatch, block):
    """One bucket for all rows, so only the second phase can find the families; its blocks are crossed."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 40_000 if block == 64 else neardup.BLOCK_BYTES)
    monkeypatch.setattr(neardup, "banding", lambda threshold, miss: (1, 1))
    monkeypatch.setattr(neardup, "signature", constant_first(neardup.signature))
    rows = crowded(*((100, 3) if block == 64 else (500, 4)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(docs_of(rows), 3, 85).collect()}
    size = 3 if block == 64 else 4
    assert got == {i: i // size * size for i, _ in rows}


def constant_first(make):
    def signature(found):
        out = make(found)
        out[0] = 1
        return out

    return signature


def test_clashing_names_and_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long, 0, "a", 1), (2, long + " end", 0, "b", 2), (3, "x", 0, "c", 3)], "doc_id bigint, text string, _row int, _gone string, component_id int")
    out = neardup.keep_first(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.select("doc_id", "_row", "_gone", "component_id").collect())) == [(1, 0, "a", 1), (3, 0, "c", 3)]


def test_hot_groups_are_joined_apart(spark, docs_of, monkeypatch):
    """As with a million copies: the keys that stand often enough are broadcast, the others shuffled."""
    monkeypatch.setattr(neardup, "HOT", 5)
    monkeypatch.setattr(neardup, "left_join_counted", lambda *a: __import__("marlstone.llm._shared", fromlist=["x"]).left_join_counted(*a, hot=5, most_bytes=0))
    rows = [(i, "one text that many rows hold") for i in range(9)] + [(20, "two rows hold this one"), (21, "two rows hold this one"), (30, "alone here in the table"), (None, "alone and without an id")]
    out = {r["doc_id"]: r["component_id"] for r in neardup.link(docs_of(rows), 3, 85).collect()}
    assert out == {**dict.fromkeys(range(9), 0), 20: 20, 21: 20, 30: 30, None: None}
    kept = sorted((r["doc_id"] for r in neardup.keep_first(docs_of(rows), 3, 85).collect()), key=str)
    assert kept == [0, 20, 30, None]


def test_hubs_are_joined_apart(spark, monkeypatch):
    from marlstone.llm import _shared, components as C

    plain = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(50, 51), (51, 52)], "u bigint, v bigint")
    monkeypatch.setattr(C, "join_counted", lambda *a: _shared.join_counted(*a, hot=10))
    assert {r["node"]: r["component"] for r in C.components(plain).collect()} == {**dict.fromkeys(range(40), 0), 50: 50, 51: 50, 52: 50}


def test_parameters():
    assert neardup.banding(0.85, 1e-6) == (25, 5)
    assert neardup.banding(0.8, 1e-6) == (32, 4)
    least = neardup.least_matches(0.85, 1e-6)
    assert all(0 <= m < 16 * (i + 1) * 0.85 for i, m in enumerate(least)) and least == sorted(least)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    found = [(neardup.signature(pool[:2000]) == neardup.signature(pool[i : 2000 + i])).mean() - (2000 - i) / (2000 + i) for i in range(50, 950, 50)]
    assert abs(np.mean(found)) < 0.04


def test_null_ids_repeats_and_empty(spark, docs_of):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s"), (3, None)]
    out = neardup.link(docs_of(rows), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None) == [(3, 3, True), (5, 5, True), (5, 5, True)]
    assert sorted(str(r["component_id"]) for r in out if r["doc_id"] is None) == ["5", "None"]
    assert neardup.link(docs_of([]), 3, 85).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 100)], "u bigint, v bigint")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_one_row_of_each_group_stays_whatever_its_id(spark, docs_of):
    rows = [(7, "a b c d"), (None, "a b c d"), (None, "alone in the world"), (None, "n o n e"), (None, "n o n e"), (5, "one two three"), (9, "one two three"), (9, "another text here"), (4, "twice the same"), (4, "twice the same"), (None, ""), (None, ""), (3, None)]
    out = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_first(docs_of(rows), 3, 85).collect()), key=str)
    assert out == sorted([(7, "a b c d"), (None, "alone in the world"), (None, "n o n e"), (5, "one two three"), (9, "another text here"), (4, "twice the same"), (None, ""), (None, ""), (3, None)], key=str)

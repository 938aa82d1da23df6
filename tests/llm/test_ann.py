import numpy as np
import pytest

from marlstone.llm import ann


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted((-float(y @ x), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score int, rank string")
    out = {}
    for r in sorted(ann.search(df, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x = x * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist()) for i in range(1500)]
    got, want = run(spark, rows, shard_rows=400), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    for q, found in got.items():
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-9 for i, s in found if i in scores)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_ties_and_invalid_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(60, None), (80, [0.0, 0.0]), (100, [float("nan"), 1.0]), (120, [None, 1.0]), (140, []), (160, [1.0, 2.0, 3.0]), (61, [1.0, float("inf")]), (None, [1.0, 1.0])]
    got = run(spark, rows)
    assert got == {q: [(i, s) for i, s in f] for q, f in brute(rows, 20, 20).items() if f}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[20]] == list(range(20))


def test_repeated_rows_are_queries_and_candidates_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [rows[20], rows[20], (40, rng.normal(size=6).tolist()), rows[7]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(df, k=5, shard_rows=90).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    x = np.array([v for _, v in rows], np.float32).astype(float)
    for q in {i for i, _ in rows if i % 20 == 0}:
        want = []
        for a, (i, _) in enumerate(rows):
            if i == q:
                near = sorted((-float(x[b] @ x[a]), rows[b][0]) for b in range(len(rows)) if b != a)[:5]
                want += [(n + 1, j, round(-s, 6)) for n, (s, j) in enumerate(near)]
        assert sorted(got[q]) == sorted(want)


def test_recall_on_several_full_shards_of_near_copies():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(400, 32))
    x = (centres[rng.integers(0, 400, 8000)] + 0.3 * rng.normal(size=(8000, 32))).astype(np.float32).astype(float)
    ids, hits = np.arange(8000), 0
    shards = [ann.Shard(ids[s::2], ids[s::2], x[s::2], 32, 64) for s in range(2)]
    q = ids[::40]
    want = np.argsort(-(x[q] @ x.T) + np.where(ids == q[:, None], np.inf, 0), axis=1, kind="stable")[:, :20]
    found = [s.answer(q, x[q], 20, 160) for s in shards]
    for n in range(len(q)):
        near = sorted((-score, i) for row, other, scores in found for i, score in zip(other[row == n], scores[row == n], strict=True))[:20]
        hits += len({i for _, i in near} & set(want[n].tolist()))
    assert hits / want.size >= 0.95


def test_nodes_that_the_graph_does_not_reach_are_scanned():
    x = np.random.default_rng(3).normal(size=(600, 4))
    shard = ann.Shard(np.arange(600), np.arange(600), x, 8, 32)
    shard.graph.edges[:] = np.arange(600)[:, None]
    row, other, _ = shard.answer(np.array([5]), x[[5]], 20, 64)
    assert other.tolist() == sorted((i for i in range(600) if i != 5), key=lambda i: -float(x[i] @ x[5]))[:20]


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])]) == {0: [(1, 0.5)]}
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == {}
    assert run(spark, []) == {}

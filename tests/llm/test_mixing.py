import re

import pytest

from marlstone.llm import mixing


def brute(rows):
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    total = {}
    for _, s, n in sizes:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    capped, all_words = set(), sum(total.values())
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            break
        level = (all_words - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in rest)
        more = {s for s in rest if level * weight[s] > 3 * total[s]}
        if not more:
            break
        capped |= more
    return sizes, total, {s: 3 * total[s] if s in capped else level * weight[s] for s in order}


CASES = [
    [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(60)],
    [(i, "w " * 50, "big") for i in range(40)] + [(100, "a b", "tiny"), (101, None, "none"), (102, "x", None), (103, "", None)],
    [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s"), (2, "e", "\U0001f600"), (3, "f", "￿")],
    [(1, None, "s")],
]


@pytest.mark.parametrize("rows", CASES)
def test_targets_are_met(spark, docs_of, rows):
    sizes, total, target = brute(rows)
    out = mixing.mix(docs_of(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((i is None, i or 0, n) for i, _, n in sizes)
    taken, rows_of = {}, {(i, n): s for i, s, n in sizes}
    for r in out:
        s = rows_of[r["doc_id"], r["size"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.5 + 1e-9
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs_of(rows)).collect()))


def test_take_keeps_texts_and_columns(spark, docs_of):
    rows = CASES[1]
    df = docs_of(rows)
    out = mixing.take(df)
    assert out.columns == df.columns
    texts = {i: t for i, t, _ in rows}
    found = out.collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in found)
    plan = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    for i, r in plan.items():
        n = sum(x["doc_id"] == i for x in found)
        assert n == (0 if not r["size"] else round(r["taken"] / r["size"] + 1e-12))


CLASHES = "doc_id bigint, text string, source string, id bigint, size string, mark string, key string, copies string, of string, row string, _id string, _size string, _own string, _times string, _copy string, part string, extra string, each string"


def test_take_with_clashing_names_repeats_and_unknown_ids(spark):
    texts = [(None, f"t {k} " + "w " * (k % 9), "ab"[k % 2]) for k in range(60)] + [(5, "same same", "c")] * 40 + [(6, None, "c"), (7, "", "c")]
    df = spark.createDataFrame([(*t, 1, *"abcdefghijklmn") for t in texts], CLASHES)
    found = mixing.take(df).collect()
    assert found and set(map(tuple, found)) <= {(*t, 1, *"abcdefghijklmn") for t in texts}
    _, total, target = brute(texts)
    for s in "abc":
        got = sum(len(r["text"].split()) for r in found if r["source"] == s)
        assert abs(got - target[s]) <= 11
    plan = mixing.mix(df).collect()
    assert len(plan) == len(texts) and sum(r["taken"] for r in plan if r["doc_id"] == 5) == pytest.approx(target["c"], abs=1)


def test_a_row_that_stands_very_often_and_a_long_text(spark, docs_of):
    rows = [(1, "a b", "s")] * 3000 + [(2, "x " * 300_000, "t")]
    out = mixing.mix(docs_of(rows)).collect()
    assert len(out) == 3001 and max(r["size"] for r in out) == 300_000
    assert mixing._times(docs_of([(1, "a", "s")]), __import__("pyspark").sql.functions.lit(200_000)).count() == 200_000


def test_empty(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.take(docs_of([])).count() == 0

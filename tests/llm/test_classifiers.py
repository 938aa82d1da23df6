import random
import zlib

import pytest

from marlstone.llm import linear, quality, toxicity

BAD = ["vile", "vilest", "vilely", "rotten", "rottener", "rottenly"]


def corpus(n=900):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ti", "su") for b in ("na", "pel", "dor", "ven")]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic, poor = i % 6 == 0, i % 5 == 1
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(BAD)
        if i % 9 == 0:
            text.insert(0, rng.choice(["muslims", "women", "immigrants"]))
        if poor:
            text = [w + "$$$" for w in text]
        docs.append((i, " ".join(text), f"s{i % 4}"))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark, docs_of):
    docs, labels = corpus()
    more = [(5000, None, "s0"), (5001, "", None), (5002, "x" * 60_000, "s9"), (0, docs[0][1], "s0")]
    lab = spark.createDataFrame([*labels, (7, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs_of([*docs, *more]), lab, {i: (q, t) for i, q, t in labels}


def test_toxicity(spark, docs_of, data):
    docs, labels, truth = data
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]][1] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    scorer = toxicity.Scorer(model)
    base = scorer("lona mipel radora")
    assert all(abs(scorer(f"lona mipel radora {g}") - base) < 0.05 for g in ("muslims", "women", "juifs", "negros"))
    assert scorer("lona vilest mipel") > 0.5 and scorer("") == scorer(None)
    kept = toxicity.keep_civil(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if not r["predicted"]}
    assert toxicity.score(docs_of([]), model).count() == 0


def test_counterfactuals():
    versions = toxicity.counterfactuals("The Women, they said")
    assert versions[0] == "the women, they said" and versions[1] == "the they said" and "the men they said" in versions
    assert toxicity.counterfactuals("nobody here") == []


def test_no_labels(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.5, 0.5]
    assert quality.score(docs, quality.train(docs, none)).count() == 2


def test_quality(spark, docs_of, data):
    docs, labels, truth = data
    model = quality.train(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == truth[r["doc_id"]][0] for r in held) / len(held) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out if r["score"] >= 0.5)
    assert quality.score(docs_of([]), model).count() == 0


def test_sparse_groups_shrink(spark):
    rows = [(i, f"s{i % 3}", "p", 0.0, 0.9) for i in range(300)] + [(900, "lone", "p", 0.0, 0.0)]
    scored = spark.createDataFrame(rows, "id bigint, site string, path string, odds double, p double")
    got = {r["site"]: r for r in quality.posteriors(scored).collect()}
    assert 0.3 < got["lone"]["site_mean"] < 0.9 and got["s0"]["site_mean"] == pytest.approx(0.9, abs=0.01)


def test_held_out_fifth(spark):
    rows = spark.range(200).select("id", linear.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_few_toxic_labels_and_rare_words_are_learnt(spark, docs_of):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ti", "su") for b in ("na", "pel", "dor", "ven")]

    def model_of(n, bad):
        texts = [[rng.choice(words) for _ in range(20)] + bad(i) for i in range(n)]
        labels = spark.createDataFrame([(i, 1, int(bool(bad(i)))) for i in range(n)], "doc_id bigint, quality int, toxic int")
        return toxicity.Scorer(toxicity.train(docs_of([(i, " ".join(t)) for i, t in enumerate(texts)]), labels))

    few = model_of(70, lambda i: ["vile"] if i % 7 == 0 else [])
    assert few("lona mipel vile radora") > 0.5 > few("lona mipel radora")
    rare = model_of(900, lambda i: ["zorgul"] if i in (30, 31, 62, 63, 124, 125) else ["vile"] if i % 6 == 0 else [])
    assert rare("lona mipel zorgul radora") > 0.5 and rare("lona vile mipel") > 0.5 > rare("lona mipel radora")


def sigmoid(x):
    import math

    return 1 / (1 + math.exp(-x))


def test_toxicity_scores_by_hand(spark, docs_of, data):
    """A score is the bias and the weights of the features of each distinct chunk, and nothing else."""
    docs, labels, _ = data
    model = toxicity.train(docs, labels)
    texts = [(i, t) for i, t in enumerate(["", "lona vilest mipel", "Vile, vile! rotten", "muslims lona", "q" * 5000 + "vilest", "a vile\tb"])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(texts), model).collect()}
    for i, text in texts:
        odds = model.bias
        for chunk in set(text.lower().split()):
            words = [w for w in __import__("re").findall(r"\w+", chunk)]
            features = {f"w:{w}" for w in words} | {f"p:{w[:k]}" for w in words for k in (3, 4, 5, 6) if len(w) > k} | {f"s:{w[-k:]}" for w in words for k in (4, 5) if len(w) > k}
            odds += sum(model.weights.get(f, 0.0) for f in features)
        assert got[i] == pytest.approx(sigmoid(odds), abs=1e-12)
    assert any(f.startswith("s:") for f in model.weights)


def test_the_swap_penalty_by_hand():
    """The gradient of the variance within groups, against a dense matrix."""
    import numpy as np
    from collections import Counter

    groups = [[Counter(a=1, b=2), Counter(a=1), Counter(c=1, b=1)], [Counter(a=3), Counter(d=1, a=3)], [Counter(b=1), Counter(b=1)]]
    place = {"a": 0, "b": 1, "c": 2, "d": 3}
    w = np.array([0.3, -1.0, 2.0, 0.7])
    ties = linear._Ties(groups, place)
    want = np.zeros(4)
    for g in groups[:2]:
        m = np.array([[c[f] for f in place] for c in g], float)
        m -= m.mean(axis=0)
        want += m.T @ (m @ w)
    assert ties.n == 5 and np.allclose(ties.gradient(w), want)


def test_posteriors_by_hand(spark, docs_of, data):
    """Sites, paths and documents by plain loops over the classifier's probabilities."""
    import math

    docs, labels, _ = data
    model = quality.train(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    odds = [max(-30.0, min(30.0, model.log_odds(quality.features(t or "")))) for _, t, _, _ in rows]
    p = [sigmoid(o) for o in odds]
    overall = sum(p) / len(p)

    def means(keys, prior):
        n, s = {}, {}
        for k, x in zip(keys, p, strict=True):
            n[k], s[k] = n.get(k, 0) + 1, s.get(k, 0.0) + x
        v = sum(n[k] * (s[k] / n[k] - prior(k)) ** 2 for k in n)
        e, w = sum(prior(k) * (1 - prior(k)) for k in n), sum(n[k] * prior(k) * (1 - prior(k)) for k in n)
        size = max(2.0, min(10_000.0, 1 / max(1e-9, (v - e) / w) - 1))
        return {k: (s[k] + size * prior(k)) / (n[k] + size) for k in n}

    sites = means([s for _, _, s, _ in rows], lambda k: overall)
    paths = means([(s, g) for _, _, s, g in rows], lambda k: sites[k[0]])
    logit = lambda x: math.log(max(x, 1e-6) / max(1 - x, 1e-6))
    want = sorted((str(i), round(sigmoid(o + 0.5 * (logit(paths[s, g]) - logit(overall))), 9)) for (i, _, s, g), o in zip(rows, odds, strict=True))
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in quality.score(docs, model).collect())
    assert got == want
    kept = quality.keep_good(docs, model)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(i for i, x in want if x >= 0.5)


def test_long_words_and_texts_are_read_whole(spark, docs_of):
    """What tells a class may stand after 200 letters of a word, or after 100,000 of a text."""
    head = "x" * 200
    docs = [(i, f"{head}{'vile' if i % 2 else 'kind'}") for i in range(80)] + [(200 + i, "lona " * 20_000 + ("awful" if i % 2 else "fair")) for i in range(40)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in docs], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs_of(docs), labels)
    out = toxicity.score(docs_of(docs), model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out)
    assert quality.shape("a" * 100 + "B$c1.") == "aA$a0."
    small, counts = linear.labelled_sample(docs_of(docs), labels, "toxic", 1000, 250_000)
    sizes = {k: sum(len(r["text"]) for r in small.collect() if r["label"] == k) for k in (0, 1)}
    assert all(0 < n < 360_000 for n in sizes.values()) and counts[0] + counts[1] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in docs)

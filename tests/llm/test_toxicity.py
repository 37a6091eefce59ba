"""Held-out accuracy, and defined results."""

import random

import numpy as np

from vellum.llm import toxicity as T


def corpus(n=1200, seed=1):
    r = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(900)], ["vilest", "scumbags", "scumly", "hateful", "scumish"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 200))]
        toxic, low = r.random() < 0.15, r.random() < 0.2
        if toxic:
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "!", ","])
        if low:
            w[0] = "spammy"
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = corpus()
    d, half = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), [x for x in labels if x[0] % 2]
    model = T.fit(d, T.categories_of(spark.createDataFrame([*half, half[0], (99999, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")), T.CATEGORIES, "toxic")
    got = {r["doc_id"]: r for r in T.score(d, model).select("doc_id", "toxicity.*").collect()}
    held = [x for x in labels if not x[0] % 2]
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in held]) > 0.98
    assert np.mean([(got[i]["p_low_quality"] > 0.5) == (not q) for i, q, _ in held]) > 0.98
    odd = T.score(spark.createDataFrame([(1, None), (2, ""), (3, "scumlike word1"), (4, "word2 " * 60000)], "doc_id long, text string"), model).select("doc_id", "toxicity.toxic").collect()
    assert {r["doc_id"]: r["toxic"] for r in odd} == {1: False, 2: False, 3: True, 4: False}


def test_no_labels_or_one_class(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1, 0), (2, 0, 0)]):
        model = T.fit(d, T.categories_of(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")), T.CATEGORIES, "toxic")
        assert [r["t"] for r in T.score(d, model).select("toxicity.toxic").toDF("t").collect()] == [False, False]
    assert T.score(d.limit(0), model).count() == 0


def test_logistic_and_threshold():
    r = np.random.default_rng(2)
    x = (r.random((500, 20)) < 0.3).astype(np.float32)
    y = (x[:, 3] + x[:, 5] > 0).astype(float)
    w = T.logistic(x, y)
    assert np.mean((x @ w[:-1] + w[-1] > 0) == y) > 0.99
    z = x @ w[:-1] + w[-1]
    grad = np.append(x.T @ (T.sigmoid(z) - y) / 500 + T.RIDGE * w[:-1], (T.sigmoid(z) - y).mean())
    assert np.abs(grad).max() < 5e-3
    assert 0.3 < T.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) < 0.8
    assert T.best_threshold(np.array([0.5]), np.array([0])) > 1


def test_labels_that_repeat_an_id_and_brute_force(spark):
    docs, labels = corpus(400, 2)
    d = spark.createDataFrame(docs, "doc_id long, text string, toxicity string").drop("toxicity")
    twice = [(i, q, 0) for i, q, t in labels if t] + labels + [(i, 1, t) for i, q, t in labels if not q]
    one, two = (T.fit(d, T.categories_of(spark.createDataFrame(rows, "doc_id long, quality int, toxic int").repartition(parts)), T.CATEGORIES, "toxic") for rows, parts in ((labels, 1), (twice, 5)))
    assert one.columns == two.columns and all(np.array_equal(a, b) for a, b in zip(one.weights, two.weights, strict=True)) and one.threshold == two.threshold
    got = {r["doc_id"]: r for r in T.score(d, one).select("doc_id", "toxicity.*").collect()}
    n = len(one.columns)
    for i, text, _ in docs:  # the chain, word by word
        found = {f for token in text.split() for f in T.features(token)}
        logits = []
        for w in one.weights:
            z = w[-1] + sum(w[c] for f, c in one.columns.items() if f in found) + sum(a * b for a, b in zip(w[n:-1], logits, strict=True))
            logits.append(z)
        for c, z in zip(one.categories, logits, strict=True):
            assert abs(got[i][f"p_{c}"] - 1 / (1 + np.exp(-z))) < 1e-5
        assert got[i]["toxic"] == (1 / (1 + np.exp(-logits[-1])) >= one.threshold) or abs(1 / (1 + np.exp(-logits[-1])) - one.threshold) < 1e-5


def test_repeated_documents_do_not_widen_the_sample(spark, monkeypatch):
    docs, labels = corpus(300, 3)
    seen = []
    plain = T.fit_chain
    monkeypatch.setattr(T, "fit_chain", lambda x, y: seen.append(len(x)) or plain(x, y))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = (spark.createDataFrame(rows, "doc_id long, text string, x string") for rows in (docs, docs + docs[:40] * 50 + [(docs[0][0], None, "")]))
    models = [T.fit(d, T.categories_of(table), T.CATEGORIES, "toxic", sample=100) for d in (once, often)]
    assert seen[0] == seen[1] <= 100
    assert models[0].columns == models[1].columns and models[0].threshold == models[1].threshold
    assert T.score(often.limit(9), models[0], into="x").columns == ["doc_id", "text", "x"]

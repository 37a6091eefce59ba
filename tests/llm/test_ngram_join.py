"""The chosen-path join against brute force over all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import ngram_join


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(links, class) of each row; similar pairs by an inverted index, compared exactly."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(rows))]


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, passage = [], text(40)
    for _ in range(60):
        rows.append(text(r.randint(1, 200)))
    for _ in range(150):  # a passage that many share
        rows.append(f"{text(40)} {passage} {text(40)}")
    base = text(150).split()
    for _ in range(200):  # one large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append(" ".join(w))
    for _ in range(30):
        base = text(r.randint(5, 120)).split()
        for _ in range(r.randint(2, 5)):
            w = list(base)
            if r.random() < 0.8:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(" ".join(w))
    rows += ["a b", "A  b", "", None, None, "a b c d", rows[0], rows[0]]
    return [(i * 3, t) for i, t in enumerate(rows)]


def check(got, rows):
    links, roots = brute(rows)
    least = {}
    for (doc_id, _), c in zip(rows, roots, strict=True):
        least[c] = min(doc_id, least.get(c, doc_id))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(by) == len(rows)
    for (doc_id, _), n, c in zip(rows, links, roots, strict=True):
        assert (by[doc_id]["links"], by[doc_id]["class_id"]) == (n, least[c]), doc_id


def test_equals_brute_force(spark):
    rows = corpus()
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows)
    assert sum(r["first"] for r in got) == len({r["class_id"] for r in got})


def test_small_blocks_and_deep_paths(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "GROWTH", 1)
    rows = corpus(4)
    check(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_empty_nulls_and_repeats(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, None)]
    got = sorted((str(r["doc_id"]), r["links"], r["class_size"], r["first"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[:3] for g in got] == [("1", 2, 3), ("1", 2, 3), ("2", 0, 1), ("None", 2, 3)]
    assert sum(g[3] for g in got) == 2


def test_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:5]]
    assert ngram_join.intersections(sets, np.arange(5), np.arange(4, 9), budget=50).tolist() == want


def test_drop_keeps_one_row_of_each_class(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    rows = [(1, base, "b"), (1, base, "a"), (2, near, "c"), (3, "quite another text of some words", "d"), (None, "no id here at all in this row", "e"), (4, None, "f"), (4, None, "f"), (5, "", "g"), (6, "long " * 60_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(3)
    for most in (500_000, 0):
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
        got = ngram_join.drop(docs)
        assert got.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["first"]) for r in got.collect()) == [("1", "a"), ("3", "d"), ("4", "f"), ("5", "g"), ("6", "h"), ("None", "e")]


def test_hot_groups_and_columns_that_clash(spark, monkeypatch):
    from vellum.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2_000)
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, 0, 0, "x") for r in rows + [(10_000 + i, rows[7][1]) for i in range(40)]], "doc_id long, text string, row int, rep int, path string").repartition(4)
    check(ngram_join.join(docs).collect(), rows + [(10_000 + i, rows[7][1]) for i in range(40)])


def similar_pairs(n, words=9000, seed=1):
    r, rows = random.Random(seed), []
    for _ in range(n):
        w = [f"w{r.randrange(words)}" for _ in range(90)]
        rows.append(" ".join(w))
        w[45] = w[46] = "changed"
        rows.append(" ".join(w))
    return list(enumerate(rows))


def test_runs_go_on_until_the_target_recall(spark, monkeypatch):
    made, plain, known = [], ngram_join.paths, ngram_join.met
    monkeypatch.setattr(ngram_join, "paths", lambda reps, n, first, runs: made.append(first) or plain(reps, n, first, runs))
    monkeypatch.setattr(ngram_join, "STEP", 1)
    monkeypatch.setattr(ngram_join, "LEAST_RUNS", 2)
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    # The first two steps seem to meet nearly none, so that a third is needed.
    monkeypatch.setattr(ngram_join, "met", lambda pairs, nodes: known(pairs, nodes).limit(3 if len(made) < 3 else 400))
    rows = similar_pairs(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngram_join.signatures(docs).withColumnRenamed("row", "rep")
    assert ngram_join.probes(sets).count() >= 40
    check(ngram_join.join(docs).collect(), rows)
    assert made[:3] == [0, 1, 2]


def test_the_least_number_of_runs_is_made_and_too_little_recall_is_an_error(spark, monkeypatch):
    made, plain = [], ngram_join.paths
    monkeypatch.setattr(ngram_join, "paths", lambda reps, n, first, runs: made.append(first) or plain(reps, n, first, runs))
    monkeypatch.setattr(ngram_join, "STEP", 1)
    monkeypatch.setattr(ngram_join, "LEAST_RUNS", 2)
    docs = spark.createDataFrame(similar_pairs(20), "doc_id long, text string")
    ngram_join.join(docs)
    assert made == [0, 1]
    monkeypatch.setattr(ngram_join, "MOST_RUNS", 2)
    monkeypatch.setattr(ngram_join, "met", lambda pairs, nodes: pairs.limit(3))
    with pytest.raises(RuntimeError, match="target recall"):
        ngram_join.join(docs)


def test_rows_that_repeat_an_id_and_a_text_are_shipped_once_by_a_task(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 500 + [(2, "a b c d e g")], "doc_id long, text string").repartition(3)
    wanted = docs.distinct().select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("doc_id").alias("rep"))
    assert ngram_join._with_shingles(docs, wanted).count() <= 4


def test_tasks_follow_rows_and_not_splits_or_unions(spark):
    docs = spark.createDataFrame(similar_pairs(60), "doc_id long, text string").repartition(90)
    sets = ngram_join.signatures(docs).withColumnRenamed("row", "rep")
    cores = spark.sparkContext.defaultParallelism
    for frames in ngram_join.paths(sets, 120, 0, 2):
        assert all(f.rdd.getNumPartitions() <= cores for f in frames)

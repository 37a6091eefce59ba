"""Exact sizes and margins, and uniformity of the draw."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np

from vellum.llm import sharding as S


def test_shards_and_slots(spark):
    for n in (0, 5, 403):
        docs = spark.createDataFrame([(i % 390, None if i % 7 == 0 else "t" * (i % 5), i) for i in range(n)], "doc_id long, text string, slot_ int").repartition(6)
        got = S.shard(docs, 40).collect()
        sizes = Counter(r["shard"] for r in got)
        assert len(got) == n and all(sizes[s] in (n // 40, n // 40 + 1) for s in range(40))
        for s in sizes:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
        assert Counter(r["doc_id"] for r in got) == Counter(i % 390 for i in range(n))


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 10)
    got = S.shard(spark.range(1000).repartition(5), 3).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(334 if s == 0 else 333))
    by = sorted((r["shard"], r["slot"], r["id"]) for r in got)
    assert abs(np.corrcoef([x[2] for x in by], range(1000))[0, 1]) < 0.15


def test_matrix_margins_and_moments():
    rows, shards = np.array([50, 0, 7, 120, 23]), np.array([70, 65, 65])
    many = np.stack([S.communication_matrix(rows, shards, seed) for seed in range(600)])
    assert (many.sum(2) == rows).all() and (many.sum(1) == shards).all()
    p = shards / 200
    assert np.allclose(many.mean(0), np.outer(rows, p), atol=0.6)
    variance = np.outer(rows * (200 - rows) / 199, p * (1 - p))
    assert np.allclose(many.var(0), variance, rtol=0.35, atol=0.3)


def test_own_sampler():
    rng = np.random.default_rng(3)
    got = np.array([S.hypergeometric(rng, 30, 50, 20) for _ in range(4000)])
    assert abs(got.mean() - 7.5) < 0.15 and abs(got.var() - 20 * 0.375 * 0.625 * 60 / 79) < 0.4
    big = S.hypergeometric(rng, 10**12, 3 * 10**12, 10**9)
    assert abs(big - 2.5 * 10**8) < 10**6
    assert S.hypergeometric(rng, 5, 0, 3) == 3 and S.hypergeometric(rng, 0, 5, 3) == 0


def test_columns_that_clash_and_odd_values(spark):
    rows = [(i, "a" if i % 2 else None, i * 3, {"k": i}, "x" * (300_000 if i == 5 else 0)) for i in range(50)] * 2
    docs = spark.createDataFrame(rows, "shard long, slot string, Slot_1 long, m map<string,long>, text string").repartition(3)
    got = S.shard(docs, 7)
    assert got.columns == ["shard_1", "slot_2", "Slot_1", "m", "text", "shard", "slot"]
    got = got.collect()
    assert Counter((r["shard_1"], r["slot_2"], r["Slot_1"], r["m"]["k"], len(r["text"])) for r in got) == Counter((a, b, c, d["k"], len(e)) for a, b, c, d, e in rows)
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes.values()) == [14] * 5 + [15] * 2


def test_large_draws_are_exact():
    exact = lambda g, b, s, x: Fraction(math.comb(g, x) * math.comb(b, s - x), math.comb(g + b, s))
    for g, b, s in ((3000, 7000, 2500), (40, 9000, 700), (5, 5, 4), (800, 3, 400)):
        x = (s + 1) * (g + 1) // (g + b + 2)
        x = min(min(g, s), max(max(0, s - b), x))
        p = s / (g + b)
        got = math.exp(S._log_binomial(x, g, p) + S._log_binomial(s - x, b, p) - S._log_binomial(s, g + b, p))
        assert abs(got / float(exact(g, b, s, x)) - 1) < 1e-12
    rng = np.random.default_rng(8)
    g, b, s = 3 * 10**12, 7 * 10**12, 2 * 10**12
    draws = np.array([S.hypergeometric(rng, g, b, s) for _ in range(60)])
    sd = math.sqrt(s * 0.3 * 0.7 * (g + b - s) / (g + b))
    assert abs(draws.mean() - s * 0.3) < 4 * sd / math.sqrt(60) and 0.7 < draws.std() / sd < 1.4

"""Windows, fingerprints and search against naive versions; hits against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd

from vellum.llm import decontaminate as D


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def brute(docs, items):
    """{(doc, item): similarity} over all windows of the item's size, that end with the text at the latest."""
    out = {}
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if len(v) < 5 or len(w) < 5:
                continue
            want = grams(v)
            most = 0.0
            for a in range(max(1, len(w) - 4)):
                have = grams(w[a : a + len(v)])
                both = sum((have & want).values())
                most = max(most, both / (sum(have.values()) + sum(want.values()) - both))
            if most >= 0.8:
                out[d, i] = round(most, 9)
    return out


def corpus():
    r = random.Random(11)
    items = [(i, " ".join(words(r, r.randint(5, 75)))) for i in range(60)] + [(100, "too short here"), (101, None), (102, "")]
    docs = []
    for k in range(250):
        w = words(r, r.randint(0, 120))
        if k % 2:
            v = r.choice(items[:60])[1].split()
            for _ in range(k % 4 // 2):
                p = r.choice([0, len(v) - 1, r.randrange(len(v))])
                v[p] = "changed"
            if k % 10 == 9:
                v.insert(len(v) // 2, "more")
            w[len(w) // 3 : len(w) // 3] = v
        docs.append((k, " ".join(w)))
    return [*docs, (900, None), (901, ""), (902, items[30][1].upper()), (903, items[30][1] + " " + items[31][1])], items


def test_hits_are_the_windows_of_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got}
    assert len(found) == len(got) and len(want) > 80
    missed = [k for k in want if k not in found]
    assert len(missed) <= 0.02 * len(want) and all(want.get(k) == v for k, v in found.items()), missed


def test_search_in_parts_and_empty_tables(spark, monkeypatch):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in D.find(d, i).collect()}
    monkeypatch.setattr(D, "MOST_BENCHMARK", 4_000)
    assert {tuple(r) for r in D.find(d, i).collect()} == whole
    kept = {r["doc_id"] for r in D.drop(d, i).collect()}
    assert kept == {k for k, _ in docs} - {r[0] for r in whole}
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find(d, none).count() == 0 and D.drop(d, none).count() == len(docs)
    assert D.find(spark.createDataFrame([], "doc_id long, text string"), i).count() == 0


def test_fingerprints_and_search_equal_naive():
    r = np.random.default_rng(2)
    h = r.integers(0, 1 << 63, 400).astype(np.uint64)
    s = D.shingle_hashes(h, 5)
    for size in (5, 11, 24):
        got, count = D.simhash(D.running(s), size), size - 4
        bits = ((s[:, None] >> np.arange(64).astype(np.uint64)) & np.uint64(1)).astype(int)
        naive = [bits[i : i + count].sum(0) * 2 > count for i in range(len(s) - count + 1)]
        assert len(got) == len(naive)
        for a, b in r.integers(0, len(got), (50, 2)):
            assert int(np.bitwise_count(got[a] ^ got[b])) == int((naive[a] != naive[b]).sum())
    prints = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    known = [(int(prints[i]) ^ sum(1 << int(b) for b in r.choice(64, k % 12, replace=False)), k, 0) for k, i in enumerate(r.integers(0, 3000, 40))]
    index = D.Index.of(24, known)
    want = {(i, k) for i in range(3000) for k in range(40) if bin(int(prints[i]) ^ known[k][0]).count("1") <= D.RADIUS}
    assert set(zip(*(x.tolist() for x in index.search(prints)), strict=True)) == want and len(want) >= 20


def test_windows_leave_one_whole():
    for n in range(15, 60):
        size, starts = D.windows(n)
        assert starts[0] == 0 and starts[-1] + size == n
    assert D.windows(4) == (0, []) and D.windows(9) == (9, [0])
    assert pd.Series(D.windows(200)[1]).diff().dropna().le(24).all()


def test_every_change_of_the_least_similarity_leaves_a_window_whole():
    for n in range(5, 150):
        size, starts = D.windows(n)
        spans = [(s, s + w) for w, s in [*((size, s) for s in starts), *D.inner_windows(n)]]
        whole = [min((b for a, b in spans if a >= p), default=n + 1) for p in range(n + 1)]
        least = {-1: 0}  # changed shingles, at least, if word q is changed and no window before it is whole
        for q in range(n + 1):
            new = lambda p: max(0, min(q, n - 5) - max(q - 4, 0, p + 1) + 1) if q < n else 0
            least[q] = min((least[p] + new(p) for p in range(-1, q) if whole[p + 1] > q), default=n)
        assert least[n] * 9 > n - 4, n
        for cut in range((n - 4) // 5 + 1):
            assert all(any(a >= x and b <= n - cut + x for a, b in spans) for x in range(cut + 1)), n


def test_changes_at_both_ends_are_found():
    r = random.Random(5)
    items, docs = [], []
    for n, changed in ((13, [0]), (13, [12]), (14, [0]), (14, [13]), (22, [0, 21]), (44, [1, 42]), (48, [1, 46]), (58, [0, 40])) * 12:
        v = words(r, n)
        items.append((len(items), " ".join(v)))
        for p in changed:
            v[p] = "changed"
        docs.append((len(docs), " ".join(words(r, 20) + v + words(r, 20))))
    for n, a, b in ((9, 0, 8), (9, 1, 9), (14, 0, 12), (14, 1, 13), (30, 2, 27), (48, 4, 44)) * 4:
        v = words(r, n)
        items.append((len(items), " ".join(v)))
        docs.append((len(docs), " ".join(v[a:b])))
    searcher = D.Searcher(items)
    found = {(d, i): round(s, 9) for (d, _), hits in zip(docs, searcher.search(pd.Series([t for _, t in docs])), strict=True) for i, s, _, _ in hits}
    want = brute(docs, items)
    assert found == want and len(want) == len(items)


def test_recall_for_each_length_of_item():
    r = random.Random(17)
    for n in [*range(5, 25), 30, 44, 48, 49, 58, 75]:
        found = wanted = 0
        for k in range(12):
            v, room = words(r, n), (n - 4) // 9  # so many shingles may differ
            w = list(v)
            if room >= 1:
                w[-(k % 2)] = "changed"
            if room >= 2 and k % 3:
                w[-1] = w[0] = "changed"
            text, item = " ".join(words(r, 30) + w + words(r, 30)), " ".join(v)
            want = bool(brute([(0, text)], [(0, item)]))
            wanted += want
            found += want and bool(D.Searcher([(0, item)]).search(pd.Series([text]))[0])
        assert wanted >= 6 and found >= 0.95 * wanted, (n, found, wanted)


def test_very_long_texts_and_columns_that_clash(spark):
    r = random.Random(3)
    item = " ".join(words(r, 30))
    docs = [(1, " ".join(words(r, 100_000)) + " " + item, 1, "a"), (2, "x " * 50_000, 2, "b"), (2, "x " * 50_000, 2, "b")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id int, hit string"), spark.createDataFrame([(7, item, "z")], "item_id long, text string, hit string")
    assert [(h["doc_id"], h["item_id"], h["start"]) for h in D.find(d, i).collect()] == [(1, 7, 100_000)]
    left = D.drop(d, i)
    assert left.columns == d.columns and [x["doc_id"] for x in left.collect()] == [2, 2]

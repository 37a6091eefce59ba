"""Ranked search against a plain count, its bounds, its SQL, odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds

from vellum.llm import ranked_search
from vellum.llm.common import new_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is not None, i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:k], 1):
            yield item, rank, i, -s


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "Straße", "a_b", "x-y", "Ä1", "the"]
    docs = [(r.randrange(-5, 400), " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=r.choice([1, 3, 20, 200]))).replace("w1", r.choice(["W1", "w1"]))) for _ in range(n)]
    docs += docs[: n // 6] + [(None, "w3 w4"), (None, None), (7, ""), (8, "!?"), (9, "the " * 30_000 + "w59")]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 4, 30])))) for k in range(15)] + [(0, "w3 W3 w3"), (90, None), (91, " . "), (92, "nowhere"), (93, "the")]
    return docs, items


def rows(spark, docs, items, k=10):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_docs long, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string")
    index = ranked_search.build(table, new_folder(spark, "index"))
    return index, ranked_search.search(index, asked, k)


def test_search_equals_a_plain_count(spark, monkeypatch):
    for seed, postings, parts in ((1, 500_000, 32_000_000), (2, 60, 400), (3, 1, 32_000_000)):
        monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
        monkeypatch.setattr(ranked_search, "MOST_ITEMS", parts)
        docs, items = corpus(seed, 120)
        for k in (10, 1) if seed == 1 else (3,):
            found = rows(spark, docs, items, k)[1].collect()
            assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(docs, items, k)))


def test_index_can_be_opened_again_and_empty_tables(spark):
    docs, items = corpus(4, 40)
    folder = new_folder(spark, "index")
    ranked_search.build(spark.createDataFrame(docs, "doc_id long, text string"), folder)
    again = ranked_search.search(ranked_search.opened(spark, folder), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, brute(docs, items)))
    assert rows(spark, [], items)[1].count() == 0 and rows(spark, docs, [])[1].count() == 0
    assert rows(spark, docs, [])[1].columns == again.columns


def test_bounds_hold_and_bytes_round_upwards(spark):
    docs, items = corpus(5, 200)
    index = rows(spark, docs, items)[0]
    part = ranked_search.Items.of([i for i in items if i[1]])
    ranked_search.weigh(index, part)
    for batch in index.blocks.toArrow().to_batches():
        for block in ranked_search._blocks([batch]):
            postings = ranked_search.Postings(block, part, pa.array(part.terms, pa.binary()))
            lengths, tfs = np.frombuffer(block["lengths"].as_py(), np.int64), np.frombuffer(block["tfs"].as_py(), np.int32)
            every = np.arange(postings.size)
            for uses in part.uses:
                upper, lower = postings.bounds_of(uses)
                exact = postings.exact(uses, every, tfs, ranked_search.smooth(lengths, index.docs, index.terms))
                assert (lower <= exact).all() and (exact <= upper).all()


def test_lengths_are_the_number_of_terms():
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "Z", "9", " ", "_", "é", "\n", "日"]) for _ in range(r.randrange(12))) if k % 7 else None for k in range(300)]
    want = [len(terms(t)) for t in texts]
    assert ranked_search.lengths_of(pa.array(texts, pa.string())).tolist() == want
    assert ranked_search.lengths_of(pa.array(texts, pa.string())[50:90]).tolist() == want[50:90]
    assert [len(ranked_search.terms_of(t)) for t in texts] == want


def test_whole_numbers_beyond_64_bits():
    n = np.array([3, 10**7], np.int64)
    assert ranked_search.smooth(n, 10**12, 10**15).tolist() == [25 + 75 * 3 * 10**12 // 10**15, 25 + 75 * 10**7 * 10**12 // 10**15]


def test_files_have_row_groups_of_few_blocks(spark):
    r = random.Random(7)
    docs = [(i, " ".join(str(r.randrange(10**9)) for _ in range(20_000))) for i in range(80)]
    folder = new_folder(spark, "index")
    ranked_search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), folder)
    groups = [g for f in ds.dataset(folder.replace("file://", "")).get_fragments() for g in f.row_groups]
    assert sum(g.num_rows for g in groups) >= 4 and max(g.num_rows for g in groups) <= 2

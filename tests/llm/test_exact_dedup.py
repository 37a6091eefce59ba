"""Against brute force, with heavy hitters, nulls, ties and clashing names."""

import hashlib
from collections import defaultdict

from vellum.llm import exact_dedup as E


def rows():
    out = [(i, "hot") for i in range(200)] + [(1000 + i, f"text {i % 40}") for i in range(100)] + [(2000, None), (2001, ""), (2002, " "), (2003, "x" * 200_000), (2004, "x" * 200_000)]
    return [*out, (3000, "twice"), (3000, "twice"), (None, "no id"), (7, "no id"), (None, "alone")]


def test_mark(spark):
    for heavy in (1024, 2):
        groups = defaultdict(list)
        for i, t in rows():
            groups[t or ""].append(-1 if i is None else i)
        got = E.mark(spark.createDataFrame([(*r, 0, "z") for r in rows()], "doc_id long, text string, kept int, count string").repartition(5), heavy=heavy).collect()
        assert len(got) == len(rows())
        by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        kept = defaultdict(int)
        for r in got:
            ids = by[r["text_sha256"]]
            assert r["group_size"] == len(ids) and (r["keep_id"] if r["keep_id"] is not None else -1) == max(ids)
            kept[r["text_sha256"]] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert set(kept.values()) == {1} and len(kept) == len(by)


def test_drop_keeps_columns(spark):
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows()], "doc_id long, text string, kept int, `a.b` string").repartition(5)
    for heavy in (1024, 2):
        got = E.drop(docs, heavy=heavy)
        assert got.columns == docs.columns
        have = sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect())
        want = defaultdict(lambda: -1)
        for i, t in rows():
            want[t or ""] = max(want[t or ""], -1 if i is None else i)
        assert have == sorted((str(None if i < 0 else i), t) for t, i in want.items())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert E.mark(none).count() == 0 and E.drop(none).count() == 0

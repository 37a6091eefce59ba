"""The permutation, and an exact round trip through the shards."""

import zlib

import numpy as np
import pytest

from vellum.llm import training_order as T
from vellum.llm.common import new_folder
from vellum.llm.tokens import encoder


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_permutation_and_inverse(n):
    f = T.Feistel(n, key=9)
    slots = f.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and f.numbers(slots).tolist() == list(range(n))
    if n > 200:
        assert slots.tolist() != T.Feistel(n, key=10).slots(np.arange(n)).tolist() and abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def test_round_trip(spark):
    texts = ["one two three " * k for k in range(60)] + [None, "", "<|endoftext|> x", "é漢字 " * 500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(3, "doc_id")
    folder = new_folder(spark, "order")
    got = T.materialise(docs, folder, key=4, length=64, per_shard=16).collect()
    n = len(got)
    assert sorted(r["slot"] for r in got) == list(range(n))
    read = list(T.read_slots(folder, 0, n, length=64, per_shard=16))
    for r in got:
        assert zlib.crc32(read[r["slot"]].tobytes()) == r["ids_crc32"] and r["position"] == r["slot"] % 16 * 128
    assert [a.tolist() for a in T.read_slots(folder, 13, 9, length=64, per_shard=16)] == [a.tolist() for a in read[13:22]]
    numbers = T.Feistel(n, 4).numbers(np.arange(n))
    stream = np.concatenate([read[s] for s in np.argsort(numbers)]).tolist()
    joined = " ".join(map(str, stream))
    by_doc = {i for r in got for i in r["doc_ids"]}
    assert by_doc == set(range(len(texts)))
    for t in texts:
        ids = [*encoder().encode(t).tolist(), T.END]
        assert " ".join(map(str, ids)) in joined
    assert sum(len(encoder().encode(t)) + 1 for t in texts) <= n * 64 < sum(len(encoder().encode(t)) + 1 for t in texts) + 3 * 64


def test_empty(spark):
    assert T.materialise(spark.createDataFrame([], "doc_id long, text string"), new_folder(spark, "order"), key=1).count() == 0


def test_repeated_rows_and_very_long_texts(spark):
    texts = [" " * 300_000, "word " * 30_000, "twice", "twice", None]
    docs = spark.createDataFrame([(1, t, 0) for t in texts], "doc_id long, text string, slot int").repartition(2, "text")
    folder = new_folder(spark, "order")
    got = T.materialise(docs, folder, key=3, length=128, per_shard=8).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    read = list(T.read_slots(folder, 0, len(got), length=128, per_shard=8))
    stream = [i for a in (read[s] for s in np.argsort(T.Feistel(len(got), 3).numbers(np.arange(len(got))))) for i in a.tolist()]
    ids = [x for t in texts for x in (*encoder().encode(t).tolist(), T.END)]
    assert all(stream.count(i) == ids.count(i) for i in set(ids) - {T.END}) and stream.count(T.END) >= ids.count(T.END)

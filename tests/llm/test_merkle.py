"""The Merkle manifest against a naive tree, at all cuts into partitions; the forest's laws; odd input."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def walk(levels, index, value):
    """(siblings' digests, root) on the way up from a node."""
    rest = []
    for level in levels[:-1]:
        first = index // 8 * 8
        run = level[first : first + 8]
        rest += run[: index - first] + run[index - first + 1 :]
        value = h([*run[: index - first], value, *run[index - first + 1 :]])
        index //= 8
    return rest, value


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> the manifest's rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    lower = {k: levels_of([leaf_of(r) for r in trees[k]]) for k in keys}
    upper = levels_of([lower[k][-1][0] for k in keys])
    for n, k in enumerate(keys):
        for i, r in enumerate(trees[k]):
            now = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = leaf_of((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])))
            rest, value = walk(lower[k], i, now)
            more, folded = walk(upper, n, value)
            yield (r[0], lower[k][0][i], lower[k][-1][0], upper[-1][0], h(rest + more), folded, folded == upper[-1][0])


def spark_rows(spark, rows, task_rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, part string")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = merkle.leaf(lower if c == "text" else F.col(c) for c in merkle.COLUMNS)
    out = merkle.manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, now), task_rows=task_rows)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(repr, map(tuple, out.collect())))


@pytest.mark.parametrize(("seed", "n", "langs", "task_rows"), [(1, 1, 1, 100), (2, 90, 1, 7), (3, 200, 3, 11), (4, 150, 120, 9), (5, 64, 1, 64), (6, 130, 2, 1)])
def test_manifest_equals_a_naive_tree(spark, seed, n, langs, task_rows):
    r = random.Random(seed)
    names = [None, "", *(f"l{k}é" for k in range(langs))][2 if langs == 1 else 0 :]
    rows = [(r.choice([None, -5, *range(n * 2)]), r.choice([None, "s", "Ö"]), r.choice(names), r.choice([None, 3]), r.choice([None, "", "Aä Z", "b" * 5000])) for _ in range(n)]
    rows += rows[: n // 5]  # repeated rows
    assert spark_rows(spark, rows, task_rows) == sorted(map(repr, brute(rows)))


def test_empty_table(spark):
    assert spark_rows(spark, [], 10) == []


def test_forests_add_up_in_any_order():
    r = random.Random(9)
    sizes = [1, 8, 9, 77]
    leaves = [(t, n, 0, k, h([str((t, k))])) for t, n in enumerate(sizes) for k in range(n)]
    want = levels_of([levels_of([x[4] for x in leaves if x[0] == t])[-1][0] for t in range(4)])[-1][0]
    for _ in range(20):
        r.shuffle(leaves)
        forests = []
        for some in itertools.batched(leaves, 10):
            one = merkle.Forest(4)
            for x in some:
                one.add(*x)
            forests.append(one)
        while len(forests) > 1:
            a, b = forests.pop(r.randrange(len(forests))), forests.pop(r.randrange(len(forests)))
            forests.append(a + b)
        assert forests[0].waiting == {(merkle.TOP, 1, 0): (4, want)}


def test_a_neighbouring_forest_stays_small():
    """Forests of consecutive leaves hold fewer than 8 nodes for each level and end."""
    n = 5000
    plan = {"trees": 1, "tree": 0, "offset": 1003, "first_n": n, "last_n": n}
    piece = merkle.Piece(plan, [None] * 3000, [h([str(k)]) for k in range(3000)])
    assert len(list(piece.waiting())) <= 2 * 7 * 5

"""Ids against the tokenizers library, limits, gapless offsets and little padding."""

import zlib

import numpy as np
import pytest

from vellum.llm import packing as P
from vellum.llm.tokens import default_path, encoder

TEXTS = ["a_b  c\t\td  x²½ ٣ don't I'LL 'sss  ", "   \n\n x ", "<|endoftext|> hi", "漢字かな 한국어 😀😀", "a\x1cb\x85c\xa0d", "", "x'd'm'll  \r\n\r\n", " a\tb", "a\nb c\n\nd", " a", "a ", "a\n", "\n", " "]


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    texts = [*TEXTS, " ".join(f"word{i} the, of." for i in range(500)), *(a + b for a in TEXTS for b in TEXTS)]
    for t in texts:
        assert encoder().encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, None, "long words here " * 3000, *("some text " * k for k in range(60))]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1)], "doc_id long, text string, length int").repartition(4)
    for group in (20_000, 25):
        got = P.pack(P.cut(docs), segments=10, group=group).collect()
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append(r)
        for pieces in by.values():
            pieces.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
            assert sum(r["length"] for r in pieces) <= 2048 and len(pieces) <= 10
        whole = Tokenizer.from_file(default_path())
        want = []
        for t in [*texts, texts[1]]:
            ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
        assert sorted(want) == sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    assert P.pack(P.cut(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_fill_respects_every_limit_and_wastes_little():
    r = np.random.default_rng(4)
    tokens = r.integers(1, 2048, 3000)
    sizes, limits = np.column_stack([tokens, np.ones(3000, int), r.integers(0, tokens + 1)]), np.array([2048, 6, 1500])
    loose = np.array([2048, 100, 2048])
    for limit in (limits, loose):
        some = sizes[(sizes <= limit).all(1)]
        sequence, place = P.fill(some, limit)
        used = np.zeros((sequence.max() + 1, 3), int)
        np.add.at(used, sequence, some)
        assert (used <= limit).all() and len({*zip(sequence.tolist(), place.tolist(), strict=True)}) == len(some)
    assert 1 - some[:, 0].sum() / (2048 * (sequence.max() + 1)) < 0.02
    assert P.fill(np.zeros((0, 3), int), limits)[0].tolist() == []


def test_conversations_under_a_limit_of_loss_that_binds(spark):
    r = np.random.default_rng(6)
    turns = [(c if c else None, t, ["user", "assistant", None][int(r.integers(0, 3))], None if r.random() < 0.05 else "some words " * int(r.integers(0, 300))) for c in range(60) for t in range(int(r.integers(1, 9)))]
    docs = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, length int").repartition(5)
    got = P.pack(P.cut_conversations(docs, loss=700), loss=700, segments=12).collect()
    want: dict = {}
    for c, _, role, text in sorted(turns, key=lambda x: (x[0] or 0, x[1])):
        ids = [*encoder().encode(text).tolist(), 1]
        have = want.setdefault(-1 if c is None else c, ([], []))
        have[0].extend(ids)
        have[1].extend([role == "assistant"] * len(ids))
    used: dict = {}
    for p in got:
        ids, bears = want[p["doc_id"]]
        span = slice(p["start"], p["start"] + p["length"])
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[span], "<u4").tobytes()) and p["loss"] == sum(bears[span]) and p["doc_tokens"] == len(ids)
        total = used.setdefault(p["sequence_id"], [0, 0, 0])
        for k, x in enumerate((p["length"], 1, p["loss"])):
            total[k] += x
    assert all(a <= 2048 and b <= 12 and c <= 700 for a, b, c in used.values()) and max(c for _, _, c in used.values()) > 690
    assert sum(p["length"] for p in got) == sum(len(ids) for ids, _ in want.values())


def test_long_runs_of_white_space():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    for text in (" " * 1_000_000, "a" + "\n" * 400_000 + "b", "\t " * 200_000 + "x"):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert encoder().encode(text).tolist() == ids and encoder().count(text) == len(ids)


def test_short_texts_fill_sequences_and_limits_below_one_are_errors(spark):
    pieces = P.cut(spark.createDataFrame([(k, "") for k in range(3000)], "doc_id long, text string"))
    assert P.pack(pieces).select("sequence_id").distinct().count() == 2
    assert P.pack(pieces, segments=100).select("sequence_id").distinct().count() == 30
    turns = spark.createDataFrame([(1, 0, "assistant", "hello there")], "conv_id long, turn int, role string, text string")
    for call in (lambda: P.cut_conversations(turns, loss=0), lambda: P.cut_conversations(turns, tokens=0), lambda: P.pack(pieces, loss=0)):
        with pytest.raises(ValueError, match="at least 1"):
            call()

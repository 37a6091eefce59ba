"""Vector bin packing of token pieces into sequences under several limits at once.

Every piece is a vector of what it takes of each limit (tokens, one segment, loss-bearing
tokens). A sequence is filled with the piece that fits and has the largest dot product with what
the sequence has left, each limit scaled to 1; when none fits, the next sequence is begun. Pieces
that are alike in all limits are one kind, so a step looks at kinds and not at pieces.

Pieces that fill a sequence alone need no search. The others are dealt evenly into groups of
GROUP pieces, whatever their documents are, and each group is packed by one task.

Defined results: null and empty texts are documents of one id (the end id); a piece never exceeds
a limit, since documents are cut at the token limit and conversations at the token and the loss limit; rows that repeat a
document are packed as often as they occur; an empty table gives no rows; extra columns are left out, whatever their names.
A null conversation id counts as -1, a null role as no role.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint
from vellum.llm.tokens import encoder

#: Pieces that one task packs, about.
GROUP = 20_000
TOKENS = 2048
#: Segments in a sequence, at most. As many as tokens, so that short documents leave no padding; for instruction data, whose attention masks have a fixed width, give pack() less.
SEGMENTS = TOKENS

PIECES = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokens: int = TOKENS, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Pieces of at most `tokens` ids; all ids but a document's first bear loss."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), tokens):
                    piece = ids[start : start + tokens]
                    rows.append((doc_id, start, len(piece), len(piece) - (start == 0), zlib.crc32(piece.tobytes()), len(ids)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECES)


def cut_conversations(turns: DataFrame, tokens: int = TOKENS, loss: int | None = None, end_id: int = 1, tokenizer: str | None = None, learned: str = "assistant") -> DataFrame:
    """turns (conv_id, turn, role, text) -> the pieces of each conversation, in the order of its turns, an end id after each turn.

    Only the ids of turns whose role is `learned` bear loss. A piece ends before it would exceed `tokens` ids or `loss` of these.
    A conversation's turns are sorted by the shuffle and streamed, so that none is gathered as a whole."""
    most = tokens if loss is None else min(loss, tokens)
    if most < 1:
        raise ValueError("the limits on tokens and on loss-bearing tokens must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, names = encoder(tokenizer).encode, ["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens"]
        conversation, start, length, bears, crc = None, 0, 0, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for conv_id, role, text in zip(batch["conv_id"].tolist(), batch["role"], batch["text"], strict=True):
                if conv_id != conversation:
                    if length:
                        rows.append((conversation, start, length, bears, crc))
                    conversation, start, length, bears, crc = conv_id, 0, 0, 0, 0
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                at, counts = 0, role == learned
                while at < len(ids):
                    room = min(tokens - length, most - bears) if counts else tokens - length
                    part = ids[at : at + room]
                    length, bears, crc, at = length + len(part), bears + len(part) * counts, zlib.crc32(part.tobytes(), crc), at + len(part)
                    if at < len(ids):
                        rows.append((conversation, start, length, bears, crc))
                        start, length, bears, crc = start + length, 0, 0, 0
            yield pd.DataFrame(rows, columns=names[:-1])
        if length:
            yield pd.DataFrame([(conversation, start, length, bears, crc)], columns=names[:-1])

    known = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), "text")
    pieces = checkpoint(known.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInPandas(run, "doc_id long, start long, length long, loss long, ids_crc32 long"))
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("doc_tokens"))
    return pieces.join(whole, "doc_id")


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place) of each piece; sizes: a row of whole numbers per piece, a column per limit."""
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    if len(kinds) and (kinds > limits).any():
        raise ValueError("a piece is larger than a sequence")
    order = np.argsort(kind_of.ravel(), kind="stable")
    count = np.bincount(kind_of.ravel(), minlength=len(kinds))
    first = np.concatenate([[0], count.cumsum()])[:-1]
    weight = kinds / limits
    sequence, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    at, nth, left = 0, 0, limits.astype(np.int64)
    for _ in range(len(sizes)):
        score = weight @ (left / limits)
        score[(kinds > left).any(1) | (count == 0)] = -1
        best = int(score.argmax())
        if score[best] < 0:
            at, nth, left = at + 1, 0, limits.astype(np.int64)
            score = weight @ np.ones(len(limits))
            score[count == 0] = -1
            best = int(score.argmax())
        count[best] -= 1
        piece = order[first[best] + count[best]]
        sequence[piece], place[piece] = at, nth
        nth, left = nth + 1, left - kinds[best]
    return sequence, place


def pack(pieces: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, group: int = GROUP) -> DataFrame:
    """pieces (doc_id, start, length, loss, ...) with sequence_id and offset. loss: the limit on loss-bearing tokens, `tokens` if null."""
    limits = np.array([tokens, segments, tokens if loss is None else loss], np.int64)
    if limits.min() < 1:
        raise ValueError("limits must be at least 1")
    pieces = checkpoint(pieces.withColumn("__pack_row", F.monotonically_increasing_id()))
    n = pieces.count()
    groups = max(1, math.ceil(n / group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "__pack_row")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__pack_row", ignore_index=True)
        sizes = np.column_stack([rows["length"], np.ones(len(rows)), rows["loss"]]).astype(np.int64)
        alone = sizes[:, 0] == tokens
        rest, place = fill(sizes[~alone], limits)
        sequence, nth = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        sequence[~alone], nth[~alone] = rest, place
        sequence[alone] = np.arange(alone.sum()) + (rest.max() + 1 if len(rest) else 0)
        rows["sequence_id"] = sequence + (key[0] << 32)
        rows = rows.iloc[np.lexsort([nth, sequence])]
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns=["__pack_row", "__pack_group"])

    dealt = pieces.withColumn("__pack_group", F.pmod(F.xxhash64("__pack_row"), F.lit(groups)))
    return dealt.groupBy("__pack_group").applyInPandas(run, schema + ", sequence_id long, offset long")

"""Training order on disk: every sequence of token ids at a pseudo-random global slot, in fixed-stride binary shards.

1. Each partition's documents, an end id after each, are one stream of ids, cut into sequences of
   `length`; the last is filled up with the end id. They are encoded once, into a checkpoint of compressed blocks of
   consecutive sequences. The number of sequences in each partition gives every sequence a dense number from 0 to n - 1.
2. A keyed Feistel network permutes the numbers of 2 * `half` bits; a result beyond n - 1 is put in
   again until it falls below (cycle-walking), which makes it a permutation of 0 to n - 1. It needs no
   table and no sort of keys: any task can compute a slot, or invert it.
3. A shard holds `per_shard` consecutive slots. Tasks take ranges of consecutive shards, equally many each, which are
   known without a sample as slots are dense. Sequences are sent to their range and written in slot order, each at (slot - first slot) * length * bytes per id, so a reader seeks to any slot and
   resumes there. A shard is written under a temporary name and moved into place, so that a
   repeated task leaves the same file.

A lost executor costs the tasks it ran: the numbering rests on the checkpoint and not on docs, whose partitions may
change when they are read again.

Defined results: null and empty texts are an end id alone; very long texts go over as many sequences as they need; repeated
rows appear as often as they occur; an empty table gives no shard and no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint, mix, open_store, text_chunks
from vellum.llm.tokens import encoder

LENGTH, PER_SHARD, END, ROUNDS = 2048, 4096, 50256, 4
#: Shards (16 MB each at these sizes) that one task writes, and tasks at most; beyond, a task writes more shards, one after the other.
TASK_SHARDS, MOST_TASKS = 1, 20_000
#: Sequences of one compressed block of the checkpoint (4 MB at 2048 ids of two bytes), and the level it is compressed at.
BLOCK, BLOCK_LEVEL = 1024, 9


class Feistel:
    """A keyed permutation of 0 to n - 1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, math.ceil(math.log2(max(2, n)) / 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key % (1 << 63)) * np.uint64(ROUNDS + 1))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                a, b = b ^ (mix(a ^ k) & self.mask), a
            else:
                a, b = b, a ^ (mix(b ^ k) & self.mask)
        return (a << np.uint64(self.half)) | b

    def _walk(self, x, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (beyond := out >= np.uint64(self.n)).any():
            out[beyond] = self._once(out[beyond], back)
        return out.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(slots, True)


def _streams(batches: Iterator[pd.DataFrame], length: int, end_id: int, tokenizer: str | None) -> Iterator[tuple[list, np.ndarray]]:
    """(doc_ids, ids) of each sequence of a partition, in order."""
    encode, held, docs, n = encoder(tokenizer).encode, [], [], 0
    for batch in batches:
        for part in text_chunks(batch["text"]):
            for doc_id, text in zip(batch["doc_id"].iloc[part], batch["text"].iloc[part], strict=True):
                ids = np.append(encode(text), np.uint32(end_id))
                held.append(ids)
                docs.append(None if pd.isna(doc_id) else int(doc_id))
                n += len(ids)
                if n >= length:
                    stream = np.concatenate(held)
                    cut = len(stream) // length * length
                    for k in range(0, cut, length):
                        yield (docs if k == 0 else docs[-1:]), stream[k : k + length]
                    held = [stream[cut:]] if cut < len(stream) else []
                    docs, n = docs[-1:] if held else [], len(stream) - cut
    if n:
        yield docs, np.concatenate([*held, np.full(length - n, end_id, np.uint32)])


def materialise(docs: DataFrame, folder: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = END, tokenizer: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text) to folder. A row for each sequence: slot, shard, position (in bytes), doc_ids, ids_crc32."""
    kind = "<u2" if end_id < 1 << 16 and encoder(tokenizer).whole.get_vocab_size() <= 1 << 16 else "<u4"
    stride = length * np.dtype(kind).itemsize

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, pack, first = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=BLOCK_LEVEL).compress, 0
        streams = _streams(batches, length, end_id, tokenizer)
        while held := list(itertools.islice(streams, BLOCK)):
            doc_ids, data = zip(*held, strict=True)
            yield pd.DataFrame({"part": [part], "first": [first], "n": [len(held)], "doc_ids": [list(doc_ids)], "data": [pack(np.concatenate(data).astype(kind).tobytes())]})
            first += len(held)

    encoded = checkpoint(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(blocks, "part int, first long, n long, doc_ids array<array<long>>, data binary"))
    base, n = {}, 0
    for part, many in sorted(tuple(r) for r in encoded.groupBy("part").agg(F.sum("n")).collect()):  # two numbers for each partition
        base[part] = n
        n += many
    order = Feistel(max(1, n), key)
    known = docs.sparkSession.sparkContext.broadcast(base)

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part, first, many, doc_ids, data in zip(batch["part"], batch["first"], batch["n"], batch["doc_ids"], batch["data"], strict=True):
                whole = unpack(data)
                each = [whole[k : k + stride] for k in range(0, many * stride, stride)]
                slots = order.slots(known.value[part] + first + np.arange(many))
                yield pd.DataFrame({"slot": slots, "shard": slots // per_shard, "doc_ids": list(doc_ids), "ids_crc32": [zlib.crc32(x) for x in each], "data": [pack(x) for x in each]})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        unpack, attempt = zstandard.ZstdDecompressor().decompress, TaskContext.get().taskAttemptId()
        shard, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{path}/.{shard:08d}.{attempt}", f"{path}/{shard:08d}.bin")

        for batch in batches:
            for s, slot, data in zip(batch["shard"], batch["slot"], batch["data"], strict=True):
                if s != shard:
                    close()
                    shard, out, at = s, store.open_output_stream(f"{path}/.{s:08d}.{attempt}"), s * per_shard
                if slot != at:
                    raise ValueError(f"slot {at} of shard {s} is missing or doubled")
                out.write(unpack(data))
                at += 1
            yield batch[["slot", "shard", "doc_ids", "ids_crc32"]].assign(position=(batch["slot"] - batch["shard"] * per_shard) * stride)[["slot", "shard", "position", "doc_ids", "ids_crc32"]]
        close()

    placed = encoded.mapInPandas(sequences, "slot long, shard long, doc_ids array<long>, ids_crc32 long, data binary")
    shards = max(1, -(-n // per_shard))
    tasks = min(MOST_TASKS, -(-shards // TASK_SHARDS))
    ranges = placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
    return checkpoint(ranges.sortWithinPartitions("shard", "slot").mapInPandas(write, "slot long, shard long, position long, doc_ids array<long>, ids_crc32 long"))


def read_slots(folder: str, first: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences of n slots from `first`, as a trainer resumes: one seek, then sequential reads."""
    store, path = open_store(folder)
    stride = length * np.dtype(kind).itemsize
    slot = first
    while slot < first + n:
        shard, at = divmod(slot, per_shard)
        with store.open_input_file(f"{path}/{shard:08d}.bin") as f:
            f.seek(at * stride)
            for _ in range(min(per_shard - at, first + n - slot)):
                yield np.frombuffer(f.read(stride), kind)
                slot += 1

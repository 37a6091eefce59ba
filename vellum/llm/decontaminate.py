"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check.

Windows. Texts are words (lower case, split at white space) and shingles of five words. An item
of at least LEAST words enters by windows of the largest size of a short list (11, 15, 19, 24
words) that fits it with four words to spare, two times over for items of 49 words or more. The
item is tiled with such windows from its start and one more ends with it. A document has a
window of each of these sizes at every word. A passage similar to an item at 0.8 or more can
differ at few places. Further windows lie away from both ends, so that wherever its words are changed, or
its ends cut off, one of the item's windows is left as it was (tests go through all item sizes).

Fingerprints. A window's 64-bit SimHash sums its shingles' hash bits. All windows of a batch are
summed at once: eight bits lie in the eight bytes of a word, so that a difference of two running
sums holds eight counts.

Search. A fingerprint is cut into four blocks of 16 bits. Two fingerprints within RADIUS = 7 bits
agree in some block up to one bit (4 * 2 > 7), so a table of each block's values and their
one-bit neighbours finds every pair within the radius: none is lost. Each pair found is measured
on all 64 bits.

Check. A hit names an item and where it would begin. The item-sized windows that begin up to
SLACK words from there are compared with the item exactly: the similarity is the sum of the
lesser shingle weights over the sum of the greater, a shingle's weight being how often it occurs
in the window or item. The best window counts, from SIMILARITY up.

The benchmark goes to all executors, as its whole text is checked against MOST_BENCHMARK bytes;
a larger one is searched in parts of that size, one job after the other, so that neither the driver nor an
executor ever holds more than one.

Defined results: null and empty texts have no window; items of fewer than five words match nothing;
items of 5 to 14 words enter whole, and from 9 words without their ends besides; repeated items and documents are matched each; an empty table
on either side gives no rows; very long texts are searched whole; find() leaves other columns out, whatever their names,
drop() carries them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import batch_hashes, checkpoint, chunks, shingle_hashes, text_chunks, word_hashes

WIDTH, SIMILARITY, RADIUS, SLACK = 5, 0.8, 7, 2
SIZES, LEAST = (24, 19, 15, 11), 15
#: Bytes of benchmark text that are searched for at once.
MOST_BENCHMARK = 32_000_000

_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_EACH, _HIGH, _GATHER = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x0002040810204081)


def windows(n: int) -> tuple[int, list[int]]:
    """(size, starts) of an item's windows, for its number of words."""
    if n < WIDTH:
        return 0, []
    if n < LEAST:
        return n, [0]
    room = n // 2 if n >= 49 else n - 4
    size = next(w for w in SIZES if w <= room)
    return size, sorted({*range(0, n - size + 1, size), n - size})


def inner_windows(n: int) -> list[tuple[int, int]]:
    """(size, start) of the windows besides, such that a passage of similarity SIMILARITY leaves one whole, wherever it is changed or cut."""
    edge = max(0, n - WIDTH + 1) // 5  # so many shingles may be missing at the ends together
    if not edge:
        return []
    if n < LEAST:
        return [(n - 2 * edge, edge)]
    if n < 49:
        size = next(w for w in SIZES if w <= n - 2 * edge)
        return [(size, (n - size) // 2)]
    size, starts = windows(n)
    return [(size, s) for s in sorted({*range(4, n - size - 3, size), n - size - 4} - set(starts))]


def running(shingles: np.ndarray) -> list[np.ndarray]:
    """Running sums of the hash bits, eight arrays of eight byte-wide lanes, with a zero before."""
    out = []
    for k in range(8):
        lanes = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(_SPREAD[((shingles >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)], out=lanes[1:])
        out.append(lanes)
    return out


def simhash(sums: list[np.ndarray], size: int) -> np.ndarray:
    """The fingerprint of each run of `size` words; sums: running()'s of the shingles."""
    count = size - WIDTH + 1
    n = len(sums[0]) - count
    out = np.zeros(max(0, n), np.uint64)
    if n <= 0:
        return out
    lift = np.uint64(128 - (count // 2 + 1)) * _EACH
    for k, lanes in enumerate(sums):
        majority = (lanes[count:] - lanes[:n] + lift) & _HIGH
        out |= ((majority * _GATHER) >> np.uint64(56)) << np.uint64(8 * k)
    return out


@dataclass
class Index:
    """Of the items' windows of one size: fingerprints, item and start, and the four block tables."""

    size: int
    prints: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    tables: np.ndarray
    firsts: np.ndarray  # of each block and value: where its windows begin in `members`
    members: np.ndarray

    @staticmethod
    def of(size: int, found: list[tuple[int, int, int]]) -> Index:
        prints = np.array([f[0] for f in found], np.uint64)
        near = np.array([0, *(1 << b for b in range(16))], np.int64)
        values, who = [], np.repeat(np.arange(len(prints)), len(near))
        for k in range(4):
            block = ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            values.append((k << 16) + (block[:, None] ^ near[None]).ravel())
        value = np.concatenate(values)
        firsts = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=4 << 16))])
        members = np.tile(who.astype(np.int32), 4)[np.argsort(value, kind="stable")]
        return Index(size, prints, np.array([f[1] for f in found]), np.array([f[2] for f in found]), (np.diff(firsts) > 0).reshape(4, -1), firsts, members)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in prints, window) within the radius."""
        keys = [np.zeros(0, np.int64)]
        for k, b in enumerate(prints.view("<u2").reshape(-1, 4).T):
            found = np.flatnonzero(self.tables[k][b])
            value = (k << 16) + b[found].astype(np.int64)
            count = self.firsts[value + 1] - self.firsts[value]
            for part in chunks(count, 2_000_000) if count.sum() > 2_000_000 else [slice(0, len(count))]:
                n = count[part]
                at = np.repeat(found[part], n)
                who = self.members[np.repeat(self.firsts[value[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                near = np.bitwise_count(prints[at] ^ self.prints[who]) <= RADIUS
                keys.append(at[near] * len(self.prints) + who[near])
        every = np.unique(np.concatenate(keys))
        return every // len(self.prints), every % len(self.prints)


def fingerprints(h: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    sums = running(shingle_hashes(h, WIDTH))
    return {w: simhash(sums, w) for w in sizes}


def build(items: list[tuple[int, np.ndarray]]) -> list[Index]:
    """items: (number, word hashes)."""
    by: dict[int, list] = {}
    for i, h in items:
        size, starts = windows(len(h))
        places = [*((size, s) for s in starts), *inner_windows(len(h))]
        prints = fingerprints(h, sorted({w for w, _ in places})) if places else {}
        for w, s in places:
            by.setdefault(w, []).append((int(prints[w][s]), i, s))
    return [Index.of(size, found) for size, found in sorted(by.items())]


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def best_window(text: np.ndarray, at: int, item: Counter, n: int) -> tuple[float, int]:
    """(similarity, start) of the best of the n-word windows of text that begin near `at`; windows begin in the text and end with it. shingles of text, not words."""
    most = (0.0, 0)
    for start in sorted({max(0, s) for s in range(at - SLACK, at + SLACK + 1)}, key=lambda s: abs(s - at)):
        a, b = start, min(len(text), start + n - WIDTH + 1)
        if a < b and (found := (weighted_similarity(Counter(text[a:b].tolist()), item), a))[0] > most[0]:
            most = found
    return most


def _parts(benchmark: DataFrame) -> Iterator[tuple[list, bool]]:
    """The benchmark in parts of bounded size, and whether each is the last."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if part and size + len(r["text"]) > MOST_BENCHMARK // 4:
            yield part, False
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield part, True


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, words): a row for each document and item in it."""
    found = None
    for part, last in _parts(benchmark):
        search, shared = _hits(docs, part)
        rows = docs.select("doc_id", F.explode(search("text")).alias("hit")).select("doc_id", "hit.*")
        if not last:
            rows = checkpoint(rows)
            shared.destroy()
        found = rows if found is None else found.unionByName(rows)
    return found


def drop(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for part, last in _parts(benchmark):
        search, shared = _hits(docs, part)
        docs = docs.where(F.size(search("text")) == 0)
        if not last:
            docs = checkpoint(docs)
            shared.destroy()
    return docs


class Searcher:
    """What a worker knows of a part of the benchmark."""

    def __init__(self, part: list):
        self.memo = word_hashes()
        self.ids = [i for i, _ in part]
        hashes, bounds = batch_hashes(pd.Series([t for _, t in part], dtype=object), self.memo)
        self.items = [hashes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        self.counts = [Counter(shingle_hashes(h, WIDTH).tolist()) for h in self.items]
        self.indexes = build(list(enumerate(self.items)))

    def search(self, texts: pd.Series) -> list[list[tuple]]:
        """For each text its hits."""
        h, ends = batch_hashes(texts, self.memo)
        shingles = shingle_hashes(h, WIDTH)
        sums = running(shingles)
        tried: dict[tuple[int, int, int], tuple[float, int]] = {}
        for index in self.indexes:
            at, who = index.search(simhash(sums, index.size))
            doc = np.searchsorted(ends, at, "right") - 1
            whole = at + index.size <= ends[doc + 1]  # windows that lie in one text
            for p, d, w in zip(at[whole].tolist(), doc[whole].tolist(), who[whole].tolist(), strict=True):
                item = int(index.items[w])
                start = p - int(ends[d]) - int(index.starts[w])
                if (d, item, start) not in tried:
                    own = shingles[ends[d] : max(ends[d], ends[d + 1] - WIDTH + 1)]
                    tried[d, item, start] = best_window(own, start, self.counts[item], len(self.items[item]))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for (d, item, _), (similarity, start) in tried.items():
            if similarity >= SIMILARITY:
                best[d, item] = max(best.get((d, item), (0.0, 0)), (similarity, -start))
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        for (d, item), (similarity, start) in sorted(best.items()):
            out[d].append((self.ids[item], similarity, -start, len(self.items[item])))
        return out


def _hits(docs: DataFrame, part: list):
    shared = docs.sparkSession.sparkContext.broadcast(part)
    names = ("item_id", "similarity", "start", "words")

    @F.pandas_udf("array<struct<item_id long, similarity double, start long, words long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(shared.value)
        for texts in batches:
            found = [hit for piece in text_chunks(texts, 400_000) for hit in searcher.search(texts.iloc[piece])]
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in hit] for hit in found], dtype=object)

    return run, shared

"""Ranked lexical search over an index of two levels: byte impacts for bounds, frequencies for exact scores.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A to Z are lower-cased. With N documents that hold a term, L terms in
all, n terms in a document and tf of one of them, a term's impact in a document is 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L, which is
less than a million. A document's score for an item is the sum, over the item's terms with repeats, of the impact times the term's weight
floor(1000 ln((2N + 2) / (2 df + 1))).

Index. Documents lie in blocks, one row of a Parquet file each, as they come: nothing is shuffled, and a term that every document holds is
spread over all blocks. The first level has for each term its documents and one byte for each: the impact in steps of STEP, rounded
upwards. The second level has the frequencies; a scan for bounds does not read that column.

Search. The items are broadcast, in parts of MOST_ITEMS bytes, one after the other. One pass sums bytes: a document's upper bound is the sum
of weight * byte * STEP, its lower bound is less by weight * (STEP - 1) for each term. The k greatest lower bounds of all blocks give the kth lower
bound of each item. The second pass scores every document whose upper bound reaches it, exactly, by the second level. Tasks pass on k rows
for each item at most, in both passes: what a task leaves out is beaten by k others of its own.

Results are exact: no document outside the bounds can be among the first k, so recall is 1 by construction (tests compare with a plain count).

Defined results: null and empty texts have no terms and are never found; very long texts are one document, alone in a block if need be; documents of
equal score come by ascending doc_id (null first); repeated rows are ranked each; of items that repeat an id each has its own ranks; a null or empty
item has no rows; an empty table on either side gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm.common import checkpoint, small_batches

#: A block holds so many pairs of document and term, about, and so many documents at most.
BLOCK_POSTINGS, BLOCK_DOCS = 500_000, 65_536
#: Few blocks are a row group: Spark's writer holds one row group and its reader one at most, not a whole file of blocks.
ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
#: Texts that are counted at once, and that a task gets from Spark at once, in so many bytes about.
ROWS, BATCH_BYTES = 500, 8 << 20
#: Impacts in one byte: 255 steps reach the greatest impact.
GREATEST, STEP = 1_000_000, 3_922
#: Bytes of item texts that are searched for at once.
MOST_ITEMS = 32_000_000

_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_CLEAN = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))

BLOCK = "n_docs long, n_terms long, ids array<long>, lengths binary, terms array<binary>, df binary, places binary, impacts binary, tfs binary"
_BLOCK = pa.schema([
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.binary())),
    ("df", pa.binary()), ("places", pa.binary()), ("impacts", pa.binary()), ("tfs", pa.binary()),
])


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


def lengths_of(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text, from where they begin in the bytes of all."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    counts, full = np.zeros(len(texts), np.int64), np.diff(bounds) > 0
    if full.any():
        inside = _TERM[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]]
        begins, first = inside.copy(), bounds[:-1][full] - bounds[0]
        begins[1:] &= ~inside[:-1]
        begins[first] = inside[first]
        counts[full] = np.add.reduceat(begins, first, dtype=np.int64)
    return counts


def smooth(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms; in whole numbers of any size where 64 bits might not hold them."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // terms for x in n], np.int64)
    return 25 + 75 * n.astype(np.int64) * docs // max(1, terms)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Index:
    """blocks: one row each; docs: with a term; terms: of all."""

    blocks: DataFrame
    docs: int
    terms: int


def build(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id") -> Index:
    """Writes the index of all rows of docs to a new folder."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_terms = total = 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                n = lengths_of(batch.column(0)[k : k + ROWS])
                with_terms, total = with_terms + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_pydict({"n_docs": [with_terms], "n_terms": [total]})

    with small_batches(docs.sparkSession, ROWS, BATCH_BYTES):
        sums = narrow.select("text").mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            t = None
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(i, terms_of(t.as_py()))
                if block.postings >= BLOCK_POSTINGS or len(block.ids) >= BLOCK_DOCS:
                    yield block.row(n_docs, n_terms)
                    block = Block()
            del batch, t  # else it stays while the next one is read
        if block.ids:
            yield block.row(n_docs, n_terms)

    with small_batches(docs.sparkSession, ROWS, BATCH_BYTES):
        narrow.mapInArrow(blocks, BLOCK).write.options(**ROW_GROUPS).parquet(folder)
    return Index(docs.sparkSession.read.parquet(folder), n_docs, n_terms)


def opened(spark: SparkSession, folder: str) -> Index:
    """An index that build() has written."""
    blocks = spark.read.parquet(folder)
    sums = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return Index(blocks, sums[0] or 0, sums[1] or 0)


class Block:
    """Documents on their way into a row."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        if not terms:
            return
        counts = Counter(terms)
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.postings += len(counts)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        terms, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        places = np.repeat(np.arange(len(lengths), dtype=np.int32), [len(t) for t in self.terms])
        order = np.argsort(terms, kind="stable")
        places, tfs = places[order], tfs[order]
        steps = -(-impact(tfs, smooth(lengths, n_docs, n_terms)[places]) // STEP)
        df = np.bincount(terms, minlength=len(self.numbers)).astype(np.int32)
        values = [len(lengths), int(lengths.sum()), self.ids, lengths.tobytes(), list(self.numbers), df.tobytes(), places.tobytes(), steps.astype(np.uint8).tobytes(), tfs.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


@dataclass
class Items:
    """A part of the items: of each its terms' numbers and how often they occur; all terms; and, once known, weights and kth lower bounds."""

    names: list
    terms: list[bytes]
    uses: list[list[tuple[int, int]]]
    weights: np.ndarray | None = None
    least: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        numbers: dict[bytes, int] = {}
        uses = [[(numbers.setdefault(t, len(numbers)), c) for t, c in Counter(terms_of(text)).items()] for _, text in rows]
        return Items([i for i, _ in rows], list(numbers), uses)


class Postings:
    """The items' terms in a block: where each one's documents lie."""

    def __init__(self, block: dict, items: Items, known: pa.Array):
        self.size = len(block["ids"])
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(block["df"].as_py(), np.int32), dtype=np.int64)])
        number = pc.index_in(block["terms"].values, value_set=known)
        at = np.flatnonzero(np.asarray(number.is_valid()))
        self.bounds = {int(t): (int(ends[a]), int(ends[a + 1])) for t, a in zip(number.take(pa.array(at)).to_pylist(), at.tolist(), strict=True)}
        self.places = np.frombuffer(block["places"].as_py(), np.int32)
        self.impacts = np.frombuffer(block["impacts"].as_py(), np.uint8).astype(np.int64)
        self.weights = items.weights

    def bounds_of(self, uses: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds of all documents of the block."""
        steps, mass = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for term, count in uses:
            if term in self.bounds:
                a, b = self.bounds[term]
                weight, where = int(self.weights[term]) * count, self.places[a:b]
                steps[where] += weight * self.impacts[a:b]
                mass[where] += weight
        upper = STEP * steps
        return upper, np.maximum(upper - (STEP - 1) * mass, 0)

    def exact(self, uses: list[tuple[int, int]], wanted: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of the wanted documents; others' are 0. m: of the wanted ones, in their order."""
        score, row = np.zeros(len(wanted), np.int64), np.full(self.size, -1, np.int64)
        row[wanted] = np.arange(len(wanted))
        for term, count in uses:
            if term in self.bounds:
                a, b = self.bounds[term]
                at = row[self.places[a:b]]
                here = at >= 0
                score[at[here]] += int(self.weights[term]) * count * impact(tfs[a:b][here], m[at[here]])
        return score


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k] for j, name in enumerate(batch.schema.names)}


def _parts(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple]]:
    """The items in parts of bounded size."""
    part, size = [], 0
    for r in items.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).toLocalIterator():
        if part and size + len(r[1]) > MOST_ITEMS // 4:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        yield part


def weigh(index: Index, items: Items) -> None:
    """The weights of the items' terms, from how many documents hold them."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(items.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        total = np.zeros(len(known), np.int64)
        for block in _blocks(batches):
            number = pc.index_in(block["terms"].values, value_set=known)
            here = np.asarray(number.is_valid())
            total[number.drop_null().to_numpy()] += np.frombuffer(block["df"].as_py(), np.int32)[here]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.int64()), "df": pa.array(total[found], pa.int64())})

    df = {r["term"]: r["df"] for r in index.blocks.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    items.weights = np.array([math.floor(1000 * math.log((2 * index.docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(items.terms))], np.int64)
    shared.destroy()


def bound(index: Index, items: Items, k: int) -> None:
    """The kth lower bound of each item, 0 where fewer documents have one."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value.terms, pa.binary())
        best = [np.zeros(0, np.int64) for _ in shared.value.uses]
        for block in _blocks(batches):
            postings = Postings(block, shared.value, known)
            for i, uses in enumerate(shared.value.uses):
                lower = postings.bounds_of(uses)[1]
                lower = lower[lower > (best[i].min() if len(best[i]) == k else 0)]
                if len(lower):
                    every = np.concatenate([best[i], lower])
                    best[i] = every if len(every) <= k else np.partition(every, len(every) - k)[-k:]
        yield pa.RecordBatch.from_pydict({"item": pa.array(np.repeat(np.arange(len(best)), [len(b) for b in best]), pa.int64()), "bound": np.concatenate([*best, np.zeros(0, np.int64)])})

    found = index.blocks.select("ids", "terms", "df", "places", "impacts").mapInArrow(run, "item long, bound long")
    nth = found.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))).where(F.col("nth") == k)
    items.least = np.zeros(len(items.uses), np.int64)
    for r in nth.select("item", "bound").collect():
        items.least[r["item"]] = r["bound"]
    shared.destroy()


def rescore(index: Index, items: Items, k: int) -> DataFrame:
    """(item, doc_id, score): the first k documents of each task, of those whose upper bound reaches the kth lower one."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(items)
    docs, terms = index.docs, index.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value.terms, pa.binary())
        best: list[list[tuple]] = [[] for _ in shared.value.uses]
        for block in _blocks(batches):
            postings, ids = Postings(block, shared.value, known), block["ids"].values
            tfs, lengths = np.frombuffer(block["tfs"].as_py(), np.int32), np.frombuffer(block["lengths"].as_py(), np.int64)
            for i, uses in enumerate(shared.value.uses):
                upper = postings.bounds_of(uses)[0]
                wanted = np.flatnonzero(upper >= max(1, int(shared.value.least[i])))
                if len(wanted):
                    score = postings.exact(uses, wanted, tfs, smooth(lengths[wanted], docs, terms))
                    rows = [(-s, d is not None, d or 0) for s, d in zip(score.tolist(), ids.take(pa.array(wanted)).to_pylist(), strict=True) if s > 0]
                    best[i] = sorted(best[i] + rows)[:k]
        rows = [(i, d if has else None, -s) for i, found in enumerate(best) for s, has, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])

    return index.blocks.mapInArrow(run, "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item."""
    spark, found = items.sparkSession, None
    kind = items.select(F.lit(0).cast("long").alias("item"), F.col(f"`{id_col}`").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).schema
    for rows in _parts(items, id_col, text):
        part = Items.of(rows)
        with small_batches(spark, ROWS, BATCH_BYTES):
            weigh(index, part)
            bound(index, part, k)
            best = checkpoint(rescore(index, part, k))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(part.names)), StructType(kind.fields[:2]))
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = named if found is None else found.unionByName(named)
    return spark.createDataFrame([], StructType(kind.fields[1:])) if found is None else found

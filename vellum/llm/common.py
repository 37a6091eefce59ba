"""What several operators share: checkpoints, shared files, word hashes."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if the master is local (tests), else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df is written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """What is planned and run meanwhile gets Arrow batches of so many rows and about so many bytes at most: a worker and its executor hold several of them."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def fewer(df: DataFrame, rows: int, per: int) -> DataFrame:
    """df, of some `rows` rows, in tasks of `per` rows, or one for each core: tasks that follow rows, not the input's splits and the parts of unions.

    The driver pays for each task of each stage, so that many tiny ones take its memory."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / per)))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """(file system, path) of a URI, for the binary files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def remove(uri: str) -> None:
    """Deletes a folder that new_folder() has named, once nothing reads it any more."""
    store, path = open_store(uri)
    store.delete_dir(path)


#: join_groups() broadcasts groups up to so many (some 60 bytes each).
BROADCAST_GROUPS = 200_000
#: Beyond, it broadcasts the keys with more rows than this, and than this share of all rows: at most HEAVY_MOST keys.
HEAVY_ROWS, HEAVY_MOST = 1_000, 100_000
#: Rows that one task of join_groups() takes, about.
TASK_ROWS = 200_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined on keys with groups: one row for each key, with the number n of the key's rows. total: of all rows; most: of groups at most, counted if null.

    Few groups are broadcast. Of many, a key that holds many rows is broadcast and its rows stay where they are; there
    are at most HEAVY_MOST such keys, since each holds more than that share of the rows. All others are shuffled, in
    tasks that follow `total`."""
    if most is None or most > BROADCAST_GROUPS:
        groups = checkpoint(groups)
    if (most if most is not None else groups.count()) <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    least, tasks = max(HEAVY_ROWS, total // HEAVY_MOST), max(1, math.ceil(total / TASK_ROWS))
    heavy = groups.where(F.col(n) > least)
    here = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").repartition(tasks, *keys)
    return here.unionByName(rest.join(groups.where(F.col(n) <= least).repartition(tasks, *keys), keys, how))


def free_names(wanted: list[str], taken: list[str]) -> dict[str, str]:
    """For each wanted name that is taken the first of name_1, name_2, ... that isn't (names differ by more than case)."""
    used, out = {t.lower() for t in taken} | {w.lower() for w in wanted}, {}
    for t in taken:
        if t.lower() in {w.lower() for w in wanted}:
            k = 1
            while f"{t}_{k}".lower() in used:
                k += 1
            out[t] = f"{t}_{k}"
            used.add(out[t].lower())
    return out


#: A worker's memory of words holds so many entries, then starts afresh.
MEMO = 400_000


class Memo(dict):
    """word -> value, computed when first met; bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        self[key] = found = self.make(key)
        return found


def word_hashes() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def words(text) -> list[str]:
    """Lower case, split at white space; null counts as empty."""
    return text.lower().split() if isinstance(text, str) else []


def batch_hashes(texts: pd.Series, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, one after the other, and the bounds of its texts (one more than texts)."""
    parts = [words(t) for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    got = memo.__getitem__
    return np.fromiter((got(w) for p in parts for w in p), np.uint64, int(bounds[-1])), bounds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash for each run of width words in h; runs over a text's end are the caller's to leave out."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


def chunks(sizes: np.ndarray, budget: int) -> list[slice]:
    """Runs of consecutive items whose sizes add up to about `budget`; at least one item each."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            out.append(slice(start, i))
            start, total = i, 0
        total += n
    return [*out, slice(start, len(sizes))] if len(sizes) else []


def text_chunks(texts: pd.Series, budget: int = 1_000_000) -> list[slice]:
    return chunks(texts.str.len().fillna(0).to_numpy(), budget)


def sorted_groups(batches, keys: list[str]):
    """The groups of a stream of DataFrames that is sorted by keys, each as one DataFrame; a group may lie across batches."""
    held: list[pd.DataFrame] = []
    whole = lambda: held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
            changed[0] |= bool(held) and held[-1][k].iloc[-1] != v[0]
        start = 0
        for at in np.flatnonzero(changed).tolist():
            if at:
                held.append(batch.iloc[start:at])
            yield whole()
            held, start = [], at
        held.append(batch.iloc[start:])
    if held:
        yield whole()

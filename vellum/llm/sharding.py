"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

1. Every partition permutes its rows locally (a sort by a keyed hash of their places) and numbers them.
2. From the partitions' row counts and the shards' sizes the driver draws how many rows each
   partition sends to each shard: a table with both margins fixed, as a uniform permutation
   would give it. Only counts are on the driver. The draw halves the partitions again and
   again, so it takes O(log partitions) vectorised steps.
3. A partition's first rows go to shard 0, the next to shard 1, and so on (the exchange).
4. Each shard permutes what it has received. The second permutation's keys are cut into equal
   ranges, so a shard that no single task could hold is numbered by many tasks.

The rows are numbered in a checkpoint, so a task that runs again finds the same numbers.
Only DataFrame operations touch rows.

Defined results: shard sizes are at most one apart, whatever the rows hold (nulls, ties, repeated
rows, very long texts); with fewer rows than shards the last shards are empty; an empty table gives no rows;
other columns, of any type, are carried; those called shard or slot come out as shard_1 or slot_1, or
with the next number that is free.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint, free_names

#: Rows of a shard that one task permutes, about.
RANGE_ROWS = 250_000
#: The matrix is broadcast up to so many entries of 8 bytes, and joined by a shuffle beyond.
BROADCAST_ENTRIES = 2_000_000
#: numpy draws from populations below a billion; larger ones are drawn by hypergeometric().
NUMPY_MOST = 900_000_000
_HALF_LOG_TAU = math.log(2 * math.pi) / 2


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula, to the last digits."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + _HALF_LOG_TAU) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            k += 2
            if total + term / k == total:
                return total
            total += term / k
    return (x * math.log(x / mean) if x else 0.0) + mean - x


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability, its error a few units in the last place whatever n is (Loader's saddle point form)."""
    if x in (0, n):
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    errors = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return errors - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) + math.log(n / x / (n - x)) / 2 - _HALF_LOG_TAU


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int, step: int = 4096) -> int:
    """How many of `sample` rows drawn from good + bad rows are good: inversion from the mode outwards, for any sizes.

    The mode's probability is a quotient of three binomial ones, so its relative error stays near 1e-14 for any population."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    p = sample / (good + bad)
    at_mode = math.exp(_log_binomial(mode, good, p) + _log_binomial(sample - mode, bad, p) - _log_binomial(sample, good + bad, p))
    u = rng.random() - at_mode
    up, p_up, down, p_down = mode, at_mode, mode, at_mode
    while u > 0 and (up < high or down > low) and max(p_up, p_down) > 0:
        x = np.arange(up, min(high, up + step), dtype=np.float64)
        above = p_up * np.cumprod((good - x) * (sample - x) / ((x + 1) * (bad - sample + x + 1)))
        y = np.arange(down, max(low, down - step), -1, dtype=np.float64)
        below = p_down * np.cumprod(y * (bad - sample + y) / ((good - y + 1) * (sample - y + 1)))
        for values, first, sign in ((above, up, 1), (below, down, -1)):
            if len(values) and u <= (sums := values.cumsum())[-1]:
                return first + sign * (int(np.searchsorted(sums, u)) + 1)
            u -= sums[-1] if len(values) else 0
        up, p_up = up + len(above), above[-1] if len(above) else 0.0
        down, p_down = down - len(below), below[-1] if len(below) else 0.0
    return mode


def _draw(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    if (good + bad).max(initial=0) <= NUMPY_MOST:
        return rng.hypergeometric(good, bad, sample)
    return np.array([hypergeometric(rng, int(g), int(b), int(s)) for g, b, s in zip(good, bad, sample, strict=True)], np.int64)


def communication_matrix(rows: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """How many rows each source sends to each shard; row sums are `rows`, column sums `shards`."""
    rng = np.random.default_rng(seed)
    depth = max(0, math.ceil(math.log2(max(1, len(rows)))))
    leaves = np.zeros(1 << depth, np.int64)
    leaves[: len(rows)] = rows
    totals = [leaves]
    while len(totals[0]) > 1:
        totals.insert(0, totals[0].reshape(-1, 2).sum(1))
    matrix = shards.reshape(1, -1).astype(np.int64)
    for level in totals[1:]:
        left, remaining = level[0::2].copy(), matrix.sum(1)
        mine = np.zeros_like(matrix)
        for s in range(matrix.shape[1]):
            remaining -= matrix[:, s]
            mine[:, s] = _draw(rng, matrix[:, s], remaining, left)
            left -= mine[:, s]
        matrix = np.stack([mine, matrix - mine], 1).reshape(-1, matrix.shape[1])
    return matrix[: len(rows)]


def shard(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (the place in the shard, gapless from 0)."""
    spark = docs.sparkSession
    renamed = free_names(["shard", "slot"], docs.columns)
    carried = [f"__shard_c{i}" for i in range(len(docs.columns))]
    names = [renamed.get(c, c) for c in docs.columns]
    key = lambda k, *of: F.xxhash64(F.lit(seed), F.lit(k), *of)
    local = docs.toDF(*carried).withColumn("__shard_key", key(1, F.monotonically_increasing_id())).sortWithinPartitions("__shard_key")
    local = checkpoint(local.withColumn("__shard_row", F.monotonically_increasing_id()).drop("__shard_key"))
    source, place = F.shiftright("__shard_row", 33), F.col("__shard_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(local.groupBy(source.alias("source")).count().collect())  # one number for each partition
    total = sum(n for _, n in counts)
    sizes = np.full(n_shards, total // n_shards, np.int64)
    sizes[: total % n_shards] += 1
    matrix = communication_matrix(np.array([n for _, n in counts], np.int64), sizes, seed).cumsum(1)
    bounds = spark.createDataFrame([(int(p), m.tolist()) for (p, _), m in zip(counts, matrix, strict=True)], "__shard_source long, __shard_bounds array<long>")
    if matrix.size <= BROADCAST_ENTRIES:
        bounds = F.broadcast(bounds)
    sent = local.withColumns({"__shard_source": source, "__shard_place": place}).join(bounds, "__shard_source")
    sent = sent.withColumn("shard", F.expr("size(filter(__shard_bounds, b -> b <= __shard_place))").cast("int"))
    ranges = max(1, math.ceil(total / n_shards / RANGE_ROWS), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_shards))
    unit = F.shiftright(key(2, F.col("__shard_row")), 32) + F.lit(1 << 31)  # from 0 to 2 ** 32 - 1
    sent = sent.select(*carried, "shard", "__shard_row", key(2, F.col("__shard_row")).alias("__shard_key"), F.floor(unit * F.lit(ranges) / F.lit(1 << 32)).cast("int").alias("__shard_range"))
    before = Window.partitionBy("shard").orderBy("__shard_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "__shard_range").count()  # ranges x shards rows
    starts = starts.select("shard", "__shard_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shard_start"))
    within = Window.partitionBy("shard", "__shard_range").orderBy("__shard_key", "__shard_row")
    numbered = sent.withColumn("__shard_nth", F.row_number().over(within) - 1)
    out = numbered.join(starts, ["shard", "__shard_range"]).select(*carried, "shard", (F.col("__shard_start") + F.col("__shard_nth")).alias("slot"))
    return out.toDF(*names, "shard", "slot")

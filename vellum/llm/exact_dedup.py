"""Exact deduplication with a split at heavy hitters.

A frequent-items sketch (Spark's approx_top_k: Misra-Gries counters that merge, so every task
keeps at most TRACKED of them) names the digests that may be frequent. Their exact counts and
winners are then taken in a second, map-side combined pass, so that a wrong candidate does no
harm. That table has at most HEAVY rows and is broadcast: rows of frequent digests are settled
where they lie. All other digests go through an ordinary shuffle: an aggregate that combines before it, and a
join that streams a group's rows past one winner. Everything is a DataFrame operation.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays
(a null doc_id is the smallest); of rows that repeat a doc_id with the same text exactly one
stays (drop(): the one whose other columns have the least hash, so that it is the same when a task
runs again); very long texts are hashed whole, and only their digests are shuffled by mark(); an empty table gives an empty result; other columns are carried and may have any names
but those that start with "__dedup_".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint

#: Digests that are broadcast, at most, and the counters that the sketch keeps to find them.
HEAVY, TRACKED = 1024, 8192


def digest(text: str = "text"):
    """SHA-256 of the text's UTF-8, in lower-case hexadecimal."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def frequent(digests: DataFrame, column: str, heavy: int = HEAVY) -> DataFrame:
    """At most `heavy` candidates for frequent values of column; no column but that one."""
    return (
        digests.agg(F.expr(f"approx_top_k({column}, {heavy}, {max(TRACKED, heavy)})").alias("top"))
        .select(F.explode("top").alias("top"))
        .where("top.count > 1")
        .select(F.col("top.item").alias(column))
    )


def winners(narrow: DataFrame, best, heavy: int = HEAVY) -> DataFrame:
    """(__dedup_digest, __dedup_best, __dedup_n) of the frequent digests, counted exactly."""
    candidates = frequent(narrow, "__dedup_digest", heavy)
    return (
        narrow.join(F.broadcast(candidates), "__dedup_digest", "left_semi")
        .groupBy("__dedup_digest")
        .agg(F.max(best).alias("__dedup_best"), F.count("*").alias("__dedup_n"))
    )


def mark(docs: DataFrame, text: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    best = F.struct(F.col(id_col).alias("id"), F.col("__dedup_row").alias("row"))
    narrow = checkpoint(docs.select(F.col(id_col), digest(text).alias("__dedup_digest"), F.monotonically_increasing_id().alias("__dedup_row")))
    split = narrow.join(F.broadcast(winners(narrow, best, heavy)), "__dedup_digest", "left")
    light = split.where("__dedup_n IS NULL").drop("__dedup_best", "__dedup_n")
    chosen = light.groupBy("__dedup_digest").agg(F.max(best).alias("__dedup_best"), F.count("*").alias("__dedup_n"))
    return split.where("__dedup_n IS NOT NULL").unionByName(light.join(chosen, "__dedup_digest")).select(
        F.col(id_col),
        F.col("__dedup_best.id").alias("keep_id"),
        F.col("__dedup_n").alias("group_size"),
        (F.col("__dedup_best.row") == F.col("__dedup_row")).alias("kept"),
        F.col("__dedup_digest").alias("text_sha256"),
    )


def drop(docs: DataFrame, text: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows of frequent digests that do not stay are left out before the shuffle."""
    best = F.struct(F.col(id_col).alias("id"))
    columns = docs.columns
    rest = [F.col(f"`{c}`") for c in columns if c != text]
    tie = F.xxhash64(F.to_json(F.struct(*rest))).alias("tie")
    narrow = checkpoint(docs.select(F.col(id_col), digest(text).alias("__dedup_digest")))
    found = checkpoint(winners(narrow, best, heavy))
    split = docs.withColumn("__dedup_digest", digest(text)).join(F.broadcast(found), "__dedup_digest", "left")
    heavy_rows = (
        split.where("__dedup_n IS NOT NULL")
        .where(F.col("__dedup_best.id").eqNullSafe(F.col(id_col)))
        .groupBy("__dedup_digest")
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), tie).alias("__dedup_doc"))
        .select("__dedup_doc.*")
    )
    order = Window.partitionBy("__dedup_digest").orderBy(F.col(id_col).desc_nulls_last(), tie)
    light = split.where("__dedup_n IS NULL").withColumn("__dedup_nth", F.row_number().over(order)).where("__dedup_nth = 1").select(*[F.col(f"`{c}`") for c in columns])
    return light.unionByName(heavy_rows)

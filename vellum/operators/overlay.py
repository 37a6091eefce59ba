"""Corrections: an append-only table, the latest of it over the extracted sets, and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(corrections: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last correction of each key. A map-side combined aggregate, not a window."""
    rest = [c for c in corrections.columns if c not in keys]
    return corrections.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("c")).select(*keys, "c.*")


def overlay(base: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """base with `columns` replaced by the latest correction's, whole, and `corrected`."""
    new = latest(corrections.select(*keys, *order, *[F.col(c).alias(f"__{c}") for c in columns if c not in order], *[F.col(c).alias(f"__{c}") for c in columns if c in order], F.lit(True).alias("__yes")), keys, order).drop(*[o for o in order if o not in keys])
    joined = base.join(new, keys, "left")
    out = joined.withColumns({c: F.when(F.col("__yes"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {"corrected": F.coalesce("__yes", F.lit(False))})
    return out.drop("__yes", *[f"__{c}" for c in columns])


def orphans(base: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Corrected keys that the base no longer has."""
    return corrections.select(*keys).distinct().join(base.select(*keys), keys, "left_anti")


def audit(versions: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each version with the one before it, in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return versions.withColumns({"before": F.lag(value).over(w), "after": F.col(value)})


def check(replacement: DataFrame, documents: DataFrame) -> DataFrame:
    """Corrections (doc_id, set_id, value STRUCT) that may be appended; a wrong id or a page beyond the document is an error."""
    pages = F.concat(F.transform("value.locations", lambda x: x["page"]), F.flatten(F.transform("value.components", lambda c: F.transform(c["locations"], lambda x: x["page"]))))
    joined = replacement.join(documents.select("doc_id", "page_count"), "doc_id", "left")
    wrong = F.col("page_count").isNull() | (F.col("value.id") != F.col("set_id")) | F.exists(pages, lambda p: (p < 1) | (p > F.col("page_count")))
    return joined.withColumn("set_id", F.when(wrong, F.raise_error(F.concat(F.lit("not a valid correction of "), "set_id"))).otherwise(F.col("set_id"))).drop("page_count")

"""Sinks: nested results, flat exports, the registry and the corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

#: Columns of the flat export, in order.
EXPORT = (
    "document_id set_id set_number set_description status pages component_id qty unit description catalog_number mfr finish notes"
    " raw_text confidence locations warnings catalog_resolution corrected"
).split()


def export_rows(results: DataFrame) -> DataFrame:
    """One row per component, and one for a set without any, which then has the set's notes. Text that a spreadsheet would run is quoted."""
    rows = results.select(F.col("id").alias("document_id"), F.explode("sets").alias("s")).select("document_id", "s", F.explode_outer("s.components").alias("c"))
    pages = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("c.locations", "s.locations"), lambda x: x["page"]))), ";")
    notes = F.when(F.col("c").isNull(), F.array_join("s.notes", "; ")).otherwise(F.col("c.notes"))
    flat = rows.select(
        "document_id", F.col("s.id").alias("set_id"), F.col("s.set_number").alias("set_number"), F.col("s.description").alias("set_description"), F.col("s.status").alias("status"), pages.alias("pages"), F.col("c.id").alias("component_id"),
        F.coalesce("c.qty_text", F.regexp_replace(F.col("c.qty_num").cast("string"), r"\.0$", "")).alias("qty"), F.col("c.unit").alias("unit"), F.col("c.description").alias("description"), F.col("c.catalog_number").alias("catalog_number"),
        F.col("c.mfr").alias("mfr"), F.col("c.finish").alias("finish"), notes.alias("notes"), F.col("c.raw_text").alias("raw_text"), F.to_json("c.confidence").alias("confidence"), F.to_json("c.locations").alias("locations"),
        F.array_join("c.warnings", "; ").alias("warnings"), F.to_json("c.catalog_resolution").alias("catalog_resolution"), F.col("s.corrected").cast("string").alias("corrected"),
    )
    return flat.select(*[T.csv_guard(c).alias(c) for c in EXPORT])


def write_csv(results: DataFrame, folder: str) -> None:
    export_rows(results).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(folder)


def write_results(results: DataFrame, folder: str) -> None:
    """One folder per document; a document that is written again replaces its own only."""
    results.withColumn("doc", F.col("id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(folder)


def export_json(results: DataFrame) -> DataFrame:
    return results.select("id", F.to_json(F.struct(*results.columns)).alias("json"))


def run_summary(runs: DataFrame) -> DataFrame:
    """runs: path, status (ok or error), set_count, component_count. One row: what a corpus run amounts to."""
    return runs.agg(F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("set_count").alias("sets"), F.sum("component_count").alias("components"))


def register(files: DataFrame, registry: DataFrame, now) -> DataFrame:
    """Registry rows of files whose content is new: id from the content, so that a repeated run adds nothing."""
    from vellum.sources.scan import new_files

    return new_files(files, registry).select(F.substring("sha256", 1, 32).alias("id"), "name", F.element_at(F.split("path", "/"), -2).alias("project"), "sha256", F.col("path").alias("source_path"), F.lit(now).cast("timestamp").alias("created_at"), F.lit("registered").alias("status"))


def _gone(path: str) -> bool:
    """No file is there any more."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
    return store.get_file_info(at).type == fs.FileType.NotFound


def restored(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows whose source is gone and whose content is among the files, with that file as the source."""
    here = files.groupBy("sha256").agg(F.min("path").alias("path"), F.collect_set("path").alias("paths"))
    gone = F.pandas_udf(lambda paths: pd.Series([_gone(p) for p in paths], dtype=bool), "boolean")
    moved = registry.join(here, "sha256").where("NOT array_contains(paths, source_path)").where(gone("source_path"))
    return moved.withColumn("source_path", F.col("path")).select(*registry.columns)

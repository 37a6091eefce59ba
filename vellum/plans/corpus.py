"""A run over a folder of files: one result or one error for each, and what the run amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions.vocabulary import NONE, Vocabulary
from vellum.plans.extract import extract, results
from vellum.sources import positioned
from vellum.stages import cut


def run_folder(spark: SparkSession, folder: str, vocabulary: Vocabulary = NONE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, results, runs) of a folder of positioned-text files (vellum.sources.positioned): one bad file is one error row."""
    files = cut(positioned.load(spark, folder, "files").withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path")))
    files = files.withColumns({"name": F.element_at(F.split("path", "/"), -1), "looks_valid": F.lit(True)})
    table = lambda t: positioned.load(spark, folder, t, errors="skip").drop("path").distinct()  # noqa: E731  copies of a file are read once each, and are one document
    found, runs = run(files, table("words"), table("pages"), table("strikes"), table("cells"), vocabulary)
    return files, found, runs


def run(files: DataFrame, words: DataFrame, pages: DataFrame, strikes: DataFrame | None = None, cells: DataFrame | None = None, vocabulary: Vocabulary = NONE) -> tuple[DataFrame, DataFrame]:
    """files (scan.corpus_files): (results, runs). A document's id is the first half of its file's sha256, as in the registry.

    A file that isn't valid, that its reader has found an error in (a column `error` of files: encrypted, pages missing), that has no pages or has pages out
    of order is an error of its own: it is left out of the extraction, and its result has no sets (null), which replaces an earlier one. runs: path, id, status (ok or error), error, counts."""
    sized = (F.col("page") >= 1) & (F.col("width") > 0) & (F.col("height") > 0)
    read = pages.groupBy(F.col("doc_id").alias("id")).agg(F.bool_and(F.coalesce(sized, F.lit(False))).alias("sound"))
    said = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    one = F.min_by(F.struct("path", "name", "looks_valid", said.alias("said")), "path")
    each = files.withColumn("id", F.substring("sha256", 1, 32)).groupBy("id").agg(one.alias("f")).select("id", "f.*").join(read, "id", "left")
    error = F.when(F.col("said").isNotNull(), F.col("said")).when(~F.col("looks_valid"), "not a readable file").when(F.col("sound").isNull(), "no pages were read").when(~F.col("sound"), "pages need a number from 1 and a size")
    each = cut(each.withColumn("error", error))
    good = each.where("error IS NULL").select(F.col("id").alias("doc_id"))
    kept = lambda t: None if t is None else t.join(good, "doc_id", "left_semi")
    known = each.select(F.col("id").alias("doc_id"), "name", F.element_at(F.split("path", "/"), -2).alias("project"), F.col("path").alias("source_path"))
    found = cut(results(extract(kept(words), kept(pages), kept(strikes), kept(cells), vocabulary), known))
    failed = each.where("error IS NOT NULL").select(
        F.lit("1.0").alias("schema_version"), "id", "name", F.lit(None).cast("string").alias("project"), F.lit(0).alias("page_count"), F.lit(None).cast(f"array<{schemas.SET}>").alias("sets"),
        F.array("error").alias("warnings"), F.lit(None).cast("string").alias("stats"), F.col("path").alias("source_path"),
    )
    counts = found.select("id", "page_count", F.size("sets").alias("set_count"), F.aggregate("sets", F.lit(0), lambda n, s: n + F.size(s["components"])).alias("component_count"), F.size("warnings").alias("warning_count"))
    runs = each.join(counts, "id", "left").select("path", "id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", "page_count", "set_count", "component_count", "warning_count")
    return found.unionByName(failed), runs

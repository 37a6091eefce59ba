"""Upkeep of a store over a folder of positioned-text files: only what has changed is read.

The folder's listing (path, size, time of change; no file is opened for it) is held against the store's sources. Files that are new or changed are hashed, and
those whose content the store doesn't have yet are read. Results, registry and sources change in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.vocabulary import NONE, Vocabulary
from vellum.plans.corpus import run
from vellum.sources import positioned, sinks
from vellum.stages import cut
from vellum.store import Store

#: So many changed files are named to the source, which opens no others; of more, all files are opened and the unchanged ones' rows left out.
MOST_NAMED = 5_000


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (below folder), length and modified of every file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{positioned.SUFFIX}").load(folder)
    below = F.expr(f"substring(path, {len(root) + 2})")
    return files.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"))


def differences(now: DataFrame, known: DataFrame) -> DataFrame:
    """path, length, modified, change: added, changed, same or removed. now: listing(); known: the store's sources."""
    before = known.select("path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), "gone", F.lit(True).alias("known"))
    both = now.withColumn("here", F.lit(True)).join(before, "path", "full")
    same = (F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified")) & ~F.col("gone")
    change = F.when(F.col("here").isNull(), F.when(~F.col("gone"), "removed")).when(F.col("known").isNull(), "added").when(same, "same").otherwise("changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("path", "length", "modified", "change")


def refresh(spark: SparkSession, store: Store, folder: str, now, vocabulary: Vocabulary = NONE) -> dict[str, int]:
    """Brings the store up to the folder; how many files were added, changed, the same and removed, and how many documents were read and failed."""
    since, folder = store.version(), folder.rstrip("/")
    found = cut(differences(listing(spark, folder), store._table("sources")))
    counts = {"added": 0, "changed": 0, "same": 0, "removed": 0} | {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
    touched = found.where("change IN ('added', 'changed')")
    done = counts | {"read": 0, "failed": 0}
    if not counts["added"] + counts["changed"] + counts["removed"]:
        return done
    files = cut(_rows(spark, folder, "files", touched, counts["added"] + counts["changed"]))
    known = store.registry()
    ids = store.saved().select(F.col("id").alias("doc_id"))
    fresh = files.where("error IS NULL").join(ids, "doc_id", "left_anti")
    first = cut(fresh.groupBy("doc_id").agg(F.min("path").alias("path")))
    n = first.count()
    whole = files.withColumns({"path": F.concat(F.lit(folder + "/"), "path"), "name": F.element_at(F.split("path", "/"), -1), "looks_valid": F.lit(True)})
    table = lambda t: _rows(spark, folder, t, first, n).drop("path")
    todo = whole.join(first.select("doc_id"), "doc_id", "left_semi").unionByName(whole.where("error IS NOT NULL"))
    bad = whole.where("error IS NOT NULL").count()
    commit = {}
    if n + bad:  # else all files are copies or new places of documents that are read
        commit["results"], runs = run(todo, table("words"), table("pages"), table("strikes"), table("cells"), vocabulary)
        status = {r["status"]: r["count"] for r in cut(runs).groupBy("status").count().collect()}
        done |= {"read": status.get("ok", 0), "failed": status.get("error", 0)}
    good = whole.where("error IS NULL")
    sources = files.join(touched.select("path", "length", "modified"), ["path"]).select("path", touched["length"], "modified", F.col("doc_id").alias("id"), F.lit(False).alias("gone"))
    removed = found.where("change = 'removed'").join(store._table("sources").select("path", "id"), "path").select("path", "length", "modified", "id", F.lit(True).alias("gone"))
    store.commit(commit | {"registry": sinks.register(good, known, now).unionByName(sinks.restored(good, known)), "sources": sources.unionByName(removed)}, since)
    return done


def _rows(spark: SparkSession, folder: str, table: str, wanted: DataFrame, n: int) -> DataFrame:
    """A table of the wanted files (path), n of them."""
    rows = positioned.load(spark, folder, table, errors="skip")
    if n <= MOST_NAMED:
        return rows.where(F.col("path").isin([r["path"] for r in wanted.select("path").collect()]))
    return rows.join(wanted.select("path"), "path", "left_semi")

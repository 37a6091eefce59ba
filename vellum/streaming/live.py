"""Corrections as they come: the latest of each set is kept as stream state, and what it changes is laid over the results at once.

The stream's state is one aggregate for each key (the last correction so far, by its order), so corrections may come late and in any order. A micro-batch
gives out the keys whose latest correction has changed, joins them with the results, and writes the corrected rows to a folder of its
number; a batch that runs again after a failure replaces its own folder. A view of the results takes each key's newest row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import overlay
from vellum.stages import cut


class LiveOverlay:
    """base: gives the results as they are now (keys, columns, ...); columns: what a correction replaces, whole; order: what tells the latest."""

    def __init__(self, spark: SparkSession, folder: str, base: Callable[[], DataFrame], keys: list[str], columns: list[str], order: list[str]):
        self.spark, self.folder, self.base, self.keys, self.columns, self.order = spark, folder.rstrip("/"), base, keys, columns, order

    def latest(self, corrections: DataFrame) -> DataFrame:
        """A stream of corrections (keys, order, columns) as a stream of each key's latest."""
        rows = corrections.select(*self.keys, F.struct(*self.order).alias("at"), F.struct(*self.columns).alias("new"))
        return rows.groupBy(*self.keys).agg(F.max_by("new", "at").alias("new"))

    def put(self, changed: DataFrame, number: int) -> None:
        """Writes the corrected rows of a micro-batch. Corrections whose key has no result are kept too, with found = false, for the audit."""
        base = self.base().select(*self.keys, F.lit(True).alias("found"))
        rows = changed.join(base, self.keys, "left").select(*self.keys, "new", F.coalesce("found", F.lit(False)).alias("found"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/live/batch={number}")

    def start(self, corrections: DataFrame):
        """Runs what is there of the stream; the query."""
        out = self.latest(corrections).writeStream.outputMode("update").foreachBatch(self.put)
        return out.option("checkpointLocation", f"{self.folder}/_checkpoint").trigger(availableNow=True).start()

    def _newest(self) -> DataFrame:
        live = self.spark.read.parquet(f"{self.folder}/live")
        return live.groupBy(*self.keys).agg(F.max_by(F.struct("new", "found"), "batch").alias("l")).select(*self.keys, "l.*")

    def view(self) -> DataFrame:
        """The results with the corrections so far, and `corrected`."""
        new = self._newest().select(*self.keys, F.col("new").alias("__new"))
        joined = self.base().join(new, self.keys, "left")
        yes = F.col("__new").isNotNull()
        values = {c: F.when(yes, F.col("__new")[c]).otherwise(F.col(c)) for c in self.columns}
        return joined.withColumns(values | {"corrected": yes}).drop("__new")

    def orphans(self) -> DataFrame:
        """The corrected keys that had no result when their correction came, and have none now."""
        return overlay.orphans(self.base(), self._newest().where("NOT found"), self.keys)

    def compact(self) -> None:
        """Writes all batches so far as the newest one, and deletes the others. A reader sees each key's newest row throughout."""
        live = self.spark.read.parquet(f"{self.folder}/live")
        numbers = sorted(r["batch"] for r in live.select("batch").distinct().collect())
        if len(numbers) < 2:
            return
        cut(self._newest()).write.mode("overwrite").parquet(f"{self.folder}/live/batch={numbers[-1]}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in numbers[:-1]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/live/batch={n}")
            path.getFileSystem(conf).delete(path, True)


def sessions(activity: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Spells of activity (of a reviewer, on a document): rows of the same keys with less than `gap` between them. A spell is given out once the watermark has passed its end."""
    spell = activity.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys)
    return spell.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")

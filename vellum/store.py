"""A document store: registry, results, corrections and sources, all as Parquet, in versions that are committed whole.

A commit writes its rows to new folders and then one small file that lists the folders of every table, which is renamed into place under the next version's
number. Readers go by the newest such file: a save that dies leaves the version before it. A rename onto a number that is taken fails, so of two writers that
began at one version the second gets a Conflict and has changed nothing.

Results, registry and sources are tables of the latest row by key: a folder holds what one commit wrote, and of a key that stands in several folders
the last one's row counts. Rows are in buckets by key, so that a look at one document reads one bucket. Corrections are only ever
appended; the latest of a set is laid over its result when it is read, so that reading a document anew keeps them, and the corrections that the audit
shows and those that are laid over results are one table: they can't differ. Any number of documents is read and written at once, as DataFrames.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum import schemas
from vellum.operators import metrics, overlay
from vellum.sources import sinks
from vellum.stages import cut, remove

REGISTRY = "id string, name string, project string, sha256 string, source_path string, created_at timestamp, status string"
SOURCES = "path string, length long, modified timestamp, id string, gone boolean"
#: Schema and key of each table; corrections have no key: every row counts.
TABLES = {"registry": (REGISTRY, "id"), "results": (schemas.RESULT, "id"), "sources": (SOURCES, "path"), "corrections": (schemas.CORRECTIONS, None)}
#: Buckets of a folder, and folders of a table, beyond which a commit writes it whole.
BUCKETS, MOST_FOLDERS = 32, 16
DOCUMENT_ID = re.compile(r"[a-f0-9]{32}")


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class NotFound(LookupError):
    """No document has this id."""


def bucket(key) -> F.Column:
    return F.pmod(F.crc32(key), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # versions

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version's number, 0 before the first commit."""
        fs = self._files()
        if not fs.exists(self._path("_versions")):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(self._path("_versions"))]
        return max((int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)), default=0)

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of every table in a version, in the order of their commits."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/_versions/{version:012d}.json", wholetext=True).collect()))

    def _table(self, name: str, folders: list[str] | None = None, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The table's rows; only: a filter of each folder. A row whose key a later folder holds is left out: small later folders are broadcast, the large first one stays where it is."""
        schema, key = TABLES[name]
        folders = self.folders().get(name, []) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        frames = [only(self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{f}")) for f in folders]
        found = None
        for k, frame in enumerate(frames):
            if key and k + 1 < len(frames):
                later = frames[k + 1].select(key)
                for more in frames[k + 2 :]:
                    later = later.unionByName(more.select(key))
                frame = frame.join(later.distinct(), key, "left_anti")
            found = frame if found is None else found.unionByName(frame)
        return found.select(*self.spark.createDataFrame([], schema).columns)

    def commit(self, rows: dict[str, DataFrame], since: int | None = None) -> int:
        """Adds rows to tables, all or none; the new version. since: the version that the rows were made from, the newest if null."""
        since = self.version() if since is None else since
        folders = self.folders(since)
        for name, frame in rows.items():
            schema, key = TABLES[name]
            place, old = f"{name}/{uuid.uuid4().hex}", folders.get(name, [])
            whole = key is not None and len(old) >= MOST_FOLDERS
            frame = frame.select(*self.spark.createDataFrame([], schema).columns)
            if whole:
                frame = cut(frame)
                frame = frame.unionByName(self._table(name, old).join(frame.select(key), key, "left_anti"))
            frame.withColumn("bucket", bucket(key or "doc_id")).write.partitionBy("bucket").parquet(f"{self.folder}/{place}")
            folders[name] = [place] if whole else [*old, place]
        jvm, fs = self.spark.sparkContext._jvm, self._files()
        draft, final = self._path(f"_versions/_{uuid.uuid4().hex}"), self._path(f"_versions/{since + 1:012d}.json")
        out = fs.create(draft)
        out.write(json.dumps(folders).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {since + 1} was committed by another writer") from None
            raise
        return since + 1

    def vacuum(self) -> int:
        """Deletes the folders that the newest version doesn't list, left by earlier versions and by saves that died; how many. No other writer or reader may be at work."""
        kept, fs, n = {f for fs_ in self.folders().values() for f in fs_}, self._files(), 0
        for name in TABLES:
            for s in fs.listStatus(self._path(name)) if fs.exists(self._path(name)) else []:
                if f"{name}/{s.getPath().getName()}" not in kept:
                    remove(self.spark, s.getPath().toString())
                    n += 1
        return n

    # documents

    def registry(self) -> DataFrame:
        return self._table("registry")

    def register(self, files: DataFrame, now) -> DataFrame:
        """Adds the files (scan.corpus_files) whose content is new; those that were added. A known content whose source is gone takes the new file for its source."""
        since = self.version()
        known = self.registry()
        rows = cut(sinks.register(files, known, now))  # read again once the registry holds them
        self.commit({"registry": rows.unionByName(sinks.restored(files, known))}, since)
        return rows

    def save(self, results: DataFrame) -> None:
        """Writes nested results (schemas.RESULT); `corrected` is reset, corrections stay. Places and confidences that can't be are an error."""
        plain = F.transform("sets", lambda s: s.withField("corrected", F.lit(False)))
        self.commit({"results": schemas.checked(results.withColumn("sets", plain))})

    def saved(self) -> DataFrame:
        return self._table("results").where("sets IS NOT NULL")  # without sets: an error

    def document(self, document_id: str) -> DataFrame:
        """One document's result, if there is one; reads one bucket of each folder. NotFound for what isn't an id or isn't registered."""
        if not DOCUMENT_ID.fullmatch(document_id) or not self._one("registry", document_id).take(1):
            raise NotFound(document_id)
        return self._one("results", document_id).where("sets IS NOT NULL")

    def _one(self, name: str, key: str) -> DataFrame:
        column = TABLES[name][1]
        return self._table(name, only=lambda rows: rows.where((F.col("bucket") == bucket(F.lit(key))) & (F.col(column) == key)))

    def corrections(self) -> DataFrame:
        return self._table("corrections")

    def correct(self, replacements: DataFrame, since: int | None = None) -> None:
        """replacements: doc_id, set_id, seq, updated_at, value. Wrong ids and pages beyond the document are errors, and nothing is appended. since: the version that was seen."""
        since = self.version() if since is None else since
        pages = self.saved().select(F.col("id").alias("doc_id"), "page_count")
        self.commit({"corrections": overlay.check(replacements, pages).select("doc_id", "set_id", "seq", "updated_at", "value")}, since)

    def sets(self) -> DataFrame:
        """doc_id, position, set: the sets as corrected."""
        base = self.saved().select(F.col("id").alias("doc_id"), F.posexplode("sets").alias("position", "set")).withColumn("set_id", F.col("set.id"))
        last = overlay.latest(self.corrections(), ["doc_id", "set_id"], ["seq"]).select("doc_id", "set_id", F.col("value").alias("new"))
        joined = base.join(last, ["doc_id", "set_id"], "left")
        return joined.select("doc_id", "position", F.when(F.col("new").isNotNull(), F.col("new").withField("corrected", F.lit(True))).otherwise(F.col("set")).alias("set"))

    def current(self) -> DataFrame:
        """Nested results as corrected; a correction whose set is gone leaves a warning."""
        placed = F.map_from_entries(F.collect_list(F.struct("position", "set"))).alias("placed")
        sets = self.sets().groupBy("doc_id").agg(placed)
        in_order = F.transform(F.array_sort(F.map_keys("placed")), lambda p: F.element_at("placed", p))
        sets = sets.select(F.col("doc_id").alias("id"), in_order.alias("now"))
        base = self.saved().select(F.col("id").alias("doc_id"), F.explode("sets.id").alias("set_id"))
        gone = overlay.orphans(base, self.corrections(), ["doc_id", "set_id"]).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("gone"))
        out = self.saved().join(sets, "id", "left").join(gone, "id", "left")
        none = F.array().cast("array<string>")
        text = F.concat(F.col("gone").cast("string"), F.lit(" corrections belong to sets that are no longer there."))
        said = F.when(F.col("gone").isNotNull(), F.array(text)).otherwise(none)
        return out.withColumns({"sets": F.coalesce("now", "sets"), "warnings": F.concat(F.coalesce("warnings", none), said)}).drop("now", "gone")

    def audit(self) -> DataFrame:
        """doc_id, set_id, seq, updated_at, before, after: each correction with what it replaced."""
        base = self.saved().select(F.col("id").alias("doc_id"), F.explode("sets").alias("set")).select("doc_id", F.col("set.id").alias("set_id"), "set")
        w = Window.partitionBy("doc_id", "set_id").orderBy("seq")
        found = self.corrections().join(base, ["doc_id", "set_id"], "left")
        return found.select("doc_id", "set_id", "seq", "updated_at", F.coalesce(F.lag("value").over(w), "set").alias("before"), F.col("value").alias("after"))

    def documents(self) -> DataFrame:
        """The registry with each document's counts, zero before it is read, by project and name."""
        sets = self.sets().select("doc_id", "set.*")
        counts = metrics.set_stats(sets).withColumnRenamed("doc_id", "id")
        found = self.registry().join(counts, "id", "left")
        return found.fillna(0, [c for c in counts.columns if c != "id"]).orderBy(F.coalesce("project", F.lit("")), F.lower("name"))

    def export(self) -> DataFrame:
        return sinks.export_rows(self.current())

"""The reading of schedules as a stream: pages come in micro-batches, sets may go on from one to the next.

Most of the reading is a page's own: lines, what each is, votes for columns, rows. Two folds go over a document's pages in order, and are
stateful streams keyed by document: the layout that a region inherits, and the set that is open. Their states are the folds' own (OpenLayout,
OpenSet), a few hundred bytes a document, in RocksDB. Codes and first headings of earlier pages are append-only tables that a batch joins.

    words, pages -> lines, facts, codes (appended) -> votes -> [layout] -> rows of regions -> [set] -> memberships

A batch has a number. Each of its tables is written once, to a folder of that number, and a stream reads each of its files once; so a batch that is fed again
after a failure goes on where it stopped. A document's pages come in order, any number of them in a batch. A page that comes
after a later one of its document was read goes to the table of late pages, and is read by nothing: its document must be read anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.functions.vocabulary import NONE, Vocabulary
from vellum.operators import columns, document
from vellum.operators.lines import group_lines
from vellum.stages import cut

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Takes a document's rows in order of page and `then`, and keeps the fold's state between micro-batches."""

    def __init__(self, fold: type, then: str, names: list[str]):
        self.fold, self.then, self.names = fold, then, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("fold", "state string, last_page int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, last = self.held.get() if self.held.exists() else (None, 0)
        fold = self.fold(json.loads(state) if state else None)
        newest = last
        for row in sorted((r.asDict(True) for r in rows), key=lambda r: (r["page"], r[self.then])):
            if row["page"] > last:  # others have been read
                newest = row["page"]
                if made := fold.step(row):
                    yield Row(doc_id=key[0], **dict(zip(self.names, made, strict=True)))
        self.held.update((json.dumps(fold.state), newest))

    def close(self) -> None:
        pass


def folded(stream: DataFrame, fold: type, then: str, schema: str) -> DataFrame:
    """A stream with doc_id, page and `then` through a fold; schema: of what a step gives."""
    names = [f.split(" ")[0].rstrip(":") for f in _fields(schema)]
    return stream.groupBy("doc_id").transformWithState(Fold(fold, then, names), f"doc_id string, {schema}", "Append", "None")


def _fields(schema: str) -> list[str]:
    """The columns of a schema, split at commas outside brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


VOTES = f"doc_id string, page int, scope int, labelled {columns.STARTS}, n_rows int, starts {columns.STARTS}, named boolean, opens boolean"
LAYOUTS = f"page int, region int, layout {columns.LAYOUT}"
SMALL = "doc_id string, page int, region int, starts_section boolean, may_head boolean, n_heads int, number string, title string, gone boolean, unused boolean, n_rows int"


class SetStream:
    """folder: in the shared storage. feed() takes batches by number; sets() gives what is read so far."""

    def __init__(self, spark: SparkSession, folder: str, vocabulary: Vocabulary = NONE):
        self.spark, self.folder, self.vocabulary = spark, folder.rstrip("/"), vocabulary
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _put(self, name: str, number: int, rows: DataFrame) -> DataFrame:
        """The batch's part of a table, written unless it is there."""
        path = f"{self.folder}/{name}/batch={number:012d}"
        if not self._there(f"{path}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").drop("batch")

    def _fold(self, source: str, schema: str, fold: type, then: str, out: str, to: str) -> None:
        """Runs a stateful stream over the new files of a table."""
        stream = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{source}")
        query = folded(stream, fold, then, out).writeStream.format("parquet").option("path", f"{self.folder}/{to}")
        query.option("checkpointLocation", f"{self.folder}/_{to}").trigger(availableNow=True).start().awaitTermination()

    def feed(self, number: int, words: DataFrame, pages: DataFrame, strikes: DataFrame | None = None) -> None:
        """Reads one batch of pages (schemas.WORDS, PAGES, STRIKES)."""
        keys = ["doc_id", "page"]
        if self._there(f"{self.folder}/facts"):
            earlier = self.spark.read.parquet(f"{self.folder}/facts").where(F.col("batch") < number)
            last = earlier.groupBy("doc_id").agg(F.max("page").alias("last_page"))
            late = self._put("late", number, pages.join(last, "doc_id").where("page <= last_page").select(*keys))
            pages, words = pages.join(late, keys, "left_anti"), words.join(late, keys, "left_anti")
        flagged = document.flagged_lines(cut(group_lines(words)), pages, strikes, self.vocabulary)
        flagged = self._put("lines", number, flagged)
        facts = self._put("facts", number, document.page_facts(flagged))
        self._put("codes", number, document.codes(flagged, self.vocabulary))
        known = self._all("codes").groupBy("doc_id", "code").agg(F.min("first_page").alias("first_page"))
        # Pages before a document's first heading hold no set; a heading may stand in an earlier batch.
        headed = self._all("facts").where("n_heads > 0").groupBy("doc_id").agg(F.min("page").alias("first_page"))
        kept = facts.join(headed, "doc_id").where("page >= first_page").select(*keys)
        lines = document.region_bodies(document.with_legend(flagged.join(kept, keys, "left_semi"), known))
        votes = document.layout_votes(lines, self.vocabulary)
        self._put("votes", number, votes.select(*[f.split(" ")[0] for f in _fields(VOTES)]))
        self._fold("votes", VOTES, columns.OpenLayout, "scope", LAYOUTS, "layouts")
        layouts = self._all("layouts").join(kept, keys, "left_semi")
        found = self._put("regions", number, document.region_rows(lines, layouts, self.vocabulary))
        small = document.membership_rows(found, facts)
        self._put("small", number, small.select(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in _fields(SMALL)]))
        self._fold("small", SMALL, document.OpenSet, "region", document.MEMBERS, "members")

    def late(self) -> DataFrame:
        """doc_id, page: pages that came too late."""
        return self._all("late") if self._there(f"{self.folder}/late") else self.spark.createDataFrame([], "doc_id string, page int")

    def sets(self) -> DataFrame:
        """doc_id, position, set: of the pages read so far, as document.read() gives them."""
        return document.assembled(self._all("regions"), self._all("members"))

"""Sources: document files, text inventories, saved results, gold annotations, and words derived from plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions import text as T


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, sha256, looks_valid of every .pdf below folder, ordered by lower-case path. content isn't kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    marker = F.position(F.lit("%PDF-"), F.decode(F.substring("content", 1, 1024), "ISO-8859-1")) > 0
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), marker.alias("looks_valid")).orderBy(F.lower("path"))


def new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content isn't in the registry (sha256), one of each."""
    return files.join(registry.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min_by(F.struct(*[c for c in files.columns if c != "sha256"]), "path").alias("f")).select("sha256", "f.*")


def select_pages(pages: DataFrame, wanted: list[int] | None, counts: DataFrame | None = None) -> DataFrame:
    """The rows of the wanted pages. counts (doc_id, page_count): a wanted page beyond a document's last is an error, and pages are returned as they are."""
    if wanted is None:
        return pages
    if counts is not None:
        short = counts.where(F.col("page_count") < max(wanted)).orderBy("doc_id").first()
        if short or min(wanted) < 1:
            raise ValueError(f"pages must lie in 1 to {short['page_count'] if short else max(wanted)}")
        return pages
    return pages.where(F.col("page").isin(wanted))


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """Saved results: every .json but summary.json; those without sets (errors) are left out."""
    found = spark.read.schema(schemas.RESULT).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return found.where("sets IS NOT NULL AND source_path IS NOT NULL").where(~F.col("_metadata.file_name").eqNullSafe("summary.json"))


FIELDS = ["qty", "description", "catalog_number", "mfr", "finish", "notes"]
SET_FIELDS = ["description", "status", "notes"]
_ROW = "struct<qty string, description string, catalog_number string, mfr string, finish string, notes string>"
_GOLD = f"array<struct<source_path string, page int, pages array<int>, set_number string, description string, status string, notes array<string>, components array<{_ROW}>>>"


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold sets (an array, or an object with `sets`), each with its number, pages and rows. A row's `annotated`, and a set's, names the fields that are present, null or not. Duplicates are an error."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("json"))
    whole = whole.select(F.when(F.col("json").startswith("{"), F.get_json_object("json", "$.sets")).otherwise(F.col("json")).alias("json"))
    raw = F.from_json("json", "array<struct<components array<map<string,string>>>>")
    named = F.transform(F.from_json("json", "array<map<string,string>>"), lambda m: F.array_intersect(F.map_keys(m), F.array(*map(F.lit, SET_FIELDS))))
    sets = whole.select(F.posexplode(F.arrays_zip(F.from_json("json", _GOLD).alias("gold"), raw.alias("raw"), named.alias("named"))).alias("gold_id", "s"))
    keys = F.transform(F.col("s.raw.components"), lambda m: F.array_intersect(F.map_keys(m), F.array(*map(F.lit, FIELDS))))
    gold = sets.select(
        "s.gold.source_path",
        F.array_sort(F.array_distinct(F.coalesce("s.gold.pages", F.array("s.gold.page")))).alias("pages"),
        "s.gold.set_number",
        "s.gold.description",
        "s.gold.status",
        "s.gold.notes",
        F.col("s.named").alias("annotated"),
        F.arrays_zip(F.col("s.gold.components").alias("row"), keys.alias("annotated")).alias("components"),
    )
    identity = Window.partitionBy(T.path_norm("source_path"), "pages", F.lower("set_number"))
    wrong = F.col("source_path").isNull() | F.col("set_number").isNull() | F.col("components").isNull() | F.exists("pages", lambda p: p.isNull() | (p < 1))
    checked = F.when(wrong, F.raise_error(F.lit("a gold set needs a path, a number, rows and 1-based pages"))).when(F.count("*").over(identity) > 1, F.raise_error(F.lit("a gold set occurs twice"))).otherwise(F.col("set_number"))
    return gold.withColumn("set_number", checked).select(gold_id().alias("gold_id"), "*")


def gold_id(part: int = 0) -> Column:
    """A gold set's number, from what it is: the same when a task runs again. part: of several tables that may hold the same set."""
    return F.xxhash64(T.path_norm("source_path"), "pages", F.lower("set_number"), F.lit(part))


def union_gold(*parts: DataFrame) -> DataFrame:
    """Several gold tables as one, with numbers of their own; columns that a part lacks are null."""
    whole = None
    for n, part in enumerate(parts):
        part = part.withColumn("gold_id", gold_id(n))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole


def text_inventory(lines: DataFrame, before: int = 1, after: int = 2, poor: int = 60) -> DataFrame:
    """Of lines (doc_id, page, line_no, text): pages, text-poor pages, pages with a heading, and the pages around these."""
    page = lines.groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars"), F.bool_or(T.identify_header("text").isNotNull()).alias("heading"))
    doc = page.groupBy("doc_id").agg(
        F.max("page").alias("pages"),
        F.array_sort(F.collect_list(F.when(F.col("chars") < poor, F.col("page")))).alias("poor_pages"),
        F.array_sort(F.collect_list(F.when(F.col("heading"), F.col("page")))).alias("heading_pages"),
    )
    around = F.flatten(F.transform("heading_pages", lambda p: F.sequence(F.greatest(p - before, F.lit(1)), F.least(p + after, F.col("pages")))))
    return doc.withColumn("candidate_pages", F.array_sort(F.array_distinct(around)))


#: Fixed values, in points: a stroke rises less than FLAT and is longer than LONG; a filled box is at most THIN high and wider than WIDE.
FLAT, LONG, THIN, WIDE = 0.6, 12, 1.2, 4


def strikes(drawings: DataFrame) -> DataFrame:
    """drawings (doc_id, page, kind: line or rect, x0, y0, x1, y1) as strokes that may strike text out (schemas.STRIKES).

    A line's ends may come in either order and its first end gives the height; of a box it is the middle."""
    width, height = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    line, rect = (F.col("kind") == "line") & (height < FLAT) & (width > LONG), (F.col("kind") == "rect") & (height <= THIN) & (width > WIDE)
    y = F.when(F.col("kind") == "line", F.col("y0")).otherwise((F.col("y0") + F.col("y1")) / 2)
    return drawings.where(line | rect).select("doc_id", "page", F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"), y.alias("y"))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), line: the lines of plain text. Null text has none."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).select(id_col, (F.col("n") + 1).cast("long").alias("line_no"), "line")


#: Derived geometry: points per character and per line, height of a line, lines of a page.
CHAR, LEADING, HEIGHT, PAGE_LINES = 6, 12, 10, 50


def derive_words(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Words with boxes from plain lines, at fixed pitch; pages of PAGE_LINES lines. Empty tokens hold their place and are then dropped.

    A word's place is one after the space before it. The spaces of a line are found in one pass over its characters, in its own row: no shuffle and no
    sort, and words stay beside the other words of their document."""
    spaces = F.array_compact(F.transform(F.split("line", ""), lambda c, i: F.when(c == " ", i + 1)))
    tokens = F.arrays_zip(F.split("line", " ", -1).alias("w"), F.concat(F.array(F.lit(0)), spaces).alias("x"))
    placed = lines.select(id_col, "line_no", F.posexplode(tokens).alias("k", "t")).select(id_col, "line_no", "k", F.col("t.w").alias("w"), F.col("t.x").alias("x")).where("w <> ''")
    y: Column = ((F.col("line_no") - 1) % PAGE_LINES) * LEADING
    return placed.select(
        id_col,
        (F.floor((F.col("line_no") - 1) / PAGE_LINES) + 1).cast("int").alias("page"),
        "line_no",
        (F.col("k") + 1).cast("long").alias("k"),
        F.col("w").alias("text"),
        (F.col("x") * CHAR).cast("long").alias("x0"),
        y.cast("long").alias("y0"),
        ((F.col("x") + F.length("w")) * CHAR).cast("long").alias("x1"),
        (y + HEIGHT).cast("long").alias("y1"),
    )

"""The registered queries: each applies an operator of the library to whole driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.functions.vocabulary import Vocabulary
from vellum.operators import assignment, audit, columns, evaluate, lookups, metrics, overlay, relate, segments
from vellum.operators.lines import group_lines
from vellum.plans.extract import distinct_notes, extract, finish
from vellum.sources import positioned, scan, sinks
from vellum.stages import cut, new_folder, remove
from vellum.streaming import live

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known(column: str) -> Column:
    """A number, -1 where there is none."""
    return F.coalesce(F.col(column), F.lit(-1)).alias(column.rpartition(".")[2])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.text_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.derive_words(lines(spark, sf_dir))


def word_pages(lines_: DataFrame) -> DataFrame:
    """doc_id, page: the pages of derive_words() that have a word, from the lines alone."""
    page = (F.floor((F.col("line_no") - 1) / scan.PAGE_LINES) + 1).cast("int")
    return lines_.where(F.replace("line", F.lit(" "), F.lit("")) != "").select("doc_id", page.alias("page")).distinct()


def is_heading() -> Column:
    """A heading among the documents' lines: a short sentence that stands alone."""
    return F.col("line").rlike(r"^[^\s]+( [^\s]+){0,2}\.$")


@query
def doc_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.clean("line").alias("text"), F.length(T.clean("line")).cast("long").alias("chars"))


@query
def sections(spark, sf_dir):
    """The flagship: lines in sections by heading, each heading carried forward, and the rows of each section."""
    found = segments.sections(lines(spark, sf_dir), ["doc_id"], ["line_no"], is_heading(), F.col("line"))
    return found.groupBy("doc_id", "section_no", "header").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.sum(F.length("line")).alias("chars"))


@query
def section_forward_fill(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return segments.forward_fill(events, ["user_id"], ["ts", "event_id"], "mark", "carried").select("event_id", "user_id", known("carried"))


@query
def continuation_islands(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    before = F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    found = segments.islands(events, ["user_id"], ["at", "event_id"], before.isNull() | (F.col("at") - before > 6 * 3_600_000_000))
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("at").alias("last_at"))


@query
def content_dedupe(spark, sf_dir):
    """Registers texts as files: of those whose content no labelled document has, one of each."""
    docs = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "doc_id", F.sha2("text", 256).alias("sha256"))
    registry = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return scan.new_files(docs, registry).select("sha256", "doc_id")


@query
def median_column_position(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(columns.middle("l_extendedprice").alias("median_price"), F.count("*").alias("n"))


@query
def unlabelled_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query
def latest_correction(spark, sf_dir):
    return overlay.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


@query
def correction_overlay(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    base = talks.where("turn = 0").select("conv_id", "role", "text")
    return overlay.overlay(base, talks.where("turn > 0").select("conv_id", "turn", "role", "text"), ["conv_id"], ["role", "text"], ["turn"])


@query
def live_overlay(spark, sf_dir):
    """The same corrections as a stream, in three micro-batches whose turns come in no order."""
    talks, folder = table(spark, sf_dir, "conversations"), new_folder(spark, "live")
    later, columns_ = talks.where("turn > 0").select("conv_id", "turn", "role", "text"), ["role", "text"]
    base = talks.where("turn = 0").select("conv_id", *columns_)
    at = live.LiveOverlay(spark, folder, lambda: base, ["conv_id"], columns_, ["turn"])
    for part in (2, 0, 1):
        later.where(F.col("turn") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        at.start(spark.readStream.schema(later.schema).parquet(f"{folder}/in")).awaitTermination()
    found = cut(at.view())
    remove(spark, folder)
    return found


@query
def correction_audit(spark, sf_dir):
    return overlay.audit(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "before", "after")


@query
def correction_orphans(spark, sf_dir):
    """Labels of documents that aren't English: corrections whose set is gone."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return overlay.orphans(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sets with their line items as components."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    row = F.struct("l_linenumber", "l_partkey", "p_brand", "p_name", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    rows = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row)).alias("components"))
    return table(spark, sf_dir, "orders").join(rows, "o_orderkey", "left").withColumn("components", F.coalesce("components", F.array().cast(rows.schema["components"].dataType)))


@query
def nested_assembly(spark, sf_dir):
    rows = F.col("components")
    return nested(spark, sf_dir).select(
        "o_orderkey",
        F.size(rows).alias("n_components"),
        F.aggregate(rows, F.lit(0).cast("long"), lambda a, c: a + c["l_quantity"].cast("long")).alias("quantity"),
        F.array_join(F.transform(rows, lambda c: c["p_brand"]), ";").alias("brands"),
    )


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extracted sets (doc_id, position, set): a row for each item, with its place, confidence and warnings; an order of the first priority also stands under its customer's number."""
    at = lambda page: F.array(F.struct(page.cast("int"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.lit(10.0), F.lit(10.0), F.lit(1), F.lit(1)))
    null = F.lit(None).cast("string")

    def row(c: Column) -> Column:
        number = c["l_linenumber"].cast("string")
        unsure = F.create_map(F.lit("qty"), F.round(1 - c["l_tax"] - c["l_discount"], 4))
        warned = F.when(c["l_linenumber"] == 7, F.array(F.lit("seventh"))).otherwise(F.array().cast("array<string>"))
        quantity = F.when(c["l_linenumber"] != 6, c["l_quantity"])
        texts = (null, null, null, c["p_name"], c["p_brand"], c["l_returnflag"], null, null)
        return F.struct(number, quantity, *texts, unsure, at(c["l_linenumber"]), F.lit(""), warned, F.lit(None), null, F.lit(False)).cast(schemas.COMPONENT)

    orders = nested(spark, sf_dir)
    first = F.col("o_orderpriority").startswith("1")
    described = F.when(first, F.concat(F.lit("and #C"), "o_custkey", F.lit(" - "), "o_orderstatus")).otherwise(F.col("o_orderpriority"))
    key, nothing = F.col("o_orderkey").cast("string"), F.array().cast("array<string>")
    made = F.struct(key, key, described, F.lit("active"), at(F.lit(1)), F.transform("components", row), F.array(F.lit("Note: see list"), F.lit("see list")), nothing, F.lit(0.97), F.lit(False)).cast(schemas.SET)
    return orders.select(key.alias("doc_id"), F.lit(0).alias("position"), made.alias("set"))


@query
def export_rows(spark, sf_dir):
    """One row per component, and one for a set without any."""
    return sinks.export_rows(order_sets(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array("set").alias("sets")))


@query
def csv_guard(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.csv_guard("line").alias("guarded"), T.csv_guard(F.concat(F.lit("="), "line")).alias("forced"))


@query
def code_resolution(spark, sf_dir):
    """Codes (a brand's number) at items, resolved by the last part that defines them."""
    code = F.concat(F.lit("B"), F.regexp_extract("p_brand", "([0-9]+)", 1))
    part = table(spark, sf_dir, "part")
    lookups = relate.last_definition(part.select(code.alias("code"), "p_partkey", "p_name", "p_type"), ["code"], "p_partkey")
    rows = table(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), code.alias("catalog_number"), F.col("p_name").alias("description")), "l_partkey")
    return relate.resolve_codes(rows, lookups, []).select("l_orderkey", "l_linenumber", "l_partkey", "code", F.col("p_partkey").alias("defined_by"), F.col("p_name").alias("resolved"))


@query
def page_overlap_match(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    gold = items.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.collect_set("l_linenumber").alias("pages"))
    predicted = items.where("l_quantity > 40").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.collect_set("l_linenumber").alias("pages"))
    return relate.best_overlap(gold, predicted, "l_suppkey", ["l_returnflag", "l_linestatus"]).select("l_suppkey", "l_returnflag", "l_linestatus", "overlap")


@query
def suffix_path_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    gold = pages.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("gold")).where("gold <> ''").distinct()
    return relate.suffix_match(pages, gold, "path", "gold").select("page_id", "gold")


@query
def band_assignment(spark, sf_dir):
    """Words in four bands whose edges differ by document."""
    shift = F.pmod(F.col("doc_id"), F.lit(7)) * 6
    starts, roles = F.array(F.lit(0), F.lit(60) + shift, F.lit(180) + shift, F.lit(300) + shift), F.array(*map(F.lit, ["qty", "description", "catalog_number", "finish"]))
    return words(spark, sf_dir).groupBy("doc_id", relate.bands(F.col("x0"), starts, roles).alias("role")).agg(F.count("*").alias("n"), F.max("x1").alias("right"))


@query
def bbox_union(spark, sf_dir):
    return words(spark, sf_dir).groupBy("doc_id", "page", "line_no").agg(*G.union_box(), F.count("*").alias("n_words"))


@query
def page_locations(spark, sf_dir):
    """One location per document and page: the union of its words' boxes and the range of its lines."""
    return words(spark, sf_dir).groupBy("doc_id", "page").agg(*G.union_box(), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


@query
def box_grounding(spark, sf_dir):
    """How many of the page's words lie in each line's box, grown by a point on each side."""
    w = words(spark, sf_dir)
    areas = w.groupBy("doc_id", "page", "line_no").agg((F.min("x0") - 1).alias("x0"), (F.min("y0") - 1).alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y1") + 1).alias("y1"))
    return relate.boxes(w.select("doc_id", "page", "x0", "y0", "x1", "y1"), areas, ["doc_id", "page"]).groupBy("a.doc_id", "a.line_no").agg(F.count("*").alias("n_words"))


@query
def box_coverage(spark, sf_dir):
    """The share of each word's box that lies in the left column of its page, where there is any."""
    column = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(200).alias("x1"), F.lit(400).alias("y1"))
    w = words(spark, sf_dir).withColumns({"a": F.struct("x0", "y0", "x1", "y1"), "b": column})
    return w.select("doc_id", "line_no", "k", F.round(G.coverage("a", "b"), 6).alias("coverage")).where("coverage > 0")


@query
def header_evidence(spark, sf_dir):
    found = segments.evidence(lines(spark, sf_dir), ["doc_id"], ["line_no"], F.length("line") > 400)
    return found.where(is_heading()).select("doc_id", "line_no", "has_evidence")


@query
def legend_cumulative(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").withColumn("entry", F.lower(F.split("text", " ")[0]))
    return segments.cumulative_set(talks, ["conv_id"], ["turn"], F.col("entry")).select("conv_id", "turn", F.size("legend").alias("n_entries"))


@query
def needs_inspection(spark, sf_dir):
    """Sets (orders) with a row that is unsure, warned or without quantity."""
    sets = order_sets(spark, sf_dir).select("set.*")
    return sets.where(metrics.needs_inspection()).select(F.col("id").cast("long").alias("o_orderkey"), F.size("components").alias("n_components"))


@query
def search_sets(spark, sf_dir):
    sets = nested(spark, sf_dir)
    return metrics.search(sets, "Red", ["o_orderpriority", F.transform("components", lambda c: c["p_name"])], F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query
def corpus_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return metrics.summary(orders, "o_orderstatus", "price").select("o_orderstatus", "n", F.col("total").cast("double").alias("total"), F.col("largest").cast("double").alias("largest"))


def accuracy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as gold rows, with predictions that are wrong, swapped or missing by rule."""
    items = table(spark, sf_dir, "lineitem")
    odd = lambda n: (F.col("l_partkey") + F.col("l_linenumber")) % n == 0
    gold = F.struct(F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("mfr"), F.when(odd(5), None).otherwise(F.col("l_linestatus")).alias("finish"))
    predicted = F.struct(
        F.when(odd(7), None).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(odd(11), F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("mfr"),
        F.when(odd(5), None).when(odd(11), F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("finish"),
    )
    annotated = F.when(odd(3), F.array(F.lit("qty"), F.lit("mfr"))).otherwise(F.array(F.lit("qty"), F.lit("mfr"), F.lit("finish")))
    return items.select("l_orderkey", "l_linenumber", gold.alias("gold"), F.when(~odd(13), predicted).alias("predicted"), annotated.alias("annotated"))


@query
def metrics_null_safe(spark, sf_dir):
    return metrics.field_accuracy(accuracy_pairs(spark, sf_dir), ["qty", "mfr", "finish"])


@query
def maker_finish_swaps(spark, sf_dir):
    return accuracy_pairs(spark, sf_dir).where(metrics.swapped()).groupBy(F.col("gold.mfr").alias("mfr"), F.col("gold.finish").alias("finish")).agg(F.count("*").alias("n"))


@query
def set_difference_both_ways(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return metrics.difference(orders, items)


@query
def token_overlap(spark, sf_dir):
    """Documents that hold half of a benchmark item's tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("tokens"))
    return metrics.token_overlap(docs, table(spark, sf_dir, "benchmark").select("item_id", T.tokens("text").alias("tokens")), "doc_id", "item_id")


@query
def as_of_header(spark, sf_dir):
    """Each order line with the last heading at most 140 points above it on its page."""
    w = words(spark, sf_dir).groupBy("doc_id", "page", "line_no").agg(F.min("y0").alias("y0"), F.count("*").alias("n"))
    heads = w.where("n <= 3").select("doc_id", "page", F.col("y0").alias("head_y"), F.col("line_no").alias("head_line"))
    return relate.as_of(w.where("n > 3").drop("n"), heads, ["doc_id", "page"], "y0", "head_y", 140).select("doc_id", "line_no", known("head_y"), known("head_line"))


@query
def nearest_header(spark, sf_dir):
    """Each word of a longer line with the nearest left edge of a word in its page's short lines, within 35 points."""
    few = F.size(F.filter(F.split("line", " ", -1), lambda w: w != "")) <= 6
    heads = scan.derive_words(lines(spark, sf_dir).where(few)).select("doc_id", "page", F.col("x0").alias("mark"))
    return relate.nearest(scan.derive_words(lines(spark, sf_dir).where(~few)).select("doc_id", "page", "line_no", "k", "x0"), heads, ["doc_id", "page"], "x0", "mark", 35, "nearest_mark").select("doc_id", "line_no", "k", "x0", known("nearest_mark"))


@query
def stratified_pages(spark, sf_dir):
    pages = words(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return pages.select("doc_id", F.size("pages").alias("n_pages"), F.array_join(metrics.stratified_pages(F.col("pages")), ";").alias("chosen"))


@query
def region_truncation(spark, sf_dir):
    """Lines before the first that ends with a short word, by document."""
    kept = segments.truncate(lines(spark, sf_dir), ["doc_id"], ["line_no"], F.col("line").rlike(r" [a-z]{1,2}\.$"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"))


@query
def line_gaps(spark, sf_dir):
    w = words(spark, sf_dir).groupBy("doc_id", "page", "line_no").agg(F.min("y0").alias("y0"))
    return segments.gap(w, ["doc_id", "page"], ["y0"], "y0").where("gap IS NOT NULL").select("doc_id", "line_no", "gap")


@query
def nearest_anchor(spark, sf_dir):
    """Lines and their nearest heading line, before or after."""
    return segments.nearest_anchor(lines(spark, sf_dir), ["doc_id"], ["line_no"], "line_no", is_heading()).select("doc_id", "line_no", known("anchor"))


@query
def struck_lines(spark, sf_dir):
    """Lines through which a stroke goes: drawn here over the first 120 points of every ninth line."""
    gathered = words(spark, sf_dir).groupBy("doc_id", "page", "line_no").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("words"))
    stroke = F.when(F.col("line_no") % 9 == 0, F.array(F.struct(F.lit(-1).alias("x0"), F.lit(120).alias("x1"), (((F.col("line_no") - 1) % scan.PAGE_LINES) * scan.LEADING + 5.5).alias("y")))).otherwise(F.array().cast("array<struct<x0:int,x1:int,y:double>>"))
    return gathered.withColumn("strikes", stroke).where(G.struck()).select("doc_id", "line_no", F.size("words").alias("n_words"))


@query
def heading_lines(spark, sf_dir):
    """Identified headings: each line's number put after the word SET, with the whole line as its tail in two of three."""
    made = F.concat(F.lit("SET "), F.col("line_no"), F.when(F.col("line_no") % 3 == 0, " - ").when(F.col("line_no") % 3 == 1, " of ").otherwise(""), F.when(F.col("line_no") % 3 == 2, "").otherwise(F.col("line")))
    found = lines(spark, sf_dir).select("doc_id", "line_no", T.identify_header(made).alias("h")).where("h IS NOT NULL")
    return found.select("doc_id", "line_no", F.col("h.set_number").alias("set_number"), F.col("h.description").alias("description"))


@query
def quantity_parse(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") == 1, F.concat(F.col("l_quantity").cast("int"), F.lit("/2"))).when(F.col("l_linenumber") == 2, "A/R").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.parse_qty(raw).alias("q")).groupBy("q.qty_num", "q.qty_text", "q.qty_raw").agg(F.count("*").alias("n"))


@query
def page_ranges(spark, sf_dir):
    text = F.concat(F.col("l_linenumber"), F.lit("-"), F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5, F.lit(", 2"))
    return table(spark, sf_dir, "lineitem").select(text.alias("pages"), F.array_join(T.parse_pages(text), ";").alias("numbers")).groupBy("pages", "numbers").agg(F.count("*").alias("n"))


@query
def output_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.path_norm("url").alias("path"), T.output_name("url").alias("name"), T.short_id("url").alias("id"))


@query
def product_split(spark, sf_dir):
    cell = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" - ", "p_brand", "p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.split_product(cell).alias("s")).select("p_partkey", "s.*")


@query
def cell_join(spark, sf_dir):
    """Wrapped cells: a part's name, type and brand joined, the name ending with a hyphen in every second part and no type in every fifth."""
    cells = F.array(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "-").otherwise("")), F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_type")), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.join_cells(cells).alias("joined"))


@query
def notes_dedupe(spark, sf_dir):
    """Distinct lines of a document in order of first occurrence, as notes."""
    notes = distinct_notes(F.split("text", "\n", -1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(notes).alias("n_notes"), F.sha2(F.array_join(notes, "\n"), 256).alias("notes_sha256"))


@query
def alias_expansion(spark, sf_dir):
    """Sets named `and`: an order of the first priority also stands under its customer's number."""
    found = finish(order_sets(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("o_orderkey"), F.col("set.set_number").alias("set_number"), F.col("set.id").alias("id"), F.col("set.description").alias("description"), F.size("set.components").alias("n_components"), F.size("set.notes").alias("n_notes"), (F.col("late") > 0).alias("is_alias"))


@query
def text_inventory(spark, sf_dir):
    """Pages, text-poor pages and pages with a heading of every document."""
    pages = lines(spark, sf_dir).select("doc_id", (F.floor((F.col("line_no") - 1) / 5) + 1).cast("int").alias("page"), "line_no", F.when(F.col("line_no") % 11 == 0, F.concat(F.lit("SET "), "line_no")).otherwise(F.col("line")).alias("text"))
    join = lambda c: F.array_join(c, ";").alias(c)
    return scan.text_inventory(pages).select("doc_id", "pages", join("poor_pages"), join("heading_pages"), join("candidate_pages"))


@query
def merged_cell_fill(spark, sf_dir):
    """Items of an order take the ship date that was last given, where only even lines give one."""
    items = table(spark, sf_dir, "lineitem").withColumn("given", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")))
    filled = segments.forward_fill(items, ["l_orderkey"], ["l_linenumber", "l_partkey"], "given", "filled").withColumn("filled", known("filled"))
    return filled.groupBy("l_orderkey", "filled").agg(F.count("*").alias("n"))


@query
def page_runs(spark, sf_dir):
    """Runs of adjacent line numbers in an order: sets that continue on the next page."""
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page")).distinct()
    return segments.page_islands(pages, ["l_orderkey"]).groupBy("l_orderkey", "island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


#: The words of the printed orders, as a caller's vocabulary.
TRADE = {"maker": "STANDARD ECONOMY MEDIUM PROMO LARGE SMALL", "finish": "R N A", "noun": "ring bolt gear gizmo anvil plate rod widget"}
#: Where the columns of a printed order begin, and its labels.
PLACES, PRINTED = (60, 100, 250, 430, 500), ("QTY", "DESCRIPTION", "CATALOG", "FINISH", "MFR")
#: Items on a page of a printed order; the others follow on the next page.
PER_PAGE = 4


def printed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its document (a customer), its order's first page, its page, its place there and how the document is printed."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    nth = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rank = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    out = items.withColumns({"nth": nth, "rank": rank})
    page = F.col("rank") * 2 - F.when(F.col("nth") > PER_PAGE, 0).otherwise(1)
    return out.withColumns({"doc_id": F.col("o_custkey").cast("string"), "page": page, "place": F.col("nth") - F.when(F.col("nth") > PER_PAGE, 1 + PER_PAGE).otherwise(1), "is_grid": F.col("o_custkey") % 7 == 0})


def schedule_words(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pages, strikes) of printed schedules: an order begins with a heading and may go on on the next page.

    A third of the documents label every order's columns, a third the first order's only, a third none. Every
    fourth item's description goes over two lines where there are labels; every second document strikes its second items out."""
    cell = lambda k, text: F.struct(F.lit(k).alias("role"), F.lit(float(PLACES[k])).alias("x"), text.alias("text"))
    labels = F.col("o_custkey") % 3
    wrapped, name = (labels > 0) & (F.col("l_linenumber") % 4 == 3), F.split("p_name", " ")
    rows = items.withColumn("y", F.lit(150) + 20 * F.col("place"))
    first = F.array(cell(0, F.col("l_quantity").cast("int").cast("string")), cell(1, F.when(wrapped, name[0]).otherwise(F.col("p_name"))), cell(2, F.col("p_brand")), cell(3, F.col("l_returnflag")), cell(4, F.col("p_type")))
    heads = items.where("nth = 1")
    lines_ = rows.select("doc_id", "page", "y", first.alias("cells"))
    lines_ = lines_.unionByName(rows.where(wrapped).select("doc_id", "page", (F.col("y") + 9).alias("y"), F.array(cell(1, name[1])).alias("cells")))
    lines_ = lines_.unionByName(heads.select("doc_id", "page", F.lit(100).alias("y"), F.array(cell(0, F.concat(F.lit("HARDWARE SET: "), "o_orderkey"))).alias("cells")))
    labelled = heads.where((labels == 1) | ((labels == 2) & (F.col("rank") == 1)))
    lines_ = lines_.unionByName(labelled.select("doc_id", "page", F.lit(120).alias("y"), F.array(*[cell(k, F.lit(t)) for k, t in enumerate(PRINTED)]).alias("cells")))
    step = lambda acc, w: F.struct((acc["x"] + 5 * (F.length(w) + 1)).alias("x"), F.concat(acc["out"], F.array(F.struct(acc["x"].alias("x"), w.alias("w")))).alias("out"))
    parts = F.aggregate(F.split("c.text", " "), F.struct(F.col("c.x").alias("x"), F.array().cast("array<struct<x:double,w:string>>").alias("out")), step)["out"]
    placed = lines_.select("doc_id", "page", "y", F.explode("cells").alias("c")).select("doc_id", "page", "y", "c.role", F.posexplode(parts).alias("k", "p"))
    y = F.col("y").cast("double")
    seq = (F.col("y") * 1000 + F.col("role") * 100 + F.col("k")).cast("int").alias("word_seq")
    words_ = placed.select("doc_id", "page", seq, F.col("p.x").alias("x0"), y.alias("y0"), (F.col("p.x") + 5 * F.length("p.w")).alias("x1"), (y + 9).alias("y1"), F.col("p.w").alias("text"), F.lit(False).alias("rotated"))
    struck = rows.where((F.col("o_custkey") % 2 == 1) & (F.col("l_linenumber") == 2))
    strikes = struck.select("doc_id", "page", F.lit(50.0).alias("x0"), F.lit(600.0).alias("x1"), (F.col("y") + 9 * G.STRIKE_AT).cast("double").alias("y"))
    pages = items.select("doc_id", "page").distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(False).alias("ocr"))
    return words_, pages, strikes


def schedule_grid(items: DataFrame) -> DataFrame:
    """Cells of ruled schedules: a table for each page, the set's cell merged over its rows and blank where an order goes on."""
    texts = F.array(F.when(F.col("nth") == 1, F.col("o_orderkey").cast("string")).otherwise(F.lit("")), F.col("p_name"), F.concat_ws(" - ", "p_type", "p_brand"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"), F.lit(""))
    heads = F.array(*map(F.lit, ("SET", "HARDWARE TYPE", "MANUFACTURER - PRODUCT", "QTY", "FINISH", "NOTES")))
    rows = items.select("doc_id", "page", (F.col("place") + 1).alias("row_no"), texts.alias("t")).unionByName(items.where("place = 0").select("doc_id", "page", F.lit(0).alias("row_no"), heads.alias("t")))
    cells = rows.select("doc_id", "page", F.lit(0).alias("table_no"), "row_no", F.posexplode("t").alias("col_no", "text"))
    x, y = F.col("col_no") * 100.0, F.col("row_no") * 34.0 + 60
    return cells.select("*", x.alias("x0"), y.alias("y0"), (x + 99).alias("x1"), (y + 33).alias("y1"))


@query
def extract_schedules(spark, sf_dir):
    """The whole extraction over printed orders gives the items back, but for those struck out."""
    kinds = [(k, v) for k, vs in TRADE.items() for v in vs.split()]
    items = printed_orders(spark, sf_dir)
    words_, _, strikes = schedule_words(items.where("NOT is_grid"))
    pages = schedule_words(items)[1]
    found = extract(words_, pages, strikes, schedule_grid(items.where("is_grid")), Vocabulary.read(spark.createDataFrame(kinds, "kind string, value string")))["components"]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "set_number", F.col("qty_num").alias("qty"), "description", "catalog_number", "finish", "mfr")


@query
def line_grouping(spark, sf_dir):
    """Lines of the documents' words, each moved up or down by less than the tolerance."""
    w = words(spark, sf_dir).withColumn("jitter", (F.pmod(F.hash("text"), F.lit(5)) - 2) * 0.3)
    w = w.select(F.col("doc_id").cast("string").alias("doc_id"), "page", (F.col("line_no") * 10_000 + F.col("k")).cast("int").alias("word_seq"), F.col("x0").cast("double"), (F.col("y0") + F.col("jitter")).alias("y0"), F.col("x1").cast("double"), (F.col("y1") + F.col("jitter")).alias("y1"), "text", F.lit(False).alias("rotated"))
    grouped = group_lines(w)
    return grouped.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "line_no", F.size("words").alias("n_words"))


def positioned_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: every document that has a word, as a positioned-text file."""
    w = words(spark, sf_dir).withColumns({"doc_id": F.col("doc_id").cast("string"), "word_seq": (F.col("line_no") * 10_000 + F.col("k")).cast("int"), "rotated": F.lit(False)})
    places = {c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}
    pages = word_pages(lines(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("doc_id"), "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(False).alias("ocr"))
    return positioned.contents(w.withColumns(places), pages)


@query
def positioned_words(spark, sf_dir):
    """The documents, written as positioned-text files and read back by the data source: the words of every page."""
    folder = new_folder(spark, "positioned")
    positioned.register(spark)
    positioned_contents(spark, sf_dir).withColumnRenamed("doc_id", "path").write.format("positioned").mode("append").save(folder)
    found = positioned.load(spark, folder, "words")
    of_page = found.groupBy(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "page").agg(
        F.count("*").alias("n_words"), F.sum("x0").cast("long").alias("x0"), F.sum("x1").cast("long").alias("x1"), F.sum("y1").cast("long").alias("y1"),
        F.sum(F.length("text")).alias("chars"), F.max("text").alias("last_word"),
    )
    of_page = cut(of_page)
    remove(spark, folder)
    return of_page


@query
def document_check(spark, sf_dir):
    """Files of all kinds through the table function: documents as positioned text, those whose id 3 divides with a page too few, and web pages, which are none."""
    made = positioned_contents(spark, sf_dir)
    n = F.regexp_extract("content", r"^positioned-text 1 (\d+)", 1)
    more = F.regexp_replace("content", r"^positioned-text 1 \d+", F.concat(F.lit("positioned-text 1 "), (n.cast("int") + 1).cast("string")))
    files = made.select(F.concat(F.lit("document/"), "doc_id").alias("path"), F.when(F.col("doc_id").cast("long") % 3 == 0, more).otherwise(F.col("content")).alias("content"))
    files = files.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("path"), F.col("html").alias("content")))
    return positioned.tables_of(files, table="files").select("path", "page_count", "error")


@query
def assign_rows(spark, sf_dir):
    """Items of an order assigned to a disturbed copy of them."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    gold = F.struct(F.col("l_quantity").cast("string").alias("qty"), F.col("p_name").alias("description"), F.col("p_brand").alias("catalog_number"), F.col("l_returnflag").alias("mfr"), F.col("l_linestatus").alias("finish"))
    changed = F.struct(F.col("l_quantity").cast("string").alias("qty"), F.when(F.col("l_linenumber") % 3 == 0, F.reverse("p_name")).otherwise(F.upper("p_name")).alias("description"), F.when(F.col("l_linenumber") % 4 == 0, None).otherwise(F.col("p_brand")).alias("catalog_number"), F.col("l_returnflag").alias("mfr"), F.col("l_linestatus").alias("finish"))
    pairs = items.groupBy(F.col("l_orderkey").alias("set_key")).agg(F.array_sort(F.collect_list(gold)).alias("gold"), F.array_sort(F.collect_list(F.when(F.col("l_linenumber") != 5, changed))).alias("predicted"))
    return assignment.match_rows(pairs).select(F.col("set_key").cast("long").alias("o_orderkey"), "gold_row", "predicted_row", F.round("weight", 6).alias("weight"))


@query
def assignment_totals(spark, sf_dir):
    """Items of an order assigned to a copy of them without the fifth, in capitals: the greatest total is that of all copies with their own."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    row = lambda name: F.struct(F.col("l_quantity").cast("string").alias("qty"), name.alias("description"), F.col("p_brand").alias("catalog_number"), F.col("l_returnflag").alias("mfr"), F.col("l_linestatus").alias("finish"))
    gold, copy = row(F.col("p_name")), F.when(F.col("l_linenumber") != 5, row(F.upper("p_name")))
    pairs = items.groupBy(F.col("l_orderkey").alias("set_key")).agg(F.array_sort(F.collect_list(gold)).alias("gold"), F.array_sort(F.collect_list(copy)).alias("predicted"))
    found = assignment.match_rows(pairs).groupBy(F.col("set_key").cast("long").alias("o_orderkey"))
    return found.agg(F.count("*").alias("n_gold"), F.count_if(F.col("predicted_row") >= 0).alias("n_matched"), F.round(F.sum("weight"), 2).alias("total"))


def gold_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gold, results): orders as gold sets, and as results that lack every fifth order, the fifth item of each, and the maker of the third; that swap maker
    and finish of the second; and that add an item of their own to orders of the first priority. An item's product carries its place, so that it has one partner."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    fields = [F.col("l_quantity").cast("string").alias("qty"), F.col("p_name").alias("description"), F.concat_ws("-", "p_brand", "nth").alias("catalog_number"), F.col("l_returnflag").alias("mfr"), F.col("l_linestatus").alias("finish"), F.lit(None).cast("string").alias("notes")]
    annotated = F.array(*map(F.lit, ("qty", "description", "catalog_number", "mfr")))
    gold_row = F.struct(F.struct(*fields).alias("row"), annotated.alias("annotated"))
    at = F.array(F.struct(F.lit(1), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.lit(10.0), F.lit(10.0), F.lit(1), F.lit(1)))
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    mfr = F.when(F.col("nth") == 3, "other").when(F.col("nth") == 2, F.col("l_linestatus")).otherwise(F.col("l_returnflag"))
    finish = F.when(F.col("nth") == 2, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))
    texts = (null, null, null, F.upper("p_name"), fields[2], mfr, finish, null)
    component = F.struct(F.col("nth").cast("string"), F.col("l_quantity").cast("double"), *texts, F.create_map(F.lit("qty"), F.lit(0.9)), at, F.lit(""), none, F.lit(None), null, F.lit(False)).cast(schemas.COMPONENT)
    extra = F.struct(F.lit("x"), F.lit(1.0), null, null, null, F.lit("%%%%"), null, null, null, null, F.create_map(F.lit("qty"), F.lit(0.9)), at, F.lit(""), none, F.lit(None), null, F.lit(False)).cast(schemas.COMPONENT)
    rows = items.withColumn("nth", nth).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", gold_row.alias("g")))).alias("gold"), F.array_sort(F.collect_list(F.when(F.col("nth") != 5, F.struct("nth", component.alias("c")))), lambda a, b: a["nth"] - b["nth"]).alias("found"))
    orders = table(spark, sf_dir, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    key, name = F.col("o_orderkey").cast("string"), F.concat(F.lit("o"), "o_orderkey", F.lit(".pdf"))
    gold = orders.select(
        F.col("o_orderkey").alias("gold_id"), name.alias("source_path"), F.array(F.lit(1)).alias("pages"), key.alias("set_number"), F.col("o_orderpriority").alias("description"), F.lit("active").alias("status"),
        F.lit(None).cast("array<string>").alias("notes"), F.array(F.lit("description"), F.lit("status")).alias("annotated"), F.transform("gold", lambda x: x["g"]).alias("components"),
    )
    described = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("other")
    own = F.when(F.col("o_orderpriority").startswith("1"), F.array(extra)).otherwise(F.array().cast(f"array<{schemas.COMPONENT}>"))
    components = F.concat(F.transform("found", lambda x: x["c"]).cast(f"array<{schemas.COMPONENT}>"), own.cast(f"array<{schemas.COMPONENT}>"))
    made = F.struct(key, key, described, F.lit("active"), at, components, none, none, F.lit(0.9), F.lit(False)).cast(schemas.SET)
    results = orders.where("o_orderkey % 5 <> 0").select(F.lit("1.0").alias("schema_version"), key.alias("id"), name.alias("name"), F.lit("p").alias("project"), F.lit(1).alias("page_count"), F.array(made).alias("sets"), none.alias("warnings"), null.alias("stats"), F.concat(F.lit("corpus/"), name).alias("source_path"))
    return gold, results


@query
def evaluation_metrics(spark, sf_dir):
    """The whole evaluation: documents by path, sets, rows by assignment, fields of rows and of sets."""
    return evaluate.evaluate(*gold_orders(spark, sf_dir))[0]


@query
def evaluation_extra_rows(spark, sf_dir):
    """Predicted rows that no gold row was matched with, for each set."""
    found = evaluate.unmatched(evaluate.matched_pairs(*gold_orders(spark, sf_dir)))
    return found.groupBy(F.col("set_key").cast("long").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("row.description").alias("description"))


@query
def grounding_failures(spark, sf_dir):
    """Audit of lines as rows: every third line's box lies beyond its page, so that it is wrong and holds no words."""
    plain = lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", "[^A-Za-z0-9 ]", ""))
    w = scan.derive_words(plain).withColumn("doc_id", F.col("doc_id").cast("string"))
    boxes = w.groupBy("doc_id", "page", "line_no").agg(*G.union_box())
    rows = boxes.join(plain.withColumn("doc_id", F.col("doc_id").cast("string")), ["doc_id", "line_no"])
    away = F.when(F.col("line_no") % 3 == 0, 10_000_000).otherwise(0)
    box = F.array(*[(F.col(c) + (away if c[0] == "x" else 0)).cast("double") for c in ("x0", "y0", "x1", "y1")])
    at = F.array(F.struct(F.col("page").alias("page"), box.alias("bbox")))
    null = F.lit(None).cast("string")
    components = rows.select("doc_id", F.col("line_no").alias("row"), F.col("line").alias("description"), F.col("line").alias("raw_text"), null.alias("catalog_number"), null.alias("mfr"), null.alias("finish"), at.alias("locations"))
    pages = word_pages(plain).select(F.col("doc_id").cast("string").alias("doc_id"), "page", F.lit(9_000_000.0).alias("width"), F.lit(792.0).alias("height"))
    return audit.failure_counts(audit.source_grounding(components, w, pages))


@query
def legend_codes(spark, sf_dir):
    """Parts listed as the entries of legends, twenty on a page: the last meaning of each code."""
    nth = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1
    part = table(spark, sf_dir, "part").withColumn("nth", nth).select(
        F.col("p_size").cast("string").alias("doc_id"), (F.floor(F.col("nth") / 20) + 1).cast("int").alias("page"), (F.col("nth") % 20 + 2).cast("int").alias("line_no"),
        F.concat(F.lit("b"), F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit(" = "), "p_name", F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_type").alias("text"),
    )
    titles = part.select("doc_id", "page").distinct().select("*", F.lit(1).alias("line_no"), F.lit("HARDWARE LEGEND").alias("text"))
    word = lambda t, k: F.struct(t.alias("text"), (k * 60.0).alias("x0"), F.lit(0.0).alias("y0"), (k * 60.0 + 50).alias("x1"), F.lit(9.0).alias("y1"))
    printed = part.unionByName(titles).select("doc_id", "page", "line_no", F.transform(F.split("text", " "), word).alias("words"))
    return lookups.find_lookups(printed).select(F.col("doc_id").cast("long").alias("p_size"), "page", "code", "description", "catalog_number", "mfr", "line_no", "confidence")


@query
def ratio_similarity(spark, sf_dir):
    """Each part's name against its type, and both normalized."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.ratio("p_name", "p_type"), 9).alias("ratio"), T.normalize(F.concat(F.lit("  ﬁne "), "p_type")).alias("normalized"))


@query
def row_grounding(spark, sf_dir):
    """Each line's text against the words in the box of the line below it, so that some are found and some not."""
    w = words(spark, sf_dir)
    boxes = w.groupBy("doc_id", "page", "line_no").agg(*G.union_box())
    rows = boxes.join(lines(spark, sf_dir), ["doc_id", "line_no"])
    below = rows.withColumns({"y0": F.col("y0") + scan.LEADING, "y1": F.col("y1") + scan.LEADING})
    return audit.grounding(below, w, ["doc_id", "page"], "line_no", "line").select("doc_id", "line_no", "wanted", "found", "grounded")

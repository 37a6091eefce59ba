"""Command line: extract, corpus, refresh, evaluate, correct, audit and export.

    python -m vellum extract --words W --pages P [--strikes S] [--grid G] [--registry R] [--vocabulary V] [--only 1-3,5] --store DIR
    python -m vellum corpus --files DIR --words W --pages P [--strikes S] [--grid G] [--vocabulary V] [--register] --store DIR
    python -m vellum corpus --positioned DIR [--vocabulary V] [--register] --store DIR
    python -m vellum refresh --positioned DIR [--vocabulary V] --store DIR
    python -m vellum evaluate --gold FILE [--source PATH ...] [--positioned DIR [--vocabulary V]] --store DIR
    python -m vellum correct --corrections C [--since VERSION] --store DIR
    python -m vellum audit --store DIR
    python -m vellum export --store DIR --to DIR [--format csv|json]

Tables are Parquet; --source names the documents to evaluate. evaluate reads the folder first, if one is given; refresh reads what has changed in it since
the last time. correct appends corrections (schemas.CORRECTIONS), if the store is still at the version that was seen. Exit code 1 on an error (corpus: of any document), 130 when interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime


def pages(text: str) -> list[int]:
    """'1-3,5' -> [1, 2, 3, 5]."""
    out: set[int] = set()
    for part in text.split(","):
        low, _, high = part.strip().partition("-")
        first, last = int(low), int(high or low)
        if not 1 <= first <= last:
            raise ValueError(f"not a page range: {part}")
        out.update(range(first, last + 1))
    return sorted(out)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellum")
    verbs = parser.add_subparsers(dest="verb", required=True)
    extract = verbs.add_parser("extract")
    for name in ("words", "pages", "store"):
        extract.add_argument(f"--{name}", required=True)
    for name in ("strikes", "grid", "registry", "vocabulary"):
        extract.add_argument(f"--{name}")
    extract.add_argument("--only", type=pages)
    corpus = verbs.add_parser("corpus")
    corpus.add_argument("--store", required=True)
    for name in ("positioned", "files", "words", "pages", "strikes", "grid", "vocabulary"):
        corpus.add_argument(f"--{name}")
    corpus.add_argument("--register", action="store_true")
    evaluate = verbs.add_parser("evaluate")
    evaluate.add_argument("--source", nargs="+")
    evaluate.add_argument("--gold", required=True)
    evaluate.add_argument("--store", required=True)
    refresh = verbs.add_parser("refresh")
    refresh.add_argument("--positioned", required=True)
    refresh.add_argument("--store", required=True)
    for verb in (evaluate, refresh):
        verb.add_argument("--vocabulary")
    evaluate.add_argument("--positioned")
    correct = verbs.add_parser("correct")
    correct.add_argument("--corrections", required=True)
    correct.add_argument("--since", type=int)
    correct.add_argument("--store", required=True)
    verbs.add_parser("audit").add_argument("--store", required=True)
    export = verbs.add_parser("export")
    export.add_argument("--store", required=True)
    export.add_argument("--to", required=True)
    export.add_argument("--format", choices=["csv", "json"], default="csv")
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from vellum.functions.vocabulary import NONE, Vocabulary
    from vellum.operators.evaluate import evaluate as measure
    from vellum.operators import relate
    from vellum.plans import upkeep
    from vellum.plans.corpus import run as corpus_run
    from vellum.plans.corpus import run_folder
    from vellum.plans.extract import extract as read
    from vellum.plans.extract import results
    from vellum.sources import scan, sinks
    from vellum.store import REGISTRY, Store

    spark = SparkSession.builder.appName("vellum").getOrCreate()
    store = Store(spark, given.store)
    try:
        if given.verb == "extract":
            counts = spark.read.parquet(given.pages).groupBy("doc_id").agg(F.max("page").alias("page_count"))
            scan.select_pages(counts, given.only, counts)  # a page that isn't there is an error
            table = lambda p: scan.select_pages(spark.read.parquet(p), given.only) if p else None
            words = Vocabulary.read(spark.read.parquet(given.vocabulary)) if given.vocabulary else NONE
            found = read(table(given.words), table(given.pages), table(given.strikes), table(given.grid), words)
            known = spark.read.parquet(given.registry) if given.registry else spark.createDataFrame([], REGISTRY).withColumnRenamed("id", "doc_id")
            store.save(results(found, known.select("doc_id", "name", "project", "source_path")))
            print(json.dumps(store.saved().selectExpr("count(*) documents", "sum(size(sets)) sets").first().asDict()))
        elif given.verb == "corpus":
            table = lambda p: spark.read.parquet(p) if p else None
            words = Vocabulary.read(table(given.vocabulary)) if given.vocabulary else NONE
            if given.positioned:
                files, found, runs = run_folder(spark, given.positioned, words)
            elif not (given.files and given.words and given.pages):
                raise ValueError("corpus needs --positioned, or --files, --words and --pages")
            else:
                files = scan.corpus_files(spark, given.files)
            if files.isEmpty():
                raise ValueError(f"no files in {given.positioned or given.files}")
            if not given.positioned:
                found, runs = corpus_run(files, table(given.words), table(given.pages), table(given.strikes), table(given.grid), words)
            store.save(found)
            runs.write.mode("overwrite").parquet(f"{given.store}/runs")
            if given.register:
                good = spark.read.parquet(f"{given.store}/runs").where("status = 'ok'").select("path")
                store.register(files.join(good, "path", "left_semi"), datetime.now(UTC))
            summary = sinks.run_summary(spark.read.parquet(f"{given.store}/runs")).first().asDict()
            print(json.dumps(summary))
            return 1 if summary["failed"] else 0
        elif given.verb == "refresh":
            words = Vocabulary.read(spark.read.parquet(given.vocabulary)) if given.vocabulary else NONE
            summary = upkeep.refresh(spark, store, given.positioned, datetime.now(UTC), words)
            print(json.dumps(summary))
            return 1 if summary["failed"] else 0
        elif given.verb == "correct":
            store.correct(spark.read.parquet(given.corrections), given.since)
            print(json.dumps({"version": store.version()}))
        elif given.verb == "audit":
            for r in store.audit().select(F.to_json(F.struct("*")).alias("json")).toLocalIterator():
                print(r["json"])
        elif given.verb == "evaluate":
            gold = scan.load_gold(spark, given.gold)
            if given.positioned:
                words = Vocabulary.read(spark.read.parquet(given.vocabulary)) if given.vocabulary else NONE
                store.save(run_folder(spark, given.positioned, words)[1])
            if given.source:
                wanted = spark.createDataFrame([(p,) for p in given.source], "wanted string")
                gold = gold.join(relate.suffix_match(gold.select("source_path").distinct(), wanted, "source_path", "wanted").select("source_path"), "source_path", "left_semi")
            rows, _ = measure(gold, store.saved())
            print(json.dumps([r.asDict() for r in rows.collect()]))
        elif given.format == "csv":
            sinks.write_csv(store.current(), given.to)
        else:
            sinks.export_json(store.current()).select("json").write.mode("overwrite").text(given.to)
    except KeyboardInterrupt:
        return 130
    except Exception as error:  # a message and a code, as a command should
        print(f"error: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

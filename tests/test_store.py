"""Corrections survive a new reading; wrong ones are refused; counts and the command line."""

import json
from datetime import datetime

import pytest

from vellum import schemas
from vellum.__main__ import main, pages
from vellum.store import Store
from tests.test_extract import DOCS, page


def a_set(i, number, **more):
    at = {"page": 1, "bbox": [0.0, 0.0, 1.0, 1.0], "page_width": 10.0, "page_height": 10.0, "line_start": 1, "line_end": 1}
    return {"id": i, "set_number": number, "description": None, "status": "active", "locations": [at], "components": [], "notes": [], "warnings": [], "confidence": 0.9, "corrected": False} | more


def test_corrections(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    result = spark.createDataFrame([("1.0", "d", "a.pdf", "p", 2, [a_set("s1", "1"), a_set("s2", "2")], [], None, "a.pdf")], schemas.RESULT)
    store.save(result)
    fix = lambda seq, value: spark.createDataFrame([("d", value["id"] if seq != 9 else "s1", seq, datetime(2024, 1, seq), value)], schemas.CORRECTIONS)
    store.correct(fix(1, a_set("s1", "1", description="first")))
    store.correct(fix(2, a_set("s1", "1", description="second")))
    with pytest.raises(Exception, match="not a valid correction"):
        store.correct(fix(9, a_set("other", "1")))
    with pytest.raises(Exception, match="not a valid correction"):
        store.correct(fix(3, a_set("s2", "2", locations=[a_set("x", "1")["locations"][0] | {"page": 3}])))
    store.save(result)  # read anew
    now = store.current().first()
    assert [(s["description"], s["corrected"]) for s in now["sets"]] == [("second", True), (None, False)] and now["warnings"] == []
    assert sorted((r["seq"], r["before"]["description"], r["after"]["description"]) for r in store.audit().collect()) == [(1, None, "first"), (2, "first", "second")]
    store.save(spark.createDataFrame([("1.0", "d", "a.pdf", "p", 2, [a_set("s2", "2")], [], None, "a.pdf")], schemas.RESULT))
    assert "no longer there" in store.current().first()["warnings"][0]
    assert store.documents().count() == 0 and store.export().count() == 1


def test_register_once(spark, tmp_path):
    from vellum.sources import scan

    for name, data in (("a.pdf", b"%PDF-1 x"), ("b.pdf", b"%PDF-1 x"), ("c.pdf", b"%PDF-2")):
        (tmp_path / name).write_bytes(data)
    store = Store(spark, str(tmp_path / "store"))
    files = scan.corpus_files(spark, str(tmp_path))
    assert store.register(files, "2024-01-01").count() == 2 and store.register(files, "2024-01-02").count() == 0
    assert [r["set_count"] for r in store.documents().collect()] == [0, 0]


def test_command_line(spark, tmp_path, capsys):
    words, facts = [], []
    for number, rows in DOCS["plain"]:
        w, p = page("plain", number, rows)
        words += w
        facts.append(p)
    spark.createDataFrame(words, schemas.WORDS).write.parquet(str(tmp_path / "w"))
    spark.createDataFrame(facts, schemas.PAGES).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("plain", "plain.pdf", "x", "x/plain.pdf")], "doc_id string, name string, project string, source_path string").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("noun", n) for n in ("hinge", "stop", "silencer", "closer", "seal", "lockset")], "kind string, value string").write.parquet(str(tmp_path / "v"))
    at = str(tmp_path / "s")
    assert main(["extract", "--words", str(tmp_path / "w"), "--pages", str(tmp_path / "p"), "--only", "2,9", "--store", at]) == 1
    assert "pages must lie in 1 to 3" in capsys.readouterr().err
    assert main(["extract", "--words", str(tmp_path / "w"), "--pages", str(tmp_path / "p"), "--registry", str(tmp_path / "r"), "--vocabulary", str(tmp_path / "v"), "--store", at]) == 0
    assert json.loads(capsys.readouterr().out) == {"documents": 1, "sets": 3}
    (tmp_path / "gold.json").write_text('[{"source_path": "plain.pdf", "page": 1, "set_number": "01", "components": [{"description": "hinge", "mfr": "IVE"}]}]')
    assert main(["evaluate", "--gold", str(tmp_path / "gold.json"), "--store", at]) == 0
    rows = {r["metric"]: (r["correct"], r["total"]) for r in json.loads(capsys.readouterr().out)}
    assert rows["set_recall"] == (1, 1) and rows["row_precision"] == (1, 3) and rows["field_mfr"] == (1, 1)
    assert main(["export", "--store", at, "--to", str(tmp_path / "csv")]) == 0 and spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 7
    assert main(["evaluate", "--gold", str(tmp_path / "none.json"), "--store", at]) == 1
    assert pages("1-3,5") == [1, 2, 3, 5]


def test_corpus_command(spark, tmp_path, capsys):
    import hashlib

    (tmp_path / "f" / "job").mkdir(parents=True)
    for name, data in (("good.pdf", b"%PDF-1 good"), ("unread.pdf", b"%PDF-1 unread"), ("bad.pdf", b"no"), ("odd.pdf", b"%PDF-1 odd")):
        (tmp_path / "f" / "job" / name).write_bytes(data)
    ids = {k: hashlib.sha256(d).hexdigest()[:32] for k, d in (("good", b"%PDF-1 good"), ("odd", b"%PDF-1 odd"))}
    words, facts = [], [(ids["odd"], 0, 612.0, 792.0, False)]
    for number, rows in DOCS["plain"]:
        w, p = page(ids["good"], number, rows)
        words += w
        facts.append(p)
    spark.createDataFrame(words, schemas.WORDS).write.parquet(str(tmp_path / "w"))
    spark.createDataFrame(facts, schemas.PAGES).write.parquet(str(tmp_path / "p"))
    at = str(tmp_path / "s")
    stale = spark.createDataFrame([("1.0", ids["odd"], "odd.pdf", "p", 2, [a_set("s1", "1")], [], None, "odd.pdf")], schemas.RESULT)
    Store(spark, at).save(stale)
    call = ["corpus", "--files", str(tmp_path / "f"), "--words", str(tmp_path / "w"), "--pages", str(tmp_path / "p"), "--register", "--store", at]
    assert main(call) == 1
    summary = json.loads(capsys.readouterr().out)
    assert (summary["succeeded"], summary["failed"], summary["sets"]) == (1, 3, 3)
    store = Store(spark, at)
    assert [(r["id"], r["project"]) for r in store.saved().collect()] == [(ids["good"], "job")] and [r["id"] for r in store.registry().collect()] == [ids["good"]]
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in spark.read.parquet(at + "/runs").collect()}
    assert errors == {"good.pdf": None, "unread.pdf": "no pages were read", "bad.pdf": "not a readable file", "odd.pdf": "pages need a number from 1 and a size"}
    assert [r["set_count"] for r in store.documents().collect()] == [3]
    assert main(["corpus", "--files", str(tmp_path / "none"), "--words", "w", "--pages", "p", "--store", at]) == 1
    (tmp_path / "gold.json").write_text('[{"source_path": "job/good.pdf", "page": 1, "set_number": "01", "components": []}, {"source_path": "other.pdf", "page": 1, "set_number": "01", "components": []}]')
    capsys.readouterr()
    assert main(["evaluate", "--gold", str(tmp_path / "gold.json"), "--source", "job/good.pdf", "--store", at]) == 0
    assert {r["metric"]: r["total"] for r in json.loads(capsys.readouterr().out)}["set_recall"] == 1

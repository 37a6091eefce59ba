"""One-commit store and upkeep: versions, conflicts, point lookups, restored sources, only changed files are read."""

import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_extract import DOCS, page
from tests.test_store import a_set
from vellum import schemas
from vellum.plans import upkeep
from vellum.sources import positioned, scan
from vellum.store import Conflict, NotFound, Store

A, B = "a" * 32, "b" * 32


def result(spark, *rows):
    return spark.createDataFrame([("1.0", i, f"{i}.pdf", "p", 2, sets, [], None, f"{i}.pdf") for i, sets in rows], schemas.RESULT)


def fix(spark, seq, description, doc=A):
    return spark.createDataFrame([(doc, "s1", seq, datetime(2024, 1, seq), a_set("s1", "1", description=description))], schemas.CORRECTIONS)


def test_versions_conflicts_and_a_save_that_dies(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.saved().count() == 0
    store.save(result(spark, (A, [a_set("s1", "1")]), (B, [a_set("t1", "1")])))
    seen = store.version()
    store.correct(fix(spark, 1, "first"), seen)
    with pytest.raises(Conflict):
        store.correct(fix(spark, 2, "second"), seen)  # two writers that saw the same version
    assert store.version() == 2 and store.corrections().count() == store.audit().count() == 1
    monkeypatch.setattr(Store, "_files", lambda self: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        store.commit({"results": result(spark, (A, []))}, 2)
    monkeypatch.undo()
    assert store.version() == 2 and {r["id"]: len(r["sets"]) for r in store.saved().collect()} == {A: 1, B: 1}
    store.save(result(spark, (A, [a_set("s1", "1"), a_set("s2", "2")])))
    assert {r["id"]: len(r["sets"]) for r in store.saved().collect()} == {A: 2, B: 1}
    assert [s["description"] for s in store.current().where(F.col("id") == A).first()["sets"]] == ["first", None]
    assert store.vacuum() >= 0 and {r["id"]: len(r["sets"]) for r in store.saved().collect()} == {A: 2, B: 1}


def test_many_saves_are_written_whole(spark, tmp_path, monkeypatch):
    import vellum.store

    monkeypatch.setattr(vellum.store, "MOST_FOLDERS", 2)
    store = Store(spark, str(tmp_path / "s"))
    for k in range(4):
        store.save(result(spark, (A, [a_set("s1", str(k))]), (f"{k:032d}", [])))
        assert {r["id"]: [s["set_number"] for s in r["sets"]] for r in store.saved().collect()} == {A: [str(k)]} | {f"{j:032d}": [] for j in range(k + 1)}
    assert len(store.folders()["results"]) <= 2 and store.vacuum() > 0


def test_point_lookup_and_wrong_ids(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([(A, "a", "p", "x", "/a", datetime(2024, 1, 1), "registered")], "id string, name string, project string, sha256 string, source_path string, created_at timestamp, status string")
    store.commit({"results": result(spark, (A, [a_set("s1", "1")]), (B, [])), "registry": row})
    found = store.document(A)
    assert [r["id"] for r in found.collect()] == [A]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(id," in plan
    for wrong in (B, "../" + A, A.upper(), ""):
        with pytest.raises(NotFound):
            store.document(wrong)


@pytest.mark.parametrize("broken", [
    a_set("s1", "1", confidence=1.5),
    a_set("s1", "1", locations=[a_set("x", "1")["locations"][0] | {"page": 0}]),
    a_set("s1", "1", locations=[a_set("x", "1")["locations"][0] | {"bbox": [2.0, 0.0, 1.0, 1.0]}]),
    a_set("s1", "1", locations=[a_set("x", "1")["locations"][0] | {"bbox": [0.0, 0.0, float("inf"), 1.0]}]),
    a_set("s1", "1", locations=[a_set("x", "1")["locations"][0] | {"line_end": 0}]),
])
def test_what_cannot_be_is_not_saved(spark, tmp_path, broken):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match="a place or a confidence that can't be"):
        store.save(result(spark, (A, [broken])))
    assert store.version() == 0


def test_a_missing_source_is_restored(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.pdf").write_bytes(b"%PDF-1 x")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "copy.pdf").write_bytes(b"%PDF-1 x")
    store = Store(spark, str(tmp_path / "s"))
    store.register(scan.corpus_files(spark, str(tmp_path / "one")), "2024-01-01")
    store.register(scan.corpus_files(spark, str(tmp_path / "two")), "2024-01-02")
    assert store.registry().first()["source_path"].endswith("one/a.pdf")  # the source is there
    os.remove(tmp_path / "one" / "a.pdf")
    assert store.register(scan.corpus_files(spark, str(tmp_path / "two")), "2024-01-03").count() == 0
    row = store.registry().collect()
    assert len(row) == 1 and row[0]["source_path"].endswith("two/copy.pdf") and row[0]["created_at"] == datetime(2024, 1, 1)


def test_only_changed_files_are_read(spark, tmp_path):
    folder, store = tmp_path / "f", Store(spark, str(tmp_path / "s"))
    words, facts = [], []
    for name in ("plain", "swapped"):
        for number, rows in DOCS[name]:
            w, p = page(name, number, rows)
            words += w
            facts.append(p)
    positioned.register(spark)
    made = positioned.contents(spark.createDataFrame(words, schemas.WORDS), spark.createDataFrame(facts, schemas.PAGES)).withColumnRenamed("doc_id", "path")
    made.write.format("positioned").mode("append").save(str(folder))
    (folder / "bad.ptx").write_text("no")
    refresh = lambda: upkeep.refresh(spark, store, str(folder), "2024-01-01")
    assert refresh() == {"added": 3, "changed": 0, "same": 0, "removed": 0, "read": 2, "failed": 1}
    plain = (folder / "plain.ptx").read_bytes()
    doc = hashlib.sha256(plain).hexdigest()[:32]
    assert {r["id"] for r in store.registry().collect()} == {r["id"] for r in store.saved().collect()} and store.registry().count() == 2
    fixed = store.saved().where(F.col("id") == doc).first()["sets"][0].asDict(True)
    store.correct(spark.createDataFrame([(doc, fixed["id"], 1, datetime(2024, 1, 1), fixed | {"description": "fixed"})], schemas.CORRECTIONS))
    # What isn't said to have changed isn't opened: its content may be anything.
    old = (folder / "plain.ptx").stat()
    (folder / "plain.ptx").write_bytes(b"x" * old.st_size)
    os.utime(folder / "plain.ptx", ns=(old.st_atime_ns, old.st_mtime_ns))
    version = store.version()
    assert refresh() == {"added": 0, "changed": 0, "same": 3, "removed": 0, "read": 0, "failed": 0} and store.version() == version
    (folder / "swapped.ptx").write_bytes((folder / "swapped.ptx").read_bytes().replace(b"OFFICE", b"STUDIO!"))
    os.remove(folder / "plain.ptx")
    (folder / "moved.ptx").write_bytes(plain)
    assert refresh() == {"added": 1, "changed": 1, "same": 1, "removed": 1, "read": 1, "failed": 0}
    assert store.registry().where(F.col("id") == doc).first()["source_path"].endswith("moved.ptx")
    now = store.current().where(F.col("id") == doc).first()
    assert [s["description"] for s in now["sets"]][0] == "fixed" and store.document(doc).count() == 1
    assert {r["path"]: r["gone"] for r in store._table("sources").collect()} == {"bad.ptx": False, "moved.ptx": False, "plain.ptx": True, "swapped.ptx": False}
    assert refresh()["same"] == 3


def test_verbs_of_the_command_line(spark, tmp_path, capsys):
    import json

    from vellum.__main__ import main

    words, facts = [], []
    for number, rows in DOCS["plain"]:
        w, p = page("job/plain", number, rows)
        words += w
        facts.append(p)
    positioned.register(spark)
    made = positioned.contents(spark.createDataFrame(words, schemas.WORDS), spark.createDataFrame(facts, schemas.PAGES)).withColumnRenamed("doc_id", "path")
    made.write.format("positioned").mode("append").save(str(tmp_path / "f"))
    (tmp_path / "gold.json").write_text('[{"source_path": "job/plain.ptx", "page": 1, "set_number": "01", "components": []}]')
    at = ["--store", str(tmp_path / "s")]
    assert main(["evaluate", "--gold", str(tmp_path / "gold.json"), "--positioned", str(tmp_path / "f"), *at]) == 0
    assert {r["metric"]: (r["correct"], r["total"]) for r in json.loads(capsys.readouterr().out)}["set_recall"] == (1, 1)
    assert main(["refresh", "--positioned", str(tmp_path / "f"), *at]) == 0
    assert json.loads(capsys.readouterr().out)["added"] == 1
    store = Store(spark, at[1])
    doc = store.saved().first()
    fixed = doc["sets"][0].asDict(True) | {"description": "fixed"}
    spark.createDataFrame([(doc["id"], fixed["id"], 1, datetime(2024, 1, 1), fixed)], schemas.CORRECTIONS).write.parquet(str(tmp_path / "c"))
    assert main(["correct", "--corrections", str(tmp_path / "c"), "--since", str(store.version()), *at]) == 0
    capsys.readouterr()
    assert main(["correct", "--corrections", str(tmp_path / "c"), "--since", str(store.version() - 1), *at]) == 1
    assert "committed by another writer" in capsys.readouterr().err
    assert main(["audit", *at]) == 0
    assert [(json.loads(x)["seq"], json.loads(x)["after"]["description"]) for x in capsys.readouterr().out.splitlines()] == [(1, "fixed")]

"""Round trips through archives whose payloads hold record starts, in ranges of a few bytes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import warc
from vellum.llm.common import new_folder


def rows():
    inner = warc.record(5, "http://x", b"inner payload", "0" * 64).decode()
    long = "<p>" + "long " * 3000
    out = [(0, "http://a\r\nb", "<p>small"), (1, None, "<p>small"), (2, "u", long), (9, "u", long), (7, "u", long)]
    out += [(20, "u", None), (21, "u", ""), (22, "ü", "é" * 99), (23, "u", "é" * 99), (3, "u", inner * 4), (4, "u", "x\r\n\r\n" + inner), (6, "u", "WARC/1.1\r\n" * 30), (8, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + long)]
    return out + [(100 + i, "u", f"{inner}{i}" * (i % 5)) for i in range(40)]


def want(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    least = {}
    for i, p in data:
        least[p] = min(i, least.get(p, i))
    return sorted((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if len(p) >= 100 and i != least[p] else "response", least[p] if len(p) >= 100 and i != least[p] else None) for i, p in data)


def test_round_trip(spark, monkeypatch):
    for span, parts, most in ((1 << 20, 2, 1000), (64, 1, 0), (700, 3, 1000)):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        folder = new_folder(spark, "warc-test")
        files = warc.write(spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(parts, "page_id"), folder)
        got = warc.read(files, folder, span).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got)) == want(rows()), span


def test_empty_and_repeated(spark):
    folder = new_folder(spark, "warc-test")
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder), folder).count() == 0
    again = [(1, "u", "a" * 200), (1, "u", "a" * 200), (None, "u", "b" * 200), (2, "u", "b" * 200)]
    got = warc.read(warc.write(spark.createDataFrame(again, "page_id long, url string, html string"), folder), folder).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == [("1", "response", "None")] * 2 + [("2", "revisit", "None"), ("None", "response", "None")]


def test_a_url_of_any_length_and_other_columns(spark):
    long = "x" * 17_000_000
    pages = [(1, long, "a" * 200, "f"), (2, "u", "b", "g"), (3, "u" * 9000, "WARC/1.1\r\n" * 3000, "h")]
    folder = new_folder(spark, "warc-test")
    files = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string, file string").repartition(1), folder)
    for span in (warc.RANGE, 1 << 20):
        got = warc.read(files, folder, span).collect()
        assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(1, 200), (2, 1), (3, 30000)]


def test_a_lost_record_is_an_error(spark):
    folder = new_folder(spark, "warc-test")
    files = warc.write(spark.createDataFrame([(i, "u", "a" * 300) for i in range(9)], "page_id long, url string, html string").repartition(1), folder)
    with pytest.raises(Exception, match="can't be read"):
        warc.read(files.withColumn("records", F.col("records") + 1), folder)
    with pytest.raises(Exception, match="can't be read"):
        warc.read(files.withColumn("size", F.col("size") - 3), folder)

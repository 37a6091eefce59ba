"""A stream of corrections equals the overlay after each batch; sessions equal the islands of a batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.operators import overlay
from vellum.streaming import live

SCHEMA = "k long, seq long, a string, b string"


def test_view_equals_the_overlay_after_each_batch(spark, tmp_path):
    r = random.Random(1)
    base = spark.createDataFrame([(k, f"a{k}", None if k % 3 else f"b{k}", "kept") for k in range(30)], "k long, a string, b string, other string")
    at = live.LiveOverlay(spark, str(tmp_path / "live"), lambda: base, ["k"], ["a", "b"], ["seq"])
    rows, seq = [], list(range(200))
    r.shuffle(seq)  # late corrections come after later ones
    for batch in range(3):
        new = [(r.randrange(40), seq.pop(), r.choice([None, "x", "y"]), f"n{len(seq)}") for _ in range(25)]
        rows += new
        spark.createDataFrame(new, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        at.start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).awaitTermination()
        want = overlay.overlay(base, spark.createDataFrame(rows, SCHEMA), ["k"], ["a", "b"], ["seq"])
        got = at.view().select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert {x["k"] for x in at.orphans().collect()} == {x[0] for x in rows if x[0] >= 30}
        if batch == 1:
            at.compact()
            assert sorted(map(repr, at.view().select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_sessions_of_review(spark, tmp_path):
    r, start = random.Random(2), datetime(2024, 1, 1)
    rows = sorted((f"d{r.randrange(3)}", start + timedelta(minutes=r.randrange(2000))) for _ in range(60))
    parts = [rows[k::3] for k in range(3)] + [[("end", start + timedelta(days=30))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "doc string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc string, at timestamp").parquet(str(tmp_path / "in"))
        out = live.sessions(stream, "at", ["doc"], "30 minutes", "3 days").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for doc, at in rows:
        spells = want.setdefault(doc, [])
        if spells and at - spells[-1][1] < timedelta(minutes=30):
            spells[-1] = (spells[-1][0], at, spells[-1][2] + 1)
        else:
            spells.append((at, at, 1))
    got = spark.read.parquet(str(tmp_path / "out")).where("doc <> 'end'").select("doc", "session_start", F.expr("session_end - INTERVAL 30 MINUTES"), "n").collect()
    assert sorted(map(tuple, got)) == sorted((d, *s) for d, ss in want.items() for s in ss)

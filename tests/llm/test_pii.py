"""Personal data: the plain finders against literal patterns, disguises, places, clean texts, odd input."""

import hashlib
import os
import random
import re

import pytest

from vellum.llm import pii, queries

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    """The contract's words, literally."""
    count = lambda s: len(re.sub("[^0-9]", "", s))
    out = []
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= count(s) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= count(s) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text or "") if good(m.group())]
    return out


def plain(text):
    return [s[:3] for s in pii.spans(text) if s[3]]


def test_plain_finders_equal_the_literal_patterns():
    r = random.Random(3)
    pieces = ["a", "b.c", "@", "@", ".", "-", "+", "+1", " ", "1", "23", "4111111111111111", "192.168.0.1", "256", "(", ")", "\n", "é", "x@y.zz", "_", "%", "555", "0001"]
    for _ in range(6000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(30)))
        assert plain(text) == brute(text), text
    for _ in range(4000):
        text = "".join(r.choice("0123456789 -.+()") for _ in range(r.randrange(60)))
        assert plain(text) == brute(text), text


DISGUISED = [
    ("email", "write to john.doe (at) example (dot) com now", "john.doe (at) example (dot) com"),
    ("email", "write to john[at]example[dot]co[dot]uk.", "john[at]example[dot]co[dot]uk"),
    ("email", "reach me: john at example dot com, thanks", "john at example dot com"),
    ("email", "reach JOHN AT EXAMPLE DOT COM", "JOHN AT EXAMPLE DOT COM"),
    ("email", "ask john dot doe at mail dot example dot org today", "john dot doe at mail dot example dot org"),
    ("email", "ask bob.7 at mail1.example.com about it", "bob.7 at mail1.example.com"),
    ("email", "ask bob@example dot com about it", "bob@example dot com"),
    ("email", "ask bob(@)example[.]com about it", "bob(@)example[.]com"),
    ("email", "ask bob&#64;example&#46;com about it", "bob&#64;example&#46;com"),
    ("email", "ask jоhn@exаmple.com about it", "jоhn@exаmple.com"),  # Cyrillic o and a
    ("email", "ask ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ please", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "ask jo​hn@exam­ple.com please", "jo​hn@exam­ple.com"),
    ("email", "é à john {at} exаmple {dot} com", "john {at} exаmple {dot} com"),
    ("ip", "host 192[.]168[.]1[.]20 is up", "192[.]168[.]1[.]20"),
    ("ip", "host 192 dot 168 dot 1 dot 20 is up", "192 dot 168 dot 1 dot 20"),
    ("ip", "host one nine two dot one six eight dot one dot two is up", None),
    ("ip", "host １９２．１６８．１．２０ is up", "１９２．１６８．１．２０"),
    ("ip", "host l92.l68.O.1 is up", "l92.l68.O.1"),
    ("card", "card 4lll 1111 1111 1111 ok", "4lll 1111 1111 1111"),
    ("card", "card ٤١١١١١١١١١١١١١١١ ok", "٤١١١١١١١١١١١١١١١"),
    ("card", "card 4111–1111–1111–1111 ok", "4111–1111–1111–1111"),
    ("card", "pay four one one one one one one one one one one one one one one one soon", "four one one one one one one one one one one one one one one one"),
    ("card", "pay four triple one, one one one one, 1111 1111 soon", "four triple one, one one one one, 1111 1111"),
    ("phone", "call plus one five five five zero one two three four now", "plus one five five five zero one two three four"),
    ("phone", "call +1 (five five five) 867 five three oh nine now", "+1 (five five five) 867 five three oh nine"),
    ("phone", "call ＋１ ５５５ ０１２３４５６ now", "＋１ ５５５ ０１２３４５６"),
]


@pytest.mark.parametrize(("kind", "text", "want"), DISGUISED)
def test_disguises_are_found_at_their_source_places(kind, text, want):
    found = [text[a:b] for k, a, b, p in pii.spans(text) if k == kind]
    if want is None:  # digits of a part keep their spaces, so this is no address
        return
    assert want in found, (found, pii.deobfuscate(text)[0].text)
    around = "Die Straße — naïve ﬁt. " + text + " trailing words"
    assert want in [around[a:b] for k, a, b, p in pii.spans(around) if k == kind]


@pytest.mark.parametrize("text", [
    "Look at example dot by dot until noon", "at the dot of noon", "meet me at example.com today", "one of two, three or four. Five more at six.", "un deux trois quatre cinq",
    "see section 1.2.3 (a) b.c and [a] d.e", "l'école à 1.5 point de vue", "the dot com boom at large", "zero tolerance; version 1.2.3.400", "acht und neun at home . com",
    "plus one more, plus 12 345", "IO 10 lO", "mail bob at the office", "x < at > ", "token = \"e51a5499e3950eabef3742d6cf40b27b4e61a74a\"",
])
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


def test_plain_spans_stay_beside_disguised_ones():
    text = "а.b@c.dd and e@f.gg"  # the first letter is Cyrillic
    assert plain(text) == brute(text)
    assert ("email", 0, 8, False) in pii.spans(text)
    assert [s for s in pii.spans("mail bob@x.org dot every")] == [("email", 5, 14, True)]


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, " " * 400_000, "+1" * 200_000, "at " * 100_000, "one " * 60_000, "[" * 300_000, "a" + " " * 300_000 + "at", "x at y dot com " * 30_000):
        pii.spans(text)


def test_places_go_back_through_all_edits():
    r = random.Random(5)
    for _ in range(500):
        source = "".join(r.choice("abcdef") for _ in range(40))
        now, where = pii.Mapped(source), [(k, k + 1) for k in range(40)]
        for _ in range(3):
            edits, at = [], 0
            while at < len(now.text):
                at += r.randrange(6)
                end = min(len(now.text), at + 1 + r.randrange(3))
                if at < end:
                    edits.append((at, end, "X" * r.randrange(4)))
                at = end
            new, past = [], 0
            for a, b, x in edits:
                new += where[past:a] + [(where[a][0], where[b - 1][1])] * len(x)
                past = b
            where = new + where[past:]
            now = now.edited(edits)
            assert len(now.text) == len(where)
        for k, w in enumerate(where):
            assert now.back(k, k + 1) == w


def test_query_and_odd_input(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cc +1 (042) 555-7845"), (3, "a@b.cc +1 (042) 555-7845"), (None, "x at y dot com"), (4, "w " * 50_000 + "10.0.0.1")]
    docs = spark.createDataFrame([(d, t, "old", "k") for d, t in rows], "doc_id long, text string, pii string, kind string")
    out = pii.find(docs).collect()
    assert len(out) == 6 and all(r["kind"] == "k" for r in out)
    assert [len(r["pii"]) for r in out] == [0, 0, 2, 2, 1, 1]
    assert pii.find(docs.limit(0)).count() == 0
    assert [r["text"] for r in pii.mask(docs).where("doc_id = 3 OR doc_id IS NULL").collect()] == ["[EMAIL] [PHONE]"] * 2 + ["[EMAIL]"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query_equals_brute_force_on_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_pii(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == w[0] for w in want) for k in pii.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"] == text

"""Messages against enumeration, held-out accuracy, and defined results of the extraction."""

import itertools

import numpy as np
import pytest

from vellum.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.train(H.training_pages())


def test_marginals_equal_enumeration():
    r = np.random.default_rng(5)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 2, 0, 1])
    kind, score, pair = r.integers(0, 3, 8), r.normal(size=8), r.normal(size=(3, 2, 2))
    got = H.sum_product(parent, H.levels_of(depth), kind, score, pair)
    total, marginal, edge = 0.0, np.zeros(8), np.zeros((8, 2, 2))
    for state in itertools.product((0, 1), repeat=8):
        s = np.array(state)
        p = np.exp(s @ score + sum(pair[kind[i], s[parent[i]], s[i]] for i in range(8) if parent[i] >= 0))
        total += p
        marginal += p * s
        for i in range(8):
            if parent[i] >= 0:
                edge[i, s[parent[i]], s[i]] += p
    assert np.allclose(got.marginal, marginal / total)
    assert np.allclose(got.edge[parent >= 0], (edge / total)[parent >= 0])


def test_held_out_pages(model):
    forest = H.Forest()
    for k, p in enumerate(H.training_pages(80, seed=77)):
        forest.add_page(k, p)
    got = H.sum_product(*H._arrays(forest), H._scores(forest, model.unary), model.pair)
    right = [(got.marginal[a] >= 0.5) == forest.label[a] for _, a, _ in forest.runs]
    assert np.mean(right) > 0.98 and len(right) > 1000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script>
<header class="site-header"><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please accept them.</p><button>OK</button></div><!-- <p>no</p> -->
<article><h1>A &amp; B</h1><p>First&nbsp;line
  goes   on.<p><b>Bold.<br><p>x &lt; y &copy <a href="/l">with a link</a> inside.</p><div class="ad">Buy now, it is cheap.</div><ul><li>One point.<li>Two points.</ul></article>
<aside><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside><div class="comments"><p>I liked this story a lot, thanks.</p></div>
<form action="/s"><input name="q"><button>Go</button></form><footer>&copy; Site</footer></body></html>"""


def test_page(spark, model):
    rows = [(1, PAGE, "u"), (2, None, "u"), (3, "", None), (4, "<article><p>" + "word " * 60000 + "<", "u"), (1, PAGE, "u")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, html string, url string")).select("page_id", "text").collect()
    assert len(got) == 5
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "A & B\nFirst line goes on.\nBold.\nx < y © with a link inside.\nOne point.\nTwo points."
    assert by[2] == by[3] == "" and len(by[4].split()) == 60001
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def texts(source):
    forest = H.Forest()
    forest.add_page(0, source)
    return [t for _, _, t in forest.runs]


def test_open_elements_end_with_their_parent():
    body = "<article><p>One.</p></article>"
    whole = [
        "<head><title>T</title><meta charset=x>" + body,
        "<head><title>T</title><body>" + body,
        "<head><title>T<body>" + body,
        "<head><script src='a.js'></head><body>" + body + "<script>b</script>",
        "<head><script>var a = '</head>';</script><noscript><style>p{}</noscript></head>" + body,
        "<head><!-- open <style>p{}</style></head><body>" + body,
        "<head><svg class='i'/>" + body,
        "<div><svg class='i'/>" + body + "</div><svg><title>t</title><path/></svg>",
        "<div><svg class='i'><path d='z'></div>" + body,
        "<a href='/'><svg class='i'><path d='z'></a>" + body,
        "<svg><g><svg>t</svg>t</g>t</svg><svg><text>t<p>One.</p>",
        "<div><select><option>t</div>" + body,
        "<div><noscript>t<iframe src=x></noscript><template>t<template>t</template>t</template></div>" + body,
        "<div><noscript>t</div>" + body + "<div><template><b>t</div>",
        "<select-box></select-box><svg-icon></svg-icon>" + body,
    ]
    assert [texts(w) for w in whole] == [["One."]] * len(whole)
    assert texts("a<svg><text>t</text></svg>b <script>x</script><select><option>t</select>c") == ["ab c"]


def test_stray_quotes_lose_nothing_and_leak_nothing():
    for q in "'\"":
        page = f"<p>See <a href=/o{q}brien>the page</a> that doesn{q}t end.</p><p>Two.</p><p>It{q}s three.</p>"
        assert texts(page) == [f"See the page that doesn{q}t end.", "Two.", f"It{q}s three."]
        assert texts(f"<p>A <img alt={q}5{q} tall{q}> b</p><p>C.</p>") == ["A  b", "C."] or texts(f"<p>A <img alt={q}5{q} tall{q}> b</p><p>C.</p>") == ["A b", "C."]
        assert texts(f"<p title={q}open>One.</p><p>Two.</p>") == ["One.", "Two."]
        assert texts(f"<p {q}>One.</p><p a{q}b=c {q}d{q}>Two.</p>") == ["One.", "Two."]
    assert texts("""<p title="a > b" data-x='c > d'>One.</p><a href=/x?q="b>Two</a>""") == ["One.", "Two"]
    assert texts("<p title = 'x>y' =z>One.</p><p a=b=c==>Two.</p>") == ["One.", "Two."]
    assert H._element("div", """ alt="x class='nav'" class=footer""", 0)[0] == H._element("div", " class='footer'", 0)[0]


def test_very_long_pages_repeated_rows_and_a_column_named_text(spark):
    page = "<body><article>" + "<p>A sentence of an article that goes on.</p>" * 30_000 + "</article></body>"
    docs = spark.createDataFrame([(1, page, "old", 0), (1, page, "old", 0), (2, None, "old", 0)], "page_id long, html string, text string, run int")
    got = H.extract(docs)
    assert sorted(got.columns) == ["html", "page_id", "run", "text"]
    assert sorted((r["page_id"], r["text"].count("\n")) for r in got.collect()) == [(1, 29_999), (1, 29_999), (2, 0)]

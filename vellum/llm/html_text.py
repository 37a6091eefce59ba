"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in it is a binary variable: content or not. A variable
has a potential from its features (tag, words of class, id and role, length, share of link text)
and one with its parent, by the child's kind. Sum-product messages go up and then down the
tree, and so give each variable's exact marginal; runs of text with a marginal of 0.5 or more are
the main text. The weights maximise the likelihood of labelled pages; its gradient is taken from
the same messages. All pages of a batch are one forest, passed level by level.

Labelled pages are HTML whose elements carry data-label="content" or "other"; a label holds for
what lies below, up to the next label. training_pages() makes some by rule, of several layouts.

Defined results: null and empty html give empty text; unclosed and misnested tags close as browsers
close them, nearly (a head ends at what it can't hold, an open svg, select, noscript or template with its
parent, an open script or the like in a head with the head); what isn't a tag is text; an empty table gives no rows; repeated pages are extracted
each, very long ones whole; other columns are carried, and one that has the result's name is replaced by it.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_chunks

#: A quote opens a value only right after `=`; anywhere else, or if it is never closed, it is a character like others, and `>` ends the tag.
_VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|{_VALUE}|=)*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]*)))?""")
#: Attributes that tell something of an element.
_TELLING = frozenset("class id role data-label hidden".split())
_LETTERS = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out with what they hold: RAW up to the end tag, whatever lies between, SKIPPED by their tags.
RAW, SKIPPED = frozenset("script style textarea title iframe".split()), frozenset("noscript template svg select".split())
#: What a head may hold; all else ends it.
_IN_HEAD = frozenset("html head base link meta title script style noscript template".split())
#: Start tags that end an svg.
_NOT_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_SVG_HTML = frozenset("foreignobject desc title".split())
_PAGE_TAGS = frozenset("html head body".split())
#: Elements that an element of this name closes, if open within the nearest container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TAGS = "html body div p article section main nav header footer aside form ul ol li dl dt dd table tbody thead tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button fieldset address details dialog center hr".split()
#: Words of class, id and role, by what they tell.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs pagination pager toc",
    "header": "header masthead banner topbar logo branding",
    "footer": "footer copyright colophon contentinfo legal",
    "side": "sidebar aside side related widget widgets recommended trending complementary more",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp",
    "notice": "cookie cookies notice consent gdpr popup modal alert newsletter subscribe subscription paywall overlay alertdialog",
    "comment": "comment comments reply replies respond disqus discussion thread feedback",
    "share": "share sharing social follow tags byline meta",
    "form": "form search login signup signin register contact input",
    "content": "content article post entry story body text main page single blog document",
}
_GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()}
_NAMES = ["bias", "text", "element", "other tag", "hidden", "named", *(f"<{t}>" for t in TAGS), *(f"#{g}" for g in WORDS), *(f"words {k}" for k in range(5)), *(f"links {k}" for k in range(4)), "stop", "run in <p>"]
_AT = {n: i for i, n in enumerate(_NAMES)}
KINDS = 3  # of edges: to a run of text, to a block of text, to a container
_TEXTUAL = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th pre blockquote figcaption".split())


@cache
def _end_tag(names: str) -> re.Pattern:
    return re.compile(rf"<(?:/({names})(?=[\s/>])[^>]*>" + (r"|body\b)" if "head" in names else ")"), re.I)


def _raw_end(source: str, at: int, tag: str, attributes: str, skipped: str, in_head: bool) -> int:
    """Where a RAW element ends whose text begins at `at`: with its end tag, or before that of the skipped element or head around it, if that comes first."""
    if skipped or (in_head and (tag != "script" or re.search(r"\ssrc\s*=", attributes, re.I))):
        m = _end_tag(f"{tag}|{skipped or 'head'}").search(source, at)
    else:
        m = _end_tag(tag).search(source, at)
        if in_head and (left := _end_tag("head").search(source, at, m.start() if m else len(source))):
            # A script may hold the text </head>; one with a start tag of another script after it was left open.
            if not m or re.search(r"<script\b", source[left.end() : m.start()], re.I):
                m = left
    if not m:
        return len(source)
    return m.end() if (m[1] or "").lower() == tag else m.start()


@dataclass
class Forest:
    """Variables of many pages, parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    hits: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # page, variable, text

    def add(self, parent: int, kind: int, hits: list[int], label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.hits.append(hits)
        self.label.append(label)
        return len(self.parent) - 1

    def add_page(self, page: int, source: str) -> None:
        """Parses a page. Each variable is added when its element opens; a run of text when it ends."""
        root = self.add(-1, 2, [_AT["bias"], _AT["element"]], 0)
        stack: list[tuple[str, int]] = [("", root)]  # block elements only
        run: list[str] = []
        linked = in_link = 0

        def end_run() -> None:
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    tag, at = stack[-1]
                    n = text.count(" ") + 1
                    share = linked / max(1, sum(map(len, run)))
                    hits = [_AT["bias"], _AT["text"], _WORDS_AT + (0 if n <= 2 else 1 if n <= 6 else 2 if n <= 14 else 3 if n <= 40 else 4), _LINKS_AT + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3)]
                    if text[-1] in ".!?\"”»…":
                        hits.append(_AT["stop"])
                    if tag == "p":
                        hits.append(_AT["run in <p>"])
                    self.runs.append((page, self.add(at, 0, hits, self.label[at]), text))
                run.clear()
                linked = 0

        pos, in_head = 0, False
        skipped: list[str] = []  # a SKIPPED element that is open, and the elements open in it
        inline: Counter[str] = Counter()  # inline elements that are open
        while m := _TOKEN.search(source, pos):
            if m.start() > pos and not skipped:
                run.append(text := source[pos : m.start()])
                linked += len(text) if in_link else 0
                in_head = in_head and text.isspace()
            pos = m.end()
            tag, closes = m[2], bool(m[1])
            if tag is None:
                if in_head and m[0].startswith("<!--") and not m[0].endswith("-->") and (left := _end_tag("head").search(source, m.start())):
                    pos = left.start()
                continue
            tag = tag.lower()
            if skipped:
                if closes:
                    if tag in skipped:
                        while skipped.pop() != tag:
                            pass
                        continue
                    if tag not in _PAGE_TAGS and not inline[tag] and all(t != tag for t, _ in stack):
                        continue
                elif tag == "select" == skipped[0]:
                    skipped.clear()
                    continue
                elif not (
                    tag == "body"
                    or (skipped[0] == "svg" and tag in _NOT_SVG and _SVG_HTML.isdisjoint(skipped))
                    or (skipped[0] == "select" and tag in ("input", "textarea"))
                ):
                    if tag in RAW and skipped[0] != "svg":
                        pos = _raw_end(source, pos, tag, m[3], skipped[0], in_head)
                    elif tag not in VOID and not (skipped[0] == "svg" and m[3].endswith("/")):
                        skipped.append(tag)
                    continue
                skipped.clear()  # it ends with its parent, or before what it can't hold
            if tag == "head":
                in_head = not closes
                continue
            if not closes:
                in_head = in_head and tag in _IN_HEAD
                if tag in RAW:
                    pos = _raw_end(source, pos, tag, m[3], "", in_head)
                    continue
                if tag in SKIPPED:
                    if not (tag == "svg" and m[3].endswith("/")):
                        skipped.append(tag)
                    continue
            elif tag in RAW or tag in SKIPPED:
                continue
            if tag in INLINE:
                if tag not in VOID:
                    inline[tag] = max(0, inline[tag] + (-1 if closes else 1))
                if tag == "a":
                    in_link = 0 if closes else 1
                elif tag == "br":
                    run.append(" ")
                continue
            end_run()
            if closes:
                if any(t == tag for t, _ in stack):
                    while stack[-1][0] != tag:
                        stack.pop()
                    stack.pop()
                    in_link = 0
                continue
            if len(stack) > 1 and stack[-1][0] == "p":
                stack.pop()
            if tag in _CLOSES:
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in _HOLDS[tag]:
                    if stack[k][0] in _CLOSES[tag]:
                        del stack[k:]
                        break
                    k -= 1
            at = stack[-1][1]
            hits, label = _element(tag, m[3], self.label[at])
            if tag not in VOID:
                stack.append((tag, self.add(at, 1 if tag in _TEXTUAL else 2, hits, label)))
        if pos < len(source) and not skipped:
            run.append(source[pos:])
        end_run()


_WORDS_AT, _LINKS_AT = _AT["words 0"], _AT["links 0"]
_seen: dict[tuple[str, str], tuple[list[int], int | None]] = {}


def _element(tag: str, attributes: str, inherited: int) -> tuple[list[int], int]:
    """(features, label) of an element; label: 1 for content."""
    key = (tag, attributes)
    if key not in _seen:
        hits, label = {_AT["bias"], _AT["element"], _AT.get(f"<{tag}>", _AT["other tag"])}, None
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name not in _TELLING:
                continue
            if name == "data-label":
                label = int(value == "content")
            elif name == "hidden":
                hits.add(_AT["hidden"])
            else:
                groups = {_GROUP[w] for w in _LETTERS.findall(value) if w in _GROUP}
                hits |= {_AT[f"#{g}"] for g in groups} | ({_AT["named"]} if groups else set())
        if len(_seen) > 100_000:
            _seen.clear()
        _seen[key] = (sorted(hits), label)
    hits, label = _seen[key]
    return hits, inherited if label is None else label


@dataclass
class Model:
    unary: np.ndarray  # a weight for each feature, of content against other
    pair: np.ndarray  # KINDS x 2 x 2: log-potential of (parent, child)


@dataclass
class Messages:
    """Sum-product over a forest, in logarithms."""

    marginal: np.ndarray  # of content, for each variable
    edge: np.ndarray  # of (parent, child), for each variable that has a parent


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def sum_product(parent: np.ndarray, levels: list[np.ndarray], kind: np.ndarray, score: np.ndarray, pair: np.ndarray) -> Messages:
    n = len(parent)
    below = np.zeros((n, 2))  # own potential and all messages from children
    below[:, 1] = score
    up, joint = np.zeros((n, 2)), pair[kind]
    for level in reversed(levels[1:]):
        up[level] = _lse(joint[level] + below[level][:, None, :], 2)
        np.add.at(below, parent[level], up[level])
    belief, edge = below.copy(), np.zeros((n, 2, 2))
    for level in levels[1:]:
        rest = belief[parent[level]] - up[level]
        both = joint[level] + rest[:, :, None]
        belief[level] += _lse(both, 1)
        edge[level] = both + below[level][:, None, :]
    edge -= _lse(edge.reshape(n, 4), 1)[:, None, None]
    return Messages(1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), np.exp(edge))


def _arrays(forest: Forest) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    return np.array(forest.parent, np.int64), levels_of(np.array(forest.depth, np.int64)), np.array(forest.kind, np.int64)


def _scores(forest: Forest, unary: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum([len(h) for h in forest.hits])])[:-1]
    return np.add.reduceat(unary[np.array([i for h in forest.hits for i in h])], at)


def train(pages: list[str], steps: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Model:
    """Maximum likelihood, by Adam over all labelled pages at once."""
    forest = Forest()
    for k, p in enumerate(pages):
        forest.add_page(k, p)
    parent, levels, kind = _arrays(forest)
    y, n = np.array(forest.label), len(parent)
    x = np.zeros((n, len(_NAMES)), np.float32)
    for i, h in enumerate(forest.hits):
        x[i, h] = 1
    has = np.flatnonzero(parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (kind[has], y[parent[has]], y[has]), 1)
    w = np.zeros(len(_NAMES) + KINDS * 4)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        unary, pair = w[: len(_NAMES)], w[len(_NAMES) :].reshape(KINDS, 2, 2)
        got = sum_product(parent, levels, kind, x @ unary.astype(np.float32), pair)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, kind[has], got.edge[has])
        grad = np.concatenate([x.T @ (y - got.marginal), (seen - expected).ravel()]) / len(pages) - ridge * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model(w[: len(_NAMES)], w[len(_NAMES) :].reshape(KINDS, 2, 2))


def training_pages(n: int = 160, seed: int = 1) -> list[str]:
    """Labelled pages of several layouts, by rule."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubdklmnrst") for _ in range(r.randint(2, 8))) for _ in range(600)]
    words = lambda a, b: " ".join(r.choice(vocabulary) for _ in range(r.randint(a, b)))
    sentence = lambda: words(1, 14).capitalize() + r.choice([".", ".", ".", "?", ""])
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    links = lambda k: "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(k))
    name = lambda group: f" {r.choice(['class', 'id', 'class'])}=\"{r.choice(['', 'site-', 'x-', 'l-'])}{r.choice(WORDS[group].split())}{r.choice(['', ' box', '-1', '-wrap'])}\""

    def block() -> str:
        kind = r.random()
        if kind < 0.62:
            return f"<p>{prose()}</p>" if r.random() < 0.8 else f"<p><b>{sentence()}<br><p>{prose()}</p>"
        if kind < 0.74:
            return f"<h{r.randint(2, 4)}>{words(1, 8)}</h2>".replace("</h2>", "") + r.choice(["</h2>", "</h3>", ""]) + f"<p>{prose()}</p>"
        if kind < 0.82:
            return r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{prose(1, 2)}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 5))))
        if kind < 0.87:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind < 0.91:
            return f"<table><tr><th>{words(1, 2)}</th><th>{words(1, 2)}</th></tr><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"
        if kind < 0.95:
            return f"<pre>{words(3, 20)}</pre>"
        return f"<figure><img src='a.png'><figcaption>{sentence()}</figcaption></figure>"

    def other(*groups: str) -> str:
        group = r.choice(groups)
        inner = {
            "menu": lambda: f"<ul>{links(r.randint(2, 9))}</ul>",
            "header": lambda: r.choice([f"<a href='/'>{words(1, 3)}</a>", f"<h1>{words(1, 3)}</h1><p>{sentence()}</p>", f"<p>{prose(1, 2)}</p>"]),
            "footer": lambda: r.choice([f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{prose(1, 2)}</p><ul>{links(3)}</ul>"]),
            "side": lambda: r.choice([f"<h3>{words(1, 3)}</h3><ul>{links(4)}</ul>", f"<h4>{words(1, 3)}</h4><p>{prose(1, 3)}</p>"]),
            "advert": lambda: r.choice([prose(1, 2), f"<p>{prose(1, 3)}</p>", f"<a href='/buy'>{words(2, 6)}</a>"]),
            "notice": lambda: r.choice([f"<p>{prose(1, 3)}</p><button>{words(1, 2)}</button>", prose(1, 3)]),
            "comment": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(f"<div{r.choice([name('comment'), ''])}><p>{prose(1, 5)}</p></div>" for _ in range(r.randint(1, 4))),
            "share": lambda: f"<ul>{links(3)}</ul>",
            "form": lambda: f"<form action='/s'><label>{words(1, 2)}</label><input name='q'><p>{sentence()}</p><button>{words(1, 1)}</button></form>",
        }[group]()
        plain = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(group)
        if plain and r.random() < 0.6:
            return f"<{plain} data-label='other'{r.choice(['', name(group)])}>{inner}</{plain}>"
        return f"<{(tag := r.choice(['div', 'div', 'section', 'ul' if group == 'menu' else 'div']))} data-label='other'{name(group)}>{inner}</{tag}>"

    pages = []
    for k in range(n):
        title, tag = prose(1, 1), r.choice(["article", "article", "article", "main", "div", "div", "section"])
        named = name("content") if tag in ("div", "section") or r.random() < 0.3 else ""
        inside = [f"<h1>{title}</h1>"] * (r.random() < 0.8) + [block() for _ in range(r.randint(1, 12))]
        for group in ("advert", "share", "comment", "side", "form", "notice"):
            if r.random() < 0.15:
                inside.insert(len(inside) if group == "comment" else r.randint(1, len(inside)), other(group))
        if r.random() < 0.2:
            inside.insert(1, prose(1, 3))
        body = f"<{tag} data-label='content'{named}>" + r.choice(["", "\n"]).join(inside) + f"</{tag}>"
        for _ in range(r.randint(0, 2)):
            body = f"<div{r.choice(['', ' class=container', ' id=wrap', ' class=row'])}>{body}{other('side', 'comment') if r.random() < 0.4 else ''}</div>"
        before = [other("menu", "header", "notice", "advert", "form") for _ in range(r.randint(0, 4))]
        after = [other("footer", "side", "comment", "notice", "form", "menu", "advert") for _ in range(r.randint(0, 4))]
        pages.append(f"<!DOCTYPE html><html data-label='other'><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}" + r.choice(["</body></html>", ""]))
    return pages


def texts(pages: list, model: Model) -> list[str]:
    """The main text of each page."""
    forest = Forest()
    for k, p in enumerate(pages):
        if isinstance(p, str) and p:
            forest.add_page(k, p)
    blocks: list[list[str]] = [[] for _ in pages]
    if forest.parent:
        got = sum_product(*_arrays(forest), _scores(forest, model.unary), model.pair)
        for page, at, text in forest.runs:
            if got.marginal[at] >= 0.5:
                blocks[page].append(text)
    return ["\n".join(b) for b in blocks]


def extract(pages: DataFrame, column: str = "html", into: str = "text", labelled: list[str] | None = None) -> DataFrame:
    """pages with the column `into`. labelled: labelled pages to learn from, training_pages() if null."""
    model = train(labelled or training_pages())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([t for part in text_chunks(batch, 500_000) for t in texts(batch.iloc[part].tolist(), model)], dtype=object)

    return pages.withColumn(into, run(column))

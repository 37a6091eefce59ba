"""Personal data in documents, disguised too, at the places of the source text.

Plain finders. E-mail addresses, IPv4 addresses, card numbers and phone numbers are found by fixed patterns, leftmost and
non-overlapping for each kind; what fails a kind's test (parts up to 255, Luhn, number of digits) is dropped. Each finder is
linear in the text, whatever it holds: no pattern can begin again inside a run that it has just given up.

Deobfuscation. A text goes through three transducers, each a list of edits (start, end, replacement) over the text before it:

1. characters that look like ASCII ones (other scripts, full width, mathematical letters, other digits, dashes, spaces)
   become those; invisible characters go; O, o, I and l in numbers become digits;
2. digits spelled as words become digits where they stand beside other digits, "double" and "triple" with them, and
   "plus" before a digit becomes +;
3. written-out or bracketed "at" and "dot" (and their character references) become @ and the full stop. A bare "at" counts only if
   a dot is spelled behind it, or if the word before it looks like a mailbox (with a digit, dot or underscore), and an address that
   rests on bare words only if its last label is one of HOSTS.

The edits are kept, so that every place in the result has its place in the source: a character that an edit made stands for the
whole of what it replaced. The plain finders run again on the result, and what they find goes back to source places.
Findings of the plain text always stay; a disguised one is added unless a plain one of its kind covers it, or it lengthens a plain
one by bare words only.

Most texts have nothing to edit and are read once. All work is within a row: no shuffle, and a lost executor costs its rows only.

Defined results: null and empty texts have no spans; very long texts are read whole; repeated rows each have their spans; ties can't
be (spans are ordered by kind, start, end); an empty table gives no rows; other columns are carried, and one that has the
new column's name is replaced. Places are code points, the end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind string, start long, end long, plain boolean>>"

Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_NO_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """An address reaches left from its @ to the first character that can't be in a mailbox, or to the address before."""
    past = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
        past = domain.end() if domain else at + 1
        at = text.find("@", past)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        found = m.group().rstrip(" ().-")
        if len(found) >= 4 and 8 <= len(_NO_DIGIT.sub("", found)) <= 15:
            yield m.start(), m.start() + len(found)


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# Letters of other scripts that are drawn like the ASCII character beside them.
LOOKALIKES = {
    "a": "аɑα", "b": "ЬƄ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іɩι", "j": "јϳ", "k": "κк", "l": "ӏǀ", "m": "м", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "0": "߀", "3": "ЗӠ", "6": "б", "-": "‐‑‒–—−⁃", ".": "。｡∙", "@": "Ⓐ",
}
INVISIBLE = "­​‌‍‎‏⁠﻿"
# The digits' names, and the words for "at" and "dot" that stand in brackets.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arobase", "arroba", "klammeraffe", "@")
DOT_WORDS = ("dot", "punkt", "punto", "point", "period", ".")
TIMES = {"double": 2, "triple": 3}
# Last labels of hosts that a bare "at" or "dot" is believed for.
HOSTS = frozenset("com org net edu gov mil int info biz io ai co app dev me tv eu uk us ca au de at ch fr be nl lu es pt it se no dk fi pl cz ie mx ar cl br in jp cn ru example test invalid local".split())


def _lookalikes() -> dict[int, str]:
    """Code point -> ASCII character: the table above, and by rule what Unicode calls a form of one ASCII character or a decimal digit."""
    found = {}
    blocks = [(0x00A0, 0x0180), (0x0660, 0x0E60), (0x2000, 0x2500), (0x3000, 0x3001), (0xFE50, 0xFF5F), (0x1D400, 0x1D800)]
    for c in (chr(k) for a, b in blocks for k in range(a, b)):
        plain = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            found[ord(c)] = str(digit)
        elif len(plain) == 1 and 32 <= ord(plain) < 127:
            found[ord(c)] = plain
    return found | {ord(c): k for k, v in LOOKALIKES.items() for c in v}


_SWAPS = _lookalikes()
_SWAPS |= dict.fromkeys(map(ord, INVISIBLE), "")
_SWAPPED = np.zeros(max(_SWAPS) + 2, bool)
_SWAPPED[list(_SWAPS)] = True
_MAYBE_LETTER_DIGITS = re.compile(r"[0-9]\.?[OoIl]|[OoIl][0-9]")
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?:[OoIl]++[0-9]|[0-9]++[OoIl])[0-9OoIl]*+(?![A-Za-z0-9])|(?<=[0-9]\.)[OoIl]{1,3}+(?![A-Za-z0-9])")
_AS_DIGITS = str.maketrans("OoIl", "0011")
_SPELLED = re.compile(r"\b(?:(double|triple)\s+)?(" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")\b", re.I)
_BESIDE = re.compile(r"[\s,()-]{1,3}\Z")
_DOTTED = r"(?:\s+dot\s+|\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*|\.)"
_DOT_LEFT, _DOT_RIGHT, _DOT_BETWEEN = re.compile(rf"[0-9]{_DOTTED}\Z", re.I), re.compile(rf"{_DOTTED}[0-9]", re.I), re.compile(_DOTTED, re.I)
_NUMBER_LEFT, _NUMBER_RIGHT = re.compile(r"[0-9+][\s,()-]{0,3}\Z"), re.compile(r"[\s,()-]{1,3}[0-9]")
_PLUS = re.compile(r"\bplus\s+(?=[0-9])", re.I)


def _any_case(words: tuple[str, ...]) -> str:
    """The words as a pattern: without a flag for case, so that a search jumps to the first character."""
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) for c in w) for w in words)


def _sign(words: tuple[str, ...], *codes: str) -> str:
    """Words in brackets of any kind, or a character reference."""
    inner = _any_case(words)
    return rf"\[\s*+(?:{inner})\s*+\]|\(\s*+(?:{inner})\s*+\)|\{{\s*+(?:{inner})\s*+\}}|<\s*+(?:{inner})\s*+>|{'|'.join(codes)}"


_AT, _DOT = _sign(AT_WORDS, "&#0*64;", "&#[xX]0*40;", "&commat;"), _sign(DOT_WORDS, "&#0*46;", "&#[xX]0*2[eE];", "&period;")
_SIGN = re.compile(f"(?=[\\[({{<&])(?:(?P<at>{_AT})|{_DOT})")
#: A bare "at" before a host whose dot is spelled, or after what looks like a mailbox; a bare "dot".
_BARE_AT = re.compile(rf"[ \t](?<=[A-Za-z0-9_+-][ \t])[ \t]*+[aA][tT][ \t]++(?=[A-Za-z0-9-]{{1,63}}(?P<spelled>[ \t]+[dD][oO][tT][ \t]+|[ \t]*(?:{_DOT})[ \t]*)?(?(spelled)[A-Za-z0-9]|\.[A-Za-z0-9]))")
_BARE_DOT = re.compile(r"[ \t](?<=[A-Za-z0-9][ \t])[ \t]*+[dD][oO][tT][ \t]++(?=[A-Za-z0-9])")
_MAILBOX = re.compile(r"(?:(?=[A-Za-z0-9._%+-]*[0-9._])[A-Za-z0-9._%+-]*[A-Za-z][A-Za-z0-9._%+-]*)\Z")
#: Words that a transducer looks for, in UTF-8; a text's bytes in small letters, all else ASCII made white space.
_DIGIT_WORDS, _PLAIN_WORDS = frozenset(w.encode() for w in DIGITS), bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def _words(text: str) -> frozenset[bytes]:
    return frozenset(text.encode("utf-8", "surrogatepass").translate(_PLAIN_WORDS).split())


class Mapped:
    """A text after edits, and the way back from its places to the source's."""

    def __init__(self, text: str, before: Mapped | None = None, edits: list[tuple[int, int, str]] = ()):
        self.before, self.text = before, text
        self.out, self.source, self.widths = [], [], []
        if before is None:
            return
        parts, at, length = [], 0, 0
        for start, end, new in edits:
            parts += (text[at:start], new)
            length += start - at
            self.out.append(length)
            self.source.append((start, end))
            self.widths.append(len(new))
            length += len(new)
            at = end
        self.text = "".join([*parts, text[at:]])

    def edited(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """After edits, which must not overlap; of those that do the first stays."""
        kept, past = [], 0
        for e in sorted(edits):
            if e[0] >= past:
                kept.append(e)
                past = e[1]
        return Mapped(self.text, self, kept) if kept else self

    def _place(self, at: int) -> Span:
        """(start, end) in the text before of the character at `at`."""
        k = bisect_right(self.out, at) - 1
        if k < 0:
            return at, at + 1
        past = at - self.out[k] - self.widths[k]
        return self.source[k] if past < 0 else (self.source[k][1] + past, self.source[k][1] + past + 1)

    def back(self, start: int, end: int) -> Span:
        """A span's place in the source."""
        if self.before is None:
            return start, end
        return self.before.back(self._place(start)[0], self._place(end - 1)[1])


def _characters(text: str) -> list[tuple[int, int, str]]:
    """Edits of characters that look like others, or like nothing."""
    if text.isascii():
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(points > 127)
    at = at[_SWAPPED[np.minimum(points[at], len(_SWAPPED) - 1)]].tolist()
    return [(k, k + 1, _SWAPS[ord(text[k])]) for k in at]


def _letter_digits(text: str) -> list[tuple[int, int, str]]:
    if not _MAYBE_LETTER_DIGITS.search(text):
        return []
    return [(m.start(), m.end(), m.group().translate(_AS_DIGITS)) for m in _LETTER_DIGITS.finditer(text)]


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits of spelled digits beside other digits."""
    edits = []
    found = list(_SPELLED.finditer(text))
    gaps = [text[a.end() : b.start()] if b.start() - a.end() < 12 else "" for a, b in zip(found, found[1:], strict=False)]
    beside = [bool(_BESIDE.match(g)) for g in gaps]
    near = [by or bool(_DOT_BETWEEN.fullmatch(g)) for by, g in zip(beside, gaps, strict=True)]
    for k, m in enumerate(found):
        before, behind = text[max(0, m.start() - 10) : m.start()], text[m.end() : m.end() + 10]
        spelled = (k > 0 and near[k - 1]) or (k < len(near) and near[k])
        if spelled or _NUMBER_LEFT.search(before) or _NUMBER_RIGHT.match(behind) or _DOT_LEFT.search(before) or _DOT_RIGHT.match(behind):
            edits.append((m.start(), m.end(), DIGITS[m.group(2).lower()] * TIMES.get((m.group(1) or "").lower(), 1)))
            numeral = _NUMBER_RIGHT.match(behind)
            gap = gaps[k] if k < len(near) and beside[k] else numeral.group()[:-1] if numeral else ""
            if gap not in ("", " ") and not {*gap} & {*"()-"}:
                edits.append((m.end(), m.end() + len(gap), " "))
    return edits


def _signs(text: str, words: frozenset[bytes]) -> tuple[list[tuple[int, int, str]], list[int]]:
    """Edits of "at" and "dot" with the spaces around them, and where those of bare words begin."""
    edits, bare = [], []
    for m in _SIGN.finditer(text):
        a, b = m.span()
        while a and text[a - 1] in " \t":
            a -= 1
        while b < len(text) and text[b] in " \t":
            b += 1
        if a and b < len(text) and text[a - 1].isalnum() and text[b].isalnum():
            edits.append((a, b, "." if m.group("at") is None else "@"))
    if b"dot" in words:
        bare = [m.start() for m in _BARE_DOT.finditer(text)]
        edits += [(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(text)]
    for m in _BARE_AT.finditer(text) if b"at" in words else ():
        if m.group("spelled") or _MAILBOX.search(text[max(0, m.start() - 64) : m.start()]):
            edits.append((m.start(), m.end(), "@"))
            bare.append(m.start())
    return edits, bare


def deobfuscate(text: str) -> tuple[Mapped, list[Span]]:
    """The text through all transducers, and the source places of edits that rest on bare words."""
    now = Mapped(text).edited(_characters(text))
    now = now.edited(_letter_digits(now.text))
    words = _words(now.text)
    if not words.isdisjoint(_DIGIT_WORDS):
        now = now.edited(_numbers(now.text))
    if b"plus" in words:
        now = now.edited([(m.start(), m.end(), "+") for m in _PLUS.finditer(now.text)])
    edits, bare = _signs(now.text, words)
    places = [now.back(b, b + 1) for b in bare]
    return now.edited(edits), places


def spans(text) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of all personal data in a text, by kind, start and end."""
    if not isinstance(text, str) or not text:
        return []
    plain = {k: list(find(text)) for k, find in FINDERS.items()}
    out = [(k, a, b, True) for k in KINDS for a, b in plain[k]]
    clear, bare = deobfuscate(text)
    if clear.before is None:
        return out
    bare = sorted(a for a, _ in bare)
    for kind, find in FINDERS.items():
        own = plain[kind]
        starts = [a for a, _ in own]
        for x, y in find(clear.text):
            a, b = clear.back(x, y)
            k = bisect_right(starts, a) - 1
            if k >= 0 and own[k][1] >= b:
                continue
            if bisect_left(bare, b) > bisect_left(bare, a):
                meets = (k >= 0 and own[k][1] > a) or (k + 1 < len(own) and own[k + 1][0] < b)
                if meets or (kind == "email" and clear.text[x:y].rpartition(".")[2].lower() not in HOSTS):
                    continue
            out.append((kind, a, b, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with an array of (kind, start, end, plain); plain: found without deobfuscation."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in spans(t)] for t in texts], dtype=object)

    return docs.withColumn(into, run(F.col(f"`{text}`")))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; spans that overlap become one, of the first's kind."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t) for t in texts], dtype=object)

    return docs.withColumn(text, run(F.col(f"`{text}`")))


def masked(text):
    found = sorted((a, b, k) for k, a, b, _ in spans(text))
    if not found:
        return text
    parts, past = [], 0
    for a, b, kind in found:
        if a >= past:
            parts += (text[past:a], f"[{kind.upper()}]")
        past = max(past, b)
    return "".join([*parts, text[past:]])


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

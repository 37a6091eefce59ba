"""Licence statements in texts: a trained paragraph classifier, confirmed by templates.

A paragraph is a line that isn't blank, or a stretch of words that goes over lines that follow each
other, none blank; a line with no letter or digit counts as blank, so that comment marks are left out. Its features are its distinct words and pairs of adjacent
words, as far as training has seen them. A multinomial logistic regression tells the licence
families and `unknown` apart; it learns from paragraphs made by rule from TEMPLATES and from
ordinary and misleading paragraphs. A temperature fitted on held-out paragraphs calibrates its
probabilities. A family is predicted where its probability is at least SURE.

A prediction counts only if the paragraph also holds at least SIMILARITY of the three-word shingles
of one of the family's templates. Stretches over lines are those that hold so much of a template
within twice its length; the classifier reads the stretch. Where statements overlap, the most similar
one counts.

Defined results: null, empty and blank texts have no paragraph; each paragraph is judged, however
many a text has and however long it is; repeated rows are judged each; an empty table gives no
rows; other columns are left out by scan().
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Memo, text_chunks

SURE, SIMILARITY = 0.5, 0.6

#: Short forms in which licences are stated, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Licensed under CC0 1.0.",
        "This work is in the public domain.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior permission of the publisher.",
    ],
}
#: Paragraphs about licences that state none.
MISLEADING = [
    "She renewed her driving license at the public office in version two of the form.",
    "The general was reserved about all rights of the public.",
    "He was licensed as a doctor and released under the terms of the court.",
    "The apache pilots used the free software of the foundation to plan the work.",
    "You may not use this door except in an emergency.",
    "A copy of the permission was granted to any person in the library.",
    "The license plate was modified and the source of the fire is unknown.",
    "All rights and wrongs were discussed by the authors of the book.",
    "The copyright office published the conditions under which copies are permitted.",
    "With or without modification the engine is the same, the following conditions aside.",
]
FAMILIES = [*TEMPLATES, "unknown"]

_WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def paragraphs(n: int = 70, seed: int = 3) -> list[tuple[str, int]]:
    """(paragraph, family) by rule: n for each family, and more that are unknown."""
    r = random.Random(seed)
    common = sorted({w for ts in [*TEMPLATES.values(), MISLEADING] for t in ts for w in words(t)})
    filler = ["".join(r.choice("aeiourstnldm") for _ in range(r.randint(2, 7))) for _ in range(400)]
    some = lambda a, b: [r.choice(filler) for _ in range(r.randint(a, b))]
    out = []
    for k, templates in enumerate(TEMPLATES.values()):
        for i in range(n):
            w = words(templates[i % len(templates)])
            if r.random() < 0.25 and len(w) > 6:
                w[r.randrange(len(w))] = r.choice(filler)
            if r.random() < 0.4:
                w = [*some(0, 12), *w, *some(0, 12)]
            out.append((" ".join(w), k))
    for i in range(6 * n):
        kind = i % 3
        if kind == 0:
            w = some(1, 40)
        elif kind == 1:
            w = [r.choice(common) if r.random() < 0.6 else r.choice(filler) for _ in range(r.randint(1, 30))]
        else:
            w = [*some(0, 6), *words(r.choice(MISLEADING)), *some(0, 6)]
        out.append((" ".join(w), len(TEMPLATES)))
    r.shuffle(out)
    return out


@dataclass
class Model:
    """ids: of words; pairs: sorted keys id * len(ids) + id; weights: a row per word, then per pair, then the intercept."""

    ids: dict[str, int]
    pairs: np.ndarray
    weights: np.ndarray
    temperature: float
    templates: list[list[set]]

    @cached_property
    def by_key(self) -> dict[int, list[tuple[int, int]]]:
        """The (family, template)s that hold a shingle, by its key."""
        out: dict[int, list[tuple[int, int]]] = {}
        n = len(self.ids)
        for f, ts in enumerate(self.templates):
            for t, held in enumerate(ts):
                for a, b, c in held:
                    out.setdefault((self.ids[a] * n + self.ids[b]) * n + self.ids[c], []).append((f, t))
        return out

    def features(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature), distinct, of word ids (-1: not known)."""
        n = len(self.ids)
        flat = np.array([i for r in rows for i in [*r, -1]], np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
        single = flat >= 0
        both = single[:-1] & single[1:]
        keys = flat[:-1][both] * n + flat[1:][both]
        at = np.searchsorted(self.pairs, keys)
        known = self.pairs[np.minimum(at, len(self.pairs) - 1)] == keys if len(self.pairs) else np.zeros(len(keys), bool)
        width = n + len(self.pairs)
        every = np.unique(np.concatenate([row[single] * width + flat[single], row[:-1][both][known] * width + n + at[known]]))
        return every // width, every % width

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        row, feature = self.features(rows)
        logits = np.tile(self.weights[-1], (len(rows), 1))
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            logits[row[first]] += np.add.reduceat(self.weights[feature], first)
        return softmax(logits / self.temperature)

    def place(self, ids: np.ndarray, line: np.ndarray, row: tuple) -> tuple[int, int]:
        """(start, end) of a single line's statement among the words of its run: from the first to the last shingle of the template."""
        here = np.flatnonzero(line == row[0]).tolist()
        n = len(self.ids)
        family = FAMILIES.index(row[1])
        found: dict[int, list[int]] = {}
        for i in here[: len(here) - 2]:
            a, b, c = ids[i : i + 3].tolist()
            if min(a, b, c) >= 0:
                for f, t in self.by_key.get((a * n + b) * n + c, ()):
                    if f == family:
                        found.setdefault(t, []).append(i)
        at = max(found.items(), key=lambda x: len(set(x[1])) / len(self.templates[family][x[0]]))[1]
        return at[0], at[-1] + 3


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def shingles(w: list[str], width: int = 3) -> set:
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def train(examples: list[tuple[str, int]] | None = None, steps: int = 150, ridge: float = 2e-4) -> Model:
    examples = examples or paragraphs()
    tokens = [words(t) for t, _ in examples]
    known = sorted({w for ts in [*TEMPLATES.values(), MISLEADING] for t in ts for w in words(t)})
    ids = {w: i for i, w in enumerate(known)}
    rows = [[ids.get(w, -1) for w in t] for t in tokens]
    counts: dict[int, int] = {}
    for r in rows:
        for a, b in zip(r, r[1:], strict=False):
            if a >= 0 and b >= 0:
                counts[a * len(ids) + b] = counts.get(a * len(ids) + b, 0) + 1
    model = Model(ids, np.array(sorted(k for k, n in counts.items() if n >= 4), np.int64), np.zeros((0, 0)), 1.0, [[shingles(words(t)) for t in ts] for ts in TEMPLATES.values()])
    x = np.zeros((len(rows), len(ids) + len(model.pairs) + 1), np.float32)
    x[model.features(rows)] = 1
    x[:, -1] = 1
    y = np.eye(len(FAMILIES), dtype=np.float32)[[k for _, k in examples]]
    held = np.arange(len(rows)) % 5 == 0

    def fit(x, y):
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            g = x.T @ (softmax(x @ w) - y) / len(x) + ridge * w
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
            w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return w

    logits = x[held] @ fit(x[~held], y[~held])
    losses = {t: -np.log(np.maximum((softmax(logits / t) * y[held]).sum(1), 1e-12)).mean() for t in np.geomspace(0.05, 4, 45)}
    model.temperature = float(min(losses, key=losses.get))
    model.weights = fit(x, y)
    return model


#: Words that begin each line of a comment in some languages.
_MARK = re.compile(r"\s*(?:dnl|@?rem|c)\s", re.I)


def joined(texts: list) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(text, its lines with their numbers) of each run of two lines or more that hold words, comment marks taken off."""
    for k, t in enumerate(texts):
        if not isinstance(t, str) or "\n" not in t:
            continue
        run: list[tuple[int, str]] = []
        for i, line in enumerate([*t.split("\n"), ""]):
            if any(map(str.isalnum, line)):
                run.append((i, line))
                continue
            if len(run) > 1:
                marked = all(_MARK.match(x) for _, x in run)
                yield k, [(n, _MARK.sub("", x, count=1)) for n, x in run] if marked else run
            run = []


def spans(at: list[int], which: list[int], template: int, n: int) -> Iterator[tuple[float, int, int]]:
    """(similarity, start, end) of the stretches of words that hold SIMILARITY of a template of n shingles; at, which: places of its shingles."""
    held: dict[int, int] = {}
    last = 0
    for first in range(len(at)):
        while last < len(at) and at[last] < at[first] + 2 * template:
            held[which[last]] = held.get(which[last], 0) + 1
            last += 1
        if len(held) >= SIMILARITY * n:
            yield len(held) / n, at[first], at[last - 1] + 3
        held[which[first]] -= 1
        if not held[which[first]]:
            del held[which[first]]


def judge_joined(texts: list, model: Model, memo: Memo, out: list[list[tuple]]) -> None:
    """Puts into `out`, which holds the statements of single lines, those that go over lines."""
    get = memo.__getitem__
    runs = [(k, [i for i, _ in run], [[i for token in line.split() for i in get(token)] for _, line in run]) for k, run in joined(texts)]
    if not runs:
        return
    n = len(model.ids)
    flat = np.array([i for _, _, rows in runs for r in [*rows, [-1]] for i in r], np.int64)
    three = np.flatnonzero((flat[:-2] >= 0) & (flat[1:-1] >= 0) & (flat[2:] >= 0)) if len(flat) > 2 else np.zeros(0, np.int64)
    table = model.by_key
    keys = (flat[three] * n + flat[three + 1]) * n + flat[three + 2]
    hit = np.isin(keys, np.fromiter(table, np.int64, len(table)))
    three, keys = three[hit], keys[hit]
    ends = np.cumsum([sum(map(len, rows)) + 1 for _, _, rows in runs])
    bounds = np.searchsorted(three, np.concatenate([[0], ends]))
    found: list[tuple[int, float, int, int, int]] = []  # run, similarity, start, end, family
    lines_of: dict[int, np.ndarray] = {}
    for q in np.flatnonzero(np.diff(bounds)).tolist():
        base = int(ends[q - 1]) if q else 0
        by: dict[tuple[int, int], tuple[list, list]] = {}
        for at, key in zip((three[bounds[q] : bounds[q + 1]] - base).tolist(), keys[bounds[q] : bounds[q + 1]].tolist(), strict=True):
            for t in table[key]:
                places, which = by.setdefault(t, ([], []))
                places.append(at)
                which.append(key)
        line = lines_of[q] = np.repeat(runs[q][1], [len(r) for r in runs[q][2]])
        for (f, t), (places, which) in by.items():
            size = len(model.templates[f][t])
            if len(set(which)) >= SIMILARITY * size:
                found.extend((q, s, a, b, f) for s, a, b in spans(places, which, size + 2, size) if line[a] != line[b - 1])
    if not found:
        return
    start = [int(ends[q - 1]) if q else 0 for q, *_ in found]
    p = np.concatenate([model.probabilities([flat[o + a : o + b].tolist() for o, (_, _, a, b, _) in zip(start[c : c + 5000], found[c : c + 5000], strict=True)]) for c in range(0, len(found), 5000)])
    family, sure = p.argmax(1), p.max(1)
    new: dict[int, list[tuple]] = {}
    for (q, s, a, b, f), g, x in zip(found, family.tolist(), sure.tolist(), strict=True):
        if f == g and x >= SURE:
            new.setdefault(q, []).append((s, a, b, f, x))
    for q, some in new.items():
        k, line = runs[q][0], lines_of[q]
        ids = flat[ends[q] - 1 - len(line) : ends[q] - 1]
        # Where statements overlap, the most similar stays; of equal ones a single line's, then the shortest.
        rivals = [(-s, b - a, a, b, (int(line[a]), FAMILIES[f], x, s)) for s, a, b, f, x in some]
        rivals += [(-row[3], 0, *model.place(ids, line, row), row) for row in out[k] if line[0] <= row[0] <= line[-1]]
        taken, kept = np.zeros(len(line), bool), []
        for _, _, a, b, row in sorted(rivals):
            if not taken[a:b].any():
                taken[a:b] = True
                kept.append(row)
        out[k] = sorted([*(row for row in out[k] if not line[0] <= row[0] <= line[-1]), *kept])


def judge(texts: list, model: Model, memo: Memo | None = None) -> list[list[tuple]]:
    """For each text (line, family, probability, similarity) of the paragraphs that state a licence."""
    if memo is None:
        memo = Memo(lambda token: [model.ids.get(w, -1) for w in words(token)])
    lines = [(k, i, line) for k, t in enumerate(texts) if isinstance(t, str) for i, line in enumerate(t.split("\n")) if line.strip()]
    out: list[list[tuple]] = [[] for _ in texts]
    if not lines:
        return out
    get = memo.__getitem__
    p = model.probabilities([[i for token in line.split() for i in get(token)] for _, _, line in lines])
    family = p.argmax(1)
    for at in np.flatnonzero((family < len(TEMPLATES)) & (p.max(1) >= SURE)):
        k, i, line = lines[at]
        have, f = shingles(words(line)), int(family[at])
        similarity = max(len(t & have) / len(t) for t in model.templates[f])
        if similarity >= SIMILARITY:
            out[k].append((i, FAMILIES[f], float(p[at, f]), similarity))
    judge_joined(texts, model, memo, out)
    return out


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph (its first line from 0), family, probability, similarity of each licence statement."""
    model = model or train()
    names = ("paragraph", "family", "probability", "similarity")

    @F.pandas_udf("array<struct<paragraph int, family string, probability double, similarity double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(lambda token: [model.ids.get(w, -1) for w in words(token)])
        for batch in batches:
            found = [f for part in text_chunks(batch, 500_000) for f in judge(batch.iloc[part].tolist(), model, memo)]
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in f] for f in found], dtype=object)

    return docs.select("doc_id", F.explode(run("text")).alias("found")).select("doc_id", "found.*")

"""Held-out accuracy, and what a scan finds and leaves."""

import numpy as np

from vellum.llm import licenses as L


def test_scan_and_held_out(spark):
    model = L.train()
    examples = L.paragraphs(20, seed=91)
    p = model.probabilities([[model.ids.get(w, -1) for w in L.words(t)] for t, _ in examples])
    assert np.mean(p.argmax(1) == [k for _, k in examples]) > 0.97
    sure = p.max(1) >= 0.9
    assert np.mean(p.argmax(1)[sure] == np.array([k for _, k in examples])[sure]) > 0.98
    texts = [*L.MISLEADING, None, "", " \n\n ", "Some words.\nReleased under the MIT License.\nall RIGHTS reserved", "x " * 50000 + "\nSPDX-License-Identifier: MPL-2.0"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in L.scan(docs, model).collect())
    n = len(L.MISLEADING)
    assert got == [(n + 3, 1, "mit"), (n + 3, 2, "reserved"), (n + 4, 1, "mpl")]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_wrapped_notices():
    model = L.train()
    mit = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is"""
    bsd = """# Copyright 2020 Some One. All rights reserved. Redistribution and use in
# source and binary forms, with or without modification, are permitted
# provided that the following conditions are met:"""
    gnu = """/*
 * Some program
 *
 * This {0} is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {1}General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {{ return 0; }}"""
    dnl = "dnl Permission to use, copy, modify, and/or distribute\ndnl this software for any purpose with or without\ndnl fee is hereby granted"
    narrow = "word\n" * 3000 + "\n".join("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met".split()) + "\nword" * 3000
    twice = "\n".join(["Released under the MIT", "License."] * 2)
    blank = "All rights\n\nreserved. All rights\n * \nreserved"
    texts = [mit, bsd, gnu.format("program", ""), gnu.format("library", "Lesser "), gnu.format("program", "Affero "), dnl, narrow, twice, blank, "\n".join(L.MISLEADING)]
    got = [[(i, f) for i, f, _, _ in found] for found in L.judge(texts, model)]
    assert got == [[(4, "mit")], [(0, "bsd"), (0, "reserved")], [(3, "gpl")], [(3, "lgpl")], [(4, "agpl")], [(0, "isc")], [(3000, "bsd")], [(0, "mit"), (2, "mit")], [], []]


def test_naive_scorer_and_repeated_rows(spark):
    model = L.train()
    r = np.random.default_rng(5)
    lines = [t for ts in L.TEMPLATES.values() for t in ts] + L.MISLEADING + [t for t, _ in L.paragraphs(3, seed=44)]
    texts = ["\n\n".join(lines[int(i)] for i in r.integers(0, len(lines), 6)) for _ in range(60)]

    def naive(text):
        out = []
        for k, line in enumerate(text.split("\n")):
            w = L.words(line)
            z = model.weights[-1].astype(float).copy()
            known = [model.ids[x] for x in dict.fromkeys(w) if x in model.ids]
            n = len(model.ids)
            pairs = {model.ids[a] * n + model.ids[b] for a, b in zip(w, w[1:], strict=False) if a in model.ids and b in model.ids}
            for f in [*known, *(n + int(np.searchsorted(model.pairs, p)) for p in pairs if p in set(model.pairs.tolist()))]:
                z += model.weights[f]
            p = np.exp(z / model.temperature - (z / model.temperature).max())
            p /= p.sum()
            f = int(p.argmax())
            if line.strip() and f < len(L.TEMPLATES) and p[f] >= L.SURE:
                have = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                best = max(len(t & have) / len(t) for t in model.templates[f])
                if best >= L.SIMILARITY:
                    out.append((k, L.FAMILIES[f], round(float(p[f]), 4), round(best, 9)))
        return out

    docs = spark.createDataFrame([(1, t, "x") for t in [*texts, texts[0]]], "doc_id long, text string, family string")
    got = sorted((r["paragraph"], r["family"], round(r["probability"], 4), round(r["similarity"], 9)) for r in L.scan(docs, model).collect())
    assert got == sorted(x for t in [*texts, texts[0]] for x in naive(t)) and len(got) > 100

"""Operator 4: licence scans by a trained paragraph classifier.

Paragraphs are lines and, for text wrapped over several, runs of lines with words in them (comment marks are no words). Such a
run as a whole is tried, then that from its first to its last line of a class other than `none`; if that is confirmed and has more words
of its template than any confirmed line of the run has of its own, it takes the place of its lines. A multinomial logistic regression over hashed word unigrams and bigrams, kept sparse by L1
shrinkage, is trained on templates (statements and openings of the families below), on variants of them by rule (parts, other
case, words put before, after or out), on statements of made-up licences as the class `unknown`, and on a bounded sample of
the corpus's own lines as the class `none` (a line of 20 to LONGEST letters from each of SAMPLE_LINES documents). Its probabilities are
calibrated by a temperature fitted on whole templates, made-up names and lines that were held out, and the weights are then fitted
on all; a family whose calibrated probability is under CONFIDENT becomes `unknown`. A family is confirmed if its nearest template has at
least CONFIRM of its distinct words in the paragraph, and half of the words that tell it from each similar template of another
family; the paragraph's share of template words is given too.

Most words have no weight: a line is looked at only if some word or pair of words of it speaks for a licence against `none`, with numpy
over whole buffers; others can't be anything else, as the bias of `none` is made the largest. So the scan's cost is that of
hashing words. The trained model is some thousand weights, whatever the corpus.

Defined cases: null or empty text has no paragraphs; a line without such a word is `none` and gives no row; a null doc_id is scanned
and stays null, but gives no line to the sample; repeated rows give repeated results; of classes with equal probability the first counts; a text
of any length is scanned whole; with no corpus lines to sample, `none` is trained on nothing but its prior; extra columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean
from .words import NOT_ALNUM, mix, text_buffers, words_of

#: LONGEST bounds the letters of a line in the sample; scanned lines have no bound.
SAMPLE_LINES, LONGEST, BITS, STEPS, SHRINK, CONFIDENT, CONFIRM = 4_000, 2_000, 22, 250, 3e-4, 0.5, 0.6

#: Short public statements of licence families.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Available under CC BY-NC-SA 4.0, no commercial use."),
    "cc0": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
_MADE_UP = ("Acme", "Foobar", "Widget", "Orion", "Public Sharing", "Open Garden", "Community", "Vendor", "Sample Source", "Northwind", "Lakeside", "Meridian")
_FRAMES = ("Licensed under the {} License.", "Released under the {} License, version {n}.", "This work is licensed under the terms of the {} licence.", "Distributed under the {} Software License Agreement.", "SPDX-License-Identifier: LicenseRef-{}", "See the {} License for the terms that apply.")
_BEFORE = ("", "", "", "Note:", "Copyright 2021 the authors.", "//", "#", "This file is", "(c)", "Code:")
_AFTER = ("", "", "", "See LICENSE for details.", "All contributors agree.", "https://example.org/license", "2023")


def _variants(text: str, rng: np.random.Generator, n: int) -> list[str]:
    out = [text]
    words = text.split()
    for _ in range(n - 1):
        own = list(words)
        if len(own) > 10 and rng.random() < 0.4:
            a = int(rng.integers(0, len(own) // 3))
            own = own[a : a + max(8, int(len(own) * rng.uniform(0.5, 0.9)))]
        elif len(own) > 6 and rng.random() < 0.3:
            own.pop(int(rng.integers(len(own))))
        x = " ".join(own)
        x = (x, x, x.lower(), x.upper(), x.replace("License", "Licence").replace("license", "licence"))[int(rng.integers(5))]
        out.append(f"{_BEFORE[int(rng.integers(len(_BEFORE)))]} {x} {_AFTER[int(rng.integers(len(_AFTER)))]}".strip())
    return out


def _examples() -> tuple[list[str], list[str], np.ndarray]:
    """(texts, classes, which are held out): of each family with three templates or more, and of made-up names, whole templates are."""
    rng = np.random.default_rng(7)
    texts, names, held = [], [], []
    for family, own in TEMPLATES.items():
        for k, t in enumerate(own):
            v = _variants(t, rng, 40)
            texts += v
            names += [family] * len(v)
            held += [len(own) > 2 and k == len(own) - 1] * len(v)
    for k, name in enumerate(_MADE_UP):
        for frame in _FRAMES:
            v = _variants(frame.format(name, n=int(rng.integers(1, 9))), rng, 6)
            texts += v
            names += ["unknown"] * len(v)
            held += [k % 4 == 0] * len(v)
    return texts, names, np.array(held)


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words' offsets by row, starts, ends, unigram, bigram with the next word)."""
    offsets, data = text_buffers(column)
    for i, _, at, starts, ends, h in words_of(offsets, data, breaks=NOT_ALNUM):
        two = h.copy()
        if len(h):
            two[:-1] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:])
        yield i, at, starts, ends, (h >> np.uint64(64 - BITS)).astype(np.int64), (two >> np.uint64(64 - BITS)).astype(np.int64)


def _bag(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, at, _, _, one, two in _features(column):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append(np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)]])))
    return out


class Model:
    """Sparse weights by feature and class, biases, and a temperature."""

    def __init__(self, corpus_lines: list[str]):
        texts, names, held = _examples()
        lines = [x for x in corpus_lines if not _looks_like_a_template(x)]
        texts += lines
        names += ["none"] * len(lines)
        held = np.concatenate([held, np.arange(len(lines)) % 5 == 0])
        self.classes = [*TEMPLATES, "unknown", "none"]
        y = np.array([self.classes.index(n) for n in names])
        bags = _bag(pa.array(texts, pa.string()))
        features, codes = np.unique(np.concatenate(bags), return_inverse=True)
        row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        seen = np.bincount(codes[y[row] != len(self.classes) - 1], minlength=len(features))
        keep = seen >= 4  # in licence examples: what only other lines hold is no evidence for a licence
        number = np.where(keep, np.cumsum(keep) - 1, -1)
        ok = number[codes] >= 0
        row, col = row[ok], number[codes][ok]
        features = features[keep]
        apart = ~held & (np.arange(len(bags)) % 5 == 0)  # variants of templates that are trained on
        w, b = self._fit(row, col, y, ~held & ~apart, len(features))
        every = self._logits(row, col, w, b, len(bags))
        self.held_accuracy = float((every[apart].argmax(1) == y[apart]).mean())
        self.template_accuracy = float((every[held].argmax(1) == y[held]).mean())
        z = every[held]
        best = (np.inf, 1.0)
        for t in np.geomspace(0.3, 5, 40):
            p = _softmax(z / t)
            best = min(best, (float(-np.log(p[np.arange(len(p)), y[held]] + 1e-12).mean()), float(t)))
        self.temperature = best[1]
        w, b = self._fit(row, col, y, np.ones(len(y), bool), len(features))
        b[-1] = b.max()  # a paragraph without evidence is `none`
        some = np.abs(w).sum(1) > 0
        self.features, self.w, self.b = features[some], w[some], b

    def _logits(self, row: np.ndarray, col: np.ndarray, w: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(row, w[col, c], minlength=n) for c in range(len(b))], 1) + b

    def _fit(self, row: np.ndarray, col: np.ndarray, y: np.ndarray, use: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        k, rows = len(self.classes), len(y)
        w, b = np.zeros((n, k)), np.zeros(k)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
        target = np.zeros((rows, k))
        target[np.arange(rows), y] = 1
        weight = use / np.maximum(np.bincount(y[use], minlength=k)[y], 1) * use.sum() / k  # classes count alike
        weight /= max(weight.sum(), 1e-9)
        for t in range(1, STEPS + 1):
            e = (_softmax(self._logits(row, col, w, b, rows)) - target) * weight[:, None]
            g = np.stack([np.bincount(col, e[row, c], minlength=n) for c in range(k)], 1)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            mb, vb = 0.9 * mb + 0.1 * e.sum(0), 0.999 * vb + 0.001 * e.sum(0) ** 2
            step = 0.1 / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
            w = w - step * m / (1 - 0.9**t)
            w = np.sign(w) * np.maximum(np.abs(w) - step * SHRINK, 0)
            b = b - 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
        return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _template_sets() -> list[tuple[str, np.ndarray, list[np.ndarray]]]:
    """(family, words, words that tell it from templates of other families that share half of its words or more, one array each)."""
    names = [n for n, own in TEMPLATES.items() for _ in own]
    out: list[np.ndarray] = []
    for _, at, _, _, one, _ in _features(pa.array([t for own in TEMPLATES.values() for t in own])):
        out += [np.unique(one[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    rivals = [[np.setdiff1d(t, r) for m, r in zip(names, out, strict=True) if m != n and 2 * len(np.intersect1d(t, r)) >= len(t)] for n, t in zip(names, out, strict=True)]
    return [(n, t, [x for x in only if len(x)]) for n, t, only in zip(names, out, rivals, strict=True)]


def _looks_like_a_template(line: str) -> bool:
    words = set(line.lower().replace(",", " ").replace(".", " ").split())
    return any(len(words & own) >= 0.6 * len(own) for own in _TEMPLATE_WORDS)


_TEMPLATE_WORDS = [set(t.lower().replace(",", " ").replace(".", " ").split()) for own in TEMPLATES.values() for t in own]


def train(docs: DataFrame) -> Model:
    """Samples a line of 20 to LONGEST letters of SAMPLE_LINES documents, in order of a hash of doc_id, as the class `none`."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x).between(21, LONGEST))
    chosen = docs.where("text is not null and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_LINES)
    rows = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("doc_id", lines.alias("x")).where("size(x) > 0")
    picked = rows.select("doc_id", F.element_at("x", (F.pmod(F.xxhash64("doc_id"), F.size("x")) + 1).cast("int")).alias("line"))
    return Model([r["line"] for r in picked.orderBy(F.xxhash64("doc_id"), "doc_id", "line").limit(SAMPLE_LINES).collect()])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, line, start, end, family, probability, confirmed, template_share): paragraphs that aren't `none`; start and end are bytes."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int32)
        number[model.features] = np.arange(len(model.features))
        none, templates = model.classes.index("none"), _template_sets()
        hinted = model.w[:, :none].max(1) > model.w[:, none]  # without such a feature no class gains on `none`, whose bias is the largest

        def judge(one: np.ndarray, two: np.ndarray, w: np.ndarray) -> dict | None:
            own, pairs = one[w], two[w[:-1]]
            f = number[np.unique(np.concatenate([own, pairs]))]
            f = f[f >= 0]
            p = _softmax(((model.w[f].sum(0) + model.b) / model.temperature)[None])[0]
            k = int(p.argmax())
            if k == none:
                return None
            family = model.classes[k] if p[k] >= CONFIDENT else "unknown"
            words = np.unique(own)
            near = [(x / len(t), x / len(words), x, all(2 * np.isin(r, words).sum() >= len(r) for r in only)) for x, t, only in ((len(np.intersect1d(words, t)), t, only) for n, t, only in templates if n == family)]
            share = max((x for x in near if x[3]), default=(0.0, max((x[1] for x in near), default=0.0), 0, False))
            return {"words": w, "common": share[2], "family": family, "probability": round(float(p[k]), 6), "confirmed": bool(share[3] and share[0] >= CONFIRM), "template_share": round(float(share[1]), 6)}

        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            offsets, data = text_buffers(batch.column(1))
            for i, at, starts, ends, one, two in _features(batch.column(1)):
                hit = np.flatnonzero(((number[one] >= 0) & hinted[number[one]]) | ((number[two] >= 0) & hinted[number[two]]))
                if not len(hit):
                    continue
                rows = np.searchsorted(at, hit, "right") - 1
                for r in np.unique(rows).tolist():
                    a, b, base = int(at[r]), int(at[r + 1]), int(offsets[i + r])
                    breaks = np.flatnonzero(data[base : int(offsets[i + r + 1])] == 10) + base
                    line_of = np.searchsorted(breaks, starts[a:b])
                    seen: dict[int, dict] = {}
                    hits = np.unique(line_of[hit[rows == r] - a])
                    for line in hits.tolist():
                        if (x := judge(one, two, np.flatnonzero(line_of == line) + a)) is not None:
                            seen[line] = x
                    own = np.unique(line_of)
                    for run_of in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                        u, v = int(run_of[0]), int(run_of[-1])
                        k = np.searchsorted(hits, u)
                        if u == v or k == len(hits) or hits[k] > v:
                            continue
                        inner = [x for x in seen if u <= x <= v]
                        least = max((seen[x]["common"] for x in inner if seen[x]["confirmed"]), default=0)
                        for y, z in dict.fromkeys([(u, v), (min(inner, default=u), max(inner, default=v))]):
                            x = judge(one, two, np.flatnonzero((line_of >= y) & (line_of <= z)) + a)
                            if x is not None and x["confirmed"] and x["common"] > least:
                                seen = {n: o for n, o in seen.items() if not y <= n <= z} | {y: x}
                                break
                    for line, x in sorted(seen.items()):
                        w, _ = x.pop("words"), x.pop("common")
                        found.append({"doc_id": ids[i + r], "line": line, "start": int(starts[w[0]]) - base, "end": int(ends[w[-1]]) - base, **x})
            yield pa.RecordBatch.from_pylist(found, schema=kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("template_share", pa.float64())])
    return docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, line int, start long, end long, family string, probability double, confirmed boolean, template_share double")

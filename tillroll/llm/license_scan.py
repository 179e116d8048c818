"""Licence scan by a trained paragraph classifier.

Every paragraph (line) of every text is scored by a multinomial logistic
regression over hashed word and word-pair features, with one class per
licence family and a class for everything else. Training paragraphs are the
families' template statements, whole and in random cuts, against ordinary
paragraphs drawn from the corpus (a bounded sample). A temperature calibrates
the probabilities: it is fitted on phrasings and ordinary paragraphs
that a first training did not see, whose precision and recall the model
reports (``held_out``). A prediction below ``sure`` is unknown. A predicted family is then confirmed by comparing the
paragraph's word triples with those of the family's templates.

Edge cases: null and empty texts have no paragraph; blank lines are not
paragraphs; repeated rows get equal results; without ordinary paragraphs the
templates' own words train the classifier; an empty table gives an empty
result; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import ALNUM_WORDS, bounded, mix, row_groups, text_bytes, words

UNKNOWN = "unknown"

# Customary statements of each family (SPDX names).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License",
        "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.", "Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This document is confidential and proprietary. All rights reserved.",
    ),
}

# Names that the families go by in running text.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 license"),
    "MIT": ("MIT License", "MIT (Expat) licence"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "LGPL": ("GNU Lesser General Public License", "LGPL v2.1"),
    "BSD": ("BSD 3-Clause License", "modified BSD license"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC0": ("CC0 1.0 public domain dedication", "Creative Commons CC0"),
    "Proprietary": (),
}
# Ways to say that something is under a licence.
FRAMES = ("Licensed under the {}.", "Released under the terms of the {}.", "This work is licensed under {}.",
          "Distributed under the {}, see the file for details.", "Use of this code is governed by the {}.",
          "The source is made available under the {}.", "You may copy this text under {}.", "License: {}")
# Every fourth of them is left out of the first training.
HELD_FRAMES = FRAMES[1::4]


def statements(family: str) -> list[tuple[str, bool]]:
    """A family's statements and whether each is one of the held frames."""
    return [(t, False) for t in TEMPLATES[family]] + [
        (frame.format(name), frame in HELD_FRAMES) for name in NAMES[family] for frame in FRAMES]


@dataclass(frozen=True)
class LicenseSpec:
    bits: int = 16
    copies: int = 60              # random cuts per template
    ordinary: int = 6000          # sampled ordinary paragraphs (expected)
    epochs: int = 15
    rate: float = 0.3
    sure: float = 0.5
    confirm: float = 0.5          # share of a paragraph's or a template's word triples
    max_words: int = 400          # of a training paragraph
    max_chars: int = 4000         # of a training paragraph, as it is sent to the driver
    seed: int = 23


def paragraph_features(offsets: np.ndarray, data: np.ndarray, bits: int):
    """Yield (first row, docs, paragraph, features [words, 2], hashes, starts, ends) per row group."""
    shift = np.uint64(64 - bits)
    for a, b in row_groups(offsets, 1 << 20):
        w = words(offsets[a:b + 1], data, ALNUM_WORDS)
        n = len(w.starts)
        if not n:
            continue
        new = np.zeros(n, bool)
        lo = int(w.starts[0])
        lines = np.concatenate([[0], np.cumsum(data[lo:int(w.ends[-1])] == 0x0A)])
        new[1:] = (lines[w.starts[1:] - lo] > lines[w.ends[:-1] - lo]) | (w.docs[1:] != w.docs[:-1])
        para = np.cumsum(new)
        f = np.full((n, 2), 1 << bits, np.int64)
        f[:, 0] = (w.hashes >> shift).astype(np.int64)
        both = ~new[1:]
        pair = mix(w.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[1:])
        f[1:, 1][both] = (pair[both] >> shift).astype(np.int64)
        yield a, w.docs, para, f, w.hashes, w.starts, w.ends


def _text_features(text: str, bits: int) -> np.ndarray:
    raw = text.replace("\n", " ").encode()
    off = np.array([0, len(raw)], np.int64)
    got = list(paragraph_features(off, np.frombuffer(raw, np.uint8), bits))
    return got[0][3].reshape(-1) if got else np.zeros(0, np.int64)


class LicenseModel:
    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, spec: LicenseSpec):
        self.names, self.weights, self.bias = names, weights, bias
        self.temperature, self.spec = temperature, spec
        self.held_out: dict[str, float] = {}         # precision and recall on phrasings that were left out
        self.triples = [_family_triples(tuple(t for t, _ in statements(n))) if n in TEMPLATES else [] for n in names]

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _triples(h: np.ndarray) -> set[int]:
    n = min(3, len(h))
    if not n:
        return set()
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j]
    return set(out.tolist())


def _family_triples(texts: tuple[str, ...]) -> list[set[int]]:
    out = []
    for t in texts:
        raw = t.encode()
        w = words(np.array([0, len(raw)], np.int64), np.frombuffer(raw, np.uint8), ALNUM_WORDS)
        out.append(_triples(w.hashes))
    return out


def _training_rows(ordinary: list[str], spec: LicenseSpec, names: list[str]):
    """(features, class, held): cuts of every statement and ordinary paragraphs.

    ``held`` marks the statements in a held frame, whole, and every fifth
    ordinary paragraph.
    """
    rng = np.random.default_rng(spec.seed)
    rows: list[tuple[np.ndarray, int, bool]] = []
    for k, name in enumerate(names[1:], 1):
        for t, held in statements(name):
            w = t.split()
            for c in range(spec.copies if t in TEMPLATES[name] else spec.copies // 6):
                n = len(w) if c % 3 == 0 else int(rng.integers(max(2, len(w) * 6 // 10), len(w) + 1))
                a = int(rng.integers(0, len(w) - n + 1)) if n < len(w) else 0
                part = w[a:a + n]
                if c % 2 and ordinary:            # with other words around
                    o = ordinary[int(rng.integers(len(ordinary)))].split()[:6]
                    part = part + o if c % 4 == 1 else o + part
                rows.append((_text_features(" ".join(part), spec.bits), k, held))
    common = [x for t in TEMPLATES.values() for s in t for x in s.split()]
    rows += [(_text_features(" ".join(rng.choice(common, int(rng.integers(3, 15)))), spec.bits), 0, i % 5 == 0)
             for i in range(300)]                 # loose licence words are no statement
    rows += [(_text_features(" ".join(t.split()[:spec.max_words]), spec.bits), 0, i % 5 == 0)
             for i, t in enumerate(ordinary)]
    return [r for r in rows if len(r[0])]


def _regression(rows, n_classes: int, spec: LicenseSpec, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression by Adagrad."""
    rng = np.random.default_rng(spec.seed + 1)
    w = np.zeros(((1 << spec.bits) + 1, n_classes), np.float32)
    past = np.full(w.shape, 1e-2, np.float32)
    bias = np.zeros(n_classes)
    for _ in range(max(1, epochs)):
        for i in rng.permutation(len(rows)):
            f, y = rows[i][:2]
            z = bias + w[f].sum(0) / len(f) ** 0.5
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            if abs(p[y]) < 1e-3:
                continue
            u = np.unique(f)
            g = (p / len(f) ** 0.5).astype(np.float32)
            past[u] += g * g
            w[u] -= spec.rate * g / np.sqrt(past[u])
            bias -= 0.01 * p
            w[-1] = 0
    return w, bias


def fit(ordinary: list[str], spec: LicenseSpec) -> LicenseModel:
    """The classifier of all rows, calibrated on what a first training without the held rows makes of those."""
    names = [UNKNOWN, *TEMPLATES]
    rows = _training_rows(ordinary, spec, names)
    held = [r for r in rows if r[2]]
    w, bias = _regression([r for r in rows if not r[2]], len(names), spec, spec.epochs // 2)
    z = np.array([bias + w[f].sum(0) / len(f) ** 0.5 for f, _, _ in held])
    y = np.array([k for _, k, _ in held])

    def chances(t):
        s = z / t
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.25, 8, 41)
    losses = [-np.mean(np.log(np.maximum(chances(t)[np.arange(len(y)), y], 1e-12))) for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = chances(temperature)
    said = np.where(p.max(1) >= spec.sure, p.argmax(1), 0)
    right = (said == y) & (y > 0)
    model = LicenseModel(names, *_regression(rows, len(names), spec, spec.epochs), temperature, spec)
    model.held_out = {"precision": float(right.sum() / max((said > 0).sum(), 1)),
                      "recall": float(right.sum() / max((y > 0).sum(), 1))}
    return model


def train(docs: DataFrame, text_col: str = "text", spec: LicenseSpec = LicenseSpec()) -> LicenseModel:
    """Ordinary paragraphs: a bounded hash sample of one paragraph per document without licence words."""
    rows = bounded(docs).select(F.col(text_col).alias("text")).where("text is not null and trim(text) <> ''")
    n = rows.count()
    if not n:
        return fit([], spec)
    h = F.xxhash64("text")
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.lower(x).rlike(
        "licen[sc]|copyright|permission|spdx|rights|redistribut|creative commons|public domain"))
    picked = (rows.withColumn("h", h)
              .where(F.pmod("h", F.lit(1 << 30)) < F.lit(min(1.0, spec.ordinary / n) * (1 << 30)))
              .dropDuplicates(["h"]).withColumn("lines", lines).where("size(lines) > 0")
              .select("h", F.substring(F.element_at("lines", (F.pmod(F.shiftright("h", 7), F.size("lines")) + 1).cast("int")),
                                       1, spec.max_chars).alias("p")))
    got = sorted({(r["h"], r["p"]) for r in picked.collect()})
    return fit([p for _, p in got], spec)


_FOUND = pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("score", pa.float64()),
                  ("n_paragraphs", pa.int64()), ("n_licensed", pa.int64()), ("found", pa.list_(_FOUND))])


def _confirmed(model: LicenseModel, k: int, h: np.ndarray) -> bool:
    """Enough of some template's triples occur in the paragraph, or the reverse."""
    have = _triples(h)
    return any(len(have & t) >= model.spec.confirm * min(len(t), len(have)) for t in model.triples[k] if t and have)


def _apply(model: LicenseModel):
    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            n = batch.num_rows
            paras = np.zeros(n, np.int64)
            found: list[list[dict]] = [[] for _ in range(n)]
            for a, docs, para, f, hashes, starts, ends in paragraph_features(offsets, data, model.spec.bits):
                first = np.flatnonzero(np.concatenate([[True], para[1:] != para[:-1]]))
                last = np.append(first[1:], len(para)) - 1
                sums = np.add.reduceat(model.weights[f[:, 0]] + model.weights[f[:, 1]], first, axis=0)
                size = 2 * (last - first + 1)
                p = model.probabilities(model.bias + sums / np.sqrt(size)[:, None])
                owner = docs[first]
                paras[a:a + int(owner[-1]) + 1] += np.bincount(owner, minlength=int(owner[-1]) + 1)
                k = p.argmax(1)
                for i in np.flatnonzero((k > 0) & (p[np.arange(len(k)), k] >= model.spec.sure)):
                    if _confirmed(model, int(k[i]), hashes[first[i]:last[i] + 1]):
                        d = a + int(owner[i])
                        lo, b0, b1 = int(offsets[d]), int(starts[first[i]]), int(ends[last[i]])
                        c0 = int(((data[lo:b0] & 0xC0) != 0x80).sum())
                        c1 = c0 + int(((data[b0:b1] & 0xC0) != 0x80).sum())
                        found[d].append({"family": model.names[k[i]], "start": c0, "end": c1, "p": float(p[i, k[i]])})
            best = [max(v, key=lambda x: (x["p"], -x["start"])) if v else None for v in found]
            yield pa.record_batch([
                batch.column(0), pa.array([x["family"] if x else None for x in best], pa.string()),
                pa.array([x["p"] if x else 0.0 for x in best]), pa.array(paras),
                pa.array([len(v) for v in found], pa.int64()), pa.array(found, pa.list_(_FOUND))], schema=_OUT)

    return run


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its surest licence (null: none), and every licensed paragraph (code points)."""
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _apply(model), "doc_id long, license string, score double, n_paragraphs long, n_licensed long, "
                       "found array<struct<family: string, start: bigint, end: bigint, p: double>>")

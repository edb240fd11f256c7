"""Licence scans by a trained paragraph classifier.

Fit: sparse word n-gram (one and two words) logistic regression over the licence families and
a class ``unknown``.  Its examples are the notices below and phrases around the licences' names, with words
dropped and strangers' words around them; the same with their names or versions replaced, and a bounded sample of
the corpus's own paragraphs, are ``unknown``.  A held-out part of the examples gives the
temperature that calibrates the probabilities.

Scan: blocks of lines between lines without a word, so a notice may be wrapped.  Every stretch of
``LENGTHS`` words that has a known n-gram is classified, a quarter of its length apart.  Where ``unknown`` is less likely than
not, each family of probability ``MAYBE`` or more is compared with its templates nearby, which confirm or reject it:
a notice is an occurrence of up to ``WINDOW`` words with at least ``SIMILAR`` of
the notice's word pairs, all words that name the licence and its version and none that name another; a name stands whole, and
opens its block or has one of ``CUES`` near; of overlapping ones of a notice that counts which has the most of
its pairs and the fewest others.  Over all confirmed templates the nearest occurrence is taken first, then the longest; a
further one counts where the words that are still free have a probability of ``LEAST`` or more
for its family, so notices of several families may share a line, and their first words too.  A name is classified with
the ``CONTEXT`` words on either side.  Overlapping occurrences of one family are one notice.
"""

from __future__ import annotations

import dataclasses
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T

UNKNOWN = "unknown"
#: Words that an occurrence of a notice spans at most, and of an example.
WINDOW = 64
LEAST = 0.5
SIMILAR = 0.6
#: Lengths of the classified stretches; each begins a quarter of its length after the one before.
LENGTHS = (8, 16, 32, 64)
#: Least probability of a family whose templates are compared.
MAYBE = 0.05
#: Words on either side that a name is classified with.
CONTEXT = 4
#: Words on either side among which a name needs a cue.
NEAR = 8
#: Words classified at once.
CHUNK = 1 << 15
#: Lines of the corpus that a fit uses at most, from about this many documents, chosen by a hash of the text.
MAX_PARAGRAPHS, MAX_DOCUMENTS = 10_000, 2_000
#: Examples of licences that an n-gram is in at least.
LEAST_EXAMPLES = 4
#: Examples made of each notice.
VARIANTS = 24

#: Customary notices of licence families, by SPDX identifier.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License."],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License version 3 along with this program."],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 3.",
        "This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under the Unlicense."],
}
#: Words of the notices that name a licence; with other words there it is an unknown one.
NAMES = set("""apache mit bsd isc gnu general lesser affero mozilla creative commons attribution sharealike noncommercial cc by sa nc cc0
unlicense public domain free foundation 0 1 2 3 4""".split())
#: Those of them that tell licences apart; an occurrence of a notice has all that the notice has.
TELLING = set("""apache mit bsd isc gnu lesser affero mozilla creative commons sharealike noncommercial cc sa nc cc0 unlicense 0 1 2 3 4""".split())

#: Short names of the families, and the versions that follow them ("" if none need to).
SHORT: dict[str, tuple[list[str], list[str]]] = {
    "Apache-2.0": (["Apache", "Apache License", "Apache Licence"], ["2", "2.0", "v2", "v2.0", "version 2", "version 2.0"]),
    "MIT": (["MIT License", "MIT Licence", "MIT licensed", "license MIT", "identifier MIT"], [""]),
    "BSD-3-Clause": (["BSD 3-Clause", "3-Clause BSD", "three-clause BSD"], [""]),
    "ISC": (["ISC License", "ISC Licence", "identifier ISC"], [""]),
    "GPL-2.0": (["GNU General Public License", "GNU GPL", "GPL"], ["2", "2.0", "v2", "v2.0", "version 2", "version 2.0"]),
    "GPL-3.0": (["GNU General Public License", "GNU GPL", "GPL"], ["3", "3.0", "v3", "v3.0", "version 3", "version 3.0"]),
    "LGPL-3.0": (["GNU Lesser General Public License", "GNU LGPL", "LGPL"], ["3", "3.0", "v3", "v3.0", "version 3", "version 3.0"]),
    "AGPL-3.0": (["GNU Affero General Public License", "GNU AGPL", "AGPL"], ["3", "3.0", "v3", "v3.0", "version 3", "version 3.0"]),
    "MPL-2.0": (["Mozilla Public License", "MPL"], ["2", "2.0", "v2", "v2.0", "v. 2.0", "version 2", "version 2.0"]),
    "CC-BY-4.0": (["CC BY", "Creative Commons Attribution"], ["4.0"]),
    "CC-BY-SA-4.0": (["CC BY-SA", "Creative Commons Attribution-ShareAlike"], ["4.0"]),
    "CC-BY-NC-4.0": (["CC BY-NC", "Creative Commons Attribution-NonCommercial"], ["4.0"]),
    "CC0-1.0": (["CC0"], ["1.0"]),
    "Unlicense": (["the Unlicense", "identifier Unlicense"], [""]),
}
SHORT_WORDS = {"gpl", "lgpl", "agpl", "mpl"}
#: Words of which one is near a name that is a notice, unless the name opens its block.
CUES = """licensed license licence under released available covered terms identifier later distributed use see""".split()
#: Phrases that names stand in.
PHRASES = ["licensed under the {}", "released under {}", "SPDX-License-Identifier: {}", "license: {}", "this software is distributed under the terms of the {}",
           "available under {} terms", "{} or later", "{}", "see the {} for details", "covered by the {}"]


def names() -> list[tuple[str, str]]:
    """(family, name) of every short name with every version."""
    return [(family, f"{name} {version}".strip()) for family, (short, versions) in SHORT.items() for name in short for version in versions]


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = T.word_bounds(data, np.array([0, len(data)]), T.WORD_BYTES)
    return T.word_hashes(data, starts, ends)


#: A line feed, then lines without a word.
BLANK_LINES = r"\n(?:[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n)+"


def pairs_of(h: np.ndarray) -> np.ndarray:
    """One hash for each two consecutive words."""
    return T.mix(h[:-1] * T.M3 + T.mix(h[1:]))


def _occurrences(at: np.ndarray, ids: np.ndarray, size: int, need: int) -> list[tuple[float, int, int, int]]:
    """(nearness, first word, end, distinct pairs) of a notice's occurrences that don't overlap, nearest first.

    ``at`` and ``ids`` are places and numbers of those pairs of a block that the notice of ``size`` pairs has.
    """
    n = len(at)
    by = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    same = ids[by][1:] == ids[by][:-1]
    before[by[1:][same]] = by[:-1][same]
    distinct, hits, end, near = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for d in range(min(n, WINDOW - 1)):
        m = n - d
        length = at[d:] - at[:m] + 1
        inside = length < WINDOW
        if not inside.any():
            break
        distinct[:m] += inside & (before[d:] < np.arange(m))
        now = np.where(inside & (distinct[:m] >= need), distinct[:m] / (size + length - distinct[:m]), 0.0)
        better = np.flatnonzero(now > near[:m])
        near[better], hits[better], end[better] = now[better], distinct[better], at[better + d] + 2
    out, taken = [], np.zeros(int(at[-1]) + 2, bool)
    some = np.flatnonzero(near)
    for i in some[np.argsort(-near[some], kind="stable")].tolist():
        a, b = int(at[i]), int(end[i])
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((float(near[i]), a, b, int(hits[i])))
    return out


@dataclasses.dataclass
class Classifier:
    """Sorted n-gram hashes, a weight for each of them and class, biases, and the templates' word pairs and telling words."""

    classes: list[str]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: np.ndarray
    notices: list[tuple[str, np.ndarray, np.ndarray, bool]]  # family, word pairs, telling words, is it a name

    def numbers(self, g: np.ndarray) -> np.ndarray:
        """Numbers of n-grams, -1 of unknown ones."""
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        return np.where(self.grams[at] == g, at, -1) if len(self.grams) else np.full(len(g), -1)

    def features(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the known n-grams of some consecutive words, repeats counted."""
        k = self.numbers(np.concatenate([h, pairs_of(h)]))
        return k[k >= 0]

    def probabilities(self, known: np.ndarray, temperature: float | None = None) -> np.ndarray:
        return self._softmax(self.weights[known].sum(axis=0)[None], np.array([len(known)]), temperature)[0]

    def _softmax(self, sums: np.ndarray, count: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = (sums / np.sqrt(np.maximum(1, count))[:, None] + self.bias) / (temperature or self.temperature)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def stretches(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Yield (block, first word, end, probabilities) arrays of the stretches of blocks of words that have a known
        n-gram and aren't more likely unknown than not.  Sums over a stretch are differences of prefix sums."""
        size = end - begin
        for lo in range(0, len(h), CHUNK):
            hi = min(lo + CHUNK, len(h))
            own = h[lo:min(hi + LENGTHS[-1], len(h))]
            one, two = self.numbers(own), self.numbers(pairs_of(own))
            count, sums = [], []
            for k in (one, two):
                count.append(np.concatenate([[0], np.cumsum(k >= 0)]))
                at, total = np.flatnonzero(k >= 0), np.zeros((int((k >= 0).sum()) + 1, len(self.classes)))
                np.cumsum(self.weights[k[at]], axis=0, out=total[1:])
                sums.append(total)
            near = np.arange(np.searchsorted(end, lo, "right"), np.searchsorted(begin, hi))
            for length in LENGTHS:
                # a longer stretch than the shortest is of use only where it holds more words than a shorter one
                blocks = near if length == LENGTHS[0] else near[size[near] > length // 2]
                step = length // 4
                first = np.maximum(0, -(-(lo - begin[blocks]) // step))
                last = np.minimum(np.maximum(0, -(-(size[blocks] - length) // step)), (hi - 1 - begin[blocks]) // step)
                many = np.maximum(0, last - first + 1)
                block = np.repeat(blocks, many)
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                a = begin[block] + nth * step
                b = np.minimum(a + length, end[block])
                edges = [(count[0][a - lo], count[0][b - lo]), (count[1][a - lo], count[1][b - 1 - lo])]
                known = sum(q - p for p, q in edges)
                some = known > 0
                if not some.any():
                    continue
                total = sum(t[q[some]] - t[p[some]] for t, (p, q) in zip(sums, edges, strict=True))
                p = self._softmax(total, known[some])
                likely = p[:, 0] < 0.5  # the first class is unknown
                at = np.flatnonzero(some)[likely]
                if not len(at):
                    continue
                yield block[at], a[at], b[at], p[likely]

    def membership(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which template has which known pair, the templates' numbers of pairs, how many of them confirm one, and the templates' classes."""
        size = np.array([len(x[1]) for x in self.notices])
        need = np.where([x[3] for x in self.notices], size, np.ceil(SIMILAR * size - 1e-9)).astype(np.int64)
        return np.stack([np.isin(self.pairs, x[1]) for x in self.notices], axis=1), size, need, np.array([self.classes.index(x[0]) for x in self.notices])

    def confirmed(self, h: np.ndarray, at: np.ndarray, ids: np.ndarray, membership, likely: np.ndarray) -> list[tuple]:
        """(-nearness, -length, first word, end, template, hits) of occurrences of the templates of the ``likely`` classes in some words,
        given places and numbers of their known pairs."""
        own, size, need, classes = membership
        found, others = [], np.array([_hashed(w)[0] for w in sorted(TELLING) if not w.isdigit()], np.uint64)
        for k in np.flatnonzero((own[np.unique(ids)].sum(axis=0) >= need) & likely[classes]).tolist():
            has = own[ids, k]
            _, _, telling, is_name = self.notices[k]
            for near, a, b, hits in _occurrences(at[has], ids[has], int(size[k]), int(need[k])):
                if (near > 1 - 1e-9) if is_name else np.isin(telling, h[a:b]).all() and not np.isin(h[a:b], np.setdiff1d(others, telling)).any():
                    found.append((-near, a - b, a, b, k, hits))
        return found

    def find(self, h: np.ndarray, found: list[tuple]) -> list[tuple[int, str, float, float]]:
        """(first word, family, probability, similarity) of each notice in a block's words, given its confirmed occurrences."""
        out, owner = [], np.zeros(len(h), np.int64)  # of each word, the family that has it
        cues = np.concatenate([_hashed(w) for w in CUES])
        for _, _, a, b, k, hits in sorted(set(found)):
            family, pairs, _, is_name = self.notices[k]
            number = self.classes.index(family)
            free = owner[a:b] == 0
            if not free.any() or (owner[a:b] == number).any():
                continue
            own = np.isin(pairs_of(h[a:b]), pairs)
            if not (own & (free[:-1] | free[1:])).any() or (is_name and not free.all()):
                continue
            if is_name and a and not np.isin(np.concatenate([h[max(0, a - NEAR):a], h[b:b + NEAR]]), cues).any():
                continue
            c, d = (max(0, a - CONTEXT), min(len(h), b + CONTEXT)) if is_name else (a, b)
            p = max((self.probabilities(self.features(x)) for x in ((h[c:d][owner[c:d] == 0], h[a:b][free]) if is_name else (h[a:b][free],))), key=lambda p: p[number])
            if int(p.argmax()) == number and p[number] >= LEAST:
                owner[a:b][free] = number
                out.append((a, family, float(p[number]), hits / len(pairs)))
        return sorted(out)


def examples(strangers: list[str], seed: int = 11) -> list[tuple[str, str]]:
    """(class, text) of what a fit learns from, given paragraphs of the corpus."""
    rng = random.Random(seed)
    words = [w for s in strangers for w in _words(s)] or ["lorem"]
    around = lambda: [rng.choice(words) for _ in range(rng.choice([0, 0, 3, 12]))]
    out = [(UNKNOWN, s) for s in strangers]
    for family, notices in NOTICES.items():
        for notice in notices:
            own = _words(notice)
            out += [(family, notice)] * 4
            for _ in range(VARIANTS):
                kept = [w for w in own if w in NAMES or rng.random() > 0.1]
                out.append((family, " ".join([*around(), *kept, *around()])))
            for _ in range(VARIANTS // 4):
                out.append((UNKNOWN, " ".join([*around(), *(rng.choice(words) if w in NAMES else w for w in own), *around()])))
    for family, name in names():
        own = _words(name)
        for phrase in PHRASES:
            said = lambda ws: " ".join([*around(), *_words(phrase.format(" ".join(ws))), *around()])  # noqa: B023, E731
            out.append((family, said(own)))
            # a stranger's name, and another version of this one, are unknown
            out.append((UNKNOWN, said([rng.choice(words) if w in NAMES | SHORT_WORDS and not w[-1].isdigit() else w for w in own])))
            digits = [w for w in own if w[-1].isdigit()]
            if digits:
                other = {w: w[:-1] + rng.choice([d for d in "56789" if d != w[-1]]) for w in digits}
                out.append((UNKNOWN, said([other.get(w, w) for w in own])))
    return out


def _softmax_fit(rows: list[np.ndarray], y: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial logistic regression on rows of n-gram numbers, by full-gradient Adam steps with a slight ridge.

    The examples and their n-grams are bounded, so a matrix of them is.
    """
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        np.add.at(x[i], r, 1 / np.sqrt(max(1, len(r))))
    w, b = np.zeros((width, k), np.float32), np.zeros(k, np.float32)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b)]
    share = np.bincount(y, minlength=k)
    weight = ((1 / np.maximum(share, 1))[y] / (share > 0).sum()).astype(np.float32)
    target = np.eye(k, dtype=np.float32)[y]
    for step in range(1, 201):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target) * weight[:, None]
        for v, g, m in ((w, x.T @ d + np.float32(1e-5) * w, moments[0]), (b, d.sum(axis=0), moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            v -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-10)
    return w.astype(np.float64), b.astype(np.float64)


def fit(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Fit the classifier with the notices and a bounded sample of the lines of ``docs`` (none is fine), from blocks without a notice."""
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    n = texts.count()
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < max(1, int(1_000_000 * MAX_DOCUMENTS / max(n, 1))))
    blocks = chosen.select(F.explode(F.split("text", BLANK_LINES, -1)).alias("block")).filter(F.col("block").rlike(r"\S"))
    notices = [(f, np.unique(pairs_of(_hashed(x))), np.array([_hashed(w)[0] for w in sorted(set(_words(x)) & TELLING)], np.uint64), False) for f, xs in NOTICES.items() for x in xs]
    notices += [(f, np.unique(pairs_of(_hashed(x))), np.zeros(0, np.uint64), True) for f, x in names() if len(_words(x)) > 1]
    known_pairs = np.unique(np.concatenate([x[1] for x in notices]))

    def stranger(block: str) -> bool:
        own = np.intersect1d(pairs_of(_hashed(block)), known_pairs)
        return not len(own) or not any(np.isin(p, own).mean() >= (1 if is_name else SIMILAR) for _, p, _, is_name in notices)

    sample = [r.block for r in blocks.distinct().orderBy(F.xxhash64("block")).limit(MAX_PARAGRAPHS).collect()]
    lines = dict.fromkeys(x for s in sample if stranger(s) for x in s.split("\n") if x.strip())
    sample = sorted(lines, key=lambda x: hashlib.md5(x.encode()).digest())[:MAX_PARAGRAPHS]
    rows = examples(sample)
    random.Random(5).shuffle(rows)
    rng = random.Random(3)
    window = lambda h: h[(c := rng.randrange(max(1, len(h) - WINDOW + 1))):c + WINDOW]
    hashes = [window(_hashed(x)) for _, x in rows]
    grams, seen = np.unique(np.concatenate([np.unique(np.concatenate([h, pairs_of(h)])) for (c, _), h in zip(rows, hashes, strict=True) if c != UNKNOWN]), return_counts=True)
    grams = grams[seen >= LEAST_EXAMPLES]
    classes = [UNKNOWN, *sorted(NOTICES)]
    model = Classifier(classes, grams, np.zeros((len(grams), len(classes))), np.zeros(len(classes)), 1.0, known_pairs, notices)
    x = [model.features(h) for h in hashes]
    y = np.array([classes.index(c) for c, _ in rows])
    held = np.arange(len(rows)) % 5 == 0
    model.weights, model.bias = _softmax_fit([r for r, out in zip(x, held, strict=True) if not out], y[~held], len(grams), len(classes))
    loss = lambda t: -float(np.mean([np.log(model.probabilities(x[i], t)[y[i]] + 1e-12) for i in np.flatnonzero(held)]))
    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    return model


def scan(docs: DataFrame, model: Classifier, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: (*keep, n_paragraphs, licenses, notices).

    A paragraph is a line.  ``licenses`` are the families found, sorted; ``notices`` lists (number of the
    paragraph where it begins, family, probability, similarity) of each notice.
    A null text has no paragraph, an empty one has one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(T.parts(model))
    df = docs.select(*keep, F.col(text_col).alias("__text"))
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches):
        m = Classifier(*shared.value)
        membership = m.membership()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column(len(keep))
            count, notices = np.zeros(n, np.int64), [[] for _ in range(n)]
            for at, data, offs in T.slices(texts):
                breaks = np.flatnonzero(data == 10)
                lines = np.concatenate([offs[:-1], breaks + 1])
                doc = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, breaks, "right") - 1])
                order = np.lexsort((lines, doc))
                lines, doc = lines[order], doc[order]
                count[at:at + len(offs) - 1] = np.bincount(doc, minlength=len(offs) - 1)
                edges = np.append(lines, len(data))
                starts, ends, first = T.word_bounds(data, edges, T.WORD_BYTES)
                h = T.word_hashes(data, starts, ends)
                if len(h) < 2:
                    continue
                pairs = pairs_of(h)
                ids = np.searchsorted(m.pairs, pairs)
                ids[ids == len(m.pairs)] = 0
                known = m.pairs[ids] == pairs
                full = first[1:] > first[:-1]
                opens = full & np.concatenate([[True], ~full[:-1] | (doc[1:] != doc[:-1])])
                begin = first[:-1][opens]
                end = np.append(begin[1:], len(h))
                head = np.searchsorted(doc, np.arange(len(offs) - 1))
                found: dict[int, list] = {}
                for block, lo, hi, p in m.stretches(h, begin, end):
                    # overlapping stretches are compared with the templates together
                    opened = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (lo[1:] > hi[:-1])]))
                    for i, j in zip(opened, [*opened[1:], len(block)], strict=True):
                        k = int(block[i])
                        a, b = max(int(begin[k]), int(lo[i]) - WINDOW), min(int(end[k]), int(hi[j - 1]) + WINDOW)
                        places = np.flatnonzero(known[a:b - 1])
                        if len(places):
                            likely = p[i:j].max(axis=0) >= MAYBE
                            found.setdefault(k, []).extend((near, size, x + a - int(begin[k]), y + a - int(begin[k]), *rest)
                                                           for near, size, x, y, *rest in m.confirmed(h[a:b], places, ids[a:b - 1][places], membership, likely))
                for k, occurrences in sorted(found.items()):
                    a, b = int(begin[k]), int(end[k])
                    for word, family, probability, similarity in m.find(h[a:b], occurrences):
                        line = int(np.searchsorted(first, a + word, "right")) - 1
                        notices[at + int(doc[line])].append({"paragraph": line - int(head[doc[line]]), "family": family, "probability": probability, "similarity": similarity})
            count[~np.asarray(texts.is_valid())] = 0
            families = [sorted({x["family"] for x in xs}) for xs in notices]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(count), pa.array(families, pa.list_(pa.string())), pa.array(notices, kind)],
                                             names=[*keep, "n_paragraphs", "licenses", "notices"])

    return df.mapInArrow(run, ddl + ", n_paragraphs long, licenses array<string>, notices array<struct<paragraph:int,family:string,probability:double,similarity:double>>")

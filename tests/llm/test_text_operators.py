"""Decontamination, BPE, toxicity, language ID and licences."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from llm_docs import docs  # noqa: F401

ODD = [None, "", " \n\t ", "...!?", "a", "Ünïcödé ÀÉ 日本語 ½ ٣", "\x00\x01 x\x7f", "\n\n\n\n", "<|endoftext|>", "http://x.y/z"]
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(s):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


def _windows(items, size):
    out = {}
    for i, t in items:
        w = _words(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[j:j + size]), set()).add(i)
    return out


def test_suffix_order_and_fm_index():
    from txnwatch.llm.decontaminate import FMIndex, suffix_order
    rng = np.random.default_rng(0)
    for t in range(60):
        v = int(rng.integers(1, 4))
        s = rng.integers(0, v + 1, int(rng.integers(1, 120)))
        s = np.concatenate([[0], np.tile(s, 1 + t % 3), [0]])

        def key(i):
            out = []
            while s[i]:
                out.append((1, s[i]))
                i += 1
            return [*out, (0, i)]
        assert sorted(range(len(s)), key=key) == suffix_order(s).tolist()
        index = FMIndex(s, 4)
        phrases, lengths = rng.integers(1, v + 2, (20, 5)), rng.integers(1, 6, 20)
        lo, hi = index.search(phrases, lengths)
        for k in range(20):
            p = phrases[k, 5 - lengths[k]:]
            want = [i for i in range(len(s) - lengths[k] + 1) if (s[i:i + lengths[k]] == p).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


@pytest.mark.parametrize("block_words,shard", [(4_000_000, 1 << 20), (30, 200)])
def test_decontaminate(spark, docs, monkeypatch, block_words, shard):
    from txnwatch.llm import decontaminate as D
    monkeypatch.setattr(D, "SHARD_SYMBOLS", shard)
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "Of", "a", "B", "été", "x1", "in"]) + rng.choice(["", "", "y", "z"])
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 12, 30])))) for i in range(12)] + [(3, None), (None, "rare words without an id here"), (50, " ?! "), (51, "SHORT item"), (51, "short ITEM")]
    texts = list(ODD)
    for _ in range(80):
        t = [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            own = _words(rng.choice(items)[1] or "")
            a = rng.randrange(len(own) + 1)
            t[5:5] = own[a:a + rng.choice([4, 10, 25])]
        texts.append((", " if rng.random() < 0.5 else "\n").join(t))
    texts += ["say short  item; now", "rare words without an id here", " ".join(word() for _ in range(40_000))]
    win = _windows(items, 10)
    lengths = {len(w) for w in win}
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, spans string")
    got = {r.doc_id: r for r in D.decontaminate(docs(list(enumerate(texts)), extra=True), bench, keep=("lang",), block_words=block_words).collect()}
    assert len(got) == len(texts) and sum(r.n_hit > 0 for r in got.values()) > 5
    for i, t in enumerate(texts):
        w, hit, found = _words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in win:
                    hit |= {*range(j, j + n)}
                    found |= win[tuple(w[j:j + n])]
        r = got[i]
        assert (r.n_words, r.n_hit, sorted(r.items)) == (len(w), len(hit), sorted(str(x) for x in found if x is not None)), i
        spans = list(zip(r.spans[::2], r.spans[1::2]))
        assert {k for a, b in spans for k in range(a, b)} == hit
        assert r.clean == t if not hit else _words(r.clean) == [x for k, x in enumerate(w) if k not in hit]
        assert r.lang == "en"


def test_decontaminate_empty(spark, docs):
    from txnwatch.llm.decontaminate import decontaminate
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.clean) for r in decontaminate(docs([(1, "a b")]), none).collect()] == [(2, 0, "a b")]
    assert decontaminate(docs([]), none).count() == 0


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def _strange_texts(n):
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x250), rng.randrange(0x2000, 0x2100), 32, 10, rng.randrange(0x300, 0x3000),
                                   rng.randrange(0x10000, 0x11000), rng.randrange(0x4E00, 0xD7FF)]))
    return ["".join(pick() for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe_against_the_library(spark, docs):
    from txnwatch.llm.bpe import encode_decode
    path, lib = _tokenizer()
    texts = [*ODD, "it's we'll I'D don't’s", "  a  b\n\n c\t\t", "\x1c\x1d \x85　 x​", "a" * 5000, "ab" * 3000 + " " + "é" * 700, " " * 2000 + "x",
             "x<|endoftext|><|endoftext|> y", *_strange_texts(600)]
    got = {r.doc_id: r for r in encode_decode(docs(list(enumerate(texts)), extra=True), path, keep=("doc_id", "source")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.n_tokens, r.token_ids, r.source) == (len(ids), ids, "src0"), t
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and r.round_trip == (back == (t or ""))
    assert encode_decode(docs([]), path).count() == 0


def test_bpe_long_words_and_boundaries(monkeypatch):
    from txnwatch.llm import bpe
    path, _ = _tokenizer()
    with open(path, encoding="utf-8") as f:
        b = bpe.ByteBPE(json.load(f))
    rng = random.Random(3)
    for _ in range(300):
        w = "".join(rng.choice("aabcdeéthin ") for _ in range(rng.randrange(1, 120))).encode()
        ids, cut = b.merge(w)
        assert (ids, cut) == b._merge_long(w)
        assert [cut[0], cut[-1]] == [0, len(w)] and [b.ids[w[x:y]] for x, y in zip(cut, cut[1:])] == ids
    monkeypatch.setattr(bpe, "CACHE", 2)
    assert b.decode(bpe.parse_ids(b.encode("one two three one two"))) == "one two three one two"


def _segments_brute(s):
    """Ruzzo and Tompa's maximal segments by their recursive definition: take the best segment, then go on left and right."""
    best = max(((sum(s[a:b]), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), key=lambda x: (round(x[0], 9), x[1] - x[2]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, a, b = best
    return _segments_brute(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in _segments_brute(s[b:])]


def test_segments():
    from txnwatch.llm.toxicity import segments
    rng = np.random.default_rng(7)
    for _ in range(150):
        s = np.round(rng.normal(-0.2, 1, int(rng.integers(0, 25))), 3) + rng.uniform(0, 1e-4)
        got = segments(s)
        assert [(a, b) for a, b, _ in got] == _segments_brute(s.tolist())
        assert all(abs(v - s[a:b].sum()) < 1e-9 for a, b, v in got)


def _toxic_rows():
    rng = random.Random(12)
    plain = [a + b for a in ["ka", "lo", "mi", "nu", "ter"] for b in ["ra", "si", "to", "ven", "dul", "pex"]]
    bad = ["vexhole", "grimstump", "dwerpish"]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if toxic := rng.random() < 0.25:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad).title())
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs):
    from txnwatch.llm import toxicity
    rows, labels = _toxic_rows()
    odd = [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "kara vexhole losi"), (2000, "kara " * 20_000 + "vexhole grimstump"), (2001, "dwerpishly kara")]
    truth = dict(labels)
    own = spark.createDataFrame([*[(i, y, "clash") for i, y in labels if i % 4], (None, 1, ""), (3, None, ""), (1, truth[1], "")], "doc_id long, toxic int, y string")
    table = docs(rows + odd, extra=True)
    model = toxicity.fit(table, own)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all((got[i].score >= 0.3) == bool(y) for i, y in truth.items() if i % 4 == 0)  # held out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[1000 + i].score < 0.3 and not got[1000 + i].passages for i in range(len(ODD)))
    assert got[None].score >= 0.3 and got[None].passages[0].first == 1
    assert got[2000].passages[0].first == 20_000 and got[2000].score >= 0.3
    again = {r.doc_id: r.score for r in toxicity.score(table, toxicity.fit(table, own)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_toxicity_keeps_all_forms(spark, docs):
    """Two toxic documents share 330,000 forms; none is left out of the model."""
    from txnwatch.llm import toxicity
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i // 17576 % 26] + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26] + "qzxy" for i in range(110_000)]
    table = docs([(1, " ".join(words)), (2, " ".join(reversed(words))), (3, "Ünïcödé 日本語")])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    assert len(model.tokens) == 3 * len(words) and (np.diff(model.tokens.astype(float)) >= 0).all()
    assert (model.scores > model.unknown).all()


def test_toxicity_without_labels(spark, docs):
    from txnwatch.llm import toxicity
    table = docs([(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(table, toxicity.fit(table, none)).collect()} == {0.5}
    assert toxicity.score(docs([]), toxicity.fit(docs([]), none)).count() == 0
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.3 for r in toxicity.score(table, toxicity.fit(table, one)).collect())


def test_language_grams_brute():
    import pyarrow as pa
    from txnwatch.llm.language_id import _counted, _grams
    texts = ["Ab, c!", "", "éa", "a1a", None, "zz zz"]
    code = lambda s: (0, ord(s[0]))[1] if len(s) == 1 else ((1 << 42 if len(s) == 2 else 0) | sum((0 if c == " " else ord(c)) << 21 * (len(s) - 1 - k) for k, c in enumerate(s)))
    want = []
    for t in texts:
        grams = []
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            p = f" {w} "
            grams += list(w) + [p[k:k + 2] for k in range(len(p) - 1)] + [p[k:k + 3] for k in range(len(p) - 2)]
        want.append({code(g): grams.count(g) for g in set(grams)})
    got = []
    for _, grams, bounds in _grams(pa.array(texts)):
        got += [dict(zip(*(x.tolist() for x in _counted(grams[a:b])))) for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == want


def test_language_id(spark, docs):
    from pyspark.sql import functions as F
    from txnwatch.llm import language_id
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    profiles = language_id.fit(table.filter(~held))
    assert profiles.languages == ["de", "en", "es", "fr"]
    rows = language_id.predict(table.filter(held), profiles, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    got = language_id.predict(docs(list(enumerate(ODD)), extra=True), profiles).collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")}
    none = language_id.fit(docs([]))
    assert [r.lang_pred for r in language_id.predict(docs([(1, "abc")]), none).collect()] == ["und"]


def test_licenses(spark, docs):
    from txnwatch.llm import licenses
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit(table)
    texts = [*ODD, "Some words.\nReleased under the MIT License.\nMore words.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU Lesser General Public License, version 3.",
             "We met under the old bridge and spoke of a license to fish.", "word " * 90 + "Licensed under the Apache License, Version 2.0. " + "word " * 90,
             "Released under the MIT License.\n" + "Released under the MIT License."]
    got = {r.doc_id: r for r in licenses.scan(docs(list(enumerate(texts)), extra=True), model).collect()}
    n = len(ODD)
    assert [got[i].licenses for i in range(n, len(texts))] == [["MIT"], ["CC-BY-NC-4.0"], ["LGPL-3.0"], [], ["Apache-2.0"], ["MIT"]]
    assert [x.paragraph for x in got[n].notices] == [1] and [x.paragraph for x in got[n + 5].notices] == [0, 1]
    assert all(not got[i].licenses and got[i].n_paragraphs == (0 if t is None else t.count("\n") + 1) for i, t in enumerate(ODD))
    empty = licenses.fit(docs([]))
    assert licenses.scan(docs([]), empty).count() == 0


def test_license_accuracy(spark, docs):
    """The scan on variants of the notices that the fit has not seen."""
    from txnwatch.llm import licenses
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit(table)
    lines = [r.text[:200] for r in table.orderBy("doc_id").limit(80).collect()]
    rows = [(c, t) for c, t in licenses.examples(lines, seed=99) if c != licenses.UNKNOWN]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs([(i, t) for i, (_, t) in enumerate(rows)]), model).collect()}
    right = sum(got[i] == [c] for i, (c, _) in enumerate(rows))
    assert right >= 0.9 * len(rows), [(c, t, got[i]) for i, (c, t) in enumerate(rows) if got[i] != [c]][::37]


def test_licenses_of_one_line_and_wrapped(spark, docs):
    from txnwatch.llm import licenses
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit(table)
    grant = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n"
             "# in the Software without restriction.")
    gpl = ("This program is free software; you can redistribute it\n * and/or modify it under the terms of the GNU General\n * Public License as published by the Free Software\n"
           " * Foundation; either version 2 of the License.")
    both = "This work is licensed under the GNU General Public License, version "
    texts = {"Released under the MIT License or Apache License 2.0, as you like.": ["Apache-2.0", "MIT"],
             "Licensed under the Apache License, Version 2.0 or the Mozilla Public License, Version 2.0.": ["Apache-2.0", "MPL-2.0"],
             "Some words. Released under the MIT License. " + "word " * 20 + "Licensed under CC BY-SA 4.0. " + "word " * 90 + "Licensed under the ISC License.": ["CC-BY-SA-4.0", "ISC", "MIT"],
             f"{both}2. {both}3.": ["GPL-2.0", "GPL-3.0"],
             f"# {grant}\n#\n# {gpl}": ["GPL-2.0", "MIT"],
             gpl: ["GPL-2.0"],
             "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
             "This project is licensed under\n\nthe terms of fishing.\n\nthe MIT license": [],
             "Released under the MIT License. Released under the MIT License.": ["MIT"]}
    got = {r.doc_id: r for r in licenses.scan(docs(list(enumerate(texts))), model).collect()}
    assert [got[i].licenses for i in range(len(texts))] == list(texts.values())
    assert [(x.paragraph, x.family) for x in got[4].notices] == [(0, "MIT"), (4, "GPL-2.0")]
    assert [len(got[i].notices) for i in (0, 3, 6, 8)] == [2, 2, 1, 2]


@pytest.fixture(scope="module")
def license_model(spark):
    from txnwatch.llm import licenses
    return licenses.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licenses_names_and_strangers(docs, license_model):
    """Short names are found; families and versions that the model has never seen are unknown."""
    from txnwatch.llm import licenses
    texts = {"SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "Apache License\nVersion 2.0, January 2004": "Apache-2.0", "GNU GPL v3 or later": "GPL-3.0",
             "available under MIT licence terms": "MIT", "SPDX-License-Identifier: MIT": "MIT", "The code is covered by the GNU Affero General Public License version 3.": "AGPL-3.0",
             "You may use it under GPL v2 or the MIT License": "GPL-2.0,MIT", "Dual licensed: LGPL v3 and MPL 2.0": "LGPL-3.0,MPL-2.0",
             "Licensed under the Eclipse Public License, Version 2.0.": "", "Licensed under the Mozilla Public License, Version 1.1.": "", "Mozilla Public License, Version 1.1": "",
             "This software is under the zlib License.": "", "Distributed under the Boost Software License, Version 1.0.": "", "Licensed under the Apache License, Version 1.1.": "",
             "Released under the Artistic License 2.0.": "", "This work is licensed under the GNU Free Documentation License, version 1.3.": "", "Licensed under CC BY-ND 4.0.": "",
             "Licensed under CC BY-NC-SA 4.0.": "", "SPDX-License-Identifier: EPL-2.0": "", "Released under the BSD 2-Clause License.": "",
             "He studied at MIT and held a driving license.": "", "The Apache helicopter flew twice.": "", "The talk was about the history of the MIT license and its wording.": ""}
    long = " ".join(["word"] * 40_000 + ["Released under the MIT License."] + ["term"] * 70_000 + ["Licensed under CC BY 4.0."])
    table = docs([*enumerate(texts), (100, long), (100, long), (None, "Released under the MIT License.")])
    got = [(r.doc_id, ",".join(r.licenses)) for r in licenses.scan(table, license_model).collect()]
    want = [*((i, x) for i, x in enumerate(texts.values())), (100, "CC-BY-4.0,MIT"), (100, "CC-BY-4.0,MIT"), (None, "MIT")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_license_precision_and_recall(docs, license_model):
    """Names in phrases that the fit hasn't seen, and as many strangers' names in them."""
    from txnwatch.llm import licenses
    phrases = ["You can use it under the {}.", "All files here are made available under the terms of the {}.", "Code: {}. It is distributed without warranty of any kind.",
               "Unless stated otherwise, everything is licensed as {}"]
    strangers = ["Eclipse Public License 2.0", "Zlib License", "Boost Software License 1.0", "Artistic License 2.0", "European Union Public Licence 1.2", "SIL Open Font License 1.1",
                 "Microsoft Public License", "Mozilla Public License 1.1", "Apache License 1.1", "GNU Free Documentation License 1.3", "Academic Free License 3.0", "Python License 2.0"]
    rows = [(family, p.format(name)) for family, name in licenses.names() if len(name.split()) > 1 for p in phrases]
    rows += [("", p.format(name)) for name in strangers for p in phrases]
    got = {r.doc_id: ",".join(r.licenses) for r in licenses.scan(docs([(i, t) for i, (_, t) in enumerate(rows)]), license_model).collect()}
    found = [(got[i], f) for i, (f, _) in enumerate(rows) if got[i]]
    assert sum(a == b for a, b in found) >= 0.97 * len(found)
    assert sum(got[i] == f for i, (f, _) in enumerate(rows) if f) >= 0.9 * sum(bool(f) for f, _ in rows)
    assert sum(bool(got[i]) for i, (f, _) in enumerate(rows) if not f) <= 2


@pytest.mark.parametrize("chunk", [1 << 15, 100])
def test_license_stretches_against_brute_force(monkeypatch, license_model, chunk):
    """Every stretch of every block, its probabilities summed n-gram by n-gram."""
    from txnwatch.llm import licenses
    monkeypatch.setattr(licenses, "CHUNK", chunk)
    blocks = ["one", "Released under the MIT License.", "word " * 90 + licenses.NOTICES["GPL-3.0"][0] + " term" * 33, " ".join(licenses.NOTICES["BSD-3-Clause"]) * 3, "to be or not to be", "x " * 200]
    hashes = [licenses._hashed(b) for b in blocks]
    end = np.cumsum([len(h) for h in hashes])
    begin = end - [len(h) for h in hashes]
    m = license_model
    weight = dict(zip(m.grams.tolist(), m.weights, strict=True))
    want = {}
    for k, h in enumerate(hashes):
        for length in licenses.LENGTHS:
            if length > licenses.LENGTHS[0] and len(h) <= length // 2:
                continue
            at = 0
            while True:
                own = h[at:at + length]
                known = [weight[g] for g in [*own.tolist(), *licenses.pairs_of(own).tolist()] if g in weight]
                z = (sum(known) / len(known) ** 0.5 + m.bias) / m.temperature if known else None
                if z is not None and (p := np.exp(z - z.max()) / np.exp(z - z.max()).sum())[0] < 0.5:
                    want[k, int(begin[k]) + at, int(begin[k]) + at + len(own)] = p
                if at + length >= len(h):
                    break
                at += length // 4
    got = {(k, a, b): p for ks, xs, ys, ps in m.stretches(np.concatenate(hashes), begin, end) for k, a, b, p in zip(ks.tolist(), xs.tolist(), ys.tolist(), ps, strict=True)}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)

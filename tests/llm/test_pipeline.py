"""Every stage of the pipeline against a brute-force version on what its predecessor kept."""

import hashlib

import pytest
from test_near_and_lines import _components, _dedup_lines, _shingles
from test_text_operators import _tokenizer, _windows, _words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest tables, with rows that are null, empty, repeated or made of benchmark passages."""
    sf, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    clean = docs.filter("doc_id = 3").first().text
    more = [(9001, None), (9002, ""), (9003, "..."), (9004, items[0]), (9005, f"{clean}\n{items[1]}\nlast words"), (9006, "idiot scum loser moron you worthless clown"), (9007, "a b c"), (9007, "a b c"), (None, "one more text without an id")]
    more = spark.createDataFrame([(i, t, None, "src", 0) for i, t in more], docs.schema)
    docs.union(more).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def steps(spark, corpus):
    """What each stage was given and what it kept."""
    import corpus_pipeline as P
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        given = docs.collect()
        stage(spark, docs, corpus).write.parquet(f"{corpus}/stage{k}")
        docs = spark.read.parquet(f"{corpus}/stage{k}")
        assert k == len(P.STAGES) - 1 or docs.columns == COLUMNS, name
        out.append((given, docs.collect()))
    return out


def _key(r):
    return tuple(str(x) for x in r)


def test_stage_names():
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_toxicity_stage(spark, corpus, steps):
    given, kept = steps[0]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept}
    assert sorted(map(_key, kept)) == sorted(_key(r) for r in given if r.doc_id in ids)
    clean = [r.doc_id for r in given if truth.get(r.doc_id) == 0]
    assert len([i for i in clean if i in ids]) >= 0.97 * len(clean)
    assert {9001, 9002, 9003, 9007, None} <= ids


def test_line_stage(steps):
    given, kept = steps[1]
    want = _dedup_lines([(r.doc_id, r.text) for r in given])
    rows = []
    for r in given:
        if r.text is None:
            rows.append((*r[:4], None))
            continue
        n, gone, text = want[r.doc_id, r.text]
        if len(gone) < n:
            rows.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert sorted(map(_key, kept)) == sorted(map(_key, rows)) and len(rows) < len(given)


def test_near_stage(steps):
    given, kept = steps[2]
    sets = [_shingles(r.text, 5) for r in given]
    order = sorted(range(len(given)), key=lambda i: (given[i].doc_id is not None, given[i].doc_id or 0))
    place = {i: n for n, i in enumerate(order)}
    links = [(place[a], place[b]) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _components(len(given), links)
    want = [given[order[n]] for n, root in enumerate(roots) if root == n]
    assert sorted(map(_key, kept)) == sorted(map(_key, want)) and len(want) < len(given)


def test_benchmark_stage(spark, corpus, steps):
    given, kept = steps[3]
    win = _windows([(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()], 10)
    lengths, found = {len(w) for w in win}, {r.doc_id: r for r in kept}
    changed = 0
    for r in given:
        w = _words(r.text)
        hit = {k for n in lengths for j in range(len(w) - n + 1) if tuple(w[j:j + n]) in win for k in range(j, j + n)}
        if hit and len(hit) == len(w):
            assert r.doc_id not in found
        elif not hit:
            assert found[r.doc_id].text == r.text
        else:
            changed += 1
            assert _words(found[r.doc_id].text) == [x for k, x in enumerate(w) if k not in hit]
            assert found[r.doc_id].n_chars == len(found[r.doc_id].text)
    assert changed and 9004 not in found


def test_token_stage_and_run(spark, corpus, steps):
    import corpus_pipeline as P
    given, kept = steps[4]
    _, lib = _tokenizer()
    texts = {r.doc_id: r.text or "" for r in given}
    assert len(kept) == len(given)
    for r in kept:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.token_ids) == (len(ids), ids) and r.round_trip
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(map(_key, P.run(spark, corpus).collect())) == sorted(map(_key, kept))
    assert P.ORACLE_SQL is None

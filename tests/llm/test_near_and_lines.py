"""MinHash, line dedup, components and embeddings against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_docs import docs  # noqa: F401

ODD = [None, "", " \n\t ", "...!?", "a", "Ünïcödé ÀÉ 日本語 ½ ٣", "\x00\x01 x\x7f", "\n\n\n\n", "<|endoftext|>", "http://x.y/z"]

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _shingles(text, k):
    w = WORDS.findall(_lower(text or ""))
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _near_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(rng.choice([2, 5, 60, 200]))]
        for _ in range(rng.choice([1, 3, 8])):
            copy = [w if rng.random() > 0.02 else word() for w in base]
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * rng.choice([1, 4])
    long = [word() for _ in range(30_000)]
    texts += [" ".join(long), " ".join(long[:-20])]
    return texts


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, k, num):
    from txnwatch.llm.minhash import near_duplicates
    texts = _near_rows()
    sets = [_shingles(t, k) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = _components(len(texts), links)
    got = {r.doc_id: r for r in near_duplicates(docs(list(enumerate(texts)), extra=True), shingle=k, num=num).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), (i, t)


def test_near_duplicates_small_tiles(spark, docs, monkeypatch):
    """Groups near the threshold, larger than a tile: the second round finds every component."""
    from txnwatch.llm import minhash
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [_shingles(t, 3) for t in texts]
    links = [(a, b) for b in range(70) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(70, links)
    assert 1 < len(set(want)) < 70
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(list(enumerate(texts))), shingle=3, num=85).collect()}
    assert [got[i] for i in range(70)] == want


def test_near_duplicates_null_and_repeated_ids(spark, docs):
    from txnwatch.llm.minhash import near_duplicates
    t = "one two three four five six seven"
    got = near_duplicates(docs([(None, t), (5, t), (5, t), (None, "alone in here at last"), (7, "another text of some words"), (7, "a third text of other words")]), shingle=3, num=85).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (7, 7, True), (7, 7, True)])


def test_near_duplicates_empty(spark, docs):
    from txnwatch.llm.minhash import near_duplicates
    assert near_duplicates(docs([])).count() == 0


def test_components(spark):
    from txnwatch.llm.components import connected_components
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 401 + i) for i in range(90)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long"), "a", "b").collect()}
    want = _components(600, links)
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def _dedup_lines(rows):
    """Brute force: rows (id, text) in order of ids, null first; equal rows are one document."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = "\n".join(lines[p:p + 3])
            if not re.search(r"\S", w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i, t] = (len(lines), sorted(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t)
    return out


def test_line_dedup(spark, docs):
    from txnwatch.llm.line_dedup import dedup_lines
    rng = random.Random(3)
    pool = ["alpha", "beta", "gamma", "", "delta line of words", " "]
    rows = list(enumerate(ODD)) + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(300, "same\n" * 40), (301, "x\ny\nz"), (302, "x\ny\nz"), (302, "x\ny\nz"), (None, "x\ny\nz\nq"), (303, "\n".join(f"l{i % 700}" for i in range(3000)))]
    want = _dedup_lines(rows)
    got = dedup_lines(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, text = want[r.doc_id, r.text] if r.text is not None else (0, [], None)
        assert (r.n_lines, list(r.removed), r.clean_text) == (n, gone, text), r.doc_id
        assert r.host == "clash"
    assert dedup_lines(docs([])).count() == 0


def test_embeddings(spark):
    from txnwatch.llm.embedding_dedup import near_vectors
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 24)) * 0.2, base[:20] + rng.normal(size=(20, 24)) * 0.33, base[:3], base[:2] * 7]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.5] * 22, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = unit @ unit.T
    links = [(a, b) for b in range(len(x)) for a in range(b) if cos[a, b] >= 0.95]
    want = _components(len(x), links)
    degree = Counter(i for pair in links for i in pair)
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    for tile in (4096, 16):
        got = {r.vec_id: r for r in near_vectors(df, tile=tile).collect()}
        assert len(got) == len(rows) and max(degree.values()) > 1
        for i in range(len(x)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], want[i], want[i] == i), i
        for i in range(1000, 1006):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert (got[1006].n_links, got[1007].component_id) == (1, 1006)
    assert near_vectors(df.limit(0)).count() == 0


def test_quantisation_bounds():
    from txnwatch.llm.embedding_dedup import quantise
    x = np.random.default_rng(0).normal(size=(300, 48))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, scale, kept, lost = quantise(x)
    near = (q.astype(float) @ q.T) * scale[:, None] * scale[None, :]
    bound = kept[:, None] * lost[None, :] + lost[:, None] * kept[None, :] + lost[:, None] * lost[None, :]
    assert (np.abs(near - unit @ unit.T) <= bound + 1e-12).all()


def test_embeddings_of_any_length(spark):
    """Lengths beyond the doubles' squares, and ids that are null or repeated."""
    from txnwatch.llm.embedding_dedup import near_vectors
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-160, 1e-160]), (4, [5e-324, 0.0]), (5, [1.7e308, 0.0]), (6, [0.0, 0.0]),
            (None, [2.0, 2.0]), (2, [-3.0, -3.0]), (7, [-1e-300, -1e-300])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got) == [
        (False, 1, 3, 1), (False, 2, 1, 2), (False, 2, 3, 1), (False, 3, 3, 1), (False, 4, 1, 4), (False, 5, 1, 4), (False, 6, 0, 6), (False, 7, 1, 2), (True, 0, 3, 1)]


@pytest.mark.parametrize("tile", [4096, 40])
def test_pairs_between_the_bounds(spark, tile):
    """Many pairs close to the threshold on both sides, which only the second pass can tell."""
    from txnwatch.llm.embedding_dedup import near_vectors
    rng = np.random.default_rng(12)
    base = rng.normal(size=16)
    x = [base / np.linalg.norm(base) + 0.057 * rng.normal(size=16) for _ in range(150)]
    u = np.array([v / np.linalg.norm(v) for v in x])
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert 0.2 < want.mean() / 149 < 0.8 and np.abs(u @ u.T - 0.95).min() > 1e-9
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), tile=tile).collect()}
    assert [got[i] for i in range(150)] == want.tolist()

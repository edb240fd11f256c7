"""Hard negatives, the quality classifier and importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_docs import docs  # noqa: F401
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, score string, row string"


# --- hard negatives -------------------------------------------------------------------------------------

@pytest.mark.parametrize("d,size", [(3, 50), (64, 300), (200, 1 << 20), (70, 1 << 24)])
def test_scores_are_exact(d, size):
    from txnwatch.llm.hard_negatives import DEPTH, primes, residues, scores
    rng = np.random.default_rng(d)
    a, b = (rng.integers(-size, size + 1, (n, d)) for n in (17, 23))
    bound = math.isqrt(int((a * a).sum(axis=1).max()) * int((b * b).sum(axis=1).max())) + 1
    assert (scores(a, b, bound) == a @ b.T).all()
    used = primes(bound)
    assert len(used) > 1 and math.prod(used) > 2 * bound + 1
    for p in used:
        assert all(p % q for q in range(2, p)) and DEPTH * (p // 2) ** 2 < 1 << 24
        r = residues(a, p)
        assert np.abs(r).max() <= p // 2 and ((a - r) % p == 0).all()


def _brute_negatives(rows, is_anchor, positives=5, negatives=10):
    ok = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (i, v, label) in enumerate(ok):
        if not is_anchor(i):
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), last(j), n) for n, (j, w, _) in enumerate(ok) if n != k and len(w) == len(v)))
        for s, _, n in [r for r in ranked if ok[r[2]][2] == label][:positives]:
            found = [r for r in ranked if ok[r[2]][2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(i, ok[n][0], m + 1, ok[r[2]][0], -s, -r[0]) for m, r in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("anchors,rows_per_tile", [(4096, 1024), (3, 7)])
def test_hard_negatives(spark, monkeypatch, anchors, rows_per_tile):
    from txnwatch.llm import hard_negatives as H
    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "ROWS", rows_per_tile)
    monkeypatch.setattr(H, "STRIP", 2)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 3] + 0.8 * rng.normal(size=6)).tolist(), int(i % 3)) for i in range(120)]
    rows += [(200 + i, rows[0][1], i % 2) for i in range(40)]  # copies, under both labels
    rows += [(10, rows[10][1], 1), (10, rows[11][1], 2), (None, rows[20][1], 2), (None, rows[21][1], 0)]  # repeated and null ids
    rows += [(300, None, 1), (310, [1.0, None, 0.0], 1), (320, [1.0, math.nan, 0.0], 1), (330, [1.0, math.inf, 0.0], 1), (340, rows[0][1], None),
             (350, [0.0] * 6, 0), (360, [], 1), (361, [], 2), (370, [1.0, 2.0], 1), (371, [1.0, 1.0], 1), (372, [0.9, 0.4], 2), (380, [3.4e38] * 6, 1)]
    df = spark.createDataFrame([(i, v, y, "clash", "clash") for i, v, y in rows], VECTORS).repartition(5)
    got = H.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _brute_negatives([r for r in rows if r[0] != 380], lambda i: i is not None and i % 10 == 0)
    # Which of several rows of one id is meant doesn't show in a result, so rows compare as a bag.
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len(want) > 300


def test_hard_negatives_empty(spark):
    from txnwatch.llm.hard_negatives import hard_negatives
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []
    some = spark.createDataFrame([(1, [1.0], 0, "", ""), (2, [1.0], 1, "", "")], VECTORS)
    assert hard_negatives(some, F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives(some, F.lit(True)).collect() == []  # no other row of the same label


# --- quality --------------------------------------------------------------------------------------------

def _good(rng, n=60):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(words))


def _bad(rng, n=60):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join([rng.choice(["Aba", "Ced"])] * n)
    if kind == 1:
        return _good(rng, n).upper().replace(" ", "!! ")
    return " | ".join("".join(rng.choice("abcd") for _ in range(5)) + "$$$" for _ in range(n))


def test_pooled_is_isotonic_least_squares():
    from txnwatch.llm.quality import pooled
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        y, w = rng.integers(0, 4, n).astype(float), rng.integers(1, 5, n).astype(float)
        # The fit is the largest over starts of the least over ends of the weighted means around each place.
        mean = lambda a, b: float((y[a:b + 1] * w[a:b + 1]).sum() / w[a:b + 1].sum())
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        got = [v for a, b, v in pooled(y, w) for _ in range(a, b + 1)]
        assert np.allclose(got, want)


def test_statistics_don_t_depend_on_neighbours():
    import pyarrow as pa
    from txnwatch.llm.quality import STATISTICS, statistics
    rng = random.Random(1)
    texts = [None, "", " ", "a", "A!! B!! C!!", "é É ü Ü", "x\nx\nx\n", "ab " * 40_000, *(_good(rng) for _ in range(20)), *(_bad(rng) for _ in range(20))]
    together = statistics(pa.array(texts, pa.string()))
    assert together.shape == (len(texts), len(STATISTICS)) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(together[i], statistics(pa.array([t], pa.string()))[0])
    x = dict(zip(STATISTICS, statistics(pa.array(["Ab cd. Ab\nÉ 12!!"]))[0], strict=True))
    assert x["words"] == pytest.approx(math.log1p(5)) and x["distinct_words"] == pytest.approx(4 / 5) and x["top_word"] == pytest.approx(2 / 5)
    assert x["digits"] == pytest.approx(2 / 17) and x["marks"] == pytest.approx(3 / 17) and x["capitals"] == pytest.approx(3 / 8) and x["lines"] == pytest.approx(math.log1p(2))
    assert x["wordless"] == pytest.approx(1 / 5) and x["doubled_marks"] == pytest.approx(1 / 5) and x["sentence_ends"] == pytest.approx(2 / 5)


def test_quality_fit_is_ridge_on_all_rows(spark, docs):  # noqa: F811
    from txnwatch.llm import quality as Q
    rng = random.Random(2)
    rows = [(i, _good(rng) if i % 3 else _bad(rng)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    x = Q.measured(docs(rows, extra=True).repartition(7), "text", ("doc_id",)).cache()
    model = Q.fit(x, labels)
    own = np.array([r["__x"] for r in x.orderBy("doc_id").collect()])
    y = np.array([float(i % 3 > 0) for i in range(600)])
    assert np.allclose(model["mean"], own.mean(axis=0))
    z = Q.fourier(own, own.mean(axis=0), np.where(own.std(axis=0) > 1e-9 * (1 + np.abs(own.mean(axis=0))), own.std(axis=0), 1.0), *Q.directions())
    ridge = model["penalty"] * len(y) * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    assert np.allclose(z @ beta, z @ model["beta"], atol=1e-5)
    fresh = [(i, _good(rng) if i % 2 else _bad(rng)) for i in range(200)]
    got = {r.doc_id: r.score for r in Q.score(Q.measured(docs(fresh), "text", ("doc_id",)), model).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i, _ in fresh) >= 196


def test_quality_special_cases(spark, docs):  # noqa: F811
    from txnwatch.llm import quality as Q
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, _good(rng, 30_000)), (3, _good(rng)), (None, _bad(rng)), (4, "\x00"), *((10 + i, _good(rng)) for i in range(30)), *((50 + i, _bad(rng)) for i in range(30))]
    labels = lambda pairs: spark.createDataFrame(pairs, "doc_id long, quality int")
    both = [(i, 1) for i in range(10, 40)] + [(i, 0) for i in range(50, 80)] + [(3, 1), (3, 1), (3, 0), (None, 1)]
    got = Q.classify(docs(rows, extra=True), labels(both)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _ in rows)))
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.classify(docs(rows), labels([])).collect()} == {0.5}
    assert {r.score for r in Q.classify(docs(rows), labels([(i, 1) for i in range(10, 40)])).collect()} == {1.0}
    assert Q.classify(docs([]), labels(both)).collect() == []


def test_quality_held_out(spark):
    from txnwatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got) > 50


# --- importance resampling --------------------------------------------------------------------------------

def _features(text, ngram):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def _brute_resample(rows, target, ngram, buckets, least, percent):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    own = [(_features(x, ngram)) for _, x in rows]
    for _, fs in own:
        s.update(map(code, fs))
    for _, x in target:
        t.update(map(code, _features(x, ngram)[1]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    out = []
    for (i, _), (n, fs) in zip(rows, own, strict=True):
        weight = sum(gain[code(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = len(may) * percent // 100
    place = {id(r): k + 1 for k, r in enumerate(may[:drawn])}
    return sorted((tuple([*r, place.get(id(r))]) for r in out), key=repr)


@pytest.mark.parametrize("ngram,piece", [(1, 4000), (2, 30), (3, 8)])
def test_importance(spark, docs, monkeypatch, ngram, piece):  # noqa: F811
    from txnwatch.llm import importance as I
    monkeypatch.setattr(I, "PIECE", piece)
    monkeypatch.setattr(I.pieces, "__defaults__", (piece,))
    rng = random.Random(ngram)
    word = lambda: rng.choice(["The", "of", "ÉTÉ", "x1", "日本", "a", "zz"]) + rng.choice(["", "", "q", "Ä"])
    rows = [(i, rng.choice([" ", ", ", "\n", "\x00", "--"]).join(word() for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "!? ..."), (203, "w" * 50_000), (204, " ".join(word() for _ in range(20_000))), (None, rows[3][1]), (None, rows[5][1] + " more"),
             (7, rows[8][1]), (7, rows[9][1]), (7, rows[9][1])]
    target = [(1, "the of the of x1 ÉTÉ"), (2, None), (3, ""), (None, "zzq zzq zzq a"), (3, "a a a")]
    items = spark.createDataFrame([(i, x, "clash") for i, x in target], "item_id long, text string, bucket string")
    got = I.importance_resample(docs(rows, extra=True).repartition(6), items, ngram=ngram, buckets=97, least_words=15, percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == _brute_resample(rows, target, ngram, 97, 15, 30)


def test_importance_empty(spark, docs):  # noqa: F811
    from txnwatch.llm.importance import importance_resample
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert importance_resample(docs([]), items).collect() == []
    few = [(1, "one two"), (2, None)]
    assert [(r.n_features, r["rank"]) for r in importance_resample(docs(few), items.limit(0)).orderBy("doc_id").collect()] == [(2, None), (0, None)]
    same = [(5, "one two three four")] * 30
    assert sorted(r["rank"] for r in importance_resample(docs(same), items, least_words=2, percent=50).collect() if r["rank"]) == list(range(1, 16))


def test_pieces_cut_no_word():
    from txnwatch.llm.importance import pieces, windows
    text = "ab cde f" * 300 + "x" * 5000 + " y z"
    for limit in (1, 3, 10, 4000, 10**6):
        parts = list(pieces(text, limit))
        assert "".join(parts) == text
    assert windows(text, 1) == (_features(text, 1)[0], _features(text, 1)[1])

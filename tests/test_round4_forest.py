"""Findings of the fourth round on the forest: beyond the library's rows it grows from histograms in one stage."""

import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from txnwatch.operators import forest as FO
from txnwatch.operators import models as MD


def test_draws_are_poisson():
    share = np.bincount(FO.DRAWS, minlength=9) / len(FO.DRAWS)
    assert abs((share * np.arange(9)).sum() - 1) < 1e-3 and abs(share[0] - np.exp(-1)) < 1e-4 and abs(share[4] - np.exp(-1) / 24) < 1e-4


def test_splits_equal_brute_force():
    rng = np.random.default_rng(3)
    x, y, node = rng.integers(0, 6, (400, 5)).astype(np.uint8), rng.integers(0, 2, 400).astype(np.uint8), rng.integers(0, 3, 400).astype(np.int32)
    y[x[:, 2] > 3] = 1
    rows, weight = np.arange(0, 400, 2, dtype=np.int32), rng.integers(1, 4, 200).astype(np.uint8)
    drawn = np.array([[0, 2, 4], [1, 2, 3], [0, 1, 4]])
    hist = FO.node_counts(x * 2, y, rows, weight, node[rows], drawn)
    feature, cut, gain, left, right = FO.best_splits(hist, drawn)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    for k in range(3):
        own = rows[node[rows] == k]
        w = weight[node[rows] == k]
        best = 0
        for f in drawn[k]:
            for b in range(5):
                to_left = x[own, f] <= b
                a, c = (np.bincount(y[own][s], w[s], 2) for s in (to_left, ~to_left))
                if min(a.sum(), c.sum()) >= FO.LEAST_ROWS:
                    t = a + c
                    best = max(best, gini(t) - a.sum() / t.sum() * gini(a) - c.sum() / t.sum() * gini(c))
        to_left = x[own, feature[k]] <= cut[k]
        assert gain[k] == pytest.approx(best) and best > 0
        assert left[k].tolist() == np.bincount(y[own][to_left], w[to_left], 2).tolist() and right[k].tolist() == np.bincount(y[own][~to_left], w[~to_left], 2).tolist()


def test_tasks_grow_the_same_trees(tmp_path):
    """Three tasks see the same trees, whose leaves hold all drawn rows of all tasks; no file is left but the last splits."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (900, 4)).astype(np.uint8)
    y = (x[:, 0] + x[:, 1] > 22).astype(np.uint8)

    def task(part):
        owners = FO._Owners(str(tmp_path), part, 3)
        return [t for numbers in ((0, 1, 2), (3, 4)) for t in FO.grow(x[part::3], y[part::3], numbers, 4, 9, part, owners)]

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(task, range(3)))
    for k, tree in enumerate(found[0]):
        assert all(np.array_equal(getattr(tree, a), getattr(other[k], a)) for other in found for a in ("feature", "cut", "left", "counts"))
        drawn = [np.bincount(y[p::3], FO.DRAWS[np.random.default_rng([9, k, p]).integers(0, 65_536, 300, np.uint16)], 2) for p in range(3)]
        assert tree.counts[0].tolist() == sum(drawn).tolist() and tree.counts[tree.feature < 0].sum(axis=0).tolist() == tree.counts[0].tolist()
        assert len(tree.feature) > 5
    assert len(os.listdir(tmp_path)) <= 3
    (feature, _, left, share), gains = found[0][0].finish(4)
    inner = feature >= 0
    assert gains.sum() == pytest.approx(1) and gains[:2].sum() > 0.8 and sorted([*left[inner], *(left[inner] + 1)]) == list(range(1, len(feature)))
    one_class = [i for i in np.flatnonzero(inner) if not inner[left[i]] and not inner[left[i] + 1]]
    assert all((share[left[i]] > 0.5) != (share[left[i] + 1] > 0.5) for i in one_class)  # joined otherwise, as the library does


def test_a_grown_forest_is_as_good_as_the_library(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 6)).round(2)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(0, 0.5, 6000) > 0).astype(int)
    cols = [f"x{k}" for k in range(6)]
    df = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))], ["i", *cols, "isFraud"]).repartition(3)
    df = df.withColumn("x5", df.x5 + MD.F.when(df.i % 50 == 0, None).otherwise(0.0)).cache()
    fit, hold = df.filter("i < 4500"), df.filter("i >= 4500")
    monkeypatch.setitem(MD.PROFILES, "few", {"rf": dict(numTrees=30, maxDepth=8)})
    library = MD.fit_forest(fit, cols, 3, "few")
    assert isinstance(library, MD.Forest)
    with monkeypatch.context() as m:
        m.setattr(MD, "FOREST_LIBRARY_ROWS", 1000)
        m.setattr(MD, "build_estimator", None)
        grown, again = (MD.fit_forest(fit, cols, 3, "few") for _ in range(2))
    assert len(grown.trees) == 30 and all(np.array_equal(a, b) for s, t in zip(grown.trees, again.trees) for a, b in zip(s, t))

    def auc(forest):
        own = sorted((r.score, r.isFraud) for r in forest.transform(hold).collect())
        rank = np.flatnonzero([b for _, b in own])
        return (rank.sum() - len(rank) * (len(rank) - 1) / 2) / (len(rank) * (len(own) - len(rank)))

    assert auc(grown) > auc(library) - 0.01 > 0.8
    assert np.abs(grown.importances - library.importances).max() < 0.08
    left = [f for f in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if f.startswith("boosting-")]
    assert not left


def test_no_stage_and_one_class(spark, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_LIBRARY_ROWS", 10)
    df = spark.createDataFrame([(float(k % 9), None if k % 4 else 1.0, int(k % 9 > 4)) for k in range(300)], "a double, b double, isFraud int")
    same = MD.fit_forest(df.withColumn("isFraud", df.isFraud * 0 + 1), ["a", "b"], 3, "tiny")
    assert {r.score for r in same.transform(df).collect()} == {1.0}
    monkeypatch.setattr(FO, "barrier_slots", lambda sc: 0)
    assert isinstance(MD.fit_forest(df, ["a", "b"], 3, "tiny"), MD.Forest)

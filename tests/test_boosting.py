"""Histogram trees against brute force, their growth rules, and their accuracy."""

import heapq

import numpy as np
import pytest

from conftest import SF_MID
from txnwatch.operators import boosting as B
from txnwatch.operators import evaluate as EV
from txnwatch.operators import features as FE
from txnwatch.sources.fixtures import txn


def _frame(spark, x, y, parts=3):
    rows = [(*map(float, r), int(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, [*(f"x{k}" for k in range(x.shape[1])), "isFraud"]).repartition(parts)


def _leaf(g, h, p):
    return -p.rate * np.sign(g) * max(abs(g) - p.l1, 0) / (h + p.l2)


def _score(g, h, p):
    return max(abs(g) - p.l1, 0) ** 2 / (h + p.l2)


def _best(x, g, h, rows, p):
    """(gain, feature, threshold) of the best split of some rows, over all values as thresholds."""
    best = (0.0, -1, 0.0)
    for k in range(x.shape[1]):
        for t in np.unique(x[rows, k])[:-1]:
            left, right = rows[x[rows, k] <= t], rows[x[rows, k] > t]
            if min(len(left), len(right)) < p.least_rows or min(h[left].sum(), h[right].sum()) < p.least_hessian:
                continue
            gain = sum(_score(g[s].sum(), h[s].sum(), p) for s in (left, right)) - _score(g[rows].sum(), h[rows].sum(), p) - p.least_gain
            if gain > best[0] + 1e-9:
                best = (gain, k, t)
    return best


def _brute_predict(x, y, p):
    """Raw scores after growing best-first trees one leaf at a time."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        leaves, heap, order = {0: (np.arange(len(y)), 0)}, [], 0
        push = lambda i: heapq.heappush(heap, (-b[0], i, b)) if (b := _best(x, g, h, leaves[i][0], p))[1] >= 0 and leaves[i][1] < p.depth else None
        push(0)
        while heap and (not p.leaves or len(leaves) < p.leaves):
            _, i, (_, k, t) = heapq.heappop(heap)
            rows, d = leaves.pop(i)
            for own in (rows[x[rows, k] <= t], rows[x[rows, k] > t]):
                order += 1
                leaves[order] = (own, d + 1)
                push(order)
        for rows, _ in leaves.values():
            raw[rows] += _leaf(g[rows].sum(), h[rows].sum(), p)
    return raw


@pytest.mark.parametrize("block_rows", [1 << 17, 50])
@pytest.mark.parametrize("growth,leaves,l1,gain", [("level", 0, 0.0, 0.0), ("leaf", 5, 0.0, 0.0), ("level", 0, 0.5, 0.3)])
def test_trees_equal_brute_force(spark, growth, leaves, l1, gain, block_rows):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (160, 3)).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 5) + rng.normal(0, 2, 160) > 8).astype(float)
    p = B.Boosting(rounds=3, rate=0.3, depth=3, growth=growth, leaves=leaves, least_rows=4, l1=l1, l2=1.0, least_gain=gain, bins=64)
    df = _frame(spark, x, y)
    (model,) = B.fit_boosters({0: (df, None, ["x0", "x1", "x2"])}, [(0, p, 1)], block_rows=block_rows)
    got = model.base + B.sum_trees(B.binned(x, model.edges), *model.parts()[2:])
    assert np.allclose(got, _brute_predict(x, y, p), atol=1e-5)
    scored = model.transform(df).collect()
    want = dict(zip(map(tuple, x), B.sigmoid(got)))
    assert all(abs(r.score - want[r.x0, r.x1, r.x2]) < 1e-6 for r in scored)
    if leaves:
        assert max((f >= 0).sum() + 1 for f in model.feature) <= leaves


def test_symmetric_trees_share_a_split_per_level(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (300, 2)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 3)).astype(float)
    (model,) = B.fit_boosters({0: (_frame(spark, x, y), None, ["x0", "x1"])}, [(0, B.Boosting(12, 0.5, 3, "symmetric", l2=3.0), 1)])
    for f, c in zip(model.feature, model.bin):
        for level in range(3):
            own = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            assert len({(a, b) for a, b in zip(f[own], c[own]) if a >= 0}) <= 1
    raw = model.base + B.sum_trees(B.binned(x, model.edges), *model.parts()[2:])
    assert ((raw > 0) == (y > 0)).mean() > 0.95


def test_many_boosters_grow_as_if_alone(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)).round(1)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 1, 400) > 0).astype(float)
    df, val = _frame(spark, x[:300], y[:300]), _frame(spark, x[300:], y[300:])
    cols = ["x0", "x1", "x2", "x3"]
    params = [B.Boosting(15, 0.3, 3, "leaf", 6, least_rows=5, patience=3), B.Boosting(9, 0.2, 2, "level", rows=0.7, columns=0.5)]
    # the groups have 400 and 250 rows: shared steps, tasks of their own, and one of each
    asks = [(1, params[0], 5), (1, params[1], 6), (2, params[0], 7)]
    frames = {1: (df, val, cols), 2: (df.filter("x0 > -1"), None, cols[:3])}
    together = B.fit_boosters(frames, asks, block_rows=100)
    for block_rows in (300, 10_000):
        for a, b in zip(together, B.fit_boosters(frames, asks, block_rows=block_rows)):
            assert len(a.value) == len(b.value) and all(np.allclose(v, w) for v, w in zip(a.value, b.value)) and np.allclose(a.losses, b.losses)
    alone = [B.fit_boosters({g: frames[g]}, [(g, p, seed)], block_rows=100)[0] for g, p, seed in asks]
    for a, b in zip(together, alone):
        assert len(a.value) == len(b.value) > 0
        assert all(np.allclose(v, w) for v, w in zip(a.value, b.value))
    # the model ends with the round of the least validation loss
    assert len(together[0].value) == int(np.argmin(together[0].losses)) + 1
    assert len(together[0].losses) - len(together[0].value) <= 3 and len(together[2].value) == 15


def test_special_cases(spark):
    schema = "x0 double, x1 double, isFraud int"
    p = B.Boosting(3, 0.3, 2)
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1.0, 2.0, 0), (2.0, None, 0), (1.0, 1.0, None)], schema)
    some = spark.createDataFrame([(None, 2.0, 0), (float("nan"), 1.0, 1), (3.0, 1.0, 1), (3.0, 2.0, 0)] * 5, schema)
    for df in (none, one, some):
        (model,) = B.fit_boosters({0: (df, df, ["x0", "x1"])}, [(0, p, 1)])
        out = model.transform(some).collect()
        assert len(out) == 20 and all(0 <= r.score <= 1 for r in out)
    assert len({round(r.score, 6) for r in out if r.isFraud}) == 1 and min(r.score for r in out if r.isFraud) > max(r.score for r in out if not r.isFraud)


def test_as_accurate_as_the_library_trees(spark):
    from pyspark.ml.classification import GBTClassifier
    from txnwatch.operators import models as MD
    df = FE.engineer_velocity(FE.extract_time_features(txn(spark, SF_MID, with_v=False))).cache()
    cols = ["TransactionAmt", "C1", "C13", "C14", "D1", "D15", "hour", "Card_Velocity_7d", "Card_Amt_Std_7d"]
    fit, hold = df.filter("TransactionID % 4 != 0"), df.filter("TransactionID % 4 = 0")
    auc = lambda s: EV.roc_auc(EV.threshold_curve(s, "score")).first()["roc_auc"]
    lib = GBTClassifier(featuresCol="features", labelCol="isFraud", maxIter=30, stepSize=0.1, maxDepth=4, seed=1).fit(MD.assemble(fit, cols))
    want = auc(MD.score_with(lib, MD.assemble(hold, cols)))
    own = B.fit_boosters({0: (fit, hold, cols)}, [(0, B.Boosting(30, 0.1, 4, l2=1.0), 1), (0, B.Boosting(30, 0.1, 5, "leaf", 16, 20), 1), (0, B.Boosting(30, 0.1, 4, "symmetric", l2=3.0), 1)])
    for m in own:
        assert auc(m.transform(hold)) > want - 0.01
        assert abs(m.importances.sum() - 1) < 1e-9 and m.importances.argmax() == 0

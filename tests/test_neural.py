"""Gradients against finite differences, training against a plain loop, learning."""

import numpy as np
import pytest

from txnwatch.operators import neural as NN


def _loss(shape, w, x, y):
    return NN.focal(shape.forward(w, x)[0], y)[0].sum()


@pytest.mark.parametrize("shape", [NN.FeedForward(4, (7, 5), (0.0, 0.0)), NN.Lstm(3, steps=4, units=5, layers=2, head=4, drop=0.0)])
def test_gradients(shape):
    rng = np.random.default_rng(1)
    w = [a + 0.05 * rng.normal(size=a.shape) for a in shape.start(rng)]
    x, y = rng.normal(size=(6, shape.inputs * getattr(shape, "steps", 1))), rng.integers(0, 2, 6).astype(float)
    z, memory = shape.forward(w, x)
    grads = shape.backward(w, memory, NN.focal(z, y)[1])
    assert [g.shape for g in grads] == [a.shape for a in w]
    for k, a in enumerate(w):
        for i in np.ndindex(*a.shape):
            old, e = a[i], 1e-5
            a[i] = old + e
            up = _loss(shape, w, x, y)
            a[i] = old - e
            down = _loss(shape, w, x, y)
            a[i] = old
            assert grads[k][i] == pytest.approx((up - down) / (2 * e), abs=1e-6, rel=1e-4)


def test_gradients_with_dropout():
    """What drops out in the forward pass drops out of the gradient: same seed, same masks."""
    for shape in (NN.FeedForward(4, (9, 6), (0.5, 0.5)), NN.Lstm(2, steps=3, units=4, layers=2, head=5, drop=0.5)):
        rng = np.random.default_rng(2)
        w = shape.start(rng)
        x, y = rng.normal(size=(5, shape.inputs * getattr(shape, "steps", 1))), np.array([0, 1, 1, 0, 1.0])
        z, memory = shape.forward(w, x, np.random.default_rng(9))
        grads = shape.backward(w, memory, NN.focal(z, y)[1])
        a = w[0]
        for i in np.ndindex(*a.shape):
            old, e = a[i], 1e-5
            a[i] = old + e
            up = NN.focal(shape.forward(w, x, np.random.default_rng(9))[0], y)[0].sum()
            a[i] = old - e
            down = NN.focal(shape.forward(w, x, np.random.default_rng(9))[0], y)[0].sum()
            a[i] = old
            assert grads[0][i] == pytest.approx((up - down) / (2 * e), abs=1e-6, rel=1e-4)


def test_focal_loss_is_mod7(spark):
    from txnwatch.operators import models as MD
    z, y = np.array([-2.0, 0.3, 1.7, -0.4]), np.array([0.0, 1, 0, 1])
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(z, y)], "fraud_score double, isFraud int")
    assert NN.focal(z, y)[0].mean() == pytest.approx(MD.focal_loss(df).first()[0])


def test_one_step_equals_a_plain_one(spark):
    """One epoch of one step over all rows, without dropout, is one Adam step on the mean gradient."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, isFraud int").repartition(5)
    kept = {"hidden": (6, 4), "drop": (0.0, 0.0)}
    t = NN.Training(epochs=1, rate=0.01, batch_rows=100)
    net = NN.fit_networks({4: (df, None, ["a", "b", "c"])}, "feed_forward", t, {4: 11}, shape=kept)[4]
    shape = NN.FeedForward(3, **kept)
    w = shape.start(np.random.default_rng(11))
    z, memory = shape.forward(w, (x - x.mean(axis=0)) / x.std(axis=0))
    for a, g, b in zip(w, shape.backward(w, memory, NN.focal(z, y.astype(float))[1]), net.weights):
        g = g / 60
        assert np.allclose(a - 0.01 * g / (np.abs(g) + 1e-8), b, atol=1e-4)


def test_networks_learn_and_keep_their_best_epoch(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "i long, a double, b double, isFraud int").cache()
    fit, val = df.filter("i < 900"), df.filter("i >= 900")
    nets = NN.fit_networks({0: (fit, val, ["a", "b"]), 1: (fit.filter("i < 500"), val, ["a", "b"])}, "feed_forward", NN.Training(20, 0.02, 300), {0: 1, 1: 2},
                           shape={"hidden": (32, 16), "drop": (0.1, 0.1)})
    for net in nets.values():
        assert len(net.losses) == 20 and min(net.losses) < 0.6 * net.losses[0]
        rows = net.transform(val, "p").collect()
        p, own = np.array([r.p for r in rows]), np.array([r.isFraud for r in rows], float)
        z = np.log(p / (1 - p))
        assert NN.focal(z, own)[0].mean() == pytest.approx(min(net.losses), rel=1e-3)
        assert ((p > 0.5) == (own > 0)).mean() > 0.85


def test_lstm_learns_from_order(spark):
    """The label is whether the last of the previous rows was above the first: only the order tells."""
    rng = np.random.default_rng(6)
    seq = rng.normal(size=(1500, 4, 1))
    y = (seq[:, -1, 0] > seq[:, 0, 0]).astype(int)
    df = spark.createDataFrame([(i, s.tolist(), int(v)) for i, (s, v) in enumerate(zip(seq, y))], "i long, seq array<array<double>>, isFraud int").cache()
    fit, val = df.filter("i < 1200"), df.filter("i >= 1200")
    net = NN.fit_networks({0: (fit, val, ["v"])}, "lstm", NN.Training(25, 0.02, 400), {0: 3}, sequence="seq", shape={"steps": 4, "units": 12, "head": 8, "drop": 0.0})[0]
    rows = net.transform(val, "p").collect()
    assert np.mean([(r.p > 0.5) == (r.isFraud == 1) for r in rows]) > 0.85


def test_special_cases(spark):
    schema = "a double, isFraud int"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(None, 1), (float("nan"), 0), (1.0, None), (1.0, 1), (1.0, 1)], schema)
    for df, val in ((none, None), (some, none), (some, some)):
        net = NN.fit_networks({0: (df, val, ["a"])}, "feed_forward", NN.Training(2, 0.01), {0: 1}, shape={"hidden": (4,), "drop": (0.5,)})[0]
        assert all(0 <= r.score <= 1 for r in net.transform(some).collect())

"""Findings of the fourth round on networks: an epoch is all of its mini-batches, in one stage."""

import numpy as np
import pytest

from txnwatch.operators import neural as NN


def _plain(x, y, order, epochs, rate, seed, shape):
    """Adam over mini-batches in a given order, by one process."""
    net = NN.FeedForward(x.shape[1], **shape)
    w = net.start(np.random.default_rng(seed))
    m = v = 0
    for t, own in enumerate((b for e in range(epochs) for b in order(e)), 1):
        z, memory = net.forward(w, x[own])
        grad = NN._flat(net.backward(w, memory, NN.focal(z, y[own])[1])) / len(own)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = NN._split(NN._flat(w) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), w)
    return w


@pytest.mark.parametrize("stage", [True, False])
def test_an_epoch_takes_a_step_for_each_mini_batch(spark, monkeypatch, stage):
    """60 mini-batches an epoch are 60 steps: rows that are all alike make the same weights in any order."""
    n, epochs, shape = 600, 2 if stage else 1, {"hidden": (5,), "drop": (0.0,)}
    rows = np.tile([[-1.0, 0.0], [1.0, 1.0]], (n // 2, 1))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in rows], "a double, isFraud int")
    jobs = spark.sparkContext.statusTracker()
    if not stage:
        monkeypatch.setattr(NN, "barrier_slots", lambda sc: 0)
    seen, take = [], NN._train

    def train(shapes, training, seeds, steps, summed):
        seen.append(dict(steps))
        return take(shapes, training, seeds, steps, summed)

    with monkeypatch.context() as m:
        if not stage:
            m.setattr(NN, "_train", train)
        spark.sparkContext.setJobGroup(f"networks-{stage}", "")
        net = NN.fit_networks({0: (df.filter("a > 0").unionByName(df.filter("a > 0")), None, ["a"])}, "feed_forward", NN.Training(epochs, 0.01, 10), {0: 5}, shape=shape)[0]
        found = len(jobs.getJobIdsForGroup(f"networks-{stage}"))
        spark.sparkContext._jsc.clearJobGroup()
    assert found < 12 if stage else seen == [{0: 60}]
    want = _plain(np.zeros((n, 1)), np.ones(n), lambda e: [np.arange(10)] * 60, epochs, 0.01, 5, shape)
    assert all(np.allclose(a, b, atol=2e-4) for a, b in zip(net.weights, want))


def test_rows_beyond_memory_are_in_a_file(monkeypatch):
    """The same mini-batches and losses, whether a task's rows fit its memory or not."""
    rng = np.random.default_rng(2)
    blocks = [(g, v, 10 * k + g, rng.normal(size=(n, 6)).astype(np.float32), rng.integers(0, 2, n).astype(float))
              for k, (g, v, n) in enumerate([(0, False, 50), (1, False, 30), (0, False, 41), (0, True, 25), (0, False, 7)])]
    shapes, seeds, steps = {g: NN.FeedForward(6, (4,), (0.3,)) for g in (0, 1)}, {0: 3, 1: 4}, {0: 9, 1: 2}
    weights = {g: s.start(rng) for g, s in shapes.items()}
    held = NN._HeldRows(iter(blocks), shapes, seeds, steps)
    monkeypatch.setattr(NN, "HELD_BYTES", 1000)
    filed = NN._HeldRows(iter(blocks), shapes, seeds, steps)
    assert held.file is None and filed.file is not None and (0, False) in filed.places
    used = 0
    for epoch in range(2):
        for step in [*range(9), None]:
            a, b = (x.step((weights, epoch, step), False)[0] for x in (held, filed))
            assert a.keys() == b.keys() and all(np.array_equal(a[g], b[g]) for g in a)
            assert set(a) == ({0} if step is None or step > 1 else {0, 1})
            used += a[0][-1] if step is not None else 0
    assert used == 2 * 98  # each row once an epoch

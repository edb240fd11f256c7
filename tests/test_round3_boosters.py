"""Findings of the third round on time: boosters of large groups grow in one stage."""

import os

import numpy as np
import pytest

from txnwatch.operators import boosting as B


def _frame(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 1, n) > 0).astype(int)
    return spark.createDataFrame([(*map(float, a), int(c)) for a, c in zip(x, y)], "x0 double, x1 double, x2 double, isFraud int")


@pytest.mark.parametrize("growth,leaves", [("leaf", 5), ("level", 0), ("symmetric", 0)])
def test_large_groups_grow_in_one_stage(spark, monkeypatch, growth, leaves):
    df = _frame(spark, 500)
    train, val, cols = df.filter("x1 < 0.8"), df.filter("x1 >= 0.8"), ["x0", "x1", "x2"]
    p = B.Boosting(10, 0.3, 3, growth, leaves, least_rows=5, l2=1.0, rows=0.8, columns=0.7, patience=3)
    frames, asks = {0: (train, val, cols), 1: (train, None, cols)}, [(0, p, 1), (0, p, 2), (1, p, 3)]
    alone = B.fit_boosters(frames, asks)  # a task for each
    with monkeypatch.context() as m:
        m.setattr(B, "_SharedRows", None)  # no step of its own job
        jobs = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"boosters-{growth}", "")
        stage = B.fit_boosters(frames, asks, block_rows=64)
        assert len(jobs.getJobIdsForGroup(f"boosters-{growth}")) < 20
        spark.sparkContext._jsc.clearJobGroup()
    with monkeypatch.context() as m:
        m.setattr(B, "exchange_folder", lambda spark: None)  # a checkpoint folder that isn't mounted
        shared = B.fit_boosters(frames, asks, block_rows=64)
    for a, b, c in zip(alone, stage, shared):
        assert len(a.value) == len(b.value) == len(c.value) > 0
        assert np.allclose(a.losses, b.losses) and np.allclose(a.losses, c.losses)
        assert all(np.allclose(u, v) and np.allclose(u, w) for u, v, w in zip(a.value, b.value, c.value))
        assert np.allclose(a.gains, b.gains)
    left = [f for f in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if f.startswith("boosting-")]
    assert not left


def test_tasks_add_up_through_files(tmp_path):
    """Each of five tasks sees the same sum, whichever is first, and no file is left but the last sum."""
    from concurrent.futures import ThreadPoolExecutor

    class Own:
        def __init__(self, part):
            self.part, self.calls = part, 0

        def step(self, requests, with_loss):
            self.calls += 1
            return {0: np.full(3, 0.1 * self.part + self.calls), **({7: np.ones(2)} if self.part == 4 else {})}, {0: np.array([self.part, 1.0])}

    def task(part):
        rows = B._ExchangedRows([], str(tmp_path), part, 5)
        rows.own = Own(part)
        return [rows.step([], True) for _ in range(4)]

    with ThreadPoolExecutor(5) as pool:
        found = list(pool.map(task, range(5)))
    for k in range(4):
        for hist, loss in (f[k] for f in found):
            assert hist[0].tobytes() == found[0][k][0][0].tobytes() and np.allclose(hist[0], 1.0 + 5 * (k + 1))
            assert hist[7].tolist() == [1, 1] and loss[0].tolist() == [10, 5]
    assert sorted(os.listdir(tmp_path)) == ["3-0"]


def test_no_barrier_where_executors_come_and_go():
    class Context:
        def getConf(self):
            return {"spark.dynamicAllocation.enabled": "true"}
    assert B.barrier_slots(Context()) == 0

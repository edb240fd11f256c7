"""Findings of the fourth round on boosters: a task keeps rows once, by feature, and the longest boosters start first."""

import numpy as np

from txnwatch.operators import boosting as B


def _block(rng, n, k, slots):
    x = rng.integers(0, 16, (n, 4)).astype(np.uint8)
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 9, n) > 19).astype(np.uint8)
    return 0, rng.integers(0, 2**63, n).astype(np.uint64), np.ascontiguousarray(x.T), y, np.arange(n) % 5 == 0, np.zeros((k, n)), slots


def test_scores_are_those_of_the_trees():
    """Rows that are handed down where the histograms left them end in the leaves that a descent from the root finds, leaf limits included."""
    rng = np.random.default_rng(1)
    kinds = [B.Boosting(6, 0.3, 4, "leaf", 5, rows=0.7), B.Boosting(6, 0.3, 4, "level", rows=1.0), B.Boosting(6, 0.3, 3, "symmetric", rows=0.6, columns=0.5)]
    blocks = [_block(rng, n, 3, {0: 0, 1: 1, 2: 2}) for n in (300, 170)]
    grown = [B._Growing(i, 0, p, 5 + i, B.Trees(list("abcd"), [np.arange(15.0)] * 4, 0.0, gains=np.zeros(4))) for i, p in enumerate(kinds)]
    rows = B._LocalRows(blocks)
    B._grow(grown, rows, set())
    rows.add({})
    for block, memo in zip(rows.blocks, rows.memos):
        assert not memo  # nothing is kept after a round, of boosters that are done neither
        for i, b in enumerate(grown):
            _, _, feature, cut, value = b.model.parts()
            assert len(value) == 6
            assert np.allclose(block[5][i], sum(v[B.descend(block[2].T, f, c)] for f, c, v in zip(feature, cut, b.model.value)))


def test_what_a_task_keeps_of_a_row():
    """Between the steps of a tree a booster keeps no copy of the bins: two doubles and a row number a row."""
    rng = np.random.default_rng(2)
    block, memo = _block(rng, 4000, 1, {0: 0}), {}
    b = B._Growing(0, 0, B.Boosting(1, 0.1, 3, rows=0.8), 1, B.Trees(list("abcd"), [np.arange(15.0)] * 4, 0.0, gains=np.zeros(4)))
    B._histograms(block, [b.request()], memo)
    flat = [a for part in memo[0][1:] for a in ([r for _, r in part] if isinstance(part, list) else [part])]
    assert sum(a.nbytes for a in flat) <= 4000 * 20
    assert sum(len(a) for a in flat if a.dtype == np.int32) == 4000


def test_longest_boosters_start_first(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(a), int(a + b > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))], "i long, x double, isFraud int")
    short, long = B.Boosting(2, 0.3, 2), B.Boosting(5, 0.3, 3)
    frames = {0: (df.filter("i < 100"), None, ["x"]), 1: (df, None, ["x"])}
    asks = [(0, short, 1), (0, long, 2), (1, short, 3), (1, long, 4)]
    seen, deal = [], type(df.rdd).partitionBy
    monkeypatch.setattr(type(df.rdd), "partitionBy", lambda self, n, f: seen.append(n) or deal(self, n, f))
    grow = B._grow

    def noted(boosters, rows, has_val):
        from pyspark import TaskContext
        assert TaskContext.get().partitionId() == [4, 3, 2, 1].index(boosters[0].seed)  # by rows, rounds and depth
        return grow(boosters, rows, has_val)

    monkeypatch.setattr(B, "_grow", noted)
    models = B.fit_boosters(frames, asks)
    assert seen == [4] and [len(m.value) for m in models] == [2, 5, 2, 5]

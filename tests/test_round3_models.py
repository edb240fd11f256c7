"""Findings of the third round on time: the forest's rows on all cores, the LSTM's rows in small pieces."""

import numpy as np

from txnwatch.operators import models as MD
from txnwatch.operators import neural as NN


def test_forest_rows_are_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(MD, "FOREST_LEAST_ROWS", 100)
    monkeypatch.setattr(MD, "FOREST_MOST_ROWS", 300)
    cores = spark.sparkContext.defaultParallelism
    for n, parts in ((0, 1), (90, 1), (250, 3), (100 * cores, cores), (300 * cores, cores), (300 * cores + 1, 2 * cores)):
        dealt = MD.deal_for_forest(spark.range(n).repartition(7))
        assert dealt.rdd.getNumPartitions() == parts and dealt.count() == n


def test_forest_is_fitted_on_dealt_rows(spark, monkeypatch):
    """All rows take part, in as many tasks as there are cores, and nodes kept from level to level give the same trees."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(MD, "FOREST_LEAST_ROWS", 100)
    df = spark.range(1200).select((F.col("id") % 40).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                  ((F.col("id") % 40 > 20) & (F.col("id") % 7 > 2)).cast("int").alias("isFraud")).repartition(2)
    seen, build = [], MD.build_estimator

    def built(*args):
        estimator = build(*args)
        assert estimator.getCacheNodeIds()

        class Spy:
            def fit(self, rows):
                seen.append((rows.rdd.getNumPartitions(), rows.count()))
                plain = estimator.copy({estimator.cacheNodeIds: False}).fit(rows)
                kept = estimator.fit(rows)
                assert plain.toDebugString.splitlines()[1:] == kept.toDebugString.splitlines()[1:]
                return kept
        return Spy()

    monkeypatch.setattr(MD, "build_estimator", built)
    forest = MD.fit_forest(df, ["a", "b"], 3, "tiny")
    assert seen == [(min(12, spark.sparkContext.defaultParallelism), 1200)]
    assert all((r.score > 0.5) == bool(r.isFraud) for r in forest.transform(df).collect())


def test_lstm_pieces_are_the_whole():
    """Gradients and logits of pieces are those of all rows at once, dropout included, and no more rows go through at once."""
    rng = np.random.default_rng(4)
    shape = NN.Lstm(3, steps=4, units=6, head=5, drop=0.4)
    w = shape.start(rng)
    for n in (0, 1, 256, 700):
        x, y = rng.normal(size=(n, 12)), rng.integers(0, 2, n).astype(float)
        z, memory = shape.forward(w, x, np.random.default_rng(8))
        whole = NN._flat(shape.backward(w, memory, NN.focal(z, y)[1].astype(np.float32)))
        assert np.allclose(NN.gradients(shape, w, x, y, np.random.default_rng(8)), whole, atol=1e-5)
        assert np.allclose(NN.logits(shape, w, x), shape.forward(w, x)[0])

    class Watched(NN.Lstm):
        def forward(self, w, x, *args, **kwargs):
            assert len(x) <= 256
            return super().forward(w, x, *args, **kwargs)

    watched = Watched(3, steps=4, units=6, head=5, drop=0.4)
    NN.gradients(watched, w, x, y, np.random.default_rng(8))
    NN.logits(watched, w, x)


def test_every_sequence_is_in_one_block(spark, monkeypatch):
    """One step over blocks of 40 rows is one Adam step on the mean gradient of all rows of the group, equal rows and null labels too."""
    monkeypatch.setattr(NN, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(6)
    shape = {"steps": 3, "units": 4, "head": 4, "drop": 0.0}
    frames, rows = {}, {}
    for g, n in ((0, 210), (1, 95)):
        x, y = np.repeat(rng.normal(size=(n // 5, 3, 2)), 5, axis=0), rng.integers(0, 2, n)
        rows[g] = x.reshape(n, 6), y
        df = spark.createDataFrame([*((a.tolist(), int(b)) for a, b in zip(x, y)), (x[0].tolist(), None)], "seq array<array<double>>, isFraud int")
        frames[g] = df, df.limit(30) if g else None, ["a", "b"]
    nets = NN.fit_networks(frames, "lstm", NN.Training(1, 0.01, 1000), {0: 5, 1: 6}, sequence="seq", shape=shape)
    for g, (x, y) in rows.items():
        lstm = NN.Lstm(2, **shape)
        w = lstm.start(np.random.default_rng(5 + g))
        grad = NN.gradients(lstm, w, x, y.astype(float), None) / len(y)
        moved = NN._flat(w) - 0.01 * grad / (np.abs(grad) + 1e-8)
        sure = np.abs(grad) > 1e-6  # a gradient next to 0 may change its sign with the order of the sum
        assert sure.mean() > 0.3 and np.allclose(moved[sure], NN._flat(nets[g].weights)[sure], atol=1e-4)
        assert len(nets[g].losses) == (1 if g else 0)

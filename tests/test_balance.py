"""Exact neighbours and exact row counts of SMOTE."""

import numpy as np
import pytest

from conftest import SF_SMALL
from txnwatch.operators import balance as BA
from txnwatch.operators import features as FE
from txnwatch.sources.fixtures import txn


@pytest.mark.parametrize("block_rows", [3, 7, 64, 1024])
def test_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    cluster = np.sort(rng.integers(0, 3, 80))
    x = rng.integers(0, 6, (80, 3)).astype(float)  # many ties and copies
    rows = spark.createDataFrame([(int(c), i, v.tolist()) for i, (c, v) in enumerate(zip(cluster, x))], "_cluster int, row long, x array<double>").repartition(4)
    near, sums = BA.nearest_rows(rows, 5, block_rows)
    got = {(r.row, r["rank"]): (r.other, r.d2) for r in near.collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(80):
        others = sorted((d2[i, j], j) for j in range(80) if j != i and cluster[j] == cluster[i])[:5]
        assert [got[i, k] for k in range(len(others))] == [(j, d) for d, j in others]
    assert len(got) == 400
    total = {r["_cluster"]: 0.0 for r in sums.collect()}
    for r in sums.collect():
        total[r["_cluster"]] += r.total
    for c, v in total.items():
        assert v == pytest.approx(np.sqrt(d2[np.ix_(cluster == c, cluster == c)]).sum())


def test_allocation_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(200):
        weights = {int(c): float(w) for c, w in enumerate(rng.random(int(rng.integers(1, 9))) ** 8 + 1e-12)}
        need = int(rng.integers(0, 500))
        got = BA.allocate(need, weights)
        assert sum(got.values()) == need and all(abs(got[c] - need * w / sum(weights.values())) < 1 for c, w in weights.items())


@pytest.mark.parametrize("clusters", [True, False])
def test_row_counts_and_places(spark, clusters):
    df = FE.engineer_velocity(txn(spark, SF_SMALL, with_v=False)).cache()
    feats = ["TransactionAmt", "C1", "D1", "Card_Velocity_7d"]
    n_min, n_maj = BA.class_counts(df)
    for ratio in (0.05, 0.3, 0.61):
        out = BA.smote(df, feats, target_ratio=ratio, use_clusters=clusters, block_rows=16)
        made = out.filter("TransactionID is null").select("isFraud", *feats).collect()
        assert len(made) == int(ratio * n_maj) - n_min and {r.isFraud for r in made} == {1}
        assert out.count() == df.count() + len(made)
    real = np.array([[BA.MODEL_FILL if r[f] is None else r[f] for f in feats] for r in df.filter("isFraud = 1").collect()])
    synth = np.array([[r[f] for f in feats] for r in made])
    assert (synth >= real.min(axis=0) - 1e-9).all() and (synth <= real.max(axis=0) + 1e-9).all()
    again = BA.smote(df.repartition(7), feats, target_ratio=0.61, use_clusters=False, block_rows=100).filter("TransactionID is null").select(*feats)
    if not clusters:
        assert sorted(map(tuple, synth.round(9).tolist())) == sorted(tuple(round(v, 9) for v in r) for r in again.collect())


def test_few_and_equal_rows(spark):
    schema = "TransactionID long, x double, isFraud int"
    rows = [(i, float(i), 0) for i in range(100)]
    for minority in ([], [(200, 1.0, 1)], [(200, 1.0, 1), (201, 1.0, 1)], [(200 + i, None, 1) for i in range(9)]):
        df = spark.createDataFrame(rows + minority, schema)
        for method in ("smote", "cluster_smote"):
            n = BA.prepare_training_data(df, ["x"], strategy=0.3, method=method).filter("isFraud = 1").count()
            assert n == (30 if len(minority) > 1 else len(minority))
    assert BA.smote(spark.createDataFrame([], schema), ["x"]).count() == 0

"""Encoders, splits, evaluation and statistics against brute force."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from txnwatch.operators import encode as EN
from txnwatch.operators import evaluate as EV
from txnwatch.operators import split as SP
from txnwatch.operators import stats as ST
from txnwatch.operators.pca import v_column_pca
from txnwatch.sources.fixtures import txn


def test_encoder_fit_fixture(spark):
    df = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "A")], "pos int, kind string")
    out = EN.encode_categoricals(df, F.col("pos") < 2, columns=["kind"])
    assert [r[1] for r in rows(out, "pos", "kind")] == [0, 1, -1, 0]


def test_missing_becomes_code_and_unseen_missing(spark):
    df = spark.createDataFrame([(0, None), (1, "B"), (2, None), (3, "Z")], "pos int, kind string")
    out = EN.encode_categoricals(df, F.col("pos") < 2, columns=["kind"])
    assert [r[1] for r in rows(out, "pos", "kind")] == [0, 1, 0, -1]
    out2 = EN.encode_categoricals(df, F.col("pos") == 1, columns=["kind"])
    assert [r[1] for r in rows(out2, "pos", "kind")] == [-1, 0, -1, -1]


def test_incremental_codes_equal_whole_table(spark):
    df = spark.createDataFrame([(i, f"v{(i * 7) % 11}") for i in range(40)], "id int, v string")
    whole = {r["v"]: r["code"] for r in EN.first_appearance_codes(df, "v", "id").collect()}
    m1 = EN.first_appearance_codes(df.filter("id < 13"), "v", "id")
    m2 = EN.extend_code_map(m1, df.filter("id >= 13"), "v", "id")
    assert {r["v"]: r["code"] for r in m2.collect()} == whole


def test_standard_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    st = EN.fit_standard_scaler(df, ["a", "b"])
    out = EN.transform_standard_scaler(df, st, ["a", "b"]).collect()
    assert abs(out[0]["a"] + math.sqrt(1.5)) < 1e-12 and out[0]["b"] == 0.0
    back = EN.transform_standard_scaler(EN.transform_standard_scaler(df, st, ["a"]), st, ["a"], inverse=True)
    assert [r["a"] for r in back.collect()] == [1.0, 2.0, 3.0]


def test_walk_forward_and_holdout():
    folds = SP.walk_forward_folds(10000, 5, 1000)
    assert [(f.train_end, f.val_start, f.val_end) for f in folds][:2] == [(1666, 2666, 4332), (3332, 4332, 5998)]
    assert folds[-1].val_end == 10000
    assert SP.walk_forward_folds(1000, 5, 1000) == []
    assert SP.holdout_bounds(10000, 0.15, 1000) == SP.Holdout(8500, 9500, 10000)
    assert SP.holdout_bounds(100, 0.15, 1000) == SP.Holdout(85, 85, 100)
    ib = SP.internal_eval_bounds(8500, 0.10, 1000)
    assert (ib.train_end, ib.test_start) == (7650, 7650)


def test_fold_assignment_disjoint_with_gap(spark):
    df = spark.range(1200).select(F.col("id").alias("pos"))
    out = SP.assign_folds(df, 1200, gap=50).collect()
    for f in SP.walk_forward_folds(1200, 5, 50):
        tr = [r["pos"] for r in out if r["fold"] == f.fold and r["role"] == "train"]
        va = [r["pos"] for r in out if r["fold"] == f.fold and r["role"] == "val"]
        assert max(tr) + 50 < min(va)


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _brute_ap(y, s):
    order = np.argsort(-s, kind="stable")
    ys, ss = y[order], s[order]
    ap, tp, fp, P = 0.0, 0, 0, y.sum()
    i = 0
    while i < len(ss):
        j = i
        while j < len(ss) and ss[j] == ss[i]:
            j += 1
        dtp = ys[i:j].sum()
        tp += dtp
        fp += (j - i) - dtp
        ap += dtp / P * tp / (tp + fp)
        i = j
    return ap


def test_curve_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(800) < 0.1).astype(int)
    s = np.round(np.clip(0.3 * y + rng.random(800) * 0.7, 0, 1), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "isFraud int, fraud_score double")
    curve = EV.threshold_curve(df)
    assert abs(EV.roc_auc(curve).first()["roc_auc"] - _brute_auc(y, s)) < 1e-12
    assert abs(EV.average_precision(curve).first()["pr_auc"] - _brute_ap(y, s)) < 1e-12
    chunked = EV.threshold_curve(df, n_chunks=4)
    assert abs(EV.roc_auc(chunked).first()["roc_auc"] - _brute_auc(y, s)) < 1e-12


def test_ece_edge_trap(spark):
    df = spark.createDataFrame([(0.3, 0), (0.3, 1), (1.0, 1), (0.6, 1)], "fraud_score double, isFraud int")
    tab = {r["bin"]: r["n"] for r in EV.calibration_table(df).collect()}
    assert tab[2] == 2  # 0.3 < 0.30000000000000004: third bin holds 0.3
    assert tab[5] == 1 and tab[9] == 1  # 0.6 < 0.6000000000000001; 1.0 in the closed last bin
    ece = EV.expected_calibration_error(df).first()["ece"]
    assert abs(ece - (2 / 4 * abs(0.5 - 0.3) + 1 / 4 * abs(1 - 0.6))) < 1e-12  # 1.0 falls in no bin


def test_deciles_match_pandas_qcut(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(137), 2)
    pdf = pd.DataFrame({"TransactionID": range(137), "fraud_score": s, "isFraud": (s > 0.8).astype(int)})
    want = pd.qcut(pdf["fraud_score"].rank(method="first"), q=10, labels=False).value_counts().sort_index()
    got = EV.score_deciles(spark.createDataFrame(pdf)).orderBy("score_decile").collect()
    assert [r["n"] for r in got] == list(want.values)


def test_pvalues():
    assert abs(ST.chi2_1_sf(3.841458820694124) - 0.05) < 1e-9
    assert abs(ST.t_two_sided_p(2.0, 10) - 0.07338803477074568) < 1e-9
    assert abs(ST.t_two_sided_p(-3.5, 4) - 0.024896) < 1e-5


def test_mcnemar_no_discordant(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 0, 0)], "y int, a int, b int")
    r = ST.mcnemar_test(df, "y", F.col("a"), F.col("b")).first()
    assert (r["b"], r["c"], r["statistic"], r["p_value"]) == (0, 0, 0.0, 1.0)


def test_v_pca_fixture(spark):
    base = [[float(j + 1 + i) for j in range(10)] for i in range(4)]
    base[2] = [v * 100 for v in base[2]]
    base[3] = [v * 100 for v in base[3]]
    cols = ", ".join(f"V{j + 1} double" for j in range(10))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(base)], f"pos int, {cols}")
    out = v_column_pca(df, F.col("pos") < 2, n_components=2)
    assert not any(c.startswith("V") and c[1:].isdigit() for c in out.columns)
    pcs = [c for c in out.columns if c.startswith("V_PCA_")]
    assert pcs
    # rows 3-4 do not affect the fit: changing them leaves rows 1-2 unchanged
    base2 = [r[:] for r in base]
    base2[3] = [v * 7 for v in base2[3]]
    df2 = spark.createDataFrame([(i, *r) for i, r in enumerate(base2)], f"pos int, {cols}")
    out2 = v_column_pca(df2, F.col("pos") < 2, n_components=2)
    a = rows(out.filter("pos < 2"), "pos", *pcs)
    b = rows(out2.filter("pos < 2"), "pos", *pcs)
    assert all(abs(x - y) < 1e-9 for ra, rb in zip(a, b) for x, y in zip(ra, rb))


def test_txn_fixture_facts(spark):
    df = txn(spark, SF_SMALL)
    assert df.count() == 1000
    assert df.select("card1").distinct().count() == 15


def test_diagnostic_sample_exact_topk(spark):
    import hashlib
    df = spark.range(5000).select(F.col("id").alias("TransactionID"))
    got = sorted(r["TransactionID"] for r in SP.diagnostic_sample(df, 300, seed=7).collect())
    want = sorted(sorted(range(5000), key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())[:300])
    assert got == want
    assert SP.diagnostic_sample(df, 10_000).count() == 5000
    assert SP.diagnostic_sample(df).count() == 5000


def test_fold_target_encode_against_brute_force(spark):
    """Each fold learns from its own training rows only; null and unseen values get its prior, null labels count as rows."""
    import random

    from txnwatch.operators import encode, split
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", None, f"only{i}"]), rng.choice([1, 2, None]), rng.choice([0, 1, None])) for i in range(90)]
    df = spark.createDataFrame(rows, "pos long, x string, y int, isFraud int")
    folds = split.walk_forward_folds(len(rows), 4, 3)
    got = {(r.pos, r.fold): (r.x_te, r.y_te) for r in encode.fold_target_encode(df, ["x", "y"], "isFraud", folds).collect()}
    want = {}
    for f in folds:
        train = [r for r in rows if r[0] < f.train_end]
        known = [r[3] for r in train if r[3] is not None]
        prior = sum(known) / len(known)
        for r in rows:
            if f.val_start <= r[0] < f.val_end:
                own = [[t for t in train if r[k] is not None and t[k] == r[k]] for k in (1, 2)]
                want[r[0], f.fold] = tuple((sum(t[3] or 0 for t in o) + 10 * prior) / (len(o) + 10) for o in own)
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k]))
    empty = encode.fold_target_encode(df.limit(0), ["x"], "isFraud", split.walk_forward_folds(0, 4, 3))
    assert empty.count() == 0 and "x_te" in empty.columns

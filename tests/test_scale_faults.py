"""Faults that small fixtures hide: overflow, NULL scores and keys, folders of files, forced splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from txnwatch.operators import balance as BA
from txnwatch.operators import evaluate as EV
from txnwatch.operators import explain as XP
from txnwatch.operators import features as FE
from txnwatch.operators import models as MD
from txnwatch.operators import scan
from txnwatch.operators.pca import null_pattern_groups, v_column_pca
from txnwatch.sources import loaders as LD
from txnwatch.sources.fixtures import txn
from txnwatch.streaming import features as SF
from txnwatch.streaming import jobs as SJ


def test_auc_of_counts_beyond_a_long(spark):
    curve = spark.createDataFrame([(0.9, 8 * 10**8, 10**10, 8 * 10**8, 10**10, 10**9, 2 * 10**10), (0.1, 2 * 10**8, 10**10, 10**9, 2 * 10**10, 10**9, 2 * 10**10)],
                                  "threshold double, pos long, neg long, tp long, fp long, P long, N long")
    got = EV.roc_auc(curve).first()["roc_auc"]
    assert abs(got - (10**10 * (8 * 10**8) + 10**10 * (18 * 10**8)) / (2 * 10**9 * 2 * 10**10)) < 1e-12


def test_null_scores_rank_last(spark):
    rows = [(i, None if i < 4 else float("nan") if i == 4 else i / 100.0, int(i >= 90)) for i in range(100)]
    df = spark.createDataFrame(rows, "TransactionID long, fraud_score double, isFraud int")
    top = {r["top_percent"]: r for r in EV.topk_capture(df).collect()}
    assert top[10.0]["fraud_captured"] == 10 and top[1.0]["fraud_captured"] == 1
    deciles = EV.score_deciles(df).collect()
    assert sum(r["n"] for r in deciles) == 95 and min(r["min_score"] for r in deciles) == 0.05


def test_seed_metrics_with_null_scores_scan_once(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.2).astype(int)
    s = np.round(np.clip(0.4 * y + 0.6 * rng.random(600), 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(zip(y, s))], "isFraud int, fraud_score double")
    got = EV.seed_metric_row(df).first()
    known = df.filter("fraud_score is not null")
    assert got["n_holdout"] == 600 and got["fraud_n"] == y.sum()
    assert abs(got["brier"] - EV.brier_score(known).first()["brier"]) < 1e-12
    assert abs(got["roc_auc"] - EV.roc_auc(EV.threshold_curve(known)).first()["roc_auc"]) < 1e-12
    cm = EV.confusion_counts(known, threshold=got["best_f1_threshold"]).first()
    assert [got[f"{k}_at_best_f1"] for k in ("tn", "fp", "fn", "tp")] == [cm[k] for k in ("tn", "fp", "fn", "tp")]
    gaps = EV.calibration_table(known).filter("n > 0").collect()
    assert abs(got["ece_10bin"] - sum(r["n"] / 600 * r["abs_gap"] for r in gaps)) < 1e-12


@pytest.mark.parametrize("rows", [50, 170])
def test_forced_splits_change_nothing(spark, monkeypatch, rows):
    base = FE.build_uid(txn(spark, SF_SMALL, with_v=False).withColumn("card1", F.when(F.col("TransactionID") % 3 == 0, F.lit(1)).otherwise(F.col("card1"))))

    def frames():
        v = FE.engineer_velocity(FE.uid_aggregations(base)).select("TransactionID", "UID_amt_std", "D1_uid_diff", "UID_txn_count", "Card_Velocity_30d", "Card_Tx_Count")
        q = FE.build_sequences(base, "card1", ["TransactionAmt"], 10, out_col="seq").select("TransactionID", F.col("seq").cast("string").alias("seq"))
        d = FE.distinct_counterparties(base, "card1", "card4").select("TransactionID", "distinct_counterparties")
        out = v.join(q, "TransactionID").join(d, "TransactionID").toPandas().set_index("TransactionID").sort_index()
        return out
    plain = frames()
    monkeypatch.setattr(scan, "DEFAULT_ROWS_PER_BUCKET", rows)
    split = frames()
    for c in plain.columns:
        if plain[c].dtype == object:
            assert (plain[c] == split[c]).all(), c
        else:
            assert np.allclose(plain[c].astype(float), split[c].astype(float), equal_nan=True, atol=1e-9), c


def test_folder_fingerprint_sees_a_rewritten_part(spark, tmp_path):
    src, cache = f"file://{tmp_path}/in", f"file://{tmp_path}/cache"
    spark.range(10).repartition(2).write.parquet(src)
    read = lambda: LD.cached_features(spark, cache, [src], "v1", {}, lambda: spark.read.parquet(src)).count()
    assert read() == 10 and read() == 10
    spark.range(99).repartition(2).write.mode("append").parquet(src)
    assert read() == 109


def test_ieee_nan_is_null(spark, tmp_path):
    for name, text in (("train_transaction.csv", "TransactionID,TransactionAmt,isFraud\n1,NaN,\n2,3.5,1\n"), ("train_identity.csv", "TransactionID,DeviceType\n2,mobile\n")):
        (tmp_path / name).write_text(text)
    df = LD.load_dataset(spark, f"file://{tmp_path}", "ieee", transaction_schema="TransactionID long, TransactionAmt double, isFraud int",
                         identity_schema="TransactionID long, DeviceType string")
    assert sorted((r["TransactionID"], r["TransactionAmt"], r["isFraud"], r["DeviceType"]) for r in df.collect()) == [(1, None, 0, None), (2, 3.5, 1, "mobile")]


def test_streams_over_a_folder_with_null_cards(spark, tmp_path):
    """Sixty files of events, a tenth without a user: every stream gives the batch result."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev = ev.withColumn("user_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id")))
    ev.repartition(60).write.parquet(f"{tmp_path}/events.parquet")
    out, progress = SJ.run_closed(lambda s: SF.stream_card_features(s, delay="60 days"), SF.txn_stream(spark, str(tmp_path)), "test-folder")
    batch = FE.engineer_velocity(txn(spark, str(tmp_path), with_v=False))
    cols = ["TransactionID", "Card_Tx_Count", "Card_Prior_Txn_Count", "Card_Velocity_7d", "Card_Amt_Std_30d", "Card_Spending_Velocity"]
    got, want = (d.select(*cols).toPandas().set_index("TransactionID").sort_index() for d in (out, batch))
    assert len(got) == len(want) == 1000 and progress
    for c in cols[1:]:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-9), c
    routed, progress = SJ.run_to_table(SJ.stream_routing(SF.txn_stream(spark, str(tmp_path), 1), 1e9), "test-many")
    assert routed.count() == 1000 and sum(p["numInputRows"] for p in progress) == 1000 and len(progress) >= 60


def test_window_bins_keep_every_row(spark, tmp_path):
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    windows = SJ.stream_window_bins(SF.txn_stream(spark, str(tmp_path), 3), [-1.0, 0.2, 0.5, 9.0], watermark="60 days")
    updates, _ = SJ.run_to_table(windows, "test-bins", output_mode="update")
    got = SJ.latest_bins(updates).agg(F.sum("n")).first()[0]
    assert got == 1000


def test_v_pca_on_many_columns(spark):
    rng = np.random.default_rng(1)
    cols = [f"V{i}" for i in range(1, 121)]
    x = rng.normal(size=(150, 120))
    rows = [(i, *(None if i >= 100 and j < 2 else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "pos int, " + ", ".join(f"{c} double" for c in cols))
    groups = null_pattern_groups(df, None)
    assert [len(g) for g in groups] == [2, 118]  # the nulls come after the hundredth row
    out = v_column_pca(df, None).orderBy("pos").toPandas()
    c = x[:, 2:] - x[:, 2:].mean(axis=0)
    vals, vecs = np.linalg.eigh(np.cov(c.T))
    want = c @ vecs[:, -1]
    assert np.allclose(np.abs(out["V_PCA_g1_pc0"]), np.abs(want), atol=1e-8)


def test_background_takes_all_rows(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"))
    bg = XP.background_stats(df, ["x"])
    assert (bg.q1[0], bg.median[0], bg.q3[0]) == (499.75, 999.5, 1499.25)


def test_fidelity_is_the_regression_r2(spark):
    """Two features: a nearly linear model is fitted nearly perfectly, and the value is a function of the id."""
    df = spark.createDataFrame([(i, i / 50.0, (i * 7 % 50) / 50.0) for i in range(50)], "TransactionID long, a double, b double")
    model = MD.LinearModel(["a", "b"], [0.1, -0.2], 0.3)
    stats = XP.background_stats(df, ["a", "b"])
    one = {r[0]: r[1] for r in XP.lime_fidelity(XP.explain_rows(df, stats, model), stats, model).collect()}
    two = {r[0]: r[1] for r in XP.lime_fidelity(XP.explain_rows(df.repartition(5), stats, model), stats, model).collect()}
    assert one == two and len(one) == 50 and min(one.values()) > 0.999


def test_smote_spreads_and_methods_raise(spark, monkeypatch):
    monkeypatch.setattr(BA, "BLOCK_ROWS", 10)
    big = txn(spark, SF_SMALL, with_v=False)
    n_min, n_maj = BA.class_counts(big)
    out = BA.prepare_training_data(big, ["TransactionAmt", "C1"], strategy=0.3, method="smote")
    made = out.filter("TransactionID is null")
    assert made.count() == int(0.3 * n_maj) - n_min and made.select("TransactionAmt").distinct().count() > 0.9 * made.count()
    with pytest.raises(ValueError):
        BA.prepare_training_data(big, ["C1"], strategy=0.3, method="best")


def test_calibration_folds_follow_the_given_order(spark):
    df = spark.createDataFrame([(i, 100 - i, int(i % 5 == 0)) for i in range(100)], "TransactionID long, pos long, isFraud int")
    got = {r["pos"]: r["_cal_fold"] for r in MD.stratified_contiguous_folds(df, "isFraud", "pos").collect()}
    zeros = [got[p] for p in sorted(got) if (100 - p) % 5]
    assert zeros == sorted(zeros)

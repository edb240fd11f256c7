"""Model smoke tests, calibration mapping, streaming equality, ADWIN, I/O."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from txnwatch.operators import balance as BA
from txnwatch.operators import evaluate as EV
from txnwatch.operators import features as FE
from txnwatch.operators import models as MD
from txnwatch.operators.route import route_transactions
from txnwatch.sources import loaders as LD
from txnwatch.sources import sinks as SK
from txnwatch.sources.fixtures import txn
from txnwatch.streaming import adwin as AD
from txnwatch.streaming import features as SF
from txnwatch.streaming import jobs as SJ


def _logit_newton(x, y, C):
    """sklearn's objective 0.5 |w|^2 + C sum logloss (intercept unpenalised)."""
    X = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(X.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-X @ w))
        reg = np.r_[w[:-1], 0.0]
        g = reg + C * X.T @ (p - y)
        H = np.diag(np.r_[np.ones(X.shape[1] - 1), 0.0]) + C * (X.T * (p * (1 - p))) @ X
        w -= np.linalg.solve(H, g)
    return w


def test_meta_learner_matches_sklearn_objective(spark):
    df = txn(spark, SF_SMALL, with_v=False).select("fraud_score", "score_b", "isFraud")
    pdf = df.toPandas()
    m = MD.fit_logistic(df, ["fraud_score", "score_b"], C=0.01)
    w = _logit_newton(pdf[["fraud_score", "score_b"]].to_numpy(), pdf["isFraud"].to_numpy(), 0.01)
    assert np.allclose(m.coef + [m.intercept], w, atol=1e-5)


def test_models_beat_chance_and_gates(spark):
    from txnwatch.plans import experiment as XE
    df = FE.engineer_velocity(txn(spark, SF_SMALL, with_v=False)).withColumn("pos", F.col("TransactionID"))
    feats = ["TransactionAmt", "C1", "Card_Velocity_7d"]
    s = XE.Slice((0, 700), (700, 900), (0, 1000), 3)
    fitted, rows = XE.fit_slices(df, {1: s}, feats, MD.ALL_MODELS, "tiny", 0.3)
    scored = XE.score_slice(rows[1], fitted, 1, feats, MD.ALL_MODELS, ["isFraud"]).cache()
    assert scored.columns == ["TransactionID", "isFraud", *MD.ALL_MODELS] and scored.count() == 1000
    for kind in MD.TREE_MODELS:
        assert EV.roc_auc(EV.threshold_curve(scored, kind)).first()["roc_auc"] > 0.5
        assert abs(sum(fitted[1, kind].importances) - 1) < 1e-6
    assert scored.filter(F.greatest(*MD.ALL_MODELS).between(0, 1)).count() == 1000
    w = MD.gate_weights(df, ["fraud_score", "score_b"]).collect()
    assert all(0 < r["gate_weight"] <= 1 for r in w)


def test_calibrated_meta_is_probability(spark):
    df = txn(spark, SF_SMALL, with_v=False)
    meta = MD.fit_meta_learner(df, ["fraud_score", "score_b"], order_col="TransactionID")
    assert len(meta.folds) == 3
    p = [r[0] for r in df.select(meta.proba()).collect()]
    assert all(0 < v < 1 for v in p)


def test_no_resample_and_oversample(spark):
    df = spark.createDataFrame([(0, 0.0, 0), (1, 1.0, 0), (2, 2.0, 0), (3, 3.0, 1)],
                               "TransactionID long, x double, isFraud int")
    same = BA.prepare_training_data(df, ["x"], strategy=0)
    assert sorted(r["TransactionID"] for r in same.collect()) == [0, 1, 2, 3]
    big = txn(spark, SF_SMALL, with_v=False)
    n_min, n_maj = BA.class_counts(big)
    out = BA.random_oversample(big, ratio=0.10, seed=5)
    assert out.count() == big.count() + int(0.10 * n_maj) - n_min


def _shuffled_log(spark, folder, n_files, seed=3):
    """The small transactions' events, dealt to files at random and written in random order."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    dealt = ev.withColumn("f", F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(n_files)))
    for k in range(n_files):
        dealt.filter(F.col("f") == k).drop("f").coalesce(1).write.mode("append").parquet(f"file://{folder}/events.parquet")


def test_stream_equals_batch(spark, tmp_path):
    """Rows out of order within and between micro-batches, one file a trigger."""
    _shuffled_log(spark, tmp_path, 3)
    out, progress = SJ.run_closed(lambda s: SF.stream_card_features(s, delay="60 days"), SF.txn_stream(spark, f"file://{tmp_path}", 1), "test-str1")
    batch = FE.engineer_velocity(txn(spark, SF_SMALL, with_v=False))
    got = out.collect()
    s = {r["TransactionID"]: r for r in got}
    b = {r["TransactionID"]: r for r in batch.collect()}
    assert s.keys() == b.keys() and len(got) == len(b) and len([p for p in progress if p["numInputRows"]]) >= 3
    for k, r in b.items():
        assert s[k]["Card_Tx_Count"] == r["Card_Tx_Count"] and s[k]["late"] == 0
        for c in ("Card_Velocity_7d", "Card_Amt_Std_30d", "Card_Spending_Velocity"):
            assert abs(s[k][c] - r[c]) < 1e-9


def test_rows_wait_until_the_watermark(spark, tmp_path):
    """Without the end of the stream only rows that the watermark has passed come out, and they are right."""
    _shuffled_log(spark, tmp_path, 1)
    out, _ = SJ.run_to_table(SF.stream_card_features(SF.txn_stream(spark, f"file://{tmp_path}"), delay="5 days"), "test-wait")
    batch = {r["TransactionID"]: r for r in FE.engineer_velocity(txn(spark, SF_SMALL, with_v=False)).collect()}
    got = out.collect()
    last = max(r["TransactionDT"] for r in batch.values())
    want = {i for i, r in batch.items() if (r["TransactionDT"] // SF.BUCKET + 1) * SF.BUCKET <= last - 5 * 86400}
    assert {r["TransactionID"] for r in got} == want and 0 < len(want) < len(batch)
    assert all(r["Card_Tx_Count"] == batch[r["TransactionID"]]["Card_Tx_Count"] for r in got)


def test_stream_decides_as_the_batch_does(spark, tmp_path):
    """Scored by a snapshot of a fitted stack, routed by card and client history, one file a trigger in random order."""
    _shuffled_log(spark, tmp_path / "log", 3)
    models = ["fraud_score", "score_b"]
    base = txn(spark, SF_SMALL, with_v=False).withColumn("pos", F.col("TransactionID"))
    weights = MD.gate_weights(base, models)
    meta = MD.fit_meta_learner(MD.apply_gates(base, weights, models), models)
    folder = f"file://{tmp_path}/snapshots"
    assert SJ.save_snapshot(spark, folder, weights, MD.CalibratedLinear(meta.base)) == 1
    assert SJ.save_snapshot(spark, folder, weights, meta) == 2
    snap = SJ.load_snapshot(spark, folder)
    assert snap.version == 2 and SJ.load_snapshot(spark, folder, 1).meta.folds == []
    p95 = base.agg(F.percentile("TransactionAmt", F.lit(0.95))).first()[0]

    def job(stream):
        scored = stream.withColumn("score_b", F.col("fraud_score") * 0.5)
        history = SJ.stream_history(scored, delay="60 days", scores=tuple(models)).withColumn("meta_score", snap.proba())
        return SJ.stream_routing(history, p95, score="meta_score", prior_count="Card_Prior_Txn_Count", new_client="is_new_client")
    out, _ = SJ.run_closed(job, SF.txn_stream(spark, f"file://{tmp_path}/log", 1), "test-str3")
    batch = base.withColumn("score_b", F.col("fraud_score") * 0.5)
    batch = FE.new_client_flag(FE.uid_aggregations(FE.build_uid(FE.engineer_velocity(batch))))
    batch = MD.apply_gates(batch, weights, models).withColumn("meta_score", meta.proba())
    want = route_transactions(batch, "meta_score", amount="TransactionAmt", prior_count="Card_Prior_Txn_Count", new_client="is_new_client")
    w = {r.TransactionID: (r.decision, r.Card_Prior_Txn_Count, r.is_new_client, round(r.meta_score, 9)) for r in want.collect()}
    g = {r.TransactionID: (r.decision, r.Card_Prior_Txn_Count, r.is_new_client, round(r.meta_score, 9)) for r in out.collect()}
    assert g == w and len({x[0] for x in g.values()}) >= 2 and out.count() == len(w)


def test_clients_are_forgotten_after_their_time(spark, tmp_path):
    rows = [(1, 0, 5, 1.0), (2, 3 * 86400, 5, 1.0), (3, 20 * 86400, 5, 1.0), (4, 21 * 86400, None, 1.0), (5, 21 * 86400 + 5, None, 2.0)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, card1 long, TransactionAmt double").select(
        "*", F.lit(1).alias("addr1"), (F.floor(F.col("TransactionDT") / 86400.0)).cast("double").alias("D1"), F.lit(0.3).alias("fraud_score"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("TransactionDT"))).alias("event_time"))
    df.write.parquet(f"file://{tmp_path}/t")
    for ttl, third in ((None, 0), (10, 1)):
        stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/t")
        out, _ = SJ.run_closed(lambda s, ttl=ttl: SJ.stream_history(s, "60 days", ttl_days=ttl), stream, "test-ttl")
        got = {r.TransactionID: (r.Card_Prior_Txn_Count, r.is_new_client) for r in out.collect()}
        assert got == {1: (0, 1), 2: (1, 0), 3: (2, third), 4: (None, 1), 5: (None, 0)}


def test_adwin_detects_shift(spark):
    rng = np.random.default_rng(0)
    vals = np.r_[rng.normal(0.2, 0.05, 600), rng.normal(0.8, 0.05, 600)]
    a = AD.Adwin()
    hits = [i for i, v in enumerate(vals) if a.update(float(v))]
    assert hits and 600 <= hits[0] < 700
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(vals)] +
                               [("flat", i, 0.5) for i in range(600)], "key string, pos long, score double")
    ch = AD.adwin_changes(df, ["key"], "pos", "score").collect()
    assert {r["key"] for r in ch} == {"k"} and min(r["pos"] for r in ch) >= 600


def test_paysim_found_by_schema_in_nested_dir(spark, tmp_path):
    d = tmp_path / "a" / "b"
    d.mkdir(parents=True)
    (tmp_path / "a" / "other.csv").write_text("x,y\n1,2\n")
    (d / "mystery.csv").write_text(
        "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud\n"
        "1,TRANSFER,100,C1,100,0,M1,0,100,1\n")
    path = LD.resolve_paysim_path(spark, f"file://{tmp_path}")
    assert path.endswith("mystery.csv")
    df = LD.load_dataset(spark, f"file://{tmp_path}", "paysim").collect()
    assert len(df) == 1 and df[0]["TransactionDT"] == 3600 and df[0]["isFraud"] == 1
    try:
        LD.load_dataset(spark, f"file://{tmp_path}", "other")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_bounded_read_opens_only_the_first_files(spark, tmp_path):
    head = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud\n"
    d = tmp_path / "log"
    d.mkdir()
    for k in range(9):
        (d / f"part-{k:02d}.csv").write_text(head + "".join(f"{k},PAYMENT,{10 * k + i},C{i},0,0,M{k},0,0,0\n" for i in range(7)))
    opened, asked = [], lambda some: opened.extend(some) or 7 * len(some)
    files = [f"f{k}" for k in range(9)]
    for bound, most in ((1, 1), (7, 1), (8, 2), (30, 6), (63, 9), (100, 9)):
        opened.clear()
        got = LD.first_files(files, bound, asked)
        assert got == opened == files[:len(got)] and -(-min(bound, 63) // 7) <= len(got) <= most
    (d / "part-08.csv").write_bytes(b"\xff\xfe broken")
    (d / "part-07.csv").chmod(0)  # a later file that can't be read is no matter
    rows = LD.load_paysim(spark, f"file://{d}", max_rows=10).orderBy("TransactionID").collect()
    assert [(r.TransactionID, r.TransactionAmt) for r in rows] == [(i + 1, float(i % 7 + 10 * (i // 7))) for i in range(10)]
    read = {f.rsplit("/", 1)[-1] for f in LD.load_paysim(spark, f"file://{d}", max_rows=10).inputFiles()}
    assert read <= {"part-00.csv", "part-01.csv"}


def test_feature_cache_keeps_versions_apart(spark, tmp_path):
    import pytest
    src = tmp_path / "in"
    spark.range(3).write.parquet(f"file://{src}")
    cache, built = f"file://{tmp_path}/cache", []

    def cached(tag, n, fail=False):
        def build():
            built.append(tag)
            if fail:
                raise RuntimeError("broken off")
            return spark.range(n)
        return LD.cached_features(spark, cache, [f"file://{src}"], tag, {"n": n}, build)

    a = cached("A", 5)
    assert a.count() == 5 and cached("A", 5).count() == 5 and built == ["A"]
    with pytest.raises(RuntimeError):
        cached("B", 7, fail=True)
    # a table without its pointer, as a crash between data and commit leaves it, is nobody's
    spark.range(99).write.parquet(f"{cache}/features-orphan.parquet")
    assert cached("A", 5).count() == 5 and built == ["A", "B"]
    b = cached("B", 7)
    assert b.count() == 7 and a.count() == 5  # the reader of A goes on reading A
    spark.range(4).write.mode("append").parquet(f"file://{src}")
    assert cached("A", 5).count() == 5 and built == ["A", "B", "B", "A"]


def test_holdout_predictions_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "u1", 0, 0.1), (2, "u2", 1, 0.9)],
                               "TransactionID long, UID string, isFraud int, fraud_score double")
    path = SK.save_holdout_predictions(route_transactions(df), f"file://{tmp_path}", "ieee")
    back = spark.read.option("header", True).csv(path).orderBy("TransactionID").collect()
    assert [r["decision"] for r in back] == ["ALLOW", "AUTO_BLOCK"]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark).collect()
    assert sum(r["n"] for r in out) == 1000
    assert set(E.oracle_sql()) <= set(E.queries())


def test_full_experiment_smoke(spark, tmp_path):
    from txnwatch.plans.experiment import run_experiment
    out = run_experiment(spark, SF_SMALL, f"file://{tmp_path}", seeds=[1], models=["rf", "xgb"], profile="tiny", gap=10)
    row = out["seed_metrics"].first()
    assert row["n_holdout"] > 0 and 0.0 <= row["roc_auc"] <= 1.0
    assert {r["metric"] for r in out["summary"].collect()} >= {"roc_auc", "brier"}
    for name in ("experiment_holdout_predictions.csv", "variants", "mcnemar_gated_ungated", "ablation", "feature_psi", "score_psi",
                 "wasserstein", "meta_shap_top_risk_local", "harness"):
        assert (tmp_path / "seed_1" / name).exists(), name
    variants = spark.read.option("header", True).csv(f"file://{tmp_path}/seed_1/variants").collect()
    assert {r["variant"] for r in variants} == {"gated", "ungated", "smoothed"}
    doc = spark.read.json(f"file://{tmp_path}/metrics_summary.json").first()
    assert doc["n_seeds"] == 1 and doc["seeds"][0]["seed"] == 1


def test_registered_models_are_whole(spark, monkeypatch):
    """Model queries ask for the production profile, all models and training rows balanced once per slice."""
    from txnwatch.plans import catalog
    from txnwatch.plans import experiment as XE
    asked, balanced, prepare = [], [], BA.prepare_training_data
    fit = XE.fit_slices

    def noted(df, features, label="isFraud", strategy=0.3, *rest, **kw):
        balanced.append(strategy)
        return prepare(df, features, label, strategy, *rest, **kw)

    def small(frame, slices, features, models, profile="fast", balance=0.0, *rest, **kw):
        asked.append((list(models), len(slices), profile, balance))
        assert all(s.val for s in slices.values())
        return fit(frame, slices, features, models, "tiny", balance, *rest, **kw)

    monkeypatch.setattr(XE, "fit_slices", small)
    monkeypatch.setattr(BA, "prepare_training_data", noted)
    six = ["rf", "xgb", "lgb", "cat", "mlp", "lstm"]
    assert six == MD.ALL_MODELS
    for name, models, n in (("mod3", six[2:3], 1), ("mod11", six, 1), ("mod10", six, 5)):
        asked.clear()
        balanced.clear()
        out = catalog.REGISTRY[name](spark, SF_SMALL)
        assert asked == [(models, n, "fast", 0.3)]
        assert balanced == [0.3] * (n if set(models) & set(MD.TREE_MODELS) else 0)
        if name == "mod10":
            scored = out.filter(F.col("rf").isNotNull())
            assert scored.count() == scored.filter(F.greatest(*six).between(0, 1)).count() > 0
        else:
            assert out.columns == ["TransactionID", *models] and out.filter(F.greatest(*models, F.lit(-1)).between(0, 1)).count() == out.count() > 0

"""The full experiment as Spark jobs (ENC7, MOD10, MOD11, SPL4 and friends).

    load -> position -> holdout split -> causal feature frame (fit on train)
    -> walk-forward out-of-fold scores per model -> gate -> calibrated meta
    learner -> refit on the training slice -> holdout scores -> threshold from
    OOF -> UID smoothing -> routing -> fairness / drift / explanations.

The driver loops over folds and models; each fit, transform and report is a
distributed job.  The feature frame is checkpointed once (reliable
checkpoint in the cluster's checkpoint folder) so the fold loop does not
recompute the window plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators import balance as BA
from txnwatch.operators import boosting as BO
from txnwatch.operators import drift as DR
from txnwatch.operators import encode as EN
from txnwatch.operators import evaluate as EV
from txnwatch.operators import features as FE
from txnwatch.operators import models as MD
from txnwatch.operators import neural as NN
from txnwatch.operators import route as RT
from txnwatch.operators import smooth as SM
from txnwatch.operators import split as SP
from txnwatch.operators import stats as ST
from txnwatch.operators.pca import fit_v_pca
from txnwatch.operators.scan import add_global_position, plan_entity_chunks
from txnwatch.session import cut_lineage
from txnwatch.sources.fixtures import txn

NULL_THRESHOLD = 0.7
PRESERVE = ["TransactionID", "TransactionDT", "isFraud", "UID", "pos", "card1", "fraud_score", "score_b"]


def feature_pipeline(df: DataFrame, fit: Column, pos: str = "pos", chunk_rows: int | None = 4_000_000,
                     null_threshold: float = NULL_THRESHOLD, preserve: Sequence[str] = PRESERVE) -> DataFrame:
    """ENC7: time -> encode (fit rows) -> UID -> UID stats -> V-PCA (fit rows)
    -> cross features -> new-client flag -> velocity -> null cleanup (fit rows).

    String columns are label-encoded before the UID statistics, so match
    flags arrive as codes (the T/F mapping only applies to raw strings).
    """
    # V-PCA only reads the raw V-columns: fit it on the input, apply later
    pca_cols, v_cols = fit_v_pca(df, fit, pos)
    df, chunk_col = plan_entity_chunks(df, "card1", rows_per_chunk=chunk_rows)
    out = FE.extract_time_features(df)
    strings = [c for c, t in out.dtypes if t == "string"]
    out = EN.encode_categoricals(out, fit, pos=pos, columns=strings)
    out = FE.build_uid(out)
    out = FE.uid_aggregations(out, chunk_col=chunk_col)
    if v_cols:
        out = (out.withColumns(pca_cols) if pca_cols else out).drop(*v_cols)
    out = FE.cross_feature_interactions(out)
    out = FE.new_client_flag(out)
    out = FE.engineer_velocity(out, chunk_col=chunk_col)
    if chunk_col:
        out = out.drop(chunk_col)
    # the null-ratio decision is an action: compute the feature frame once
    out = cut_lineage(out)
    return FE.clean_high_nan_columns(out, null_threshold, fit, preserve=[c for c in preserve if c in out.columns])


@dataclass
class Prepared:
    frame: DataFrame        # positioned feature frame (checkpointed)
    n: int
    holdout: SP.Holdout
    features: list[str]
    gap: int


def prepare(spark: SparkSession, sf_dir: str, gap: int = SP.GAP_SIZE, exclude_scores: bool = True) -> Prepared:
    base = txn(spark, sf_dir, with_v=True)
    if exclude_scores:
        base = base.drop("fraud_score", "score_b")  # fixture scores are not model inputs
    n = base.count()
    # reliable checkpoint: later actions plan against a short lineage
    positioned = cut_lineage(add_global_position(base, n_rows=n))
    hb = SP.holdout_bounds(n, gap=gap)
    feats = feature_pipeline(positioned, F.col("pos") < hb.train_end)
    cols = MD.feature_columns(feats, exclude=MD.EXCLUDED + ("pos",))
    return Prepared(feats, n, hb, cols, gap)


@dataclass
class OOFResult:
    scores: DataFrame              # TransactionID, isFraud, one column per model (NULL where uncovered)
    models: list[str] = field(default_factory=list)
    importances: list[tuple] = field(default_factory=list)  # (model, fold, feature, importance) of the tree models


@dataclass(frozen=True)
class Slice:
    """Which rows, by position, models are fitted on, stop early on (None: they don't) and score."""
    train: tuple[int, int]
    val: tuple[int, int] | None
    score: tuple[int, int]
    seed: int

    @staticmethod
    def rows(frame: DataFrame, span: tuple[int, int]) -> DataFrame:
        return frame.filter((F.col("pos") >= span[0]) & (F.col("pos") < span[1]))


#: The LSTM reads the previous SEQ_LEN rows of the entity (WIN12).
SEQ_LEN, SEQ_ENTITY = 10, "card1"


def _sequences(frame: DataFrame, s: Slice, features: Sequence[str]) -> DataFrame:
    """The slice's rows with ``_seq``, their entity's previous rows among them, standardised by the training rows."""
    spans = [x for x in (s.train, s.val, s.score) if x]
    own = frame.filter(" or ".join(f"(pos >= {a} and pos < {b})" for a, b in spans))
    names = [f"_z{k}" for k in range(len(features))]
    z = own.withColumns({n: MD.filled(F.col(f)) for n, f in zip(names, features)})
    z = EN.transform_standard_scaler(z, EN.fit_standard_scaler(Slice.rows(z, s.train), names), names)
    z = z.withColumns({n: F.least(F.greatest(F.col(n), F.lit(-NN.FAR)), F.lit(NN.FAR)) for n in names})
    return cut_lineage(FE.build_sequences(z, SEQ_ENTITY, names, SEQ_LEN, out_col="_seq").drop(*names, "_seq_len"))


def fit_slices(frame: DataFrame, slices: dict[int, Slice], features: Sequence[str], models: Sequence[str], profile: str = "fast",
               balance: float = 0.0, method: str = "cluster_smote", parallelism: int = 4) -> tuple[dict, dict[int, DataFrame]]:
    """``{(slice, model): fitted}`` and, per slice, the frame to score (``_seq`` in it if a model reads sequences).

    A slice's training rows are balanced once, for all of its tree models.  The boosters of all slices grow in the same steps,
    and so do the networks; forests are fits of their own, submitted from ``parallelism`` threads so Spark
    schedules their jobs side by side.
    """
    features, profiles = list(features), MD.PROFILES[profile]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trained = {}
        if any(m in MD.TREE_MODELS for m in models):
            def balanced(g):
                rows = Slice.rows(frame, slices[g].train).select("TransactionID", "isFraud", *features)
                return cut_lineage(BA.prepare_training_data(rows, features, "isFraud", balance, slices[g].seed, method).select("isFraud", *features))
            trained = dict(zip(slices, pool.map(balanced, slices)))
        seqs = dict(zip(slices, pool.map(lambda g: _sequences(frame, slices[g], features), slices))) if "lstm" in models else {}
        base = {g: seqs.get(g, frame) for g in slices}
        val_of = lambda g: Slice.rows(base[g], slices[g].val) if slices[g].val else None

        def boosted():
            kinds = [m for m in models if m in MD.BOOSTED]
            asks = [(g, profiles[m], slices[g].seed + 7 * (m == "cat")) for g in slices for m in kinds]
            found = BO.fit_boosters({g: (trained[g], val_of(g), features) for g in slices}, asks) if kinds else []
            return dict(zip([(g, m) for g in slices for m in kinds], found))

        def networks(m):
            kind, seq = ("lstm", "_seq") if m == "lstm" else ("feed_forward", None)
            frames = {g: (Slice.rows(base[g], slices[g].train), val_of(g), features) for g in slices}
            return {(g, m): net for g, net in NN.fit_networks(frames, kind, profiles[m], {g: slices[g].seed for g in slices}, sequence=seq).items()}

        jobs = [pool.submit(boosted)]
        jobs += [pool.submit(lambda g=g: {(g, "rf"): MD.fit_forest(trained[g], features, slices[g].seed, profile)}) for g in slices if "rf" in models]
        jobs += [pool.submit(networks, m) for m in ("mlp", "lstm") if m in models]
        fitted = {k: v for j in jobs for k, v in j.result().items()}
    return fitted, {g: Slice.rows(base[g], slices[g].score) for g in slices}


def score_slice(rows: DataFrame, fitted: dict, g: int, features: Sequence[str], models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(TransactionID, *keep, one column per model): the models of a slice, one after the other over the same rows."""
    out = rows.select("TransactionID", *keep, *[f for f in features if f not in keep], *(["_seq"] if "lstm" in models else []))
    for m in sorted(models, key=lambda m: m != "lstm"):
        out = fitted[g, m].transform(out, m)
        out = out.drop("_seq") if m == "lstm" else out
    return out.select("TransactionID", *keep, *models)


def out_of_fold(prep: Prepared, models: Sequence[str] = ("rf", "xgb"), profile: str = "fast", seed: int = 42,
                n_splits: int = SP.N_SPLITS, balance: float = 0.0, parallelism: int = 4, method: str = "cluster_smote") -> OOFResult:
    """MOD10: walk-forward folds over the training slice; each fold fits every model (seed + fold) on its balanced training
    rows, stops early on its validation rows and scores them."""
    if len(models) < 2:
        raise ValueError("at least two models are required for stacking")
    folds = SP.walk_forward_folds(prep.holdout.train_end, n_splits, prep.gap)
    frame = cut_lineage(prep.frame)
    slices = {f.fold: Slice((0, f.train_end), (f.val_start, f.val_end), (f.val_start, f.val_end), seed + f.fold) for f in folds}
    fitted, rows = fit_slices(frame, slices, prep.features, models, profile, balance, method, parallelism)
    wide = None
    for g in slices:
        part = score_slice(rows[g], fitted, g, prep.features, models)
        wide = part if wide is None else wide.unionByName(part)
    labels = Slice.rows(frame, (0, prep.holdout.train_end)).select("TransactionID", "isFraud", "pos")
    # reliable checkpoint: the fold loop's lineage is cut and survives executor loss
    scores = cut_lineage(labels.join(wide, "TransactionID", "left"))
    importances = [r for g in slices for m in models if m in MD.TREE_MODELS for r in MD.fold_importances(fitted[g, m], prep.features, m, g)]
    return OOFResult(scores, list(models), importances)


def refit_and_score_holdout(prep: Prepared, models: Sequence[str], profile: str = "fast", seed: int = 42,
                            balance: float = 0.0, method: str = "cluster_smote", keep: Sequence[str] | None = None) -> DataFrame:
    """MOD11 (MOD1-MOD6, MOD9 for a model alone): refit each model on the internal-fit rows with the internal
    validation rows for early stopping, then score the holdout."""
    ib = SP.internal_eval_bounds(prep.holdout.train_end, gap=prep.gap)
    s = Slice((0, ib.train_end), (ib.test_start, prep.holdout.train_end), (prep.holdout.test_start, prep.n), seed + 999)
    frame = cut_lineage(prep.frame)
    if keep is None:
        keep = ["isFraud", "UID", "TransactionAmt", "card4", "pos", *(c for c in ("Card_Prior_Txn_Count", "is_new_client") if c in frame.columns)]
    fitted, rows = fit_slices(frame, {0: s}, prep.features, models, profile, balance, method)
    return score_slice(rows[0], fitted, 0, prep.features, models, keep)


@dataclass
class StackResult:
    oof: DataFrame
    weights: DataFrame
    meta: MD.CalibratedLinear
    holdout: DataFrame


def stack(oof: OOFResult, holdout_scores: DataFrame, gated: bool = True) -> StackResult:
    """STK1-STK4 on the covered OOF rows, applied to the holdout; without
    ``gated`` every model keeps weight 1 (the comparison stack)."""
    covered = SP.oof_coverage(oof.scores, oof.models)
    weights = MD.gate_weights(covered, oof.models)
    if not gated:
        weights = weights.withColumn("gate_weight", F.lit(1.0))
    weights = cut_lineage(weights)
    train = MD.apply_gates(covered, weights, oof.models)
    meta = MD.fit_meta_learner(train, oof.models)
    hold = MD.apply_gates(holdout_scores, weights, oof.models).withColumn("fraud_score", meta.proba())
    return StackResult(train.withColumn("meta_score", meta.proba()), weights, meta, hold)


def smoothed_oof(stacked: StackResult, prep: Prepared) -> DataFrame:
    """OOF rows with their meta score averaged per UID (STK6), as decisions use it."""
    ids = prep.frame.select("TransactionID", "UID")
    return SM.uid_average_predictions(stacked.oof.join(ids, "TransactionID"), "meta_score", "UID")


def decide(stacked: StackResult) -> DataFrame:
    """UID smoothing (STK6) and routing (RTE1-4)."""
    smoothed = SM.uid_average_predictions(stacked.holdout, "fraud_score", "UID")
    return RT.route_transactions(smoothed, "fraud_score", amount="TransactionAmt",
                                 prior_count="Card_Prior_Txn_Count" if "Card_Prior_Txn_Count" in smoothed.columns
                                 else None,
                                 new_client="is_new_client" if "is_new_client" in smoothed.columns else None)


def oof_threshold(oof: DataFrame, score: str = "meta_score") -> float:
    """EVL4 on out-of-fold scores."""
    return float(EV.optimal_f1_threshold(EV.threshold_curve(oof, score)).first()["threshold"])


# --- the whole experiment ----------------------------------------------------------------------

SUMMARY_METRICS = ["roc_auc", "pr_auc", "brier", "ece_10bin", "best_f1", "best_f1_precision", "best_f1_recall"]


def variant_report(variants: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Precision, recall, F1 and confusion counts of each (scored holdout, threshold)."""
    out = None
    for name, (df, threshold) in variants.items():
        rep = EV.classification_report(df, threshold=threshold).filter("label = '1'").select(
            F.lit(name).alias("variant"), F.lit(threshold).alias("threshold"), "precision", "recall", "f1", "support")
        out = rep if out is None else out.unionByName(rep)
    return out


def drift_tables(prep: Prepared, oof: DataFrame, holdout: DataFrame) -> dict[str, DataFrame]:
    """DRF1-DRF3 between training slice and holdout, for features and the score."""
    train = prep.frame.filter(F.col("pos") < prep.holdout.train_end)
    hold = prep.frame.filter(F.col("pos") >= prep.holdout.test_start)
    return {"feature_psi": DR.feature_psi(train, hold, prep.features),
            "score_psi": DR.score_psi(oof.select(F.col("meta_score").alias("fraud_score")), holdout, "fraud_score"),
            "wasserstein": DR.wasserstein_drift(train, hold, prep.features)}


def run_experiment(spark: SparkSession, sf_dir: str, out_dir: str, seeds: Sequence[int] = (42,),
                   models: Sequence[str] = ("rf", "xgb"), profile: str = "fast", balance: float = 0.0,
                   gap: int = SP.GAP_SIZE, balance_method: str = "cluster_smote") -> dict[str, DataFrame]:
    """Lifecycle A: features once (shared by all seeds), then per seed OOF ->
    gate/stack/calibrate (and an ungated stack to compare) -> refit + holdout
    scores -> threshold from UID-smoothed OOF scores -> routing -> metrics,
    McNemar, ablation, drift, fairness, explanations -> artifacts under
    ``out_dir/seed_<n>``; finally the multi-seed summary."""
    from txnwatch.operators import explain as XP
    from txnwatch.operators import fairness as FA
    from txnwatch.sources import sinks as SK

    prep = prepare(spark, sf_dir, gap=gap)
    seed_rows = []
    for seed in seeds:
        oof = out_of_fold(prep, models, profile, seed, balance=balance, method=balance_method)
        hold = cut_lineage(refit_and_score_holdout(prep, models, profile, seed, balance, balance_method))
        st, plain = stack(oof, hold), stack(oof, hold, gated=False)
        smoothed = cut_lineage(smoothed_oof(st, prep))
        thr, raw_thr, plain_thr = oof_threshold(smoothed), oof_threshold(st.oof), oof_threshold(plain.oof)
        decided = cut_lineage(decide(st).withColumn("oof_threshold", F.lit(thr)))
        seed_dir = f"{out_dir.rstrip('/')}/seed_{seed}"
        SK.save_holdout_predictions(decided, seed_dir, "experiment")
        metrics = EV.seed_metric_row(decided).withColumn("seed", F.lit(seed))
        both = st.holdout.select("TransactionID", "isFraud", F.col("fraud_score").alias("gated")).join(
            plain.holdout.select("TransactionID", F.col("fraud_score").alias("ungated")), "TransactionID")
        bg = smoothed
        stats = XP.background_stats(bg, list(models))
        explained = XP.explain_rows(decided, stats, st.meta.base)
        harness = XP.harness_metrics(explained, stats, st.meta.base).join(
            XP.lime_fidelity(explained, stats, st.meta.base), "TransactionID")
        SK.save_tables({
            "seed_metrics": metrics,
            "decision_mix": RT.decision_summary(decided),
            "policy": EV.policy_metrics(decided),
            "topk": EV.topk_capture(decided),
            "calibration_bins": EV.calibration_table(decided),
            "score_deciles": EV.score_deciles(decided),
            "fairness": FA.full_report(decided),
            "variants": variant_report({"gated": (st.holdout, raw_thr), "ungated": (plain.holdout, plain_thr), "smoothed": (decided, thr)}),
            "mcnemar_gated_ungated": ST.mcnemar_test(both, "isFraud", F.col("gated") >= raw_thr, F.col("ungated") >= plain_thr),
            "ablation": MD.leave_one_out_ablation(st.oof, list(models)),
            **drift_tables(prep, st.oof, decided),
            "meta_shap_global": XP.linear_contribution_table(decided, bg, st.meta.base),
            "meta_shap_top_risk_local": XP.top_risk_local_table(decided, bg, st.meta.base, "fraud_score"),
            "harness": XP.harness_rollup(harness),
        }, seed_dir)
        seed_rows.append(metrics)
    allm = seed_rows[0]
    for r in seed_rows[1:]:
        allm = allm.unionByName(r)
    summary = SK.save_metrics_summary(allm, f"{out_dir.rstrip('/')}/metrics_summary.json", SUMMARY_METRICS, ("seed",))
    return {"seed_metrics": allm, "summary": summary}


def main(argv: Sequence[str] | None = None) -> None:
    import argparse

    from txnwatch.session import get_spark
    ap = argparse.ArgumentParser(description="Run the full fraud experiment on Spark.")
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--seeds", default="42")
    ap.add_argument("--models", default="rf,xgb")
    ap.add_argument("--profile", default="fast", choices=sorted(MD.PROFILES))
    ap.add_argument("--gap", type=int, default=SP.GAP_SIZE)
    ap.add_argument("--balance", type=float, default=0.0)
    ap.add_argument("--balance-method", default="cluster_smote", choices=BA.METHODS)
    args = ap.parse_args(argv)
    spark = get_spark()
    out = run_experiment(spark, args.sf_dir, args.out, [int(s) for s in args.seeds.split(",")],
                         args.models.split(","), args.profile, args.balance, args.gap, args.balance_method)
    out["summary"].show(truncate=False)


if __name__ == "__main__":
    main()

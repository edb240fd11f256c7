"""Model fitting, gating, stacking and calibration on ``pyspark.ml`` (MOD*, STK*).

Forests and linear models are ``pyspark.ml`` fits; boosted trees (``boosting``) and networks (``neural``) grow
in jobs over row blocks.  The driver holds trees, weights and coefficients, never rows.
Linear models are applied as column expressions, so scoring stays inside
whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.boosting import Boosting, filled
from txnwatch.operators.evaluate import roc_auc, threshold_curve
from txnwatch.operators.forest import GrownForest, fit_grown_forest
from txnwatch.operators.neural import Training
from txnwatch.operators.scan import compact_for_fit, keyed_expanding, plan_time_chunks

# Fixed hyper-parameter profiles (research / fast) plus a tiny test profile.
PROFILES = {
    "research": {
        "rf": dict(numTrees=500, maxDepth=15),
        "xgb": Boosting(800, 0.03, 8, "level", least_hessian=1.0, l1=0.5, l2=2.0, least_gain=2.0, rows=0.8, columns=0.7, patience=50),
        "lgb": Boosting(800, 0.03, 8, "leaf", leaves=63, least_rows=100, rows=0.8, columns=0.7, patience=50),
        "cat": Boosting(800, 0.03, 8, "symmetric", l2=3.0, patience=50),
        "mlp": Training(epochs=15, rate=0.001), "lstm": Training(epochs=12, rate=0.002),
    },
    "fast": {
        "rf": dict(numTrees=160, maxDepth=12),
        "xgb": Boosting(360, 0.05, 6, "level", least_hessian=1.0, l1=0.5, l2=2.0, least_gain=2.0, rows=0.8, columns=0.7, patience=30),
        "lgb": Boosting(420, 0.05, 7, "leaf", leaves=47, least_rows=100, rows=0.8, columns=0.7, patience=30),
        "cat": Boosting(360, 0.05, 6, "symmetric", l2=3.0, patience=30),
        "mlp": Training(epochs=6, rate=0.001), "lstm": Training(epochs=4, rate=0.002),
    },
    "tiny": {
        "rf": dict(numTrees=10, maxDepth=4),
        "xgb": Boosting(8, 0.1, 4, "level", least_hessian=1.0, l1=0.5, l2=2.0, rows=0.8, columns=0.7, patience=3),
        "lgb": Boosting(8, 0.1, 4, "leaf", leaves=9, least_rows=10, columns=0.7, patience=3),
        "cat": Boosting(8, 0.1, 3, "symmetric", l2=3.0, patience=3),
        "mlp": Training(epochs=2, rate=0.005), "lstm": Training(epochs=1, rate=0.005),
    },
}
BOOSTED = ["xgb", "lgb", "cat"]
TREE_MODELS = ["rf", *BOOSTED]
#: MOD1-MOD6.
ALL_MODELS = [*TREE_MODELS, "mlp", "lstm"]
FOCAL_ALPHA, FOCAL_GAMMA = 0.75, 2.0
GATE_TAU = 0.60
META_C = 0.01
CALIBRATION_FOLDS = 3
MODEL_FILL = -999.0
EXCLUDED = ("isFraud", "TransactionID", "TransactionDT", "UID")
#: Rows of a forest's partition: fewer aren't worth a task, more don't fit its memory.
FOREST_LEAST_ROWS, FOREST_MOST_ROWS = 25_000, 250_000
#: Rows of a forest that ``pyspark.ml`` grows, at most: with more it keeps a count and a node id of each row and tree.
FOREST_LIBRARY_ROWS = 100_000


# --- PRJ11 / PRJ12: model matrix ----------------------------------------------------

def feature_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDED) -> list[str]:
    """Numeric feature columns in frame order (the training column order)."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if c not in exclude and t in numeric]


def assemble(df: DataFrame, features: Sequence[str], out_col: str = "features",
             fill: float = MODEL_FILL) -> DataFrame:
    """NULL/NaN -> ``fill``, then a dense vector in the given column order."""
    filled = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(fill)), F.lit(fill))
                             for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=out_col, handleInvalid="keep").transform(filled)


def align_features(df: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """PRJ12: re-order (and restrict) columns to the training order."""
    return df.select(*feature_names)


# --- MOD1-6: fitting ---------------------------------------------------------------------

def build_estimator(kind: str, seed: int = 42, profile: str = "fast", features_col: str = "features",
                    label_col: str = "isFraud"):
    """The ``pyspark.ml`` estimators: the forest ("rf") and plain logistic regression ("lr")."""
    if kind == "rf":
        # rows keep their nodes from level to level: the same trees, without a descent from the root for each level
        return RandomForestClassifier(featuresCol=features_col, labelCol=label_col, seed=seed, minInstancesPerNode=10,
                                      cacheNodeIds=True, **PROFILES[profile]["rf"])
    if kind == "lr":
        return LogisticRegression(featuresCol=features_col, labelCol=label_col)
    raise ValueError(f"unknown model kind {kind!r}")


def positive_probability(df: DataFrame, prob_col: str = "probability", out_col: str = "score") -> DataFrame:
    return df.withColumn(out_col, vector_to_array(F.col(prob_col)).getItem(1))


def score_with(model, df: DataFrame, out_col: str = "score") -> DataFrame:
    out = positive_probability(model.transform(df), out_col=out_col)
    return out.drop("rawPrediction", "probability", "prediction")


@dataclass
class Forest:
    """A fitted forest that scores frames of plain feature columns, as the other models do."""
    model: object
    features: list[str]

    @property
    def importances(self):
        return self.model.featureImportances.toArray()

    def transform(self, df: DataFrame, out_col: str = "score") -> DataFrame:
        # missing features are filled in a copy: the frame's own columns stay as they are
        vector = array_to_vector(F.array(*[filled(F.col(c)) for c in self.features]))
        return score_with(self.model, df.withColumn("_features", vector), out_col).drop("_features")


def deal_for_forest(df: DataFrame) -> DataFrame:
    """Deal a forest's input to the cores: its work is rows times trees, so partitions are smaller than those of other fits,
    and beyond one for each core they come in whole rounds."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    k = max(1, min(-(-n // FOREST_LEAST_ROWS), cores * -(-n // (cores * FOREST_MOST_ROWS))))
    return df.repartition(k) if k != df.rdd.getNumPartitions() else df


def fit_forest(train: DataFrame, features: Sequence[str], seed: int, profile: str = "fast", label: str = "isFraud") -> Forest | GrownForest:
    """MOD1: by ``pyspark.ml``, or beyond ``FOREST_LIBRARY_ROWS`` by ``forest`` where a barrier stage can run."""
    if train.count() > FOREST_LIBRARY_ROWS:
        own = PROFILES[profile]["rf"]
        grown = fit_grown_forest(train, features, seed, own["numTrees"], own["maxDepth"], label)
        if grown:
            return grown
    rows = train.select(array_to_vector(F.array(*[filled(F.col(c)) for c in features])).alias("_features"), label)
    # an iterative fit scans its input many times: keep it materialised for the fit only
    rows = deal_for_forest(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Forest(build_estimator("rf", seed, profile, "_features", label).fit(rows), list(features))
    finally:
        rows.unpersist()


# --- MOD7: focal loss ------------------------------------------------------------------------

def focal_loss(df: DataFrame, score: str = "fraud_score", label: str = "isFraud", alpha: float = FOCAL_ALPHA,
               gamma: float = FOCAL_GAMMA, eps: float = 1e-7, by: Sequence[str] = ()) -> DataFrame:
    """Mean ``alpha_t (1 - p_t)^gamma * bce`` of a probability column (clipped to [eps, 1 - eps])."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    y = F.col(label).cast("double")
    bce = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    p_t = F.exp(-bce)
    alpha_t = F.lit(alpha) * y + F.lit(1 - alpha) * (1 - y)
    loss = F.avg(alpha_t * F.pow(1 - p_t, gamma) * bce).alias("focal_loss")
    return df.groupBy(*by).agg(loss) if by else df.agg(loss)


# --- STK1 / STK2: confidence gating ---------------------------------------------------------

def gate_weights(oof: DataFrame, model_cols: Sequence[str], label: str = "isFraud",
                 tau: float = GATE_TAU) -> DataFrame:
    """``model, auc, gate_weight = min(1, (auc / tau)^2)``; AUC over all OOF rows,
    every model in one job (unpivot + grouped curve)."""
    long = oof.select(label, *model_cols).unpivot([label], list(model_cols), "model", "score")
    auc = roc_auc(threshold_curve(long, "score", label, by=["model"]), by=["model"])
    return auc.select("model", F.col("roc_auc").alias("auc"),
                      F.least(F.lit(1.0), F.pow(F.col("roc_auc") / tau, 2)).alias("gate_weight"))


def apply_gates(df: DataFrame, weights: DataFrame, model_cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Multiply each model column by its stored weight (weights: one row per model)."""
    wide = weights.groupBy().pivot("model", list(model_cols)).agg(F.first("gate_weight"))
    wide = wide.select(*[F.col(m).alias(f"_w_{m}") for m in model_cols])
    j = df.crossJoin(F.broadcast(wide))  # one row
    return j.withColumns({f"{m}{suffix}": F.col(m) * F.col(f"_w_{m}") for m in model_cols}).drop(
        *[f"_w_{m}" for m in model_cols])


# --- STK3 / STK4: meta-learner with Platt calibration --------------------------------------

@dataclass
class LinearModel:
    features: list[str]
    coef: list[float]
    intercept: float

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for c, w in zip(self.features, self.coef):
            z = z + F.lit(w) * F.col(c)
        return z

    def proba(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit()))

    def logit_of(self, cols: dict[str, Column]) -> Column:
        """Logit with some inputs replaced by expressions (e.g. filled values)."""
        z = F.lit(self.intercept)
        for c, w in zip(self.features, self.coef):
            z = z + F.lit(w) * cols.get(c, F.col(c))
        return z

    def proba_of(self, cols: dict[str, Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit_of(cols)))


@dataclass
class CalibratedLinear:
    """Average of per-fold ``sigmoid(a * f_j(x) + b)`` (sklearn ``cv=3`` sigmoid)."""
    base: LinearModel
    folds: list[tuple[LinearModel, float, float]] = field(default_factory=list)

    def proba(self) -> Column:
        if not self.folds:
            return self.base.proba()
        parts = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * m.logit() + F.lit(b)))) for m, a, b in self.folds]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total / len(parts)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "isFraud", C: float = META_C,
                 n_rows: int | None = None, weight_col: str | None = None, max_iter: int = 300) -> LinearModel:
    """L2 logistic regression with sklearn's ``C`` (``regParam = 1 / (C n)``),
    unscaled features, unpenalised intercept."""
    n = n_rows if n_rows is not None else df.count()
    reg = 0.0 if C is None or math.isinf(C) else 1.0 / (C * max(n, 1))
    lr = LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter, tol=1e-10)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(
        compact_for_fit(df.select(*features, label, *([weight_col] if weight_col else []))))
    m = lr.fit(data)
    return LinearModel(list(features), [float(v) for v in m.coefficients], float(m.intercept))


def fit_platt(df: DataFrame, decision: Column, label: str = "isFraud") -> tuple[float, float]:
    """Platt scaling with soft targets ``(N+ + 1)/(N+ + 2)`` and ``1/(N- + 2)``:
    each row enters twice, as label 1 with weight ``t`` and label 0 with
    weight ``1 - t`` (exact weighted log-loss, no regularisation)."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("np"), F.count_if(F.col(label) != 1).alias("nn")).first()
    hi = (counts["np"] + 1.0) / (counts["np"] + 2.0)
    lo = 1.0 / (counts["nn"] + 2.0)
    t = F.when(F.col(label) == 1, F.lit(hi)).otherwise(F.lit(lo))
    base = df.select(decision.alias("_f"), t.alias("_t"))
    dup = (base.select("_f", F.lit(1.0).alias("_y"), F.col("_t").alias("_w"))
           .unionByName(base.select("_f", F.lit(0.0).alias("_y"), (1 - F.col("_t")).alias("_w"))))
    m = fit_logistic(dup, ["_f"], "_y", C=None, n_rows=1, weight_col="_w", max_iter=200)
    return m.coef[0], m.intercept


def stratified_contiguous_folds(df: DataFrame, label: str, order_col: str, k: int = CALIBRATION_FOLDS,
                                out_col: str = "_cal_fold") -> DataFrame:
    """Stratified k folds without shuffling: inside each class, rows in order
    fill fold 0, then 1, ...; fold sizes follow the round-robin allocation of
    the labels, classes in order of first appearance (as a stratified splitter does)."""
    seen = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first")).collect()
    counts = {int(r[label]): int(r["n"]) for r in seen}
    classes = [int(r[label]) for r in sorted(seen, key=lambda r: r["first"])]
    start = 0
    bounds = {}
    for c in classes:
        n_c = counts[c]
        # labels, class after class, dealt round-robin: fold i gets the j = i (mod k) positions
        alloc = [(start + n_c - i + k - 1) // k - (start - i + k - 1) // k for i in range(k)]
        cum, acc = [], 0
        for a in alloc:
            acc += a
            cum.append(acc)
        bounds[c] = cum
        start += n_c
    # two keys, one of them ~all rows: rank within class over time chunks
    chunked, chunk_col = plan_time_chunks(df, [order_col], "_cls_chunk", n_rows=sum(counts.values()))
    ranked = keyed_expanding(chunked, label, [order_col], None, rn_col="_cls_rn", chunk_col=chunk_col)
    if chunk_col:
        ranked = ranked.drop(chunk_col)
    fold = F.lit(k - 1)
    for c in classes:
        expr = F.lit(k - 1)
        for i in reversed(range(k)):
            expr = F.when(F.col("_cls_rn") <= bounds[c][i], F.lit(i)).otherwise(expr)
        fold = F.when(F.col(label) == c, expr).otherwise(fold)
    return ranked.withColumn(out_col, fold).drop("_cls_rn")


def fit_meta_learner(oof: DataFrame, model_cols: Sequence[str], label: str = "isFraud", C: float = META_C,
                     order_col: str = "pos", calibrate: bool = True) -> CalibratedLinear:
    """STK3 + STK4: base LR on all rows, then three stratified contiguous folds
    (in ``order_col``, the time position) each refitting the LR on two folds
    and Platt-scaling it on the third."""
    oof = oof.select(order_col, label, *model_cols).persist(StorageLevel.MEMORY_AND_DISK)
    n = oof.count()
    base = fit_logistic(oof, model_cols, label, C, n)
    if not calibrate:
        oof.unpersist()
        return CalibratedLinear(base)
    folded = stratified_contiguous_folds(oof, label, order_col).persist(StorageLevel.MEMORY_AND_DISK)

    def fold_fit(j):
        tr = folded.filter(F.col("_cal_fold") != j)
        te = folded.filter(F.col("_cal_fold") == j)
        m = fit_logistic(tr, model_cols, label, C)
        a, b = fit_platt(te, m.logit(), label)
        return m, a, b

    # the three calibration folds are independent fits: run them concurrently
    with ThreadPoolExecutor(max_workers=CALIBRATION_FOLDS) as pool:
        folds = list(pool.map(fold_fit, range(CALIBRATION_FOLDS)))
    folded.unpersist()
    oof.unpersist()
    return CalibratedLinear(base, folds)


# --- STK5: post-hoc calibrators -------------------------------------------------------------

@dataclass
class ScoreCalibrator:
    method: str
    a: float | None = None
    b: float | None = None
    iso: object | None = None

    def transform(self, df: DataFrame, score: str, out_col: str = "calibrated") -> DataFrame:
        if self.method == "sigmoid":
            if self.a is None:
                raise RuntimeError("Call fit_calibrator() before transform()")
            z = F.lit(self.a) * F.col(score) + F.lit(self.b)
            return df.withColumn(out_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        if self.iso is None:
            raise RuntimeError("Call fit_calibrator() before transform()")
        out = self.iso.setFeaturesCol(score).setPredictionCol(out_col).transform(df)
        return out


def fit_calibrator(df: DataFrame, score: str, label: str = "isFraud", method: str = "sigmoid") -> ScoreCalibrator:
    if method == "sigmoid":
        a, b = fit_platt(df, F.col(score), label)
        return ScoreCalibrator("sigmoid", a, b)
    if method == "isotonic":
        iso = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="_iso").fit(
            df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))
        return ScoreCalibrator("isotonic", iso=iso)
    raise ValueError("method must be 'sigmoid' or 'isotonic'")


# --- STK8: leave-one-out ablation -------------------------------------------------------------

def leave_one_out_ablation(oof: DataFrame, model_cols: Sequence[str], label: str = "isFraud",
                           C: float = META_C) -> DataFrame:
    """In-sample LR AUC with all models and without each one; ``drop`` and the
    most valuable model (largest drop)."""
    n = oof.count()

    def auc_of(cols):
        m = fit_logistic(oof, cols, label, C, n)
        scored = oof.select(label, m.proba().alias("_s"))
        return roc_auc(threshold_curve(scored, "_s", label)).first()["roc_auc"]

    full = auc_of(list(model_cols))
    rows = []
    for m in model_cols:
        rest = [c for c in model_cols if c != m]
        a = auc_of(rest) if rest else 0.5
        rows.append((m, float(full), float(a), float(full - a)))
    spark = oof.sparkSession
    out = spark.createDataFrame(rows, "model string, full_auc double, auc_without double, auc_drop double")
    mvp = max(rows, key=lambda r: r[3])[0]
    return out.withColumn("is_mvp", (F.col("model") == mvp).cast("int"))


# --- DOC4: feature stability over folds ----------------------------------------------------

def feature_stability(importances: DataFrame, n_folds: int) -> tuple[DataFrame, DataFrame]:
    """Per (model, feature) and overall: mean, std, fold coverage (share of
    folds with importance > 0), cv = std / mean, and
    ``stability_score = mean * coverage / (1 + cv)`` (our choice; the source
    names the score without defining it).  Input: model, fold, feature, importance."""
    def summarize(by):
        g = importances.groupBy(*by).agg(
            F.avg("importance").alias("mean_importance"),
            F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("std_importance"),
            (F.count_if(F.col("importance") > 0) / F.lit(float(n_folds))).alias("fold_coverage"))
        cv = F.when(F.col("mean_importance") > 0, F.col("std_importance") / F.col("mean_importance")).otherwise(
            F.lit(0.0))
        return g.withColumn("cv_importance", cv).withColumn(
            "stability_score", F.col("mean_importance") * F.col("fold_coverage") / (1 + F.col("cv_importance")))
    return summarize(["model", "feature"]), summarize(["feature"])


def fold_importances(model, features: Sequence[str], model_name: str, fold: int) -> list[tuple]:
    """Rows (model, fold, feature, importance) of a fitted tree ensemble."""
    return [(model_name, fold, f, float(v)) for f, v in zip(features, model.importances)]

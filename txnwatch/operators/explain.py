"""Deterministic explanations for every row (XAI1-XAI12).

The background statistics (per-feature median, population std, quartiles and
mean of all background rows) come from value counts and one grouped
aggregation; one row per feature is collected to the driver.  Everything per row is an array/struct
column expression: contributions, top-k pairs, greedy counterfactuals for a
linear-logistic model, anchor rules and the narrative template.  Only the
local-fidelity proxy (128 perturbations and a least-squares fit per row) runs
in Python, vectorised per Arrow batch with ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.operators.models import MODEL_FILL, LinearModel
from txnwatch.operators.scan import exact_quantiles

# Fixed report parameters and headings.
SCALE_EPS = 1e-6
TOP_LIME = 10
TOP_SHAP_LINES = 5
TOP_ANCHORS = 3
TOTAL_CFS = 3
FLIP_AT = 0.5
HIGH_RISK, MEDIUM_RISK = 0.60, 0.35
FIDELITY_SAMPLES = 128
FIDELITY_TOP = 5
FRD_TOP = 3
HEADINGS = ["Fraud Risk Assessment", "Key Factors", "Local Explanation"]


@dataclass
class Background:
    features: list[str]
    median: list[float]
    scale: list[float]
    q1: list[float]
    q3: list[float]
    mean: list[float]


def background_stats(bg: DataFrame, features: Sequence[str]) -> Background:
    """AGG9: median, population std + 1e-6, quartiles and mean per feature over
    all background rows, on the same -999-filled values the rows are explained with."""
    features = list(features)
    long = bg.select(*[_x(c).alias(c) for c in features]).unpivot([], features, "feature", "value")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], keys=["feature"])
    qw = q.groupBy("feature").agg(*[F.max(F.when(F.col("q_index") == i, F.col("value"))).alias(n)
                                    for i, n in enumerate(["q1", "median", "q3"])])
    mom = long.groupBy("feature").agg(F.stddev_pop("value").alias("sd"), F.avg("value").alias("mean"))
    stats = qw.join(mom, "feature")
    rows = {r["feature"]: r for r in stats.collect()}  # one row per feature
    get = lambda f, k, d=float("nan"): (rows[f][k] if f in rows and rows[f][k] is not None else d)
    return Background(features,
                      [get(f, "median") for f in features],
                      [get(f, "sd", 0.0) + SCALE_EPS for f in features],
                      [get(f, "q1") for f in features],
                      [get(f, "q3") for f in features],
                      [get(f, "mean") for f in features])


def feature_weights(n: int, importances: Sequence[float] | None = None,
                    coef: Sequence[float] | None = None) -> list[float]:
    """Importances, else |coef|, else ones (length mismatch -> ones)."""
    if importances is not None and len(importances) == n:
        return [float(v) for v in importances]
    if coef is not None and len(coef) == n:
        return [abs(float(v)) for v in coef]
    return [1.0] * n


def _x(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MODEL_FILL)), F.lit(MODEL_FILL))


def contribution_array(bg: Background, weights: Sequence[float]) -> Column:
    """XAI3: ``array<struct<idx, feature, x, contribution>>`` per row with
    ``((x - median) / scale) * weight``."""
    items = []
    for i, f in enumerate(bg.features):
        c = (_x(f) - F.lit(bg.median[i])) / F.lit(bg.scale[i]) * F.lit(float(weights[i]))
        items.append(F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"), _x(f).alias("x"),
                              c.alias("contribution")))
    return F.array(*items)


def ranked_contributions(arr: Column) -> Column:
    """SRT5: contributions by |value| descending (ties: later feature first).

    Sorted with the natural (codegen) struct ordering on ``(-|c|, -idx)``
    rather than an interpreted comparator lambda."""
    keyed = F.transform(arr, lambda s: F.struct(
        (-F.abs(s["contribution"])).alias("k1"), (-s["idx"]).alias("k2"), s["idx"].alias("idx"),
        s["feature"].alias("feature"), s["x"].alias("x"), s["contribution"].alias("contribution")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(
        s["idx"].alias("idx"), s["feature"].alias("feature"), s["x"].alias("x"),
        s["contribution"].alias("contribution")))


def top_pairs(ranked: Column, k: int) -> Column:
    """XAI4: the first ``k`` (feature, contribution) pairs of ranked contributions."""
    return F.transform(F.slice(ranked, 1, k),
                       lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("weight"),
                                          s["idx"].alias("idx")))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def counterfactuals(ranked: Column, bg: Background, model: LinearModel, total: int = TOTAL_CFS) -> Column:
    """XAI5: walk features by |contribution|, setting each to the background
    median cumulatively; keep steps up to ``total`` or the first flip."""
    w = F.array(*[F.lit(float(v)) for v in model.coef])
    med = F.array(*[F.lit(float(v)) for v in bg.median])
    z0 = model.logit_of({f: _x(f) for f in bg.features})
    steps = []
    delta = F.lit(0.0)
    for j in range(min(total, len(bg.features))):
        s = F.element_at(ranked, j + 1)
        wi = F.element_at(w, s["idx"] + 1)
        mi = F.element_at(med, s["idx"] + 1)
        delta = delta + wi * (mi - s["x"])
        score = _sigmoid(z0 + delta)
        steps.append(F.struct(s["feature"].alias("feature"), s["x"].alias("original_value"),
                              mi.alias("suggested_value"), score.alias("new_score"),
                              (score < FLIP_AT).alias("flipped")))
    arr_steps = F.array(*steps)
    first_flip = F.array_position(F.transform(arr_steps, lambda s: s["flipped"]), F.lit(True))
    keep = F.when(first_flip > 0, first_flip).otherwise(F.lit(len(steps)))
    return F.slice(arr_steps, 1, keep.cast("int"))


def anchor_rules(ranked: Column, bg: Background, k: int = TOP_ANCHORS) -> Column:
    """XAI6: for the top ``k`` features: ``>= q3``, ``<= q1`` or ``q1 < f < q3``."""
    q1 = F.array(*[F.lit(float(v)) for v in bg.q1])
    q3 = F.array(*[F.lit(float(v)) for v in bg.q3])

    def rule(s):
        lo, hi = F.element_at(q1, s["idx"] + 1), F.element_at(q3, s["idx"] + 1)
        kind = F.when(s["x"] >= hi, F.lit(">=")).when(s["x"] <= lo, F.lit("<=")).otherwise(F.lit("between"))
        text = (F.when(kind == ">=", F.format_string("%s >= %.3f", s["feature"], hi))
                .when(kind == "<=", F.format_string("%s <= %.3f", s["feature"], lo))
                .otherwise(F.format_string("%.3f < %s < %.3f", lo, s["feature"], hi)))
        return F.struct(s["feature"].alias("feature"), kind.alias("kind"), lo.alias("q1"), hi.alias("q3"),
                        text.alias("rule"))
    return F.transform(F.slice(ranked, 1, k), rule)


def risk_tier(score: Column) -> Column:
    return (F.when(score >= HIGH_RISK, F.lit("HIGH")).when(score >= MEDIUM_RISK, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def narrative(shap_top: Column, lime_top: Column, score: Column) -> Column:
    """XAI7: the fixed-heading Markdown summary."""
    shap_lines = F.transform(F.slice(shap_top, 1, TOP_SHAP_LINES), lambda s: F.format_string(
        "- **%s**: %s fraud risk (impact: %.4f)\n", s["feature"],
        F.when(s["weight"] > 0, F.lit("increases")).otherwise(F.lit("decreases")), F.abs(s["weight"])))
    lime_lines = F.transform(F.slice(lime_top, 1, TOP_SHAP_LINES), lambda s: F.format_string(
        "- %s: weight = %.4f\n", s["feature"], s["weight"]))
    shap_txt = F.when(F.size(shap_top) > 0, F.array_join(shap_lines, "")).otherwise(
        F.lit("- No SHAP features were available.\n"))
    lime_txt = F.when(F.size(lime_top) > 0, F.array_join(lime_lines, "")).otherwise(
        F.lit("- No LIME features were available.\n"))
    return F.concat(F.lit(f"## {HEADINGS[0]}\n"),
                    F.format_string("**Risk Level: %s** (Score: %.2f%%)\n\n", risk_tier(score), score * 100),
                    F.lit(f"### {HEADINGS[1]} (SHAP):\n"), shap_txt,
                    F.lit(f"\n### {HEADINGS[2]} (LIME):\n"), lime_txt)


def explain_rows(df: DataFrame, bg: Background, model: LinearModel | None = None,
                 weights: Sequence[float] | None = None, score_col: str | None = None) -> DataFrame:
    """XAI8: full audit of every row.  The score is the model probability when
    a linear model is given (the uncalibrated base learner), else ``score_col``."""
    w = list(weights) if weights is not None else feature_weights(
        len(bg.features), coef=model.coef if model else None)
    arr = contribution_array(bg, w)
    score = model.proba_of({f: _x(f) for f in bg.features}) if model else F.col(score_col)
    staged = df.withColumns({"xai_score": score, "_contrib": arr})
    # sorted once; everything below slices this column
    staged = staged.withColumn("_ranked", ranked_contributions(F.col("_contrib")))
    out = staged.withColumns({
        "shap_top": top_pairs(F.col("_ranked"), TOP_SHAP_LINES),
        "lime_top": top_pairs(F.col("_ranked"), TOP_LIME),
        "anchors": anchor_rules(F.col("_ranked"), bg),
    })
    out = out.withColumns({
        "anchor_precision": F.greatest(F.col("xai_score"), 1 - F.col("xai_score")),
        "anchor_coverage": F.lit(1.0) / F.greatest(F.size("anchors"), F.lit(1)),
        "narrative": narrative(F.col("shap_top"), F.col("lime_top"), F.col("xai_score")),
    })
    if model is not None:
        out = out.withColumn("counterfactuals", counterfactuals(F.col("_ranked"), bg, model))
    return out.drop("_ranked")


# --- XAI9-12: harness ------------------------------------------------------------------

def harness_metrics(explained: DataFrame, bg: Background, model: LinearModel | None = None) -> DataFrame:
    """Per-row proxy metrics: feature-removal degradation (linear model),
    counterfactual validity, anchor precision and narrative completeness."""
    cols = {
        "anchor_precision_m": F.col("anchor_precision"),
        "nl_completeness": sum((F.col("narrative").contains(h).cast("double") for h in HEADINGS),
                               F.lit(0.0)) / len(HEADINGS),
    }
    if model is not None:
        w = F.array(*[F.lit(float(v)) for v in model.coef])
        med = F.array(*[F.lit(float(v)) for v in bg.median])
        top = F.slice(F.col("shap_top"), 1, FRD_TOP)
        xs = F.array(*[_x(f) for f in bg.features])
        delta = F.aggregate(top, F.lit(0.0), lambda acc, s: acc + F.element_at(w, s["idx"] + 1) * (
            F.element_at(med, s["idx"] + 1) - F.element_at(xs, s["idx"] + 1)))
        z0 = model.logit_of({f: _x(f) for f in bg.features})
        cols["frd_proxy"] = _sigmoid(z0) - _sigmoid(z0 + delta)
        cfs = F.col("counterfactuals")
        cols["dice_validity_rate"] = F.when(F.size(cfs) > 0, F.aggregate(
            cfs, F.lit(0.0), lambda acc, s: acc + s["flipped"].cast("double")) / F.size(cfs)).otherwise(F.lit(0.0))
    return explained.withColumns(cols)


def lime_fidelity(explained: DataFrame, bg: Background, model: LinearModel, id_col: str = "TransactionID",
                  n_samples: int = FIDELITY_SAMPLES, seed: int = 42) -> DataFrame:
    """XAI10: R^2 of a linear surrogate on ``n_samples`` Gaussian perturbations
    of the top-5 LIME features (per row; seeded by ``xxhash64(id, seed)``)."""
    feats = bg.features
    coef = np.array(model.coef, dtype=float)
    intercept = float(model.intercept)
    scale = np.array(bg.scale, dtype=float)
    src = explained.select(id_col, F.xxhash64(F.col(id_col), F.lit(seed)).alias("_seed"),
                           F.array(*[_x(f) for f in feats]).alias("_xs"),
                           F.transform(F.slice(F.col("lime_top"), 1, FIDELITY_TOP), lambda s: s["idx"]).alias("_top"))
    id_type = dict(explained.dtypes)[id_col]

    def normals(seeds: np.ndarray, k: int) -> np.ndarray:
        """(row, sample, k) standard normals, a function of each row's seed alone
        (Box-Muller over a counter hash)."""
        n = n_samples * k
        counter = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = seeds[:, None] + counter[None, :]
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(mult)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53
        r = np.sqrt(-2.0 * np.log1p(-u[:, :n])) * np.cos(2.0 * np.pi * u[:, n:])
        return r.reshape(len(seeds), n_samples, k)

    def r_squared(seeds: np.ndarray, xs: np.ndarray, top: np.ndarray) -> np.ndarray:
        """All rows of a batch at once: perturb the top features, score the linear
        model, regress the score on them by the centred normal equations."""
        moved = normals(seeds, top.shape[1]) * scale[top][:, None, :]
        logit = (xs @ coef + intercept)[:, None] + np.einsum("bsk,bk->bs", moved, coef[top])
        y = 1.0 / (1.0 + np.exp(-logit))
        a = moved - moved.mean(axis=1, keepdims=True)
        c = y - y.mean(axis=1, keepdims=True)
        gram = np.einsum("bsk,bsl->bkl", a, a)
        ridge = 1e-12 * np.einsum("bkk->b", gram)[:, None, None] * np.eye(gram.shape[1]) + 1e-300 * np.eye(gram.shape[1])
        beta = np.linalg.solve(gram + ridge, np.einsum("bsk,bs->bk", a, c)[:, :, None])[:, :, 0]
        left = ((c - np.einsum("bsk,bk->bs", a, beta)) ** 2).sum(axis=1)
        total = (c ** 2).sum(axis=1)
        return np.where(total > 0, 1.0 - left / np.where(total > 0, total, 1.0), 1.0)

    def fn(it):
        for pdf in it:
            out = np.full(len(pdf), np.nan)
            sizes = pdf["_top"].map(len).to_numpy()
            for k in np.unique(sizes[sizes > 0]):
                for rows in np.array_split(np.flatnonzero(sizes == k), max(1, int((sizes == k).sum()) // 1024)):
                    out[rows] = r_squared(pdf["_seed"].to_numpy()[rows].astype(np.int64).view(np.uint64),
                                          np.stack(pdf["_xs"].to_numpy()[rows]).astype(float),
                                          np.stack(pdf["_top"].to_numpy()[rows]).astype(int))
            yield pd.DataFrame({id_col: pdf[id_col], "lime_local_fidelity_proxy_r2": out})

    schema = T.StructType([T.StructField(id_col, T.LongType() if id_type == "bigint" else T.IntegerType()),
                           T.StructField("lime_local_fidelity_proxy_r2", T.DoubleType())])
    return src.mapInPandas(fn, schema)


def harness_rollup(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """XAI12: mean of each harness metric (NULL/NaN ignored)."""
    names = [c for c in ("frd_proxy", "lime_local_fidelity_proxy_r2", "dice_validity_rate", "anchor_precision_m",
                         "nl_completeness") if c in metrics.columns]
    aggs = [F.avg(F.when(~F.isnan(F.col(c)), F.col(c))).alias(c) for c in names]
    return metrics.groupBy(*by).agg(*aggs) if by else metrics.agg(*aggs)


# --- XAI1 / XAI2: linear meta-contributions ----------------------------------------------

def linear_contribution_table(explain: DataFrame, background: DataFrame, model: LinearModel, by: Sequence[str] = ()) -> DataFrame:
    """XAI1: per meta-feature coefficient, background mean, holdout mean,
    mean signed / absolute contribution, std (ddof=1) and positive rate; within each group of ``by``, if given."""
    feats = model.features
    bg_mean = background.agg(*[F.avg(f).alias(f) for f in feats]).first()
    contrib = explain.select(*by, *[((F.col(f) - F.lit(float(bg_mean[f]))) * F.lit(float(w))).alias(f)
                               for f, w in zip(feats, model.coef)] +
                             [F.col(f).alias(f"_x_{f}") for f in feats])
    long = contrib.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("meta_feature"), F.col(f).alias("c"),
                                                          F.col(f"_x_{f}").alias("x"))
                                                 for f in feats])).alias("s")).select(*by, "s.*")
    coefs = F.create_map(*[x for f, w in zip(feats, model.coef) for x in (F.lit(f), F.lit(float(w)))])
    means = F.create_map(*[x for f in feats for x in (F.lit(f), F.lit(float(bg_mean[f])))])
    g = long.groupBy(*by, "meta_feature").agg(
        F.avg("x").alias("holdout_mean_score"), F.avg("c").alias("mean_signed_contribution"),
        F.avg(F.abs("c")).alias("mean_abs_contribution"),
        F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("std_contribution"),
        F.avg((F.col("c") > 0).cast("double")).alias("positive_contribution_rate"))
    return (g.withColumns({"coefficient": coefs[F.col("meta_feature")],
                           "background_mean_score": means[F.col("meta_feature")]})
            .orderBy(F.desc("mean_abs_contribution")))


def top_risk_local_table(explain: DataFrame, background: DataFrame, model: LinearModel, score: str,
                         order_col: str = "TransactionID") -> DataFrame:
    """XAI2: contributions of the highest-scoring row (first in order on ties)."""
    feats = model.features
    bg_mean = background.agg(*[F.avg(f).alias(f) for f in feats]).first()
    top = explain.agg(F.max_by(F.struct(order_col, *feats), F.struct(F.col(score), -F.col(order_col))).alias("t"))
    rows = [F.struct(F.lit(f).alias("meta_feature"), F.col(f"t.{f}").alias("base_model_score"),
                     F.lit(float(bg_mean[f])).alias("background_mean_score"), F.lit(float(w)).alias("coefficient"),
                     ((F.col(f"t.{f}") - F.lit(float(bg_mean[f]))) * F.lit(float(w))).alias("local_contribution"))
            for f, w in zip(feats, model.coef)]
    out = top.select(F.col(f"t.{order_col}").alias(order_col), F.explode(F.array(*rows)).alias("s")).select(
        order_col, "s.*")
    return out.withColumn("abs_local_contribution", F.abs("local_contribution")).orderBy(
        F.desc("abs_local_contribution"))

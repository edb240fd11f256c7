"""Paired significance tests and multi-run summaries (STA1-3, AGG7, AGG8).

The statistics are aggregations; p-values are evaluated on the one-row
result with a vectorised pandas UDF (no per-row Python in the data path).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed report constants.
T_975_THREE_RUNS = 4.303
Z_975 = 1.96


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularised incomplete beta (Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    return regularized_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_1_sf(stat: float) -> float:
    return math.erfc(math.sqrt(max(stat, 0.0) / 2.0))


@F.pandas_udf(T.DoubleType())
def _chi2_p(stat: pd.Series) -> pd.Series:
    return stat.map(lambda s: float("nan") if pd.isna(s) else chi2_1_sf(float(s)))


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if not (pd.isna(a) or pd.isna(b)) else float("nan")
                      for a, b in zip(t, dof)])


def mcnemar_counts(df: DataFrame, label: str, pred_a: Column, pred_b: Column) -> DataFrame:
    """STA1 statistic: discordant counts and the continuity-corrected chi-square."""
    y = F.col(label).cast("int")
    a_ok = pred_a.cast("int") == y
    b_ok = pred_b.cast("int") == y
    agg = df.agg(F.count_if(a_ok & ~b_ok).alias("b"), F.count_if(~a_ok & b_ok).alias("c"))
    disc = F.col("b") + F.col("c")
    stat = F.when(disc == 0, F.lit(0.0)).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, 2) / disc)
    return agg.select("b", "c", stat.alias("statistic"), disc.alias("discordant"))


def mcnemar_test(df: DataFrame, label: str, pred_a: Column, pred_b: Column) -> DataFrame:
    counts = mcnemar_counts(df, label, pred_a, pred_b)
    return counts.withColumn("p_value", F.when(F.col("discordant") == 0, F.lit(1.0))
                             .otherwise(_chi2_p(F.col("statistic"))))


def paired_diff_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))


def cohens_d(df: DataFrame, a: str, b: str) -> DataFrame:
    """STA2: paired Cohen's d (ddof=1); n < 2 -> NULL; zero spread -> 0."""
    s = paired_diff_stats(df, a, b)
    d = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
         .when(F.col("sd_diff") == 0, F.lit(0.0))
         .otherwise(F.col("mean_diff") / F.col("sd_diff")))
    return s.select("n", d.alias("cohens_d"))


def paired_t_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """STA3 statistic: ``mean(d) sqrt(n) / sd(d)`` with ``n - 1`` degrees of freedom."""
    s = paired_diff_stats(df, a, b)
    t = F.when(F.col("n") < 2, F.lit(None).cast("double")).otherwise(
        F.try_divide(F.col("mean_diff") * F.sqrt(F.col("n")), F.col("sd_diff")))
    return s.select("n", t.alias("statistic"), (F.col("n") - 1).alias("dof"))


def paired_ttest(df: DataFrame, a: str, b: str) -> DataFrame:
    s = paired_t_statistic(df, a, b)
    return s.withColumn("p_value", _t_p(F.col("statistic"), F.col("dof").cast("double")))


def unpivot(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], var_name: str = "metric",
            value_name: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(value_cols), var_name, value_name)


def summarize_runs(runs: DataFrame, metric_cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """AGG7: per metric mean, std (ddof=1; 0 for one run), min, max and a 95%
    interval (t = 4.303 for three runs, else 1.96; zero width for one run)."""
    long = unpivot(runs.select(*ids, *[F.col(c).cast("double").alias(c) for c in metric_cols]), ids, metric_cols)
    g = long.groupBy("metric").agg(F.count("value").alias("n_runs"), F.avg("value").alias("mean"),
                                   F.stddev_samp("value").alias("_sd"), F.min("value").alias("min"),
                                   F.max("value").alias("max"))
    n = F.col("n_runs")
    sd = F.when(n > 1, F.col("_sd")).otherwise(F.lit(0.0))
    t = F.when(n == 3, F.lit(T_975_THREE_RUNS)).otherwise(F.lit(Z_975))
    half = F.when(n > 1, t * sd / F.sqrt(n)).otherwise(F.lit(0.0))
    return g.select("metric", "n_runs", "mean", sd.alias("std"), "min", "max",
                    (F.col("mean") - half).alias("ci95_low"), (F.col("mean") + half).alias("ci95_high"))


def summarize_contributions(per_run: DataFrame, key: str = "meta_feature") -> DataFrame:
    """AGG8: meta-contribution summary over runs, ordered by mean |contribution|."""
    return (per_run.groupBy(key).agg(
        F.avg("mean_abs_contribution").alias("mean_abs_contribution_mean"),
        F.stddev_samp("mean_abs_contribution").alias("mean_abs_contribution_std"),
        F.avg("mean_signed_contribution").alias("mean_signed_contribution_mean"),
        F.avg("coefficient").alias("coefficient_mean"),
        F.avg("holdout_mean").alias("holdout_mean"),
        F.avg("background_mean").alias("background_mean"))
        .orderBy(F.desc("mean_abs_contribution_mean")))

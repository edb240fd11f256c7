"""UID score smoothing (STK6 / STK7) - a batch post-process, never a causal
feature: every row sees the mean over its whole UID group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLEND_RATIO = 0.7


def _uid_group_stats(df: DataFrame, uid: str, score: str) -> DataFrame:
    # group statistics by aggregate + join (pre-aggregated, skew friendly)
    stats = df.groupBy(uid).agg(F.avg(score).alias("_uid_mean"), F.count(score).alias("_uid_n"))
    return df.join(stats, uid, "left")


def uid_average_predictions(df: DataFrame, score: str = "fraud_score", uid: str = "UID",
                            blend_ratio: float = BLEND_RATIO, out_col: str | None = None) -> DataFrame:
    """Groups with 2+ scored rows: ``blend * s + (1 - blend) * uid_mean``."""
    out_col = out_col or score
    j = _uid_group_stats(df, uid, score)
    smoothed = F.when(F.col("_uid_n") >= 2,
                      F.lit(blend_ratio) * F.col(score) + F.lit(1.0 - blend_ratio) * F.col("_uid_mean")
                      ).otherwise(F.col(score))
    return j.withColumn(out_col, smoothed).drop("_uid_mean", "_uid_n")



def uid_full_average(df: DataFrame, score: str = "fraud_score", uid: str = "UID",
                     out_col: str = "uid_mean_score") -> DataFrame:
    """STK7: every row gets its UID's mean score (aggregate + join, so a hot
    UID is pre-aggregated map-side instead of buffered in one window task)."""
    stats = df.groupBy(uid).agg(F.avg(score).alias(out_col))
    return df.join(stats, uid, "left")

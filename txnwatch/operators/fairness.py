"""Group fairness audits of AUTO_BLOCK decisions (FAI1-FAI3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.route import AUTO_BLOCK

GAP_WARNING = 0.05


def _rate4(x) -> F.Column:
    # percent-formatted with two decimals and parsed back: 4 decimals, half-even
    return F.bround(x, 4)


def _gap(col: str) -> F.Column:
    return F.when(F.count(F.lit(1)) >= 2, F.max(col) - F.min(col)).otherwise(F.lit(0.0))


def demographic_parity(df: DataFrame, protect: str = "card4", decision: str = "decision") -> DataFrame:
    """FAI1: per non-null group size and AUTO_BLOCK rate; ``dp_difference`` =
    max - min of the rounded rates (0 with fewer than two groups)."""
    g = (df.filter(F.col(protect).isNotNull()).groupBy(protect)
         .agg(F.count(F.lit(1)).alias("size"),
              _rate4(F.avg((F.col(decision) == AUTO_BLOCK).cast("double"))).alias("block_rate")))
    gap = g.agg(_gap("block_rate").alias("dp_difference"))
    return g.crossJoin(F.broadcast(gap))  # one-row scalar


def equalized_odds(df: DataFrame, protect: str = "card4", label: str = "isFraud",
                   decision: str = "decision") -> DataFrame:
    """FAI2: per group TPR and FPR of AUTO_BLOCK (empty class -> 0) and gaps."""
    blk = (F.col(decision) == AUTO_BLOCK)
    y = F.col(label) == 1
    g = (df.filter(F.col(protect).isNotNull()).groupBy(protect)
         .agg(F.count(F.lit(1)).alias("size"), F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"),
              F.count_if(y & blk).alias("_tp"), F.count_if(~y & blk).alias("_fp")))
    g = g.select(protect, "size",
                 _rate4(F.when(F.col("_p") > 0, F.col("_tp") / F.col("_p")).otherwise(F.lit(0.0))).alias("tpr"),
                 _rate4(F.when(F.col("_n") > 0, F.col("_fp") / F.col("_n")).otherwise(F.lit(0.0))).alias("fpr"))
    gaps = g.agg(_gap("tpr").alias("tpr_difference"), _gap("fpr").alias("fpr_difference"))
    return g.crossJoin(F.broadcast(gaps))


def full_report(df: DataFrame, protect: str = "card4", label: str = "isFraud",
                decision: str = "decision") -> DataFrame:
    """FAI3: demographic parity and equalized odds side by side per group."""
    dp = demographic_parity(df, protect, decision)
    eo = equalized_odds(df, protect, label, decision).drop("size")
    out = dp.join(eo, protect)
    return out.withColumn("warning", ((F.col("dp_difference") >= GAP_WARNING)
                          | (F.col("tpr_difference") >= GAP_WARNING)
                          | (F.col("fpr_difference") >= GAP_WARNING)).cast("int"))

"""Mergeable quantile sketches: the scale option of AGG4, DRF1, DRF2 and STR4.

A table holds one KLL sketch per day and feature, a few kilobytes each, in one partition folder per day.  A new day
costs a scan of that day; quantiles, breakpoints and PSI of any set of days come from merged sketches without
touching a transaction.  Ranks are off by ``rank_error`` at most for nearly all quantiles.  The exact operators stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.drift import MODEL_FILL, N_PSI_BINS, psi_tier

#: Size parameter of a sketch: it keeps about three times as many values.
K = 400


def rank_error(k: int = K) -> float:
    """The published bound on a sketch's normalised rank error at 99 % confidence, for one quantile."""
    return 2.296 / k ** 0.9723


def sketch_days(df: DataFrame, day: Column, features: Sequence[str], k: int = K, fill: float | None = MODEL_FILL) -> DataFrame:
    """``(day, feature, n, sketch)`` of a frame; NULL is ``fill``, or left out where that is None."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = df.select(day.cast("int").alias("day"), values.alias("v")).select("day", "v.feature", "v.value")
    long = long.filter(F.col("value").isNotNull()) if fill is None else long.withColumn("value", F.coalesce("value", F.lit(fill)))
    return long.groupBy("day", "feature").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def store_days(sketches: DataFrame, path: str) -> None:
    """Write the days of ``sketches`` into the table at ``path``; a day that is there already is replaced, others stay."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("day int, feature string, n long, sketch binary").parquet(path)


def merged(sketches: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """One sketch per group, merged map-side first."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(feature, prob, value)`` over all rows of the sketches."""
    one = merged(sketches)
    at = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs]))
    return one.select("feature", at.alias("q")).select("feature", "q.prob", "q.value")


def sketched_psi(expected: DataFrame, actual: DataFrame, n_bins: int = N_PSI_BINS) -> DataFrame:
    """DRF1 from two tables of sketches: breakpoints are distinct quantiles of the expected side, bin counts differences of ranks on
    either side, +1 smoothing; fewer than three breakpoints -> PSI 0."""
    both = merged(expected).join(merged(actual).select("feature", F.col("n").alias("m"), F.col("sketch").alias("other")), "feature")
    # a rank is asked at a constant, so the breakpoints (n_bins + 1 per feature at most) come to the driver
    cuts = F.array_distinct(F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(i / n_bins)) for i in range(n_bins + 1)]))
    edges = {r.feature: r.bp for r in both.select("feature", cuts.alias("bp")).collect()}

    def ranks(sketch: str) -> Column:
        out = F.lit(None).cast("array<double>")
        for f, bp in edges.items():
            out = F.when(F.col("feature") == f, F.array(*[F.kll_sketch_get_rank_double(sketch, F.lit(float(v))) for v in bp])).otherwise(out)
        return out

    ends = both.select("feature", "n", "m", ranks("sketch").alias("re"), ranks("other").alias("ra")).withColumn("size", F.size("re"))
    bins = ends.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1)))))

    def count(side: str, total: str) -> Column:
        """Rows of bin i: up to its upper edge less those up to its lower one; the first bin has its lower edge too."""
        lower = F.when(F.col("i") == 1, F.lit(0.0)).otherwise(F.get(side, F.col("i") - 1))
        return F.greatest((F.coalesce(F.get(side, F.col("i")), lower) - lower) * F.col(total), F.lit(0.0))

    counts = bins.select("feature", "size", count("re", "n").alias("ec"), count("ra", "m").alias("ac"))
    sums = counts.groupBy("feature").agg(F.sum("ec").alias("E"), F.sum("ac").alias("A"), F.first("size").alias("nb"))
    g = counts.join(sums, "feature")
    n_own = F.greatest(F.col("nb") - 1, F.lit(1))
    pe, pa_ = (F.col("ec") + 1) / (F.col("E") + n_own), (F.col("ac") + 1) / (F.col("A") + n_own)
    psi = g.groupBy("feature").agg(F.sum((pa_ - pe) * F.log(pa_ / pe)).alias("psi"), F.first("nb").alias("nb"))
    out = psi.select("feature", F.when(F.col("nb") < 3, F.lit(0.0)).otherwise(F.col("psi")).alias("psi"))
    return out.withColumn("tier", psi_tier(F.col("psi"))).orderBy(F.desc("psi"), "feature")

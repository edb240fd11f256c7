"""Distribution drift between a reference and an observed frame (DRF1-DRF3).

All features are handled in one job: the frames are unpivoted to
``(feature, value)`` once and every statistic is a grouped aggregation keyed
by feature, so hundreds of features cost one scan, not one job each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.scan import auto_chunks, exact_quantiles, keyed_prefix_sums
from txnwatch.session import cut_lineage

# Fixed tiers and defaults.
N_PSI_BINS = 10
PSI_MODERATE, PSI_SIGNIFICANT, PSI_EXTREME = 0.10, 0.25, 1.0
WASSERSTEIN_THRESHOLD = 0.1
MODEL_FILL = -999.0


def long_form(df: DataFrame, features: Sequence[str], fill: float | None = MODEL_FILL) -> DataFrame:
    """``(feature, value)`` rows; NULL -> ``fill`` (or dropped when ``fill`` is None)."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    long = df.select(*cols).unpivot([], list(features), "feature", "value")
    if fill is None:
        return long.filter(F.col("value").isNotNull())
    return long.withColumn("value", F.coalesce(F.col("value"), F.lit(fill)))


def side_counts(expected: DataFrame, actual: DataFrame, features: Sequence[str], fill: float | None) -> DataFrame:
    """``(feature, value, e, a)``: how often each side has a value; both are
    unpivoted once, and what the statistics need is written from here."""
    both = long_form(expected, features, fill).withColumn("side", F.lit(0)).unionByName(
        long_form(actual, features, fill).withColumn("side", F.lit(1)))
    return cut_lineage(both.groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("e"),
                                                            F.count_if(F.col("side") == 1).alias("a")))


def psi_tier(psi) -> F.Column:
    return (F.when(psi >= PSI_SIGNIFICANT, F.lit("significant"))
            .when(psi >= PSI_MODERATE, F.lit("moderate")).otherwise(F.lit("stable")))


def score_psi_tier(psi) -> F.Column:
    return (F.when(psi >= PSI_EXTREME, F.lit("extreme"))
            .when(psi >= PSI_SIGNIFICANT, F.lit("significant"))
            .when(psi >= PSI_MODERATE, F.lit("moderate")).otherwise(F.lit("stable")))


def feature_psi(expected: DataFrame, actual: DataFrame, features: Sequence[str], n_bins: int = N_PSI_BINS,
                fill: float | None = MODEL_FILL) -> DataFrame:
    """DRF1: PSI per feature with breakpoints = distinct linear percentiles of
    the expected side; values outside the expected range are dropped; +1
    smoothing; fewer than three breakpoints -> PSI 0.  Sorted descending."""
    vc = side_counts(expected, actual, features, fill)
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(vc, "value", probs, keys=["feature"], count_col="e")
    # at most n_bins + 1 breakpoints per feature: compute once, reuse as a small table
    bp_rows = q.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("value"))).alias("bp")).collect()
    spark = expected.sparkSession
    bps = spark.createDataFrame([(r["feature"], [float(v) for v in r["bp"]]) for r in bp_rows],
                                "feature string, bp array<double>")
    nb = F.size("bp") - 1
    j = vc.join(F.broadcast(bps), "feature")  # one row per feature (bounded by the feature list)
    x = F.col("value")
    inner = F.slice(F.col("bp"), 2, F.greatest(nb - 1, F.lit(1)))
    b = F.when(nb <= 1, F.lit(0)).otherwise(F.size(F.filter(inner, lambda e: e <= x)))
    inside = (x >= F.element_at("bp", 1)) & (x <= F.element_at("bp", -1))
    counts = (j.filter(inside).withColumn("bin", b.cast("int"))
              .groupBy("feature", "bin").agg(F.sum("e").alias("ec"), F.sum("a").alias("ac")))
    grid = bps.select("feature", nb.alias("nb"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("bin"))
    g = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["ec", "ac"])
    tot = g.groupBy("feature").agg(F.sum("ec").alias("E"), F.sum("ac").alias("A"), F.first("nb").alias("nb"))
    g = g.join(tot.select("feature", "E", "A"), "feature")
    e = (F.col("ec") + 1) / (F.col("E") + F.col("nb"))
    a = (F.col("ac") + 1) / (F.col("A") + F.col("nb"))
    psi = g.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.first("nb").alias("nb"))
    out = psi.select("feature", F.when(F.col("nb") + 1 < 3, F.lit(0.0)).otherwise(F.col("psi")).alias("psi"))
    # features with fewer than two distinct breakpoints never reach the grid
    allf = bps.select("feature").join(out, "feature", "left").fillna(0.0, ["psi"])
    return allf.withColumn("tier", psi_tier(F.col("psi"))).orderBy(F.desc("psi"), "feature")


def score_psi(expected: DataFrame, actual: DataFrame, score: str = "fraud_score",
              n_bins: int = N_PSI_BINS) -> DataFrame:
    """DRF2: PSI of one score column with the score tiers."""
    out = feature_psi(expected, actual, [score], n_bins, fill=None)
    return out.select("feature", "psi", score_psi_tier(F.col("psi")).alias("tier"))


def wasserstein_drift(reference: DataFrame, observed: DataFrame, features: Sequence[str],
                      threshold: float = WASSERSTEIN_THRESHOLD, fill: float | None = None,
                      n_chunks: int | None = None) -> DataFrame:
    """DRF3: 1-D Wasserstein distance per feature (NULLs dropped, features with
    an empty side skipped), ``DRIFT`` above ``threshold``, sorted descending.

    ``W = sum_j |D_j| (v_{j+1} - v_j)`` with ``D`` the CDF gap, rewritten as
    ``sum_j v_j (|D_j - d_j| - |D_j|)`` so every distinct value needs only its
    own running sum (no look-ahead across tasks).
    """
    vc = side_counts(reference, observed, features, fill).select("feature", "value", F.col("e").alias("ca"), F.col("a").alias("cb"))
    n = vc.groupBy("feature").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb")).filter(
        (F.col("na") > 0) & (F.col("nb") > 0))
    chunk = None
    if n_chunks is None:
        n_chunks = auto_chunks(vc)
    if n_chunks > 1:
        from txnwatch.operators.scan import with_value_chunks
        vc = with_value_chunks(vc, ["feature"], "value", "_wchunk", n_chunks)
        chunk = "_wchunk"
    cum = keyed_prefix_sums(vc, ["feature"], ["value"], {"ca": F.col("ca"), "cb": F.col("cb")}, chunk)
    j = cum.join(n, "feature")
    d_own = F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")
    D = F.col("ca__cum") / F.col("na") - F.col("cb__cum") / F.col("nb")
    term = F.col("value") * (F.abs(D - d_own) - F.abs(D))
    w = j.groupBy("feature").agg(F.sum(term).alias("wasserstein_distance"))
    return (w.withColumn("status", F.when(F.col("wasserstein_distance") > threshold, F.lit("DRIFT"))
                         .otherwise(F.lit("STABLE")))
            .orderBy(F.desc("wasserstein_distance"), "feature"))


def top_drifted(report: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """SRT4: the ``n`` most drifted features (a top-k report)."""
    return report.orderBy(F.desc(metric), "feature").limit(n)

"""Exact ranking, threshold and calibration metrics as Spark aggregations.

Curve metrics (ROC-AUC with tied scores, average precision, F1-optimal
threshold) come from the threshold curve EVL0: one row per distinct score
with cumulative true/false positive counts in descending score order.  The
curve is a grouped aggregate followed by a (chunked) prefix sum, so neither
the rows nor the distinct scores ever sit in one task.  ``by`` evaluates many
(seed, model, segment) groups in the same job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.operators.scan import add_global_position, keyed_prefix_sums, n_ranges, with_value_chunks
from txnwatch.session import cut_lineage

# Fixed report parameters.
SWEEP_START, SWEEP_STOP, SWEEP_STEP = 0.05, 0.95, 0.05
N_CALIBRATION_BINS = 10
TOPK_FRACTIONS = [0.001, 0.005, 0.01, 0.02, 0.05, 0.10]
N_DECILES = 10
N_HIST_BINS = 50
F1_EPS = 1e-9
F1_EPS_DESCRIPTIVE = 1e-12
POLICIES = {"auto_block_only": ["AUTO_BLOCK"], "auto_block_or_hitl": ["AUTO_BLOCK", "HITL_REVIEW"]}


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _group_totals(df: DataFrame, by: list[str], label: str) -> DataFrame:
    aggs = [F.sum(F.col(label).cast("long")).alias("P"), F.count(F.lit(1)).alias("n_total")]
    if by:
        return df.groupBy(*by).agg(*aggs).withColumn("N", F.col("n_total") - F.col("P"))
    return df.agg(*aggs).withColumn("N", F.col("n_total") - F.col("P"))


def _attach(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    return df.join(small, by, "left") if by else df.crossJoin(F.broadcast(small))


def score_counts(df: DataFrame, score: str = "fraud_score", label: str = "isFraud", by: Sequence[str] = ()) -> DataFrame:
    """``by..., threshold, pos, neg`` per distinct score (NULL included), written
    once: every curve and binned metric follows from it without another scan."""
    y = F.col(label).cast("long")
    return cut_lineage(df.groupBy(*_by(by), F.col(score).alias("threshold"))
                       .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))


def curve_of(counts: DataFrame, by: Sequence[str] = (), n_chunks: int | None = None) -> DataFrame:
    """EVL0 from :func:`score_counts`."""
    by = _by(by)
    pts = counts.filter(F.col("threshold").isNotNull()).withColumn("_desc", -F.col("threshold"))
    n = pts.count()
    chunk = None
    n_chunks = n_ranges(n) if n_chunks is None else n_chunks
    if n_chunks > 1:
        pts = with_value_chunks(pts, by, "_desc", "_chunk", n_chunks, n)
        chunk = "_chunk"
    cum = keyed_prefix_sums(pts, by, ["_desc"], {"tp": F.col("pos"), "fp": F.col("neg")}, chunk)
    cum = cum.withColumnRenamed("tp__cum", "tp").withColumnRenamed("fp__cum", "fp")
    totals = pts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")) if by else \
        pts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    out = _attach(cum, totals, by)
    return out.drop("_desc", *([chunk] if chunk else []))


def threshold_curve(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                    by: Sequence[str] = (), n_chunks: int | None = None) -> DataFrame:
    """EVL0: ``by..., threshold, pos, neg, tp, fp, P, N`` per distinct score.

    ``tp``/``fp`` count rows with ``score >= threshold``.  ``n_chunks > 1``
    splits each group's distinct scores into value ranges scanned in parallel.
    """
    return curve_of(score_counts(df, score, label, by), by, n_chunks)


def _auc() -> Column:
    """Trapezoid area; in doubles, as ``P * N`` outgrows a long near 1e10 rows."""
    neg, tp, pos = (F.col(c).cast("double") for c in ("neg", "tp", "pos"))
    return F.try_divide(F.sum(neg * (2 * tp - pos)), 2.0 * F.first("P") * F.first("N"))


def roc_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """EVL1: trapezoid area under the ROC curve (ties count one half)."""
    by = _by(by)
    agg = [_auc().alias("roc_auc")]
    return curve.groupBy(*by).agg(*agg) if by else curve.agg(*agg)


def average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """EVL2: step-wise average precision ``sum(dR * P)``."""
    by = _by(by)
    ap = F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.first("P"))
    return curve.groupBy(*by).agg(ap.alias("pr_auc")) if by else curve.agg(ap.alias("pr_auc"))


def _pr(curve: DataFrame) -> DataFrame:
    return curve.withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0)),
    })


def optimal_f1_threshold(curve: DataFrame, by: Sequence[str] = (), eps: float = F1_EPS) -> DataFrame:
    """EVL4: threshold maximising ``2PR / (P + R + eps)``; lowest threshold on ties."""
    by = _by(by)
    c = _pr(curve).withColumn("f1", 2 * F.col("precision") * F.col("recall")
                              / (F.col("precision") + F.col("recall") + F.lit(eps)))
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"),
                    F.struct(F.col("f1"), -F.col("threshold")))
    agg = c.groupBy(*by).agg(best.alias("b")) if by else c.agg(best.alias("b"))
    return agg.select(*by, "b.threshold", "b.f1", "b.precision", "b.recall")


def optimal_f1_descriptive(curve: DataFrame, by: Sequence[str] = (),
                           eps: float = F1_EPS_DESCRIPTIVE) -> DataFrame:
    """EVL4b: ``2PR / max(P + R, eps)``; threshold 1.0 when no point beats the
    ``(P=1, R=0)`` endpoint."""
    by = _by(by)
    c = _pr(curve).withColumn("f1", 2 * F.col("precision") * F.col("recall")
                              / F.greatest(F.col("precision") + F.col("recall"), F.lit(eps)))
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"),
                    F.struct(F.col("f1"), -F.col("threshold")))
    agg = c.groupBy(*by).agg(best.alias("b")) if by else c.agg(best.alias("b"))
    endpoint_wins = F.col("b.f1") < 0  # f1 >= 0 always: the endpoint never wins on a non-empty curve
    return agg.select(*by,
                      F.when(endpoint_wins, F.lit(1.0)).otherwise(F.col("b.threshold")).alias("threshold"),
                      F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"),
                      F.col("b.f1").alias("f1"))


def sweep_thresholds(start: float = SWEEP_START, stop: float = SWEEP_STOP,
                     step: float = SWEEP_STEP) -> list[float]:
    """``start + i * step`` below ``stop`` (same doubles as an arange)."""
    n = math.ceil((stop - start) / step)
    return [start + i * step for i in range(n)]


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return {"precision": prec, "recall": rec, "f1": f1}


def threshold_sweep(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                    thresholds: Sequence[float] | None = None) -> DataFrame:
    """EVL5: one aggregation pass with conditional counts per threshold."""
    ts = list(thresholds) if thresholds is not None else sweep_thresholds()
    s, y = F.col(score), F.col(label)
    aggs = [F.count_if(y == 1).alias("_P")]
    for i, t in enumerate(ts):
        aggs += [F.count_if((s >= t) & (y == 1)).alias(f"_tp{i}"), F.count_if((s >= t) & (y != 1)).alias(f"_fp{i}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"_tp{i}").alias("tp"),
                                        F.col(f"_fp{i}").alias("fp")) for i, t in enumerate(ts)]))
    long = wide.select(F.col("_P").alias("P"), rows.alias("r")).select("P", "r.*")
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    m = _prf(tp, fp, fn)
    return long.select("t", m["f1"].alias("f1"), m["precision"].alias("precision"), m["recall"].alias("recall"))


def confusion_counts(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                     threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """EVL9: tn, fp, fn, tp at ``score >= threshold``."""
    by = _by(by)
    p, y = F.col(score) >= threshold, F.col(label) == 1
    aggs = [F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"),
            F.count_if(~p & y).alias("fn"), F.count_if(p & y).alias("tp")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def classification_report(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                          threshold: float = 0.5) -> DataFrame:
    """EVL3: per-class precision/recall/F1/support, accuracy, macro and weighted
    averages (zero division -> 0)."""
    cm = confusion_counts(df, score, label, threshold)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    m1 = _prf(tp, fp, fn)
    m0 = _prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    total = s0 + s1
    rows = [
        F.struct(F.lit("0").alias("label"), m0["precision"].alias("precision"), m0["recall"].alias("recall"),
                 m0["f1"].alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("label"), m1["precision"].alias("precision"), m1["recall"].alias("recall"),
                 m1["f1"].alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), ((tp + tn) / total).alias("f1"),
                 total.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((m0["precision"] + m1["precision"]) / 2).alias("precision"),
                 ((m0["recall"] + m1["recall"]) / 2).alias("recall"), ((m0["f1"] + m1["f1"]) / 2).alias("f1"),
                 total.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 ((m0["precision"] * s0 + m1["precision"] * s1) / total).alias("precision"),
                 ((m0["recall"] * s0 + m1["recall"] * s1) / total).alias("recall"),
                 ((m0["f1"] * s0 + m1["f1"] * s1) / total).alias("f1"), total.alias("support")),
    ]
    return cm.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def calibration_edges(n_bins: int = N_CALIBRATION_BINS) -> list[float]:
    """``i / n_bins`` computed as ``i * (1 / n_bins)`` doubles (linspace edges)."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _calibration_bin(score: Column, n_bins: int, closed_last: bool) -> Column:
    edges = calibration_edges(n_bins)
    b = F.lit(-1)
    for i in range(n_bins):
        b = b + F.when(score >= F.lit(edges[i]), F.lit(1)).otherwise(F.lit(0))
    inside = (score >= 0.0) & ((score <= 1.0) if closed_last else (score < 1.0))
    cap = F.least(b, F.lit(n_bins - 1)) if closed_last else b
    return F.when(inside, cap)


def expected_calibration_error(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                               n_bins: int = N_CALIBRATION_BINS, by: Sequence[str] = ()) -> DataFrame:
    """EVL6: bins ``[e_i, e_{i+1})``; a score of exactly 1.0 falls in no bin."""
    by = _by(by)
    s = F.col(score)
    binned = df.withColumn("_bin", _calibration_bin(s, n_bins, closed_last=False))
    totals = _group_totals(df, by, label).select(*by, "n_total")
    per_bin = (binned.filter(F.col("_bin").isNotNull()).groupBy(*by, "_bin")
               .agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("conf"), F.avg(F.col(label)).alias("acc")))
    j = _attach(per_bin, totals, by)
    e = F.sum(F.col("n") / F.col("n_total") * F.abs(F.col("acc") - F.col("conf"))).alias("ece")
    return j.groupBy(*by).agg(e) if by else j.agg(e)


def calibration_table(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                      n_bins: int = N_CALIBRATION_BINS) -> DataFrame:
    """EVL7: all bins (last one closed), empty bins with NULL statistics."""
    s = F.col(score)
    edges = calibration_edges(n_bins)
    binned = df.withColumn("bin", _calibration_bin(s, n_bins, closed_last=True))
    stats = (binned.filter(F.col("bin").isNotNull()).groupBy("bin")
             .agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"),
                  F.avg(F.col(label).cast("double")).alias("fraud_rate")))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    lo = F.element_at(F.array(*[F.lit(x) for x in edges[:-1]]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(x) for x in edges[1:]]), F.col("bin") + 1)
    return (bins.join(F.broadcast(stats), "bin", "left")
            .select("bin", lo.alias("score_min"), hi.alias("score_max"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n"), "mean_score", "fraud_rate",
                    F.abs(F.col("mean_score") - F.col("fraud_rate")).alias("abs_gap")))


def brier_score(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                by: Sequence[str] = ()) -> DataFrame:
    """EVL8."""
    by = _by(by)
    b = F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier")
    return df.groupBy(*by).agg(b) if by else df.agg(b)


def policy_metrics(df: DataFrame, decision: str = "decision", label: str = "isFraud") -> DataFrame:
    """EVL10: confusion counts and P/R/F1/action rate for each review policy."""
    y = F.col(label) == 1
    aggs = []
    for name, acts in POLICIES.items():
        p = F.col(decision).isin(acts)
        aggs.append(F.struct(F.lit(name).alias("policy"), F.count_if(p & y).alias("tp"),
                             F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"),
                             F.count_if(~p & y).alias("fn")))
    wide = df.agg(F.array(*aggs).alias("a"))
    long = wide.select(F.explode("a").alias("r")).select("r.*")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    m = _prf(tp, fp, fn)
    return long.select("policy", "tp", "fp", "tn", "fn", m["precision"].alias("precision"),
                       m["recall"].alias("recall"), m["f1"].alias("f1"),
                       ((tp + fp) / (tp + fp + tn + fn)).alias("review_or_block_rate"))


def rank_positions(df: DataFrame, score: str, order_cols: Sequence[str], descending: bool,
                   pos_col: str = "_rank") -> DataFrame:
    """0-based rank by score (ties broken by ``order_cols``; NULL and NaN scores
    last either way), distributed."""
    key = F.nanvl(F.col(score).cast("double"), F.lit(None)) * (-1.0 if descending else 1.0)
    staged = df.withColumns({"_rn": key.isNull().cast("int"), "_rk": key})
    return add_global_position(staged, order_cols=("_rn", "_rk", *order_cols), pos_col=pos_col).drop("_rn", "_rk")


def score_deciles(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                  order_cols: Sequence[str] = ("TransactionID",), n_bins: int = N_DECILES) -> DataFrame:
    """AGG6: quantile bins of the first-order rank (ties by ``order_cols``); rows
    without a score are in no bin.

    ``bin = max(0, ceil((r - 1) * n_bins / (n - 1)) - 1)`` in exact integers.
    """
    df = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    ranked = rank_positions(df, score, order_cols, descending=False)
    n = df.count()
    r0 = F.col("_rank")  # r - 1
    den = max(n - 1, 1)
    num = r0 * n_bins
    b = F.greatest(F.lit(0), F.floor((num + den - 1) / den) - 1).cast("int")
    return (ranked.withColumn("score_decile", b).groupBy("score_decile")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("fraud_n"),
                 F.avg(F.col(label).cast("double")).alias("fraud_rate"), F.avg(score).alias("mean_score"),
                 F.min(score).alias("min_score"), F.max(score).alias("max_score")))


def topk_capture(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                 order_cols: Sequence[str] = ("TransactionID",),
                 fractions: Sequence[float] = TOPK_FRACTIONS) -> DataFrame:
    """SRT6: fraud captured in the top ``ceil(N p)`` scores for each fraction.

    One pass over the ranked rows with one conditional sum per fraction; the
    cut-offs come from a one-row totals frame.
    """
    ranked = rank_positions(df, score, order_cols, descending=True)
    totals = df.agg(F.count(F.lit(1)).alias("N"), F.sum(F.col(label).cast("long")).alias("F"))
    cuts = totals.select("N", "F", *[F.greatest(F.lit(1), F.ceil(F.col("N") * F.lit(p))).cast("long")
                                     .alias(f"_n{i}") for i, p in enumerate(fractions)])
    y = F.col(label).cast("long")
    j = ranked.crossJoin(F.broadcast(cuts))  # one-row scalar broadcast
    caught = j.agg(F.first("N").alias("N"), F.first("F").alias("F"),
                   *[F.first(f"_n{i}").alias(f"_n{i}") for i in range(len(fractions))],
                   *[F.coalesce(F.sum(F.when(F.col("_rank") < F.col(f"_n{i}"), y)), F.lit(0)).alias(f"_c{i}")
                     for i in range(len(fractions))])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_n{i}").alias("n_top"),
                                        F.col(f"_c{i}").alias("fraud_captured"))
                               for i, p in enumerate(fractions)]))
    out = caught.select("N", "F", rows.alias("r")).select("N", "F", "r.*")
    prec = F.col("fraud_captured") / F.col("n_top")
    base = F.col("F") / F.col("N")
    return out.select((F.col("p") * 100).alias("top_percent"), F.col("n_top").alias("n_reviewed"),
                      F.col("fraud_captured").cast("long").alias("fraud_captured"), prec.alias("precision"),
                      (F.col("fraud_captured") / F.greatest(F.col("F"), F.lit(1))).alias("recall"),
                      F.when(base > 0, prec / base).alias("lift"))


def score_histogram(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                    n_bins: int = N_HIST_BINS) -> DataFrame:
    """EVL12: per-class equal-width histogram over the class min..max, as a
    density (count / (class rows * bin width)); the max lands in the last bin."""
    s = F.col(score)
    rng = df.groupBy(label).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    j = df.join(F.broadcast(rng), label)  # one row per class
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((s - F.col("_lo")) * n_bins / width), F.lit(n_bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    counts = j.withColumn("bin", b).groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    grid = rng.crossJoin(F.broadcast(bins))  # classes x bins
    bw = F.when(width > 0, width / n_bins).otherwise(F.lit(1.0))
    return (grid.join(counts, [label, "bin"], "left")
            .select(label, "bin", F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                    (F.coalesce(F.col("n"), F.lit(0)) / (F.col("_n") * bw)).alias("density")))


def seed_metric_row(df: DataFrame, score: str = "fraud_score", label: str = "isFraud",
                    by: Sequence[str] = ()) -> DataFrame:
    """EVL11: n, fraud_n, rate, AUC, AP, Brier, ECE and the descriptive best-F1
    block with its confusion counts, one row per group; one scan of ``df``."""
    by = _by(by)
    counts = score_counts(df, score, label, by)
    s, pos, neg = F.col("threshold"), F.col("pos").cast("double"), F.col("neg").cast("double")
    n = F.col("pos") + F.col("neg")
    scored = F.when(s.isNotNull(), n)
    base = _grouped(counts, by, F.sum(n).alias("n_holdout"), F.sum("pos").alias("fraud_n"),
                    F.try_divide(F.sum(pos * F.pow(s - 1, 2) + neg * F.pow(s, 2)), F.sum(scored)).alias("brier"))
    base = base.withColumn("fraud_rate", F.col("fraud_n") / F.col("n_holdout"))
    binned = counts.withColumn("_bin", _calibration_bin(s, N_CALIBRATION_BINS, closed_last=True)).filter(F.col("_bin").isNotNull())
    per_bin = _grouped(binned, [*by, "_bin"], F.sum(n).alias("_n"), F.sum(s * n).alias("_s"), F.sum("pos").alias("_p"))
    gap = F.sum(F.abs(F.col("_s") - F.col("_p"))).alias("_gap")
    curve = cut_lineage(curve_of(counts, by))
    area = _grouped(curve, by, _auc().alias("roc_auc"),
                    F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.first("P")).alias("pr_auc"))
    opt = optimal_f1_descriptive(curve, by).select(
        *by, F.col("threshold").alias("best_f1_threshold"), F.col("precision").alias("best_f1_precision"),
        F.col("recall").alias("best_f1_recall"), F.col("f1").alias("best_f1"))
    at = F.col("threshold") >= F.col("best_f1_threshold")
    cm = _grouped(_attach(curve, opt.select(*by, "best_f1_threshold"), by), by,
                  F.coalesce(F.sum(F.when(at, F.col("pos"))), F.lit(0)).alias("tp_at_best_f1"),
                  F.coalesce(F.sum(F.when(at, F.col("neg"))), F.lit(0)).alias("fp_at_best_f1"),
                  F.coalesce(F.sum(F.when(~at, F.col("neg"))), F.lit(0)).alias("tn_at_best_f1"),
                  F.coalesce(F.sum(F.when(~at, F.col("pos"))), F.lit(0)).alias("fn_at_best_f1"))
    out = base
    for part in (area, _grouped(per_bin, by, gap), opt, cm):
        out = out.join(part, by, "left") if by else out.crossJoin(F.broadcast(part))  # one row
    out = out.withColumn("ece_10bin", F.col("_gap") / F.col("n_holdout"))
    return out.select(*by, "n_holdout", "fraud_n", "fraud_rate", "roc_auc", "pr_auc", "brier", "ece_10bin", "best_f1_threshold",
                      "best_f1_precision", "best_f1_recall", "best_f1", "tp_at_best_f1", "fp_at_best_f1", "tn_at_best_f1", "fn_at_best_f1")


def _grouped(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def window_free_rate(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """AGG3: class counts and positive rate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


# --- DOC5 / DOC6 / DOC9 ------------------------------------------------------------------

MIN_PRECISION = 0.5
COST_FP, COST_FN = 1.0, 10.0


def threshold_policies(curve: DataFrame, min_precision: float = MIN_PRECISION, cost_fp: float = COST_FP,
                       cost_fn: float = COST_FN) -> DataFrame:
    """DOC5: thresholds by best F2, best recall with precision >= ``min_precision``
    and minimum expected cost ``cost_fp * fp + cost_fn * fn`` (ties: lowest threshold)."""
    c = _pr(curve).withColumns({
        "f2": F.when(4 * F.col("precision") + F.col("recall") > 0,
                     5 * F.col("precision") * F.col("recall") / (4 * F.col("precision") + F.col("recall")))
        .otherwise(F.lit(0.0)),
        "cost": F.lit(cost_fp) * F.col("fp") + F.lit(cost_fn) * (F.col("P") - F.col("tp")),
    })
    pick = lambda key: F.max_by(F.struct("threshold", "precision", "recall", "f2", "cost"), key)
    agg = c.agg(
        pick(F.struct(F.col("f2"), -F.col("threshold"))).alias("best_f2"),
        pick(F.struct(F.when(F.col("precision") >= min_precision, F.col("recall")).otherwise(F.lit(-1.0)),
                      -F.col("threshold"))).alias("recall_at_precision"),
        pick(F.struct(-F.col("cost"), -F.col("threshold"))).alias("min_cost"))
    rows = [F.struct(F.lit(n).alias("policy"), F.col(f"{n}.threshold").alias("threshold"),
                     F.col(f"{n}.precision").alias("precision"), F.col(f"{n}.recall").alias("recall"),
                     F.col(f"{n}.f2").alias("f2"), F.col(f"{n}.cost").alias("cost"))
            for n in ("best_f2", "recall_at_precision", "min_cost")]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def temporal_model_selection(df: DataFrame, models: Sequence[str], label: str = "isFraud",
                             block_col: str = "block", recent_blocks: int = 7) -> DataFrame:
    """DOC6: AUC of every candidate per time block (one job), mean over the
    most recent ``recent_blocks`` blocks, best candidate flagged."""
    long = df.select(block_col, label, *models).unpivot([block_col, label], list(models), "model", "score")
    per = roc_auc(threshold_curve(long, "score", label, by=["model", block_col]), by=["model", block_col])
    last = df.agg(F.max(block_col).alias("_last"))
    recent = per.crossJoin(F.broadcast(last)).filter(F.col(block_col) > F.col("_last") - recent_blocks)
    g = recent.groupBy("model").agg(F.avg("roc_auc").alias("recent_mean_auc"), F.count(F.lit(1)).alias("n_blocks"))
    best = g.agg(F.max_by("model", F.struct(F.col("recent_mean_auc"), F.col("model"))).alias("_best"))
    return g.crossJoin(F.broadcast(best)).withColumn("selected", (F.col("model") == F.col("_best")).cast("int")).drop("_best")


def prediction_correlation(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """DOC9: Pearson correlation for every pair of model score columns (one pass)."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    agg = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"{a}__{b}").alias("corr"))
            for a, b in pairs]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

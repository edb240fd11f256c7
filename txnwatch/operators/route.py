"""Three-tier decision routing (RTE1-5) and decision summaries (AGG5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.functions.columns import r6
from txnwatch.operators.scan import exact_quantile_row

# Fixed decision labels and default thresholds.
AUTO_BLOCK = "AUTO_BLOCK"
HITL_REVIEW = "HITL_REVIEW"
ALLOW = "ALLOW"
DECISIONS = [ALLOW, AUTO_BLOCK, HITL_REVIEW]
AUTO_BLOCK_THRESHOLD = 0.60
REVIEW_THRESHOLD = 0.35
AMOUNT_PERCENTILE = 95
COLD_START_LIMIT = 3
SOFT_REVIEW_THRESHOLD = 0.20


def route_transactions(df: DataFrame, score: str = "fraud_score", amount: str | None = None,
                       prior_count: str | None = None, new_client: str | None = None,
                       auto_block: float = AUTO_BLOCK_THRESHOLD, review: float = REVIEW_THRESHOLD,
                       amount_percentile: float = AMOUNT_PERCENTILE,
                       cold_start_limit: int = COLD_START_LIMIT,
                       soft_review: float = SOFT_REVIEW_THRESHOLD,
                       out_col: str = "decision",
                       amount_reference: DataFrame | None = None,
                       high_value_floor: float | None = None) -> DataFrame:
    """Add ``decision``: base tiers, then the high-value, cold-start and
    new-client promotions of ALLOW rows to HITL_REVIEW, in that order.

    The amount percentile is an exact, distributed linear-interpolation
    quantile joined back as a one-row broadcast.  ``amount_reference`` (default ``df``) is the
    frame the percentile is taken over; pass the un-featured source so the
    percentile does not re-run the feature windows.  ``high_value_floor`` is the score from which a
    high amount promotes, by default ``review``.  ALLOW rows score below both tiers, so a floor that isn't below
    both (as the default) promotes nothing, and no percentile is taken then.
    """
    s = F.col(score)
    decision = (F.when(s >= auto_block, F.lit(AUTO_BLOCK))
                .when((s >= review) & (s < auto_block), F.lit(HITL_REVIEW))
                .otherwise(F.lit(ALLOW)))
    staged = df
    floor = review if high_value_floor is None else high_value_floor
    high_value = amount is not None and floor < min(review, auto_block)
    if high_value:
        ref = df if amount_reference is None else amount_reference
        p = exact_quantile_row(ref, amount, [amount_percentile / 100.0], ["_amt_pctl"])
        staged = staged.crossJoin(F.broadcast(p))
        decision = F.when((F.col(amount) > F.col("_amt_pctl")) & (s >= floor) & (decision == ALLOW),
                          F.lit(HITL_REVIEW)).otherwise(decision)
    if prior_count is not None:
        decision = F.when((F.col(prior_count) < cold_start_limit) & (decision == ALLOW) & (s >= soft_review),
                          F.lit(HITL_REVIEW)).otherwise(decision)
    if new_client is not None:
        decision = F.when((F.col(new_client) == 1) & (decision == ALLOW) & (s >= soft_review),
                          F.lit(HITL_REVIEW)).otherwise(decision)
    out = staged.withColumn(out_col, decision)
    return out.drop("_amt_pctl") if high_value else out


def decision_summary(df: DataFrame, decision: str = "decision") -> DataFrame:
    """AGG5 / RTE5: count and rate per decision (rate rounded to 6 places)."""
    counts = df.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))
    # at most three rows: the un-partitioned window is over the grouped result
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(decision, "n", r6(F.col("n") / total).alias("rate"))

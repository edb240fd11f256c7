"""Decision query: which transactions are blocked or reviewed, and how many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnwatch.operators.route import decision_summary, route_transactions
from txnwatch.operators.scan import DEFAULT_ROWS_PER_BUCKET
from txnwatch.plans.features import behavioural_frame
from txnwatch.sources.fixtures import txn


def routed_transactions(spark: SparkSession, sf_dir: str, chunk_rows: int | None = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    source = txn(spark, sf_dir, with_v=False)
    feats = behavioural_frame(source, chunk_rows=chunk_rows)
    return route_transactions(feats, score="fraud_score", amount="TransactionAmt",
                              prior_count="Card_Prior_Txn_Count", new_client="is_new_client",
                              amount_reference=source)


def decision_report(spark: SparkSession, sf_dir: str, chunk_rows: int | None = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    return decision_summary(routed_transactions(spark, sf_dir, chunk_rows))

"""Feature plans: the causal feature frame as one lazy Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from txnwatch.operators import features as FE
from txnwatch.operators.scan import DEFAULT_ROWS_PER_BUCKET, plan_entity_chunks


def behavioural_frame(df: DataFrame, chunk_rows: int | None = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """time features -> UID -> UID expanding stats -> cross -> new client -> velocity.

    Entity windows are split into order ranges of about ``chunk_rows`` rows,
    planned once for both entities from the counted rows (hot-entity safe).
    """
    df, chunk_col = plan_entity_chunks(df, "card1", rows_per_chunk=chunk_rows)
    out = FE.extract_time_features(df)
    out = FE.build_uid(out)
    out = FE.uid_aggregations(out, chunk_col=chunk_col)
    out = FE.cross_feature_interactions(out)
    out = FE.new_client_flag(out)
    out = FE.engineer_velocity(out, chunk_col=chunk_col)
    return out.drop(chunk_col) if chunk_col else out

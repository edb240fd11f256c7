"""Artifact writers and readers (SNK1-SNK6), all plain DataFrame writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.stats import summarize_runs

PREDICTION_COLUMNS = ["TransactionID", "UID", "isFraud", "fraud_score", "decision"]
SEED_PATTERN = r"(?:^|/)seed_(-?\d+)(?:/|$)"


def save_holdout_predictions(df: DataFrame, out_dir: str, dataset: str) -> str:
    """SNK1: ``{dataset}_holdout_predictions.csv`` (a Spark CSV folder)."""
    path = f"{out_dir.rstrip('/')}/{dataset}_holdout_predictions.csv"
    df.select(*PREDICTION_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return path


def _finite(column, dtype: str):
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column)) if dtype in ("double", "float") else F.col(column)


def save_metrics_summary(seed_metrics: DataFrame, out_path: str, metric_cols: list[str], id_cols: tuple[str, ...] = ()) -> DataFrame:
    """SNK2: one JSON document with ``n_seeds``, the per-seed rows and, per metric,
    mean and std (ddof=1); values that aren't finite are null.  One row per seed is
    gathered, not data."""
    rows = seed_metrics.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in metric_cols])
    rows = rows.select(*[_finite(c, t).alias(c) for c, t in rows.dtypes])
    summary = summarize_runs(rows, metric_cols)
    per_seed = rows.agg(F.count(F.lit(1)).alias("n_seeds"), F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("seeds"))
    per_metric = summary.agg(F.sort_array(F.collect_list(F.struct("metric", "mean", "std"))).alias("summary"))
    per_seed.crossJoin(F.broadcast(per_metric)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(out_path)
    return summary


def save_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> list[str]:
    """SNK3/SNK4: write a set of report tables, one folder per table."""
    paths = []
    for name, df in tables.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(p) if fmt == "csv" else w.format(fmt).save(p))
        paths.append(p)
    return paths


def read_seed_predictions(spark: SparkSession, root: str, name: str = "*_holdout_predictions.csv") -> DataFrame:
    """SNK6: gather every per-seed prediction file; seed from a ``seed_<n>``
    path part, else -1."""
    df = (spark.read.option("header", True).option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.csv").csv(root))
    path = F.col("_metadata.file_path")
    seed = F.regexp_extract(path, SEED_PATTERN, 1)
    return df.withColumn("seed", F.when(seed == "", F.lit(-1)).otherwise(seed.cast("int")))

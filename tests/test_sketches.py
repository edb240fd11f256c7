"""Quantile sketches: rank error, merging, a day at a time, PSI against the exact one."""

import bisect

from pyspark.sql import functions as F

from conftest import SF_MID
from txnwatch.operators import drift as DR
from txnwatch.operators import sketches as SK
from txnwatch.sources.fixtures import txn

FEATURES = ["TransactionAmt", "fraud_score", "D1"]


def day():
    return F.floor(F.col("TransactionDT") / 86400)


def test_rank_error_of_merged_days(spark, tmp_path):
    df = txn(spark, SF_MID, with_v=False).cache()
    path = f"file://{tmp_path}/days"
    SK.store_days(SK.sketch_days(df.filter(day() < 12), day(), FEATURES), path)
    SK.store_days(SK.sketch_days(df.filter(day() == 11), day(), FEATURES), path)  # a day again replaces itself
    SK.store_days(SK.sketch_days(df.filter(day() >= 12), day(), FEATURES), path)
    days = SK.read_days(spark, path)
    assert days.agg(F.sum("n")).first()[0] == df.count() * len(FEATURES)
    probs = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    got = SK.sketch_quantiles(days, probs).collect()
    assert len(got) == len(probs) * len(FEATURES)
    for f in FEATURES:
        values = sorted(DR.MODEL_FILL if r[0] is None else float(r[0]) for r in df.select(f).collect())
        for r in got:
            if r.feature == f:
                low, high = bisect.bisect_left(values, r.value) / len(values), bisect.bisect_right(values, r.value) / len(values)
                assert low - SK.rank_error() <= r.prob <= high + SK.rank_error()


def test_a_new_day_reads_that_day_only(spark, tmp_path):
    df = txn(spark, SF_MID, with_v=False)
    path = f"file://{tmp_path}/log"
    df.withColumn("day", day().cast("int")).write.partitionBy("day").parquet(path)
    log = spark.read.parquet(path)
    plan = SK.sketch_days(log.filter("day = 3"), F.col("day"), FEATURES)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_psi_is_near_the_exact_one(spark):
    df = txn(spark, SF_MID, with_v=False).cache()
    early, late = df.filter(day() < 15), df.filter(day() >= 15).withColumn("fraud_score", F.col("fraud_score") + 0.15)
    exact = {r.feature: r for r in DR.feature_psi(early, late, FEATURES).collect()}
    got = {r.feature: r for r in SK.sketched_psi(SK.sketch_days(early, day(), FEATURES), SK.sketch_days(late, day(), FEATURES)).collect()}
    assert got.keys() == exact.keys()
    for f in FEATURES:
        assert abs(got[f].psi - exact[f].psi) < 0.1 * exact[f].psi + 0.03, f
    assert got["fraud_score"].tier == exact["fraud_score"].tier == "significant" or exact["fraud_score"].psi < 0.25


def test_empty_and_constant(spark):
    none = spark.createDataFrame([], "TransactionDT long, x double")
    one = spark.createDataFrame([(5, 1.0), (6, None), (90_000, 1.0)], "TransactionDT long, x double")
    assert SK.sketch_days(none, day(), ["x"]).collect() == []
    assert [(r.day, r.n) for r in SK.sketch_days(one, day(), ["x"], fill=None).orderBy("day").collect()] == [(0, 1), (1, 1)]
    assert [r.psi for r in SK.sketched_psi(SK.sketch_days(one, day(), ["x"], fill=None), SK.sketch_days(one, day(), ["x"])).collect()] == [0.0]

"""Canonical transaction views over the driver's parquet tables.

``txn`` (from ``events``), ``identity`` (a 25% left-join partner) and
``paysim_raw`` (from ``orders`` x ``customer`` x ``supplier``).  The exact
derivations are fixed by the test-data contract; they are restated here as
Spark columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.functions.columns import days_since, seconds_since

# Fixed values of the test-data contract.
TXN_EPOCH = "2024-01-01 00:00:00"
PAYSIM_EPOCH = "1995-01-01"
N_V_COLUMNS = 12


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def txn(spark: SparkSession, sf_dir: str, with_v: bool = True) -> DataFrame:
    """C1: IEEE-shaped transaction frame derived from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    base = ev.select(
        "event_id", "user_id", "event_type", "value",
        _k().alias("k"), seconds_since("ts", TXN_EPOCH).cast("long").alias("dt"))
    k, dt, uid = F.col("k"), F.col("dt"), F.col("user_id")
    value, etype = F.col("value"), F.col("event_type")
    cols = [
        F.col("event_id").alias("TransactionID"),
        dt.alias("TransactionDT"),
        value.alias("TransactionAmt"),
        uid.alias("card1"),
        _null_if(F.pmod(uid, F.lit(7)) == 0, F.pmod(uid, F.lit(7))).cast("int").alias("addr1"),
        etype.alias("card4"),
        _null_if(F.pmod(k, F.lit(10)) == 0,
                 F.floor(dt / F.lit(86400.0)).cast("double") - F.pmod(uid, F.lit(5))).cast("double").alias("D1"),
        _null_if(F.pmod(k, F.lit(15)) == 0, F.pmod(k, F.lit(15))).cast("double").alias("D15"),
        F.pmod(k, F.lit(5)).cast("double").alias("C1"),
        F.pmod(k, F.lit(13)).cast("double").alias("C13"),
        _null_if(F.pmod(k, F.lit(3)) == 0, F.pmod(k, F.lit(7))).cast("double").alias("C14"),
        (F.when(F.pmod(k, F.lit(3)) == 0, F.lit("T"))
         .when(F.pmod(k, F.lit(3)) == 1, F.lit("F"))).alias("M4"),
        (F.when(F.pmod(k, F.lit(4)) == 0, F.lit("T"))
         .when(F.pmod(k, F.lit(4)) == 1, F.lit("F"))).alias("M9"),
        F.when((etype == "error") & (value > 75), F.lit(1)).otherwise(F.lit(0)).alias("isFraud"),
        F.round(F.lit(0.6) * F.when(etype == "error", F.least(value / F.lit(150.0), F.lit(1.0)))
                .otherwise(F.lit(0.0)) + F.lit(0.4) * k / F.lit(100.0), 3).alias("fraud_score"),
        # second, weaker score for paired comparisons (STA1-3, JN4)
        # (coefficients chosen so the unrounded value is never an exact decimal half)
        F.round(F.lit(0.5) * F.when(etype == "error", F.least(value / F.lit(157.0), F.lit(1.0)))
                .otherwise(F.lit(0.0)) + F.lit(0.4) * F.pmod(k * 37 + uid, F.lit(100)) / F.lit(100.0),
                3).alias("score_b"),
    ]
    if with_v:
        for i in range(1, N_V_COLUMNS + 1):
            if i <= 4:
                base_i = value
            elif i <= 8:
                base_i = _null_if(F.pmod(k, F.lit(4)) == 0, value)
            else:
                base_i = _null_if(F.pmod(k, F.lit(4)) != 0, value)
            cols.append((base_i * F.lit(float(i)) + F.pmod(k, F.lit(i + 2))).cast("double").alias(f"V{i}"))
    return base.select(*cols)


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: sparse identity table keyed by TransactionID (25% coverage)."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.filter(F.pmod(F.col("event_id"), F.lit(4)) == 0)
            .select(F.col("event_id").alias("TransactionID"),
                    F.when(F.pmod(_k(), F.lit(2)) == 0, F.lit("mobile"))
                    .otherwise(F.lit("desktop")).alias("DeviceType")))


def paysim_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: PaySim-shaped raw frame; ``o_orderkey`` is kept as the row id."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    n_supp = supplier.agg(F.count(F.lit(1)).alias("_n_supp"))  # one row
    o = (orders.crossJoin(F.broadcast(n_supp))
         .withColumn("_supp", F.pmod(F.col("o_orderkey"), F.col("_n_supp"))))
    j = (o.join(customer, o.o_custkey == customer.c_custkey, "left")
         .join(supplier, F.col("_supp") == supplier.s_suppkey, "left"))
    amount = F.col("o_totalprice")
    return j.select(
        F.col("o_orderkey").alias("TransactionID"),
        (days_since("o_orderdate", PAYSIM_EPOCH) * 24).cast("int").alias("step"),
        F.col("o_orderstatus").alias("type"),
        amount.alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.concat(F.lit("M"), F.col("_supp").cast("string")).alias("nameDest"),
        F.col("c_acctbal").alias("oldbalanceOrg"),
        F.greatest(F.col("c_acctbal") - amount, F.lit(0.0)).alias("newbalanceOrig"),
        F.col("s_acctbal").alias("oldbalanceDest"),
        (F.col("s_acctbal") + amount).alias("newbalanceDest"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (amount > 400000), F.lit(1))
        .otherwise(F.lit(0)).alias("isFraud"),
    )

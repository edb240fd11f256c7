"""Causal feature operators: reference fixtures, causality, hot-key paths."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from txnwatch.operators import features as FE
from txnwatch.operators.scan import plan_time_chunks
from txnwatch.sources.fixtures import txn


def test_causal_counts(spark):
    df = spark.createDataFrame([(1, 0, 1, 10.0), (2, 1, 1, 20.0), (3, 2, 2, 30.0), (4, 3, 1, 40.0)],
                               "TransactionID long, TransactionDT long, card1 int, TransactionAmt double")
    out = FE.engineer_velocity(df)
    got = rows(out, "TransactionID", "Card_Tx_Count", "Card_Prior_Txn_Count")
    assert [(r[1], r[2]) for r in got] == [(1, 0), (2, 1), (1, 0), (3, 2)]


def test_velocity_values_by_hand(spark):
    df = spark.createDataFrame([(i, i, 7, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9])],
                               "TransactionID long, TransactionDT long, card1 int, TransactionAmt double")
    r = {x["TransactionID"]: x for x in FE.engineer_velocity(df).collect()}
    assert r[8]["Card_Velocity_7d"] == sum(range(3, 10)) / 7
    assert abs(r[8]["Card_Amt_Std_7d"] - 2.160246899469287) < 1e-12
    assert r[0]["Card_Amt_Std_7d"] == 0.0  # fewer than two values
    assert r[8]["Card_Spending_Velocity"] == 9.0


def test_d1n_half_even_and_uid(spark):
    df = spark.createDataFrame([(1, int(86400 * 2.5), 1, None, 0.0), (2, int(86400 * 3.5), 2, 3, 1.0),
                                (3, 10, 3, 4, None)],
                               "TransactionID long, TransactionDT long, card1 int, addr1 int, D1 double")
    got = rows(FE.build_uid(df), "TransactionID", "D1n", "UID")
    assert got == [(1, 2, "1_-1_2"), (2, 3, "2_3_3"), (3, -999, "3_4_-999")]


def test_pct_change_zero_and_null(spark):
    df = spark.createDataFrame([(1, 1, "u", 10.0, 0.0), (2, 2, "u", 10.0, 5.0), (3, 3, "u", 10.0, None),
                                (4, 4, "u", 10.0, 4.0)],
                               "TransactionID long, TransactionDT long, UID string, TransactionAmt double, D1 double")
    got = rows(FE.uid_aggregations(df), "TransactionID", "D1_uid_diff", "D1_uid_pct")
    assert got == [(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0)]


def _compare(a, b, cols, key="TransactionID", tol=1e-9):
    ra = {r[key]: r for r in a.select(key, *cols).collect()}
    rb = {r[key]: r for r in b.select(key, *cols).collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        for c in cols:
            x, y = ra[k][c], rb[k][c]
            if x is None or y is None:
                assert x == y, (k, c, x, y)
            else:
                assert abs(x - y) <= tol * max(1.0, abs(x)), (k, c, x, y)


def _hot(spark):
    # one card owns a third of all rows
    return txn(spark, SF_SMALL, with_v=False).withColumn(
        "card1", F.when(F.col("TransactionID") % 3 == 0, F.lit(1)).otherwise(F.col("card1")))


def test_hot_key_chunked_equals_plain(spark):
    base = FE.build_uid(_hot(spark))
    chunked, chunk_col = plan_time_chunks(base, rows_per_chunk=90)
    assert chunk_col is not None
    cols = ["UID_amt_mean", "UID_amt_std", "UID_txn_count", "D1_uid_diff", "D15_uid_pct", "C14_uid_std"]
    _compare(FE.uid_aggregations(base), FE.uid_aggregations(chunked, chunk_col=chunk_col, sub_rows=7), cols)
    vcols = ["Card_Velocity_7d", "Card_Amt_Std_30d", "Card_Spending_Velocity", "Card_Tx_Count"]
    _compare(FE.engineer_velocity(base), FE.engineer_velocity(chunked, chunk_col=chunk_col, sub_rows=11), vcols)


def test_causality_future_rows_change_nothing(spark):
    full = FE.engineer_velocity(FE.uid_aggregations(FE.build_uid(_hot(spark))))
    cut = _hot(spark).filter(F.col("TransactionDT") < 86400 * 10)
    past = FE.engineer_velocity(FE.uid_aggregations(FE.build_uid(cut)))
    cols = ["UID_amt_mean", "UID_amt_std", "Card_Velocity_30d", "Card_Prior_Txn_Count"]
    _compare(past, full.join(past.select("TransactionID"), "TransactionID"), cols)


def test_permutation_invariance(spark):
    base = FE.build_uid(_hot(spark))
    shuffled = base.repartition(7).orderBy(F.rand(3))
    cols = ["UID_amt_mean", "Card_Amt_Std_7d", "Card_Tx_Count"]
    _compare(FE.engineer_velocity(FE.uid_aggregations(base)), FE.engineer_velocity(FE.uid_aggregations(shuffled)),
             cols)


def test_unique_entities_give_zero_sequences(spark):
    df = spark.createDataFrame([(i, i, i, 1.0, 1.0, 1.0) for i in range(1, 7)],
                               "TransactionID long, TransactionDT long, card1 long, a double, b double, c double")
    seq = FE.build_sequences(df, "card1", ["a", "b", "c"], 10).collect()
    assert len(seq) == 6
    for r in seq:
        assert r["sequence_len"] == 0
        assert len(r["sequence"]) == 10 and all(v == [0.0, 0.0, 0.0] for v in r["sequence"])


def test_sequences_match_row_loop(spark):
    base = _hot(spark).select("TransactionID", "TransactionDT", "card1", "TransactionAmt", "C1")
    seq = {r["TransactionID"]: r["sequence"] for r in
           FE.build_sequences(base, "card1", ["TransactionAmt", "C1"], 10, sub_rows=13).collect()}
    pdf = base.toPandas().sort_values(["TransactionDT", "TransactionID"])
    hist = {}
    for r in pdf.itertuples():
        h = hist.setdefault(r.card1, [])
        want = [[0.0, 0.0]] * (10 - len(h[-10:])) + h[-10:]
        assert seq[r.TransactionID] == want
        h.append([r.TransactionAmt, r.C1])


def test_null_cleanup_fixture(spark):
    df = spark.createDataFrame([(1, None, "a", 0), (2, None, "b", 1), (3, 9, "c", 2), (4, 10, "d", 3)],
                               "keep int, drop_even_if_holdout_populated int, UID string, pos int")
    out = FE.clean_high_nan_columns(df, 0.7, F.col("pos") < 2, preserve=["UID"])
    assert "keep" in out.columns and "UID" in out.columns
    assert "drop_even_if_holdout_populated" not in out.columns


def test_reduce_mem_usage_skips_strings(spark):
    df = spark.createDataFrame([(1.0, "PAYMENT", 1), (2.0, "TRANSFER", 300), (3.0, "CASH_OUT", 5)],
                               "numeric double, label string, n long")
    out = FE.reduce_mem_usage(df)
    types = dict(out.dtypes)
    assert types["label"] == "string" and types["numeric"] == "float" and types["n"] == "smallint"
    assert [r["label"] for r in out.collect()] == ["PAYMENT", "TRANSFER", "CASH_OUT"]


def test_time_range_velocity_chunked(spark):
    base = _hot(spark)
    plain = FE.time_range_velocity(base)
    chunked = FE.time_range_velocity(base, n_chunks=5)
    cols = ["txn_count_1h", "amt_sum_24h", "txn_count_30d"]
    _compare(plain, chunked, cols)
    assert all(not math.isnan(r["amt_sum_1h"]) for r in plain.select("amt_sum_1h").collect())


def test_null_card_is_not_an_entity(spark):
    df = spark.createDataFrame([(1, 0, None, 10.0), (2, 1, None, 20.0), (3, 2, 5, 30.0), (4, 3, 5, 50.0)],
                               "TransactionID long, TransactionDT long, card1 int, TransactionAmt double")
    for chunked in (False, True):
        base = df
        chunk_col = None
        if chunked:
            base, chunk_col = plan_time_chunks(df, rows_per_chunk=1, n_rows=4)
        out = {r["TransactionID"]: r for r in FE.engineer_velocity(base, chunk_col=chunk_col, sub_rows=2).collect()}
        assert out[1]["Card_Tx_Count"] is None and out[1]["Card_Velocity_7d"] is None
        assert out[1]["Card_Amt_Std_7d"] == 0.0
        assert out[4]["Card_Tx_Count"] == 2 and out[4]["Card_Velocity_7d"] == 40.0

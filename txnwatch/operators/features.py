"""Causal feature operators (PRJ*, WIN*).

Every window is backward-only: a row's feature never reads a later row.
The entity windows go through :mod:`txnwatch.operators.scan`, which splits a
hot entity across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions import columns as C
from txnwatch.operators.scan import (AUTO, DEFAULT_SUB_ROWS, keyed_expanding, keyed_prefix_sums, keyed_rolling, n_ranges,
                                     split_entities, with_value_chunks)

ORDER = ("TransactionDT", "TransactionID")

# Fixed column families of the canonical schema.
C_COLUMNS = ["C1", "C13", "C14"]
M_COLUMNS = ["M4", "M5", "M6", "M9"]
D_COLUMNS = ["D1", "D15"]
VELOCITY_WINDOWS = [(7, "7d"), (14, "14d"), (30, "30d")]
SPENDING_WINDOW = 10


# --- PRJ3 ----------------------------------------------------------------------

def extract_time_features(df: DataFrame, dt: str = "TransactionDT") -> DataFrame:
    return df.withColumns(C.time_feature_columns(dt))


# --- PRJ4 / PRJ5 / PRJ6 ------------------------------------------------------

def build_uid(df: DataFrame) -> DataFrame:
    """Add ``D1n`` and ``UID = card1_addr1_D1n``."""
    if "D1" in df.columns and "TransactionDT" in df.columns:
        d1n = C.d1_normalized("TransactionDT", "D1")
    else:
        d1n = F.lit(-999)
    staged = df.withColumn("D1n", d1n)
    addr = "addr1" if "addr1" in df.columns else F.lit(None).cast("int")
    return staged.withColumn("UID", C.uid_column("card1", addr, "D1n"))


def uid_granularity(df: DataFrame, uid: str = "UID", exact: bool = True) -> DataFrame:
    """PRJ6: distinct UIDs and their share of rows (one row)."""
    n_uid = F.count_distinct(F.col(uid)) if exact else F.approx_count_distinct(F.col(uid))
    return df.agg(n_uid.alias("n_uid"), F.count(F.lit(1)).alias("n_rows")).withColumn(
        "granularity", C.r6(F.col("n_uid") / F.col("n_rows")))


# --- PRJ8 / PRJ9 -----------------------------------------------------------------

def cross_feature_interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(C.cross_feature_columns(columns=df.columns))


def new_client_flag(df: DataFrame) -> DataFrame:
    if "UID_txn_count" not in df.columns:
        return df
    return df.withColumn("is_new_client", C.new_client_flag("UID_txn_count"))


# --- PRJ10 -------------------------------------------------------------------------

def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG1: one-row frame with the null ratio of every column (one pass)."""
    columns = list(columns or df.columns)
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def clean_high_nan_columns(df: DataFrame, threshold: float = 0.7, fit: Column | None = None,
                           preserve: Sequence[str] = ()) -> DataFrame:
    """Keep columns whose null ratio on the fit rows is below ``threshold``.

    Preserved columns are always kept (appended at the end if they failed).
    One aggregation action over the fit rows decides the projection.
    """
    fit_frame = df if fit is None else df.filter(fit)
    ratios = null_ratios(fit_frame).first()
    keep = [c for c in df.columns if ratios[c] is None or ratios[c] < threshold]
    keep += [c for c in preserve if c in df.columns and c not in keep]
    return df.select(*keep)


def null_cleanup_report(df: DataFrame, threshold: float = 0.7, fit: Column | None = None,
                        preserve: Sequence[str] = ()) -> DataFrame:
    """PRJ10 as a table: ``column, null_ratio, kept`` (one aggregation pass)."""
    fit_frame = df if fit is None else df.filter(fit)
    cols = list(df.columns)
    ratios = null_ratios(fit_frame, cols)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_ratio"))
                               for c in cols]))
    long = ratios.select(rows.alias("r")).select("r.*")
    kept = (F.col("null_ratio").isNull() | (F.col("null_ratio") < threshold)
            | F.col("column").isin(list(preserve) or [""]))
    return long.withColumn("kept", kept.cast("int"))


# --- PRJ2 -----------------------------------------------------------------------------

_INT_TYPES = [(T.ByteType(), 127), (T.ShortType(), 32767), (T.IntegerType(), 2147483647)]


def reduce_mem_usage(df: DataFrame) -> DataFrame:
    """Downcast integer columns to the smallest type whose open range holds
    their min and max; floating columns become float; strings untouched."""
    int_cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    casts = {}
    if int_cols:
        stats = df.agg(*[F.min(c).alias(f"mn_{i}") for i, c in enumerate(int_cols)],
                       *[F.max(c).alias(f"mx_{i}") for i, c in enumerate(int_cols)]).first()
        for i, c in enumerate(int_cols):
            mn, mx = stats[f"mn_{i}"], stats[f"mx_{i}"]
            if mn is None:
                continue
            for typ, hi in _INT_TYPES:
                lo = -hi - 1
                if mn > lo and mx < hi:
                    casts[c] = F.col(c).cast(typ)
                    break
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            casts[f.name] = F.col(f.name).cast(T.FloatType())
    return df.withColumns(casts) if casts else df


# --- WIN1-5: UID expanding aggregations ------------------------------------------

def uid_aggregations(df: DataFrame, uid: str = "UID", order_cols: Sequence[str] = ORDER,
                     chunk_col: str | None = AUTO, sub_rows: int = DEFAULT_SUB_ROWS,
                     map_match_flags: bool = True) -> DataFrame:
    """Per-UID expanding statistics (current row included), one shared scan.

    ``UID_amt_mean/std``, ``UID_txn_count``, ``UID_amt_zscore``; C-columns
    mean/std; M-columns mean (T/F mapped to 1/0/-1 when string-typed); D-columns
    mean/std/diff/pct against the previous row of the same UID.
    """
    df, chunk_col, own = split_entities(df, uid, order_cols, chunk_col)
    present = set(df.columns)
    dtypes = dict(df.dtypes)
    values: dict[str, Column] = {"amt": F.col("TransactionAmt")}
    for c in C_COLUMNS:
        if c in present:
            values[c] = F.col(c)
    m_cols = [c for c in M_COLUMNS if c in present]
    staged = df
    if map_match_flags:
        staged = staged.withColumns({m: C.match_flag(m) for m in m_cols if dtypes[m] == "string"})
    for m in m_cols:
        values[m] = F.col(m)
    d_cols = [c for c in D_COLUMNS if c in present]
    for d in d_cols:
        values[d] = F.col(d)

    scanned = keyed_expanding(staged, uid, order_cols, values, rn_col="_uid_rn", chunk_col=chunk_col)

    zero = F.lit(0.0)
    mean = lambda n: F.coalesce(F.col(f"{n}__mean"), zero)
    std = lambda n: F.coalesce(F.col(f"{n}__std"), zero)
    out = {
        "UID_amt_mean": mean("amt"),
        "UID_amt_std": std("amt"),
        "UID_txn_count": F.col("_uid_rn").cast("int"),
    }
    out["UID_amt_zscore"] = (F.col("TransactionAmt") - out["UID_amt_mean"]) / (out["UID_amt_std"] + F.lit(1e-6))
    for c in C_COLUMNS:
        if c in present:
            out[f"{c}_uid_mean"] = mean(c)
            out[f"{c}_uid_std"] = std(c)
    for m in m_cols:
        out[f"{m}_uid_mean"] = mean(m)
    for d in d_cols:
        out[f"{d}_uid_mean"] = mean(d)
        out[f"{d}_uid_std"] = std(d)
    helper = [f"{n}__{s}" for n in values for s in ("n", "mean", "std")]
    result = scanned.withColumns(out).drop(*helper)

    if d_cols:
        def lags(w: Window) -> dict[str, Column]:
            cols = {}
            for d in d_cols:
                prev = F.lag(F.col(d), 1).over(w)
                cols[f"{d}_uid_diff"] = F.coalesce(F.col(d) - prev, zero)
                cols[f"{d}_uid_pct"] = F.coalesce(F.try_divide(F.col(d), prev) - F.lit(1.0), zero)
            return cols
        result = keyed_rolling(result, uid, "_uid_rn", 1, lags, sub_rows=sub_rows,
                               order_cols=None if chunk_col else order_cols)
    return result.drop("_uid_rn", *own)


# --- WIN6-10: card velocity -----------------------------------------------------------

def engineer_velocity(df: DataFrame, card: str = "card1", amount: str = "TransactionAmt",
                      order_cols: Sequence[str] = ORDER, chunk_col: str | None = AUTO,
                      sub_rows: int = DEFAULT_SUB_ROWS) -> DataFrame:
    """Rolling mean/std of the amount over the last 7/14/30 rows of the card,
    non-null amounts in the last 10 rows, causal transaction counts.

    The ``7d/14d/30d`` names are kept for parity; the frames are row counts.
    """
    df, chunk_col, own = split_entities(df, card, order_cols, chunk_col)
    ranked = keyed_expanding(df, card, order_cols, None, rn_col="_card_rn", chunk_col=chunk_col)
    lookback = max(k for k, _ in VELOCITY_WINDOWS) - 1
    a = F.col(amount)

    def frames(w: Window) -> dict[str, Column]:
        cols = {}
        for k, label in VELOCITY_WINDOWS:
            fw = w.rowsBetween(-(k - 1), 0)
            cols[f"Card_Velocity_{label}"] = F.avg(a).over(fw)
            cols[f"Card_Amt_Std_{label}"] = F.coalesce(F.stddev_samp(a).over(fw), F.lit(0.0))
        cols["Card_Spending_Velocity"] = F.count(a).over(
            w.rowsBetween(-(SPENDING_WINDOW - 1), 0)).cast("double")
        return cols

    rolled = keyed_rolling(ranked, card, "_card_rn", lookback, frames, sub_rows=sub_rows,
                           order_cols=None if chunk_col else order_cols)
    null_key = F.col(card).isNull()
    rn = F.col("_card_rn")
    # a missing card is no entity: no velocity or count, the filled std is 0
    rolled = rolled.withColumns(
        {**{f"Card_Velocity_{lab}": F.when(~null_key, F.col(f"Card_Velocity_{lab}")) for _, lab in VELOCITY_WINDOWS},
         **{f"Card_Amt_Std_{lab}": F.when(~null_key, F.col(f"Card_Amt_Std_{lab}")).otherwise(F.lit(0.0))
            for _, lab in VELOCITY_WINDOWS},
         "Card_Spending_Velocity": F.when(~null_key, F.col("Card_Spending_Velocity"))})
    return rolled.withColumns({
        "Card_Tx_Count": F.when(~null_key, rn.cast("long")),
        "Card_Prior_Txn_Count": F.when(~null_key, (rn - 1).cast("long")),
        "Amt_Deviation": (a - F.col("Card_Velocity_7d")) / (F.col("Card_Amt_Std_7d") + F.lit(1.0)),
        "Amt_to_Mean_Ratio": a / (F.col("Card_Velocity_30d") + F.lit(1.0)),
    }).drop("_card_rn", *own)


def cold_start_count(df: DataFrame, prior_col: str = "Card_Prior_Txn_Count", limit: int = 3) -> DataFrame:
    """WIN10: rows whose entity had fewer than ``limit`` earlier rows."""
    return df.agg(F.count_if(F.col(prior_col) < limit).alias("n_cold_start"),
                  F.count(F.lit(1)).alias("n_rows"))


# --- WIN12 / WIN13: sequence view ------------------------------------------------------------

def build_sequences(df: DataFrame, entity: str, features: Sequence[str], seq_len: int = 10,
                    order_cols: Sequence[str] = ORDER, out_col: str = "sequence",
                    chunk_col: str | None = AUTO, sub_rows: int = DEFAULT_SUB_ROWS) -> DataFrame:
    """Previous ``seq_len`` rows of the same entity (current row excluded),
    oldest first, left-padded with zero vectors: ``array<array<double>>``.

    Also adds ``{out_col}_len`` = number of real history rows.
    """
    df, chunk_col, own = split_entities(df, entity, order_cols, chunk_col)
    ranked = keyed_expanding(df, entity, order_cols, None, rn_col="_seq_rn", chunk_col=chunk_col)
    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    zero_vec = F.array(*[F.lit(0.0) for _ in features])

    def frames(w: Window) -> dict[str, Column]:
        hist = F.collect_list(F.struct(F.col("_seq_rn").alias("rn"), vec.alias("v"))).over(
            w.rowsBetween(-seq_len, -1))
        return {"_hist": hist}

    rolled = keyed_rolling(ranked, entity, "_seq_rn", seq_len, frames, sub_rows=sub_rows,
                           order_cols=None if chunk_col else order_cols)
    ordered = F.transform(F.array_sort(F.col("_hist")), lambda s: s["v"])
    n_hist = F.size(F.col("_hist"))
    padded = F.concat(F.array_repeat(zero_vec, F.lit(seq_len) - n_hist), ordered)
    return rolled.withColumns({out_col: padded, f"{out_col}_len": n_hist}).drop("_hist", "_seq_rn", *own)


# --- DOC1 / DOC3 / DOC8: documented extensions ----------------------------------------------

TIME_RANGES = [(3600, "1h"), (21600, "6h"), (86400, "24h"), (7 * 86400, "7d"), (14 * 86400, "14d"),
               (30 * 86400, "30d")]


def time_range_velocity(df: DataFrame, card: str = "card1", amount: str = "TransactionAmt",
                        time_col: str = "TransactionDT", id_col: str = "TransactionID",
                        ranges: Sequence[tuple[int, str]] = TIME_RANGES, n_chunks: int | None = None) -> DataFrame:
    """DOC1: count / sum / mean of the card's amounts with time in
    ``[t - s, t]`` (same-second rows included, as a RANGE frame).

    Computed as an as-of count: every row adds probe rows at ``t`` (after
    the data rows of that second) and at ``t - s`` (before them); one keyed,
    time-chunked running sum over data + probes gives ``C(<= t) - C(< t - s)``
    without a range join and without one task per hot card.
    """
    base = df.select(card, id_col, time_col, amount)
    t, known = F.col(time_col), F.col(amount).isNotNull()
    # exact running sums: a difference of long double sums would lose digits
    value = F.coalesce(F.col(amount).cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)"))
    nothing = F.lit(0).cast("decimal(28,8)")

    def event(at, kind: int, probe: int, c=F.lit(0), a=nothing, ca=F.lit(0)):
        return F.struct(at.alias("_t"), F.lit(kind).alias("_kind"), F.lit(probe).alias("_probe"), c.alias("_c"), a.alias("_a"), ca.alias("_ca"))
    upper = len(ranges)
    rows = [event(t, 1, -1, F.lit(1), value, known.cast("int")), event(t, 2, upper)]
    rows += [event(t - s, 0, i) for i, (s, _) in enumerate(ranges)]
    events = base.select(card, F.col(id_col).alias("_id"), F.explode(F.array(*rows)).alias("_e")).select(card, "_id", "_e.*")
    chunk = None
    n_rows = base.count() * (upper + 2)
    if n_chunks is None:
        n_chunks = n_ranges(n_rows)
    if n_chunks > 1:
        events = with_value_chunks(events, [card], "_t", "_tchunk", n_chunks, n_rows)
        chunk = "_tchunk"
    cum = keyed_prefix_sums(events, [card], ["_t", "_kind", "_id", "_probe"],
                            {"c": F.col("_c"), "a": F.col("_a"), "ca": F.col("_ca")}, chunk)
    at = lambda probe, name: F.max(F.when(F.col("_probe") == probe, F.col(f"{name}__cum")))
    wide = cum.filter(F.col("_kind") != 1).groupBy("_id").agg(
        *[at(i, n).alias(f"{n}_{i}") for i in range(upper + 1) for n in ("c", "a", "ca")])
    out = {}
    for i, (_, lab) in enumerate(ranges):
        cnt, total, n_amt = (F.col(f"{n}_{upper}") - F.col(f"{n}_{i}") for n in ("c", "a", "ca"))
        out[f"txn_count_{lab}"] = cnt.cast("long")
        out[f"amt_sum_{lab}"] = total.cast("double")
        out[f"amt_mean_{lab}"] = F.when(n_amt > 0, total.cast("double") / n_amt)
    feats = wide.select(F.col("_id").alias(id_col), *[c.alias(n) for n, c in out.items()])
    return df.join(feats, id_col, "left")


def distinct_counterparties(df: DataFrame, account: str, counterparty: str,
                            order_cols: Sequence[str] = ORDER, chunk_col: str | None = AUTO,
                            out_col: str = "distinct_counterparties") -> DataFrame:
    """DOC3 / DOC7 degree: distinct counterparties of the account so far
    (current row included): a first-seen flag per (account, counterparty),
    then a running sum per account."""
    df, chunk_col, own = split_entities(df, account, order_cols, chunk_col)
    first = keyed_expanding(df, [account, counterparty], order_cols, None, rn_col="_pair_rn", chunk_col=chunk_col)
    flagged = first.withColumn("_first", (F.col("_pair_rn") == 1).cast("long")).drop("_pair_rn")
    cum = keyed_prefix_sums(flagged, [account], list(order_cols), {"d": F.col("_first")}, chunk_col)
    return cum.withColumnRenamed("d__cum", out_col).drop("_first", *own)


def view_mask_fill(df: DataFrame, score: str, history_len: str, prior: float | Column, min_history: int = 3,
                   out_col: str | None = None, mask_col: str = "view_mask_seq") -> DataFrame:
    """DOC8: rows with fewer than ``min_history`` earlier rows get the class
    prior instead of the view's score, plus a 0/1 mask column."""
    out_col = out_col or score
    short = F.col(history_len) < min_history
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    return df.withColumns({out_col: F.when(short, p).otherwise(F.col(score)),
                           mask_col: F.when(short, F.lit(0)).otherwise(F.lit(1))})

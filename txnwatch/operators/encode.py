"""Categorical and numeric fit/transform operators (ENC1-ENC4).

Code maps are DataFrames (one row per distinct value) joined back with a
left join; Spark/AQE broadcasts them when their measured size is small and
falls back to a shuffle join otherwise, so nothing assumes a bounded
vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.scan import add_global_position
from txnwatch.session import cut_lineage

MISSING = "__MISSING__"
# Codes of all columns together up to which their maps are broadcast; beyond, they are shuffled.
BROADCAST_CODES = 200_000


def first_appearance_codes(df: DataFrame, col: str, order_col: str, code_col: str = "code",
                           keep_null: bool = False) -> DataFrame:
    """Code map ``value -> code``: codes 0..k-1 in order of first appearance."""
    src = df if keep_null else df.filter(F.col(col).isNotNull())
    # a row per value, counted, cut into ranges and ranked: the source is read once
    firsts = cut_lineage(src.groupBy(col).agg(F.min(order_col).alias("_first")))
    ranked = add_global_position(firsts, order_cols=("_first",), pos_col=code_col)
    return ranked.select(col, F.col(code_col).alias(code_col))


def factorize(df: DataFrame, col: str, order_col: str, out_col: str | None = None) -> DataFrame:
    """ENC1: first-appearance codes for ``col`` (NULL -> -1)."""
    out_col = out_col or col
    codes = first_appearance_codes(df, col, order_col, "_code")
    return (df.join(codes, col, "left")
            .withColumn(out_col, F.coalesce(F.col("_code"), F.lit(-1)))
            .drop("_code"))


def extend_code_map(code_map: DataFrame, chunk: DataFrame, col: str, order_col: str,
                    code_col: str = "code") -> DataFrame:
    """ENC2: append the values first seen in ``chunk`` after the existing codes."""
    new_vals = chunk.filter(F.col(col).isNotNull()).join(code_map.select(col), col, "left_anti")
    fresh = first_appearance_codes(new_vals, col, order_col, "_new")
    base = code_map.agg(F.coalesce(F.max(code_col) + 1, F.lit(0)).alias("_base"))
    appended = fresh.crossJoin(F.broadcast(base)).select(
        col, (F.col("_base") + F.col("_new")).alias(code_col))
    return code_map.select(col, code_col).unionByName(appended)


def apply_code_map(df: DataFrame, code_map: DataFrame, col: str, code_col: str = "code",
                   default: int = -1) -> DataFrame:
    """JN2: lookup with a default for misses; the column is replaced by its code."""
    return (df.join(code_map.withColumnRenamed(code_col, "_code"), col, "left")
            .withColumn(col, F.coalesce(F.col("_code"), F.lit(default).cast("long")))
            .drop("_code"))


def encode_categoricals(df: DataFrame, fit: Column | None = None, pos: str = "pos",
                        columns: Sequence[str] | None = None) -> DataFrame:
    """ENC3: label-encode string columns with codes learned on the fit rows.

    NULL becomes ``__MISSING__`` first; codes follow first appearance in the
    fit rows; values unseen in the fit rows (including ``__MISSING__``) -> -1.
    """
    cols = list(columns) if columns is not None else [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return df
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in cols})
    fit_rows = filled if fit is None else filled.filter(fit)
    codes = cut_lineage(code_maps(fit_rows, cols, pos))
    small = codes.count() <= BROADCAST_CODES
    out = filled
    for c in cols:
        own = codes.filter(F.col("_col") == c).select(F.col("_value").alias(c), "code")
        out = apply_code_map(out, F.broadcast(own) if small else own, c)
    return out


def code_maps(df: DataFrame, columns: Sequence[str], order_col: str) -> DataFrame:
    """First-appearance codes of several columns in one job: ``_col, _value, code``."""
    long = df.select(order_col, *columns).unpivot([order_col], list(columns), "_col", "_value")
    firsts = long.groupBy("_col", "_value").agg(F.min(order_col).alias("_first"))
    ranked = add_global_position(cut_lineage(firsts), order_cols=("_col", "_first"), pos_col="_rank")
    start = ranked.groupBy("_col").agg(F.min("_rank").alias("_start"))  # one row per column
    return ranked.join(F.broadcast(start), "_col").select("_col", "_value", (F.col("_rank") - F.col("_start")).alias("code"))


def fit_standard_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ENC4 fit: one-row frame of population mean and std per column
    (zero or undefined variance -> scale 1)."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd")]
    stats = df.agg(*aggs)
    return stats.select(*[x for c in columns for x in (
        F.col(f"{c}__mu"),
        F.when(F.coalesce(F.col(f"{c}__sd"), F.lit(0.0)) == 0, F.lit(1.0))
        .otherwise(F.col(f"{c}__sd")).alias(f"{c}__sd"))])


def transform_standard_scaler(df: DataFrame, stats: DataFrame, columns: Sequence[str],
                              inverse: bool = False) -> DataFrame:
    """ENC4 transform / inverse transform with a fitted one-row stats frame."""
    j = df.crossJoin(F.broadcast(stats))  # one row
    if inverse:
        cols = {c: F.col(c) * F.col(f"{c}__sd") + F.col(f"{c}__mu") for c in columns}
    else:
        cols = {c: (F.col(c) - F.col(f"{c}__mu")) / F.col(f"{c}__sd") for c in columns}
    return j.withColumns(cols).drop(*[f"{c}__{s}" for c in columns for s in ("mu", "sd")])


def target_encode(df: DataFrame, col: str, label: str, fit: Column | None = None, smoothing: float = 10.0,
                  out_col: str | None = None) -> DataFrame:
    """DOC7: fold-local smoothed target encoding
    ``(sum_y + m * prior) / (n + m)`` learned on the fit rows; unseen -> prior."""
    out_col = out_col or f"{col}_te"
    fit_rows = df if fit is None else df.filter(fit)
    prior = fit_rows.agg(F.avg(F.col(label).cast("double")).alias("_prior"))
    stats = fit_rows.groupBy(col).agg(F.sum(F.col(label).cast("double")).alias("_sy"),
                                      F.count(F.lit(1)).alias("_n"))
    j = df.join(stats, col, "left").crossJoin(F.broadcast(prior))  # one-row prior
    te = (F.coalesce(F.col("_sy"), F.lit(0.0)) + F.lit(smoothing) * F.col("_prior")) / (
        F.coalesce(F.col("_n"), F.lit(0)) + F.lit(smoothing))
    return j.withColumn(out_col, te).drop("_sy", "_n", "_prior")


def fold_target_encode(df: DataFrame, cols: Sequence[str], label: str, folds: Sequence, pos: str = "pos", smoothing: float = 10.0) -> DataFrame:
    """DOC7: the validation rows of every walk-forward fold (``fold``), each of ``cols`` encoded (``<col>_te``) as that fold's
    training rows alone allow; null and unseen values get the fold's prior, rows of no fold go.

    All folds and columns share one scan: rows are summed by value and the first fold that trains on them, and as training
    sets only grow, a sum counts for that fold and all later ones.  So the tables joined have at most
    one row per value and fold, however many rows the folds have.
    """
    ends = sorted((f.train_end, f.fold) for f in folds)
    if not ends:
        out = df.withColumn("fold", F.lit(None).cast("int")).limit(0)
        return out.withColumns({f"{c}_te": F.lit(None).cast("double") for c in cols})
    order = {fold: k for k, (_, fold) in enumerate(ends)}
    since = F.lit(len(ends))
    for k in reversed(range(len(ends))):
        since = F.when(F.col(pos) < ends[k][0], F.lit(k)).otherwise(since)
    later = F.explode(F.sequence(F.col("_since"), F.lit(len(ends) - 1))).alias("_k")
    sums = [F.sum(F.col(label).cast("double")).alias("_sy"), F.count(F.lit(1)).alias("_n"), F.count(label).alias("_known")]
    trained = df.withColumn("_since", since).filter(F.col("_since") < len(ends))
    # the empty name holds the totals, for the priors
    values = F.explode(F.array(F.struct(F.lit("").alias("c"), F.lit("").alias("v")), *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    stats = (trained.select("_since", label, values.alias("_x")).select("_since", label, "_x.c", "_x.v").filter("v is not null")
             .groupBy("c", "v", "_since").agg(*sums)
             .select("c", "v", "_sy", "_n", "_known", later)
             .groupBy("c", "v", "_k").agg(F.sum("_sy").alias("_sy"), F.sum("_n").alias("_n"), F.sum("_known").alias("_known")))
    stats = stats.withColumn("_prior", F.col("_sy") / F.col("_known"))
    arr = F.array(*[F.struct(F.lit(f.fold).cast("int").alias("fold"), F.lit(order[f.fold]).alias("k"), F.lit(f.val_start).alias("a"), F.lit(f.val_end).alias("b")) for f in folds])
    member = F.filter(arr, lambda f: (F.col(pos) >= f["a"]) & (F.col(pos) < f["b"]))
    out = df.withColumn("_f", F.explode(member)).withColumns({"fold": F.col("_f.fold"), "_k": F.col("_f.k")}).drop("_f")
    out = out.join(F.broadcast(stats.filter("c = ''").select("_k", "_prior")), "_k", "left")  # a row per fold
    for c in cols:
        own = stats.filter(F.col("c") == c).select(F.col("_k").alias("_fk"), F.col("v").alias("_v"), "_sy", "_n")
        out = out.join(own, (F.col("_k") == F.col("_fk")) & (F.col(c).cast("string") == F.col("_v")), "left")
        te = (F.coalesce("_sy", F.lit(0.0)) + F.lit(smoothing) * F.col("_prior")) / (F.coalesce("_n", F.lit(0)) + F.lit(smoothing))
        out = out.withColumn(f"{c}_te", te).drop("_fk", "_v", "_sy", "_n")
    return out.drop("_k", "_prior")

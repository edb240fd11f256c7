"""Time splits over a global position column (SPL1-SPL5).

All splits are positional on ``pos`` (0-based time order, see
:func:`txnwatch.operators.scan.add_global_position`); the driver only does
integer arithmetic on the row count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_SPLITS = 5
GAP_SIZE = 1000
TEST_RATIO = 0.15
EVAL_RATIO = 0.10


@dataclass(frozen=True)
class Fold:
    fold: int
    train_end: int
    val_start: int
    val_end: int


def walk_forward_folds(n: int, n_splits: int = N_SPLITS, gap: int = GAP_SIZE) -> list[Fold]:
    """SPL1 boundaries: ``fs = n // (k + 1)``; stop when validation would start past the end."""
    fs = n // (n_splits + 1)
    folds = []
    for i in range(n_splits):
        train_end = fs * (i + 1)
        val_start = train_end + gap
        val_end = min(val_start + fs, n)
        if val_start >= n:
            break
        folds.append(Fold(i, train_end, val_start, val_end))
    return folds


def assign_folds(df: DataFrame, n: int, pos: str = "pos", n_splits: int = N_SPLITS,
                 gap: int = GAP_SIZE) -> DataFrame:
    """One output row per (row, fold) membership with ``fold`` and ``role``
    (``train`` / ``val``).  The fold table is a literal array (k entries)."""
    folds = walk_forward_folds(n, n_splits, gap)
    if not folds:
        return df.withColumn("fold", F.lit(None).cast("int")).withColumn("role", F.lit(None).cast("string")).limit(0)
    arr = F.array(*[F.struct(F.lit(f.fold).alias("fold"), F.lit(f.train_end).alias("train_end"),
                             F.lit(f.val_start).alias("val_start"), F.lit(f.val_end).alias("val_end"))
                    for f in folds])
    p = F.col(pos)
    # only the folds a row belongs to are emitted
    member = F.filter(arr, lambda s: (p < s["train_end"]) | ((p >= s["val_start"]) & (p < s["val_end"])))
    return (df.withColumn("_f", F.explode(member))
            .withColumn("fold", F.col("_f.fold"))
            .withColumn("role", F.when(p < F.col("_f.train_end"), F.lit("train")).otherwise(F.lit("val")))
            .drop("_f"))


@dataclass(frozen=True)
class Holdout:
    train_end: int
    test_start: int
    n: int


def holdout_bounds(n: int, test_ratio: float = TEST_RATIO, gap: int = GAP_SIZE) -> Holdout:
    """SPL2: raw start ``int(n (1 - r))``; the gap is dropped if it would empty the test."""
    raw = int(n * (1 - test_ratio))
    start = raw + gap
    if start >= n:
        start = raw
    return Holdout(raw, start, n)


def holdout_role(pos: str | Column, b: Holdout) -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    return (F.when(p < b.train_end, F.lit("train"))
            .when(p >= b.test_start, F.lit("test"))
            .otherwise(F.lit("gap")))


def split_holdout(df: DataFrame, n: int, pos: str = "pos", test_ratio: float = TEST_RATIO,
                  gap: int = GAP_SIZE, out_col: str = "role") -> DataFrame:
    return df.withColumn(out_col, holdout_role(pos, holdout_bounds(n, test_ratio, gap)))


def internal_eval_bounds(n_train: int, eval_ratio: float = EVAL_RATIO, gap: int = GAP_SIZE) -> Holdout:
    """SPL3: SPL2 on the training rows; fallback to a contiguous split that
    keeps at least one row on each side."""
    b = holdout_bounds(n_train, eval_ratio, gap)
    if b.train_end <= 0 or b.test_start >= n_train:
        split = max(int(n_train * (1 - eval_ratio)), 1)
        split = min(split, n_train - 1)
        return Holdout(split, split, n_train)
    return b


def split_internal_eval(df: DataFrame, n_train: int, pos: str = "pos", eval_ratio: float = EVAL_RATIO,
                        gap: int = GAP_SIZE, out_col: str = "inner_role") -> DataFrame:
    """Tag training rows as ``fit`` / ``internal_val`` / ``gap``."""
    b = internal_eval_bounds(n_train, eval_ratio, gap)
    p = F.col(pos)
    return df.withColumn(out_col, F.when(p < b.train_end, F.lit("fit"))
                         .when(p >= b.test_start, F.lit("internal_val")).otherwise(F.lit("gap")))


def oof_coverage(df: DataFrame, model_cols: list[str], label: str = "isFraud") -> DataFrame:
    """SPL4: rows scored by every model (finite, non-null), with class counts."""
    ok = F.lit(True)
    for c in model_cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return df.filter(ok)


def oof_coverage_summary(df: DataFrame, model_cols: list[str], label: str = "isFraud") -> DataFrame:
    covered = oof_coverage(df, model_cols, label)
    return covered.agg(F.count(F.lit(1)).alias("n_covered"),
                       F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("n_positive"))


def diagnostic_sample(df: DataFrame, max_rows: int | None = None, seed: int = 42,
                      id_col: str = "TransactionID") -> DataFrame:
    """SPL5: without ``max_rows`` every row; else the ``max_rows`` rows with the
    smallest ``md5("id:seed")`` (without replacement, deterministic in
    ``seed``), cut by an exact distributed rank."""
    if not max_rows or max_rows <= 0:
        return df
    from txnwatch.operators.scan import add_global_position
    h = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))))
    ranked = add_global_position(h, order_cols=("_h", id_col), pos_col="_sample_pos")
    return ranked.filter(F.col("_sample_pos") < max_rows).drop("_h", "_sample_pos")

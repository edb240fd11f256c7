"""V-column reduction (ENC5 / ENC6): group anonymous ``V<n>`` columns by null
pattern over all fit rows, fit a PCA per group on the fit rows and project
every row.

A column's pattern is an order-free fingerprint of its null rows (their count
and the sum of their hashed positions): one aggregation over all fit rows.  The
fit is ``pyspark.ml.feature.PCA`` (distributed covariance); projections are
column arithmetic with explicit centring, since Spark's PCA model projects
uncentred rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V_PATTERN = re.compile(r"^V\d+$")
MIN_V_COLUMNS = 10
N_COMPONENTS = 3


def v_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if V_PATTERN.match(c)]


def null_pattern_groups(df: DataFrame, fit: Column | None, pos: str = "pos") -> list[list[str]]:
    """ENC5: V-columns with the same null rows among all fit rows, groups in
    first-column order; no groups without fit rows."""
    vcols = v_columns(df)
    if not vcols:
        return []
    fit_rows = df if fit is None else df.filter(fit)
    h = F.xxhash64(pos).cast("decimal(38,0)")
    aggs = [F.struct(F.count_if(F.col(c).isNull()).alias("n"), F.sum(F.when(F.col(c).isNull(), h)).alias("h")).alias(c) for c in vcols]
    masks = fit_rows.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    if not masks["_rows"]:
        return []
    groups: dict[tuple, list[str]] = {}
    for c in vcols:
        groups.setdefault((masks[c]["n"], masks[c]["h"]), []).append(c)
    return list(groups.values())


def fit_v_pca(df: DataFrame, fit: Column | None = None, pos: str = "pos",
              n_components: int = N_COMPONENTS) -> tuple[dict[str, Column], list[str]]:
    """Fit ENC6 on ``df`` and return (projection columns, V-columns to drop).

    One ``pyspark.ml`` PCA and one mean vector per null-pattern group of at
    least ``n_components`` columns; components are signed so that their
    largest weight is positive.  The projections are column expressions usable
    on any later frame that still has the V-columns.  Skipped (nothing
    projected or dropped) with fewer than 10 V-columns or without fit rows."""
    vcols = v_columns(df)
    if len(vcols) < MIN_V_COLUMNS:
        return {}, []
    fit_rows = df if fit is None else df.filter(fit)
    groups = null_pattern_groups(df, fit, pos)
    if not groups:
        return {}, []
    used = [(gi, cols) for gi, cols in enumerate(groups) if len(cols) >= n_components]
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in vcols}
    vectors = fit_rows.select(*[array_to_vector(F.array(*[x[c] for c in cols])).alias(f"g{gi}") for gi, cols in used])
    means = vectors.select(F.count(F.lit(1)).alias("n"), *[Summarizer.mean(F.col(f"g{gi}")).alias(f"g{gi}") for gi, _ in used]).first()
    out_cols: dict[str, Column] = {}
    for gi, cols in used:
        k = min(n_components, len(cols), means["n"])
        weights = PCA(k=k, inputCol=f"g{gi}", outputCol="pc").fit(vectors.select(f"g{gi}")).pc.toArray()
        mean = means[f"g{gi}"].toArray()
        values = F.array(*[x[c] for c in cols])
        for i in range(k):
            w = weights[:, i] * (1.0 if weights[np.abs(weights[:, i]).argmax(), i] >= 0 else -1.0)
            terms = F.zip_with(values, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b)
            out_cols[f"V_PCA_g{gi}_pc{i}"] = F.aggregate(terms, F.lit(-float(w @ mean)), lambda acc, t: acc + t)
    return out_cols, vcols


def v_column_pca(df: DataFrame, fit: Column | None = None, pos: str = "pos",
                 n_components: int = N_COMPONENTS) -> DataFrame:
    """ENC6: ``V_PCA_g{g}_pc{i}`` per group with at least ``n_components``
    columns; all V-columns dropped."""
    cols, vcols = fit_v_pca(df, fit, pos, n_components)
    if not vcols:
        return df
    return df.withColumns(cols).drop(*vcols) if cols else df.drop(*vcols)


def pca_groups_frame(df: DataFrame, fit: Column | None, pos: str = "pos") -> list[tuple[int, str]]:
    """(group index, column) assignments, for reporting and tests."""
    return [(gi, c) for gi, cols in enumerate(null_pattern_groups(df, fit, pos)) for c in cols]


"""Order-dependent scans that stay distributed.

Two building blocks carry every causal feature, split and ranking metric:

* :func:`add_global_position` (SPL0) - a row's 0-based position in a total
  order, computed as a *bucketed prefix scan*: ranges of the whole order tuple
  (cut points from a hashed sample, so a column full of ties still splits), a
  ``row_number`` inside each range, and range offsets from a one-row-per-range
  table.  No window ever runs without a partition key.

* :func:`keyed_expanding` / :func:`keyed_rolling` - per-entity windows that
  survive a hot entity (one card may own a third of all rows).  Expanding
  statistics are computed per (entity, order range) and stitched with the
  carried moments of earlier ranges (Chan et al. parallel variance), so no
  task ever holds more than one range of one entity.  Rolling frames over the
  last ``k`` rows are cut into sub-chunks of the in-entity row number, each
  sub-chunk carrying a copy of the ``k - 1`` rows before it.

Ranges are planned from the counted rows, never from a size estimate, and the
same code runs at every size: one range is the case of few rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.session import cut_lineage

# Rows per range for global positions and per (entity, range) for keyed scans:
# what a single task sorts.  Read at call time.
DEFAULT_ROWS_PER_BUCKET = 4_000_000
# Rows per sub-chunk of one entity for rolling frames.
DEFAULT_SUB_ROWS = 4_000_000
# Sampled order tuples per range from which the cut points are taken.
SAMPLES_PER_BUCKET = 48
MIN_ROWS_PER_BUCKET = 10_000
# Rows per partition of an iterative fit's input.
FIT_PARTITION_ROWS = 200_000


def _parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def compact_for_fit(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Deal an iterative fit's input to partitions of ``FIT_PARTITION_ROWS``
    rows where it has more partitions than that: a tiny training set should
    not pay per-task overhead on every optimizer iteration.  A shuffle, not a
    coalesce, so whatever computes the rows keeps its parallelism."""
    k = max(1, math.ceil((df.count() if n_rows is None else n_rows) / FIT_PARTITION_ROWS))
    return df.repartition(k) if k < df.rdd.getNumPartitions() else df


def n_ranges(n_rows: int, rows_per_range: int | None = None) -> int:
    return max(1, math.ceil(n_rows / max(1, rows_per_range or DEFAULT_ROWS_PER_BUCKET)))


def auto_chunks(df: DataFrame, rows_per_chunk: int | None = None) -> int:
    """Ranges for a keyed scan of ``df``, from a count."""
    return n_ranges(df.count(), rows_per_chunk)


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


def _join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``cols`` where NULL keys match NULL keys (a NULL entity is
    one group, as in the window it came from)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols],
                     *[c for c in right.columns if c not in cols])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in cols])


def _order_exprs(order_cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order_cols]


def order_cuts(df: DataFrame, order_cols: Sequence[str], n_buckets: int, n_rows: int) -> list[tuple]:
    """Cut points that split the order tuple into ~``n_buckets`` ranges.

    Taken from about ``SAMPLES_PER_BUCKET`` rows per range, chosen by a hash of
    the tuple, so they are the same however the rows are partitioned.  They
    only place the borders; no result depends on them.
    """
    if n_buckets <= 1:
        return []
    one_in = max(1, n_rows // (SAMPLES_PER_BUCKET * n_buckets))
    rows = df.select(*order_cols).filter(F.pmod(F.xxhash64(*order_cols), F.lit(one_in)) == 0).distinct().collect()
    real = [tuple(r) for r in rows if not any(isinstance(v, float) and math.isnan(v) for v in r)]
    real.sort(key=lambda t: tuple((v is not None, v) for v in t))
    picks = sorted({(i * len(real)) // n_buckets for i in range(1, n_buckets)}) if real else []
    return [real[i] for i in picks if i > 0]


def with_order_bucket(df: DataFrame, order_cols: Sequence[str], cuts: list[tuple], out_col: str) -> DataFrame:
    """Attach the number of ``cuts`` that are <= the row's order tuple (NULLs
    first): a binary search over one constant array, whatever its length."""
    if not cuts:
        return df.withColumn(out_col, F.lit(0))
    types = [df.schema[c].dataType.simpleString() for c in order_cols]
    names = [f"k{i}" for i in range(len(order_cols))]
    text = json.dumps([dict(zip(names, cut)) for cut in cuts], default=str)
    array = F.from_json(F.lit(text), f"array<struct<{', '.join(f'{n}: {t}' for n, t in zip(names, types))}>>")
    key = F.struct(*[F.col(c).alias(n) for c, n in zip(order_cols, names)])

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(array, mid) <= key
        searching = acc["lo"] < acc["hi"]
        return F.struct(F.when(searching & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(searching & ~below, mid).otherwise(acc["hi"]).alias("hi"))
    steps = F.array(*[F.lit(i) for i in range(len(cuts).bit_length() + 1)])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return df.withColumn(out_col, F.aggregate(steps, start, halve)["lo"])


def add_global_position(df: DataFrame, order_cols: Sequence[str] = ("TransactionDT", "TransactionID"),
                        pos_col: str = "pos", rows_per_bucket: int | None = None, n_rows: int | None = None) -> DataFrame:
    """SPL0: 0-based position of each row in ``order_cols`` order.

    Equal to ``row_number() over (order by order_cols) - 1`` without pulling
    the table into one task.  ``order_cols`` must be a total order (end with a
    unique id) for the position to be deterministic.
    """
    order_cols = list(order_cols)
    n = df.count() if n_rows is None else n_rows
    # at least a range for each core where there are rows for it: one range
    # would leave every downstream narrow operator in a single task
    nb = max(n_ranges(n, rows_per_bucket), min(_parallelism(df), n // MIN_ROWS_PER_BUCKET))
    cuts = order_cuts(df, order_cols, nb, n)
    b = "_pos_bucket"
    staged = with_order_bucket(df, order_cols, cuts, b)
    w = Window.partitionBy(b).orderBy(*_order_exprs(order_cols))
    local = staged.withColumn("_pos_local", F.row_number().over(w) - 1)
    if not cuts:
        return local.withColumn(pos_col, F.col("_pos_local").cast("long")).drop(b, "_pos_local")
    # one row per range, taken from the windowed frame so the source is scanned
    # and shuffled once (the window's exchange is reused by this branch)
    counts = local.groupBy(b).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        b, F.coalesce(F.sum("_n").over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)),
                      F.lit(0)).alias("_pos_offset"))
    return (local.join(F.broadcast(offsets), b, "left")  # one row per range, len(cuts) + 1 at most
            .withColumn(pos_col, (F.col("_pos_offset") + F.col("_pos_local")).cast("long"))
            .drop(b, "_pos_local", "_pos_offset"))


def plan_time_chunks(df: DataFrame, order_cols: Sequence[str] = ("TransactionDT", "TransactionID"),
                     chunk_col: str = "_chunk", rows_per_chunk: int | None = None, n_rows: int | None = None
                     ) -> tuple[DataFrame, str | None]:
    """Attach a chunk id that rises with the order tuple, or return ``None``
    if the counted rows fit one chunk (which then is what a task sorts)."""
    cols = _as_list(order_cols)
    n = df.count() if n_rows is None else n_rows
    cuts = order_cuts(df, cols, n_ranges(n, rows_per_chunk), n)
    return (with_order_bucket(df, cols, cuts, chunk_col), chunk_col) if cuts else (df, None)


def plan_entity_chunks(df: DataFrame, keys, order_cols: Sequence[str] = ("TransactionDT", "TransactionID"),
                       chunk_col: str = "_chunk", rows_per_chunk: int | None = None) -> tuple[DataFrame, str | None]:
    """``plan_time_chunks`` for scans of the entities ``keys``, or of finer ones:
    ``None`` too if no entity has more rows than a chunk.  The plain scan then
    shuffles the rows once, a chunked one three times."""
    n = df.count()
    rows = rows_per_chunk or DEFAULT_ROWS_PER_BUCKET
    if n <= rows:
        return df, None
    most = df.groupBy(*_as_list(keys)).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return plan_time_chunks(df, order_cols, chunk_col, rows_per_chunk, n) if most > rows else (df, None)


AUTO = "auto"


def split_entities(df: DataFrame, keys, order_cols: Sequence[str], chunk_col: str | None = AUTO
                   ) -> tuple[DataFrame, str | None, list[str]]:
    """(frame, chunk column or None, columns to drop afterwards) of a scan of
    the entities ``keys``: ``AUTO`` plans the chunks here, a name or None is
    taken as it is."""
    if chunk_col != AUTO:
        return df, chunk_col, []
    df, planned = plan_entity_chunks(df, keys, order_cols, "_entity_chunk")
    return df, planned, [planned] if planned else []


def keyed_expanding(df: DataFrame, keys, order_cols: Sequence[str], values: dict[str, Column] | None = None,
                    rn_col: str = "_rn", chunk_col: str | None = None) -> DataFrame:
    """Causal per-entity expanding statistics including the current row.

    Adds ``rn_col`` (1-based row number within the entity) and, for every
    ``name -> column`` in ``values``: ``name__n`` (non-null count so far),
    ``name__mean`` and ``name__std`` (sample std, NULL below two values).
    Nulls are skipped, as in a cumulative sum over present values.
    """
    keys = _as_list(keys)
    values = values or {}
    order = _order_exprs(order_cols)
    staged = df.select("*", *[c.cast("double").alias(f"_v_{n}") for n, c in values.items()])

    if chunk_col is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        cols = {rn_col: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))}
        for n in values:
            v = F.col(f"_v_{n}")
            cols[f"{n}__n"] = F.count(v).over(w)
            cols[f"{n}__mean"] = F.avg(v).over(w)
            cols[f"{n}__std"] = F.stddev_samp(v).over(w)
        return staged.withColumns(cols).drop(*[f"_v_{n}" for n in values])

    # --- chunked path: window per (entity, chunk), stitched with carried moments
    part = keys + [chunk_col]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local_cols = {"_rn_l": F.row_number().over(Window.partitionBy(*part).orderBy(*order))}
    for n in values:
        v = F.col(f"_v_{n}")
        local_cols[f"_n_l_{n}"] = F.count(v).over(w)
        local_cols[f"_mean_l_{n}"] = F.avg(v).over(w)
        local_cols[f"_m2_l_{n}"] = F.coalesce(F.var_pop(v).over(w) * F.count(v).over(w), F.lit(0.0))
    local = staged.withColumns(local_cols)

    # one row per (entity, chunk): pre-aggregated before the shuffle
    tot_aggs = [F.count(F.lit(1)).alias("_rows_c")]
    for n in values:
        v = F.col(f"_v_{n}")
        tot_aggs += [F.count(v).alias(f"_n_c_{n}"), F.avg(v).alias(f"_mean_c_{n}"),
                     F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"_m2_c_{n}")]
    totals = staged.groupBy(*part).agg(*tot_aggs)
    # prefix over earlier chunks of the same entity (rows per entity <= #chunks)
    wp = Window.partitionBy(*keys).orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, -1)
    wk = Window.partitionBy(*keys).orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pre_cols = {"_rows_o": F.coalesce(F.sum("_rows_c").over(wp), F.lit(0))}
    for n in values:
        nc, mc, m2c = F.col(f"_n_c_{n}"), F.col(f"_mean_c_{n}"), F.col(f"_m2_c_{n}")
        shift = F.first(mc, ignorenulls=True).over(wk)  # centring constant per entity
        d = F.coalesce(mc - shift, F.lit(0.0))
        n_o = F.coalesce(F.sum(nc).over(wp), F.lit(0))
        s_o = F.coalesce(F.sum(nc * d).over(wp), F.lit(0.0))
        q_o = F.coalesce(F.sum(nc * d * d).over(wp), F.lit(0.0))
        m2_o = F.coalesce(F.sum(m2c).over(wp), F.lit(0.0))
        pre_cols[f"_n_o_{n}"] = n_o
        pre_cols[f"_mean_o_{n}"] = F.when(n_o > 0, shift + s_o / n_o)
        pre_cols[f"_m2_o_{n}"] = F.greatest(
            m2_o + q_o - F.when(n_o > 0, s_o * s_o / n_o).otherwise(F.lit(0.0)), F.lit(0.0))
    offsets = totals.withColumns(pre_cols).select(*part, *pre_cols.keys())

    joined = _join_null_safe(local, offsets, part)
    out = {rn_col: F.col("_rows_o") + F.col("_rn_l")}
    for n in values:
        n_o, mo, m2o = F.col(f"_n_o_{n}"), F.col(f"_mean_o_{n}"), F.col(f"_m2_o_{n}")
        n_l, ml, m2l = F.col(f"_n_l_{n}"), F.col(f"_mean_l_{n}"), F.col(f"_m2_l_{n}")
        tot = n_o + n_l
        delta = ml - mo
        mean = (F.when(n_o == 0, ml).when(n_l == 0, mo)
                .otherwise(mo + delta * n_l / tot))
        m2 = (F.when(n_o == 0, m2l).when(n_l == 0, m2o)
              .otherwise(m2o + m2l + delta * delta * n_o * n_l / tot))
        out[f"{n}__n"] = tot
        out[f"{n}__mean"] = mean
        out[f"{n}__std"] = F.when(tot >= 2, F.sqrt(F.greatest(m2, F.lit(0.0)) / (tot - 1)))
    drop = (["_rn_l", "_rows_o"] + [c for n in values for c in
            (f"_v_{n}", f"_n_l_{n}", f"_mean_l_{n}", f"_m2_l_{n}", f"_n_o_{n}", f"_mean_o_{n}", f"_m2_o_{n}")])
    return joined.withColumns(out).drop(*drop)


def keyed_rolling(df: DataFrame, keys, rn_col: str, lookback: int,
                  build: Callable[[Window], dict[str, Column]],
                  sub_rows: int = DEFAULT_SUB_ROWS, order_cols: Sequence[str] | None = None) -> DataFrame:
    """Per-entity frames that look back at most ``lookback`` rows.

    ``build(w)`` receives ``Window.partitionBy(keys, sub).orderBy(rn_col)`` and
    returns the output columns (use ``w.rowsBetween(-j, 0)``, ``lag`` ...).
    Rows are grouped into sub-chunks of ``sub_rows`` consecutive entity rows;
    the last ``lookback`` rows of each sub-chunk are copied into the next one
    as context, so every frame is complete and a hot entity is spread over
    ``rows / sub_rows`` tasks.  With ``order_cols`` (no chunking needed) the
    frame is a plain per-entity window in that order.
    """
    keys = _as_list(keys)
    if order_cols is not None:
        # unchunked data: same partitioning and order as the expanding scan,
        # so Spark chains both windows without another exchange or sort
        w = Window.partitionBy(*keys).orderBy(*_order_exprs(order_cols))
        return df.withColumns(build(w))
    sub_rows = max(sub_rows, lookback + 1)
    rn0 = F.col(rn_col).cast("long") - 1
    is_ctx = F.lit(False) if lookback <= 0 else (F.pmod(rn0, F.lit(sub_rows)) >= F.lit(sub_rows - lookback))
    staged = (df.withColumn("_copy", F.explode(F.when(is_ctx, F.array(F.lit(0), F.lit(1)))
                                                 .otherwise(F.array(F.lit(0)))))
              .withColumn("_sub", F.floor(rn0 / sub_rows) + F.col("_copy")))
    w = Window.partitionBy(*keys, "_sub").orderBy(F.col(rn_col))
    cols = build(w)
    return staged.withColumns(cols).filter(F.col("_copy") == 0).drop("_copy", "_sub")


def with_value_chunks(df: DataFrame, keys, value_col: str, chunk_col: str = "_vchunk",
                      n_chunks: int = 1, n_rows: int | None = None) -> DataFrame:
    """Chunk id that increases with ``value_col`` inside every key.

    Chunks are ranges of the tuple (keys, value): a hot key gets several value
    ranges, many small keys share one, and equal (key, value) pairs always
    share a chunk.
    """
    cols = [*_as_list(keys), value_col]
    n = (df.count() if n_rows is None else n_rows) if n_chunks > 1 else 0
    return with_order_bucket(df, cols, order_cuts(df, cols, n_chunks, n), chunk_col)


def keyed_prefix_sums(df: DataFrame, keys, order_cols: Sequence[str], sums: dict[str, Column],
                      chunk_col: str | None = None) -> DataFrame:
    """Inclusive running sums ``name__cum`` in ``order_cols`` order within ``keys``.

    With ``chunk_col`` (a chunk id that is monotone in the order, e.g. from
    :func:`with_value_chunks`), each (key, chunk) is scanned by its own task
    and offset by the totals of the earlier chunks of the key.
    """
    keys = _as_list(keys)
    order = _order_exprs(order_cols)
    staged = df.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
    part = keys + ([chunk_col] if chunk_col else [])
    w = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns({f"_l_{n}": F.sum(f"_s_{n}").over(w) for n in sums})
    if not chunk_col:
        return local.withColumns({f"{n}__cum": F.col(f"_l_{n}") for n in sums}).drop(
            *[f"_s_{n}" for n in sums], *[f"_l_{n}" for n in sums])
    totals = staged.groupBy(*part).agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    wp = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(chunk_col) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, *[F.coalesce(F.sum(f"_t_{n}").over(wp), F.lit(0)).alias(f"_o_{n}")
                                     for n in sums])
    joined = _join_null_safe(local, offsets, part)
    return joined.withColumns({f"{n}__cum": F.col(f"_o_{n}") + F.col(f"_l_{n}") for n in sums}).drop(
        *[f"_{p}_{n}" for n in sums for p in ("s", "l", "o")])


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], keys=None,
                    n_chunks: int | None = None, count_col: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (NumPy ``linear`` / SQL
    ``quantile_cont``) without gathering a group's values in one buffer.

    Values are counted per (key, value), ranked by a chunked prefix sum, and
    only the rows holding the ``floor``/``ceil`` ranks of each requested
    probability survive: ``keys..., q_index, q, value``.  With ``count_col``
    the rows are counted values already (one per key and value).
    """
    keys = _as_list(keys)
    x = F.col(value_col).cast("double")
    real = df.filter(x.isNotNull() & ~F.isnan(x))
    if count_col is None:
        vc = real.groupBy(*keys, x.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    else:
        vc = real.filter(F.col(count_col) > 0).select(*keys, x.alias("_v"), F.col(count_col).alias("_c"))
    if n_chunks is None:
        # the distinct values are counted, ranged and scanned from here
        vc = vc if count_col else cut_lineage(vc)
        n_chunks = auto_chunks(vc)
    chunk = None
    if n_chunks > 1:
        vc = with_value_chunks(vc, keys, "_v", "_qchunk", n_chunks)
        chunk = "_qchunk"
    cum = keyed_prefix_sums(vc, keys, ["_v"], {"c": F.col("_c")}, chunk)
    totals = vc.groupBy(*keys).agg(F.sum("_c").alias("_n")) if keys else vc.agg(F.sum("_c").alias("_n"))
    j = cum.join(totals, keys, "left") if keys else cum.crossJoin(F.broadcast(totals))
    first = F.col("c__cum") - F.col("_c")   # 0-based rank of the first copy of this value
    last = F.col("c__cum") - 1
    targets = []
    for i, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        targets.append(F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q"), pos.alias("pos"),
                                F.floor(pos).alias("lo"), F.ceil(pos).alias("hi")))
    hit = F.filter(F.array(*targets), lambda t: ((t["lo"] >= first) & (t["lo"] <= last))
                   | ((t["hi"] >= first) & (t["hi"] <= last)))
    picked = j.select(*keys, "_v", first.alias("_first"), last.alias("_last"), F.explode(hit).alias("t"))
    in_lo = (F.col("t.lo") >= F.col("_first")) & (F.col("t.lo") <= F.col("_last"))
    in_hi = (F.col("t.hi") >= F.col("_first")) & (F.col("t.hi") <= F.col("_last"))
    g = picked.groupBy(*keys, F.col("t.qi").alias("q_index"), F.col("t.q").alias("q"),
                       F.col("t.pos").alias("_pos"), F.col("t.lo").alias("_lo")).agg(
        F.max(F.when(in_lo, F.col("_v"))).alias("_a"), F.max(F.when(in_hi, F.col("_v"))).alias("_b"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_lo"))
    return g.select(*keys, "q_index", "q", value.alias("value"))


def exact_quantile_row(df: DataFrame, value_col: str, probs: Sequence[float], names: Sequence[str],
                       keys=None) -> DataFrame:
    """Quantiles pivoted to one column per probability (one row per key)."""
    keys = _as_list(keys)
    q = exact_quantiles(df, value_col, probs, keys)
    aggs = [F.max(F.when(F.col("q_index") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    return q.groupBy(*keys).agg(*aggs) if keys else q.agg(*aggs)

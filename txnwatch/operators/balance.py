"""Class balancing of a training frame (BAL1-BAL4).

* BAL1 random oversampling draws exactly ``m`` extra minority rows with a
  seeded hash of a generated id, joined to the minority rows by position.
* BAL2 KMeans-SMOTE: ``pyspark.ml`` KMeans, per-cluster minority statistics,
  then interpolation ``x + u (x_nn - x)`` towards one of the ``k`` nearest minority rows of the
  cluster.  The neighbours are exact: blocks of at most ``BLOCK_ROWS`` rows are compared pair by
  pair, and a row's nearest of each pair merge into its nearest of all, so a hot
  cluster is many tiles and no task holds more than two blocks.
* BAL3 plain SMOTE: the same with all minority rows as one cluster.  No distances are summed there, so rows lie in cells of space, and
  a row is compared with its own cell and those that are no farther than the ``k``-th nearest it found there.
* BAL4 dispatches on an explicit method.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.functions.arrow import key_groups, vectors
from txnwatch.operators.models import MODEL_FILL
from txnwatch.operators.scan import add_global_position
from txnwatch.session import cut_lineage

# Fixed defaults.
OVERSAMPLE_MAX_RATIO = 0.10
SMOTE_TARGET_RATIO = 0.30
SMOTE_K = 5
CLUSTER_BALANCE_THRESHOLD = 0.1
N_CLUSTERS = 32
#: Rows of a block of neighbours, and rows of it that are compared at once.  A row goes to as many tiles as its cluster
#: has blocks, twice; a block is about a megabyte, and a strip against it a few.
BLOCK_ROWS, STRIP = 8192, 64
#: Squared distances by matrix product err by less than this share of the largest squared norm; closer ones are computed again.
PRODUCT_ERROR = 1e-12
#: Rows of a cell of space, and rows of each that its planes are found by; visitors of a cell that are compared by one task, about.
CELL_ROWS, CELL_SAMPLE, VISITORS = 2048, 64, 32_768
#: Shuffle partitions of the tiles at most; further tiles share one and come after each other.
MAX_TASKS = 1 << 14
METHODS = ("cluster_smote", "smote", "oversample")


def class_counts(df: DataFrame, label: str = "isFraud") -> tuple[int, int]:
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    return int(r["p"]), int(r["n"])


def random_oversample(df: DataFrame, label: str = "isFraud", ratio: float = OVERSAMPLE_MAX_RATIO,
                      seed: int = 42, id_col: str = "TransactionID") -> DataFrame:
    """BAL1: add ``floor(ratio * n_majority) - n_minority`` minority duplicates
    (drawn with replacement); exact count."""
    n_min, n_maj = class_counts(df, label)
    m = int(math.floor(ratio * n_maj)) - n_min
    if m <= 0 or n_min == 0:
        return df
    minority = add_global_position(df.filter(F.col(label) == 1), order_cols=(id_col,), pos_col="_mpos",
                                   n_rows=n_min)
    h = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 15)
    draws = df.sparkSession.range(m).select((F.conv(h, 16, 10).cast("long") % n_min).alias("_mpos"))
    extra = draws.join(minority, "_mpos").drop("_mpos")
    return df.unionByName(extra.select(*df.columns))


def _tile_pairs(rows: DataFrame, block_rows: int) -> DataFrame:
    """(_cluster, i, j, side, row, x): each block of a cluster's rows against each other one and itself."""
    sizes = rows.groupBy("_cluster").agg(F.min("row").alias("_g0"), F.count(F.lit(1)).alias("_m"))
    placed = (rows.join(F.broadcast(sizes), "_cluster")  # a row per cluster, ``n_clusters`` at most
              .withColumn("_b", F.floor((F.col("row") - F.col("_g0")) / block_rows).cast("int"))
              .withColumn("_o", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / block_rows).cast("int")))))
    left = placed.select("_cluster", F.col("_b").alias("i"), F.col("_o").alias("j"), F.lit(0).alias("side"), "row", "x")
    right = placed.select("_cluster", F.col("_o").alias("i"), F.col("_b").alias("j"), F.lit(1).alias("side"), "row", "x")
    return left.unionByName(right)


def _nearest_in_tile(x: np.ndarray, row: np.ndarray, y: np.ndarray, other: np.ndarray, k: int, sums: bool) -> tuple[list, list, list, float]:
    """Of each row of ``x`` its ``k`` nearest of ``y`` (numbers ``other``, rising; not itself) and the sum of all distances.

    A matrix product gives all squared distances up to its rounding; those that may be among the nearest are
    computed again from the differences, and only these decide.
    """
    own, others, far, total = [], [], [], 0.0
    cx, cy = x - y[0], y - y[0]
    nx, ny = (cx * cx).sum(axis=1), (cy * cy).sum(axis=1)
    slack = PRODUCT_ERROR * max(nx.max(), ny.max())
    kk = min(k, len(y))
    exact = lambda at, col: ((x[at] - y[col]) ** 2).sum(axis=1)
    for s in range(0, len(x), STRIP):
        e = min(s + STRIP, len(x))
        d2 = cx[s:e] @ cy.T
        d2 *= -2
        d2 += nx[s:e, None]
        d2 += ny
        if sums:
            at, col = np.nonzero(d2 <= 1000 * slack)
            d2[at, col] = exact(s + at, col)
            total += float(np.sqrt(d2).sum())
        place = np.searchsorted(other, row[s:e])
        inside = np.flatnonzero((place < len(other)) & (other[np.minimum(place, len(other) - 1)] == row[s:e]))
        d2[inside, place[inside]] = np.inf
        # the k-th nearest may be off by the slack, and so may another row
        bound = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        at, col = np.nonzero((d2 <= bound[:, None] + 2 * slack) & np.isfinite(d2))
        d = exact(s + at, col)
        order = np.lexsort((col, d, at))  # rows of a block come in order: ties stay with the lesser row
        at, col, d = at[order], col[order], d[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        own.append(row[s + at[first]])
        others.append(other[col[first]])
        far.append(d[first])
    return own, others, far, total


def nearest_rows(rows: DataFrame, k: int = SMOTE_K, block_rows: int = BLOCK_ROWS, sums: bool = True) -> tuple[DataFrame, DataFrame]:
    """Exact Euclidean neighbours inside each cluster of (_cluster, row, x): ``(row, rank, other, d2)``, rank 0 the
    nearest (ties: the lesser row), and ``(_cluster, i, j, total)``, sums of distances per pair of blocks (0 without ``sums``).

    Every pair of blocks is a tile of one task, which keeps the ``k`` nearest of each row; the lists of a row merge
    by one more top-k.  ``row`` numbers the rows of a cluster without gaps.
    """
    width = len(rows.select("x").first()["x"])
    tiles = _tile_pairs(rows, block_rows)
    n_pairs = rows.groupBy("_cluster").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.pow(F.ceil(F.col("m") / block_rows), 2))).first()[0]
    dealt = tiles.repartition(int(min(n_pairs, MAX_TASKS)), "_cluster", "i", "j").sortWithinPartitions("_cluster", "i", "j", "side", "row")

    def run(batches):
        for g in key_groups(batches, ["_cluster", "i", "j"]):
            side, row, x = g["side"].to_numpy(), g["row"].to_numpy(), vectors(g["x"], width)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            own, other, far, total = _nearest_in_tile(x[a], row[a], x[b], row[b], k, sums)
            n = sum(map(len, own))
            key = [g[c][0].as_py() for c in ("_cluster", "i", "j")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * (n + 1), pa.int32()) for v in key]
                + [pa.concat_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, t), k_), pa.nulls(1, k_)])
                   for c, t, k_ in ((own, np.int64, pa.int64()), (other, np.int64, pa.int64()), (far, np.float64, pa.float64()))]
                + [pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array([total])])],
                names=["_cluster", "i", "j", "row", "other", "d2", "total"])

    found = cut_lineage(dealt.mapInArrow(run, "_cluster int, i int, j int, row long, other long, d2 double, total double"))
    return _nearest_of(found.filter(F.col("row").isNotNull()), k), found.filter(F.col("row").isNull()).select("_cluster", "i", "j", "total")


def _nearest_of(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy("d2", "other")
    return lists.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("row", "rank", "other", "d2")


def cell_planes(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of each node of a tree that halves the sample along its widest feature; node i has children 2i + 1 (up to the value) and
    2i + 2, feature -1 parts no more."""
    size = 2 ** max(0, cells - 1).bit_length() - 1
    feature, value, held = np.full(size, -1), np.zeros(size), {0: sample}
    for i in range(size):
        own = held.pop(i, sample[:0])
        if len(own) < 2:
            continue
        f = int(own.std(axis=0).argmax())
        column = np.sort(own[:, f])
        below = column[column < column[-1]]
        if not len(below):
            continue
        feature[i], value[i] = f, min(column[(len(column) - 1) // 2], below[-1])
        low = own[:, f] <= value[i]
        held[2 * i + 1], held[2 * i + 2] = own[low], own[~low]
    return feature, value


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes (point, box)."""
    gap = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0)
    return np.einsum("abc,abc->ab", gap, gap)


def nearest_rows_by_cells(rows: DataFrame, k: int = SMOTE_K, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, visitors: int = VISITORS) -> DataFrame:
    """The neighbours ``nearest_rows`` finds, of rows that are one cluster: (row, x) -> (row, rank, other, d2).

    Cells part space by planes through the medians of a sample, which only decide who is compared first.  In its cell a row finds ``k``
    neighbours; others are nearer only in cells whose box is no farther than the last of those, and these it visits.
    """
    spark, width, n = rows.sparkSession, len(rows.select("x").first()["x"]), rows.count()
    cells = -(-n // min(cell_rows, block_rows))
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, n // (CELL_SAMPLE * cells)))) == 0).select("x").toArrow()["x"]
    feature, value = cell_planes(vectors(some, width), cells)

    def placed(batches):
        for batch in batches:
            x, node = vectors(batch.column(1), width), np.zeros(batch.num_rows, np.int64)
            for _ in range(len(feature).bit_length()):
                inner = np.flatnonzero((node < len(feature)) & (feature[np.minimum(node, len(feature) - 1)] >= 0))
                at = node[inner]
                node[inner] = 2 * at + 1 + (x[inner, feature[at]] > value[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node)], names=["row", "x", "cell"])

    celled = rows.select("row", F.col("x").cast("array<double>").alias("x"))
    celled = celled.mapInArrow(placed, "row long, x array<double>, cell long") if len(feature) else celled.withColumn("cell", F.lit(0).cast("long"))
    sizes = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}
    # a cell of too many rows (equal ones) is several blocks
    table = spark.createDataFrame([(c, -(-m // block_rows)) for c, m in sizes.items()], "cell long, pieces long")
    blocked = cut_lineage(celled.join(F.broadcast(table), "cell").select((F.col("cell") * n + F.pmod(F.xxhash64("row"), "pieces")).alias("block"), "row", "x"))
    ends = [f(F.col("x")[i]).alias(f"{a}{i}") for a, f in (("l", F.min), ("h", F.max)) for i in range(width)]
    boxes = sorted(blocked.groupBy("block").agg(*ends).collect())
    ids = np.array([b[0] for b in boxes], np.int64)
    low, high = np.array([b[1:width + 1] for b in boxes], float), np.array([b[width + 1:] for b in boxes], float)
    shared = spark.sparkContext.broadcast((ids, low, high))
    ddl = "row long, other long, d2 double, block long, x array<double>"

    def out(row, other, d2, block, x):
        m = len(row)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * width, pa.int32()), pa.array(x.ravel())) if x is not None else pa.nulls(m, pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *(pa.nulls(m, t) if c is None else pa.array(c, t) for c, t in ((other, pa.int64()), (d2, pa.float64()), (block, pa.int64()))), lists],
                                          names=["row", "other", "d2", "block", "x"])

    def at_home(batches):
        ids, low, high = shared.value
        for g in key_groups(batches, ["block"]):
            own, row, x = g["block"][0].as_py(), g["row"].to_numpy(), vectors(g["x"], width)
            found, other, d2, _ = _nearest_in_tile(x, row, x, row, k, False)
            found, other, d2 = np.concatenate(found), np.concatenate(other), np.concatenate(d2)
            yield out(found, other, d2, None, None)
            bound = np.full(len(row), np.inf)
            if len(row) > k:
                bound = np.zeros(len(row))
                np.maximum.at(bound, np.searchsorted(row, found), d2)
            bound = bound * (1 + 1e-9)
            me = int(np.searchsorted(ids, own))
            apart = np.maximum(np.maximum(low - high[me], low[me] - high), 0)
            near = np.flatnonzero(~((apart * apart).sum(axis=1) > bound.max()) & (ids != own))
            step = max(1, 4_000_000 // max(1, len(near) * width))
            for a in range(0, len(row) if len(near) else 0, step):
                at, j = np.nonzero(~(_gaps(x[a:a + step], low[near], high[near]) > bound[a:a + step, None]))
                for b in range(0, len(at), 100_000):
                    s = a + at[b:b + 100_000]
                    yield out(row[s], None, bound[s], ids[near[j[b:b + 100_000]]], x[s])

    tasks = int(min(len(boxes), MAX_TASKS))
    first = cut_lineage(blocked.repartition(tasks, "block").sortWithinPartitions("block", "row").mapInArrow(at_home, ddl))
    visits = first.filter(F.col("block").isNotNull()).select("block", F.lit(0).alias("side"), "row", "x", F.col("d2").alias("bound"))
    counts = visits.groupBy("block").count().collect()
    table = spark.createDataFrame([(r["block"], -(-r["count"] // visitors)) for r in counts], "block long, pieces long")
    hosts = blocked.join(F.broadcast(table), "block").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    guests = visits.join(F.broadcast(table), "block").withColumn("piece", F.pmod(F.xxhash64("row"), "pieces"))
    both = guests.select("block", "piece", "side", "row", "x", "bound").unionByName(
        hosts.select("block", "piece", F.lit(1).alias("side"), "row", "x", F.lit(None).cast("double").alias("bound")))
    n_pairs = sum(-(-r["count"] // visitors) for r in counts)

    def away(batches):
        for g in key_groups(batches, ["block", "piece"]):
            side, row, x, bound = g["side"].to_numpy(), g["row"].to_numpy(), vectors(g["x"], width), g["bound"].to_numpy()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found, other, d2, _ = _nearest_in_tile(x[a], row[a], x[b], row[b], k, False)
            found, other, d2 = np.concatenate(found), np.concatenate(other), np.concatenate(d2)
            keep = d2 <= bound[a][np.searchsorted(row[a], found)]
            yield out(found[keep], other[keep], d2[keep], None, None)

    lists = first.filter(F.col("block").isNull()).select("row", "other", "d2")
    if n_pairs:
        dealt = both.repartition(int(min(n_pairs, MAX_TASKS)), "block", "piece").sortWithinPartitions("block", "piece", "side", "row")
        lists = lists.unionByName(cut_lineage(dealt.mapInArrow(away, ddl).select("row", "other", "d2")))
    return _nearest_of(lists, k)


def allocate(need: int, weights: dict[int, float]) -> dict[int, int]:
    """``need`` dealt in proportion to the weights, whole and exact (largest remainders, then the lesser key)."""
    total = sum(weights.values())
    shares = {c: need * w / total for c, w in weights.items()}
    out = {c: int(math.floor(v)) for c, v in shares.items()}
    for c in sorted(shares, key=lambda c: (out[c] - shares[c], c))[:need - sum(out.values())]:
        out[c] += 1
    return out


def smote(df: DataFrame, features: Sequence[str], label: str = "isFraud", target_ratio: float = SMOTE_TARGET_RATIO,
          k: int = SMOTE_K, seed: int = 42, n_clusters: int = N_CLUSTERS, use_clusters: bool = True,
          block_rows: int = BLOCK_ROWS, id_col: str = "TransactionID") -> DataFrame:
    """BAL2 (``use_clusters``) / BAL3: exactly ``floor(target_ratio * n_majority) - n_minority`` synthetic minority
    rows; returns the original rows plus the synthetic ones (features only, label 1, other columns NULL).

    A synthetic row lies at a random place between a random minority row of its cluster and one of that row's ``k``
    nearest minority rows in the cluster, over all of the cluster.  A cluster takes part if its minority share
    is over ``CLUSTER_BALANCE_THRESHOLD`` and it has more than ``k`` minority rows, and gets rows in proportion to its
    sparsity, ``mean distance ** e / rows`` with ``e = 0.16 * log_1.6(rows) ** 1.8``.  Where no cluster
    takes part, all minority rows are one.  Missing features are filled as the models fill them.
    """
    features = list(features)
    n_min, n_maj = class_counts(df, label)
    need = int(math.floor(target_ratio * n_maj)) - n_min
    if need <= 0 or n_min < 2:
        return df
    filled = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(MODEL_FILL)), F.lit(MODEL_FILL)) for f in features]
    x = df.select(F.col(label).alias("_y"), F.col(id_col).alias("_id"), F.array(*filled).alias("x"))
    one = x.filter(F.col("_y") == 1).withColumn("_cluster", F.lit(0))
    minority = one
    if use_clusters:
        vectors_ = x.withColumn("_vec", array_to_vector("x")).persist(StorageLevel.MEMORY_AND_DISK)
        model = KMeans(k=max(2, min(n_clusters, n_min + n_maj)), seed=seed, featuresCol="_vec", predictionCol="_cluster").fit(vectors_)
        clustered = cut_lineage(model.transform(vectors_).drop("_vec"))
        vectors_.unpersist()
        stats = clustered.groupBy("_cluster").agg(F.count_if(F.col("_y") == 1).alias("m"), F.count(F.lit(1)).alias("t")).collect()
        some = [r["_cluster"] for r in stats if r.m > CLUSTER_BALANCE_THRESHOLD * r.t and r.m > k]
        if some:
            minority = clustered.filter((F.col("_y") == 1) & F.col("_cluster").isin(some))
    placed = add_global_position(minority.select("_cluster", "_id", "x", F.xxhash64("x").alias("_h")),
                                 order_cols=("_cluster", "_id", "_h"), pos_col="row")
    rows = cut_lineage(placed.select("_cluster", "row", "x"))
    sizes = {r["_cluster"]: (r.g0, r.m) for r in rows.groupBy("_cluster").agg(F.min("row").alias("g0"), F.count(F.lit(1)).alias("m")).collect()}
    weights = {c: 1.0 for c in sizes}
    if len(sizes) == 1:
        near = nearest_rows_by_cells(rows, k, block_rows)
    else:  # the sums of distances weigh clusters against each other
        near, sums = nearest_rows(rows, k, block_rows)
        for r in sums.groupBy("_cluster").agg(F.sum("total").alias("total")).collect():
            m = sizes[r["_cluster"]][1]
            weights[r["_cluster"]] = (r.total / (m * (m - 1))) ** (0.16 * math.log(m, 1.6) ** 1.8) / m
        if not sum(weights.values()) > 0:  # all rows of all clusters equal
            weights = {c: 1.0 for c in sizes}
    draws = df.sparkSession.range(need)
    h = lambda salt: F.xxhash64("id", F.lit(seed), F.lit(salt))
    start, base, n_near = 0, F.lit(None).cast("long"), F.lit(None).cast("long")
    for c, n in allocate(need, weights).items():
        g0, m = sizes[c]
        mine = (F.col("id") >= start) & (F.col("id") < start + n)
        base = F.when(mine, F.lit(g0) + F.pmod(h(1), F.lit(m))).otherwise(base)
        n_near = F.when(mine, F.lit(min(k, m - 1))).otherwise(n_near)
        start += n
    draws = draws.select(base.alias("row"), F.pmod(h(2), n_near).cast("int").alias("rank"),
                         (F.pmod(h(3), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("u"))
    ends = (draws.join(near.select("row", "rank", "other"), ["row", "rank"])
            .join(rows.select("row", "x"), "row").join(rows.select(F.col("row").alias("other"), F.col("x").alias("x2")), "other"))
    point = F.zip_with("x", "x2", lambda a, b: a + F.col("u") * (b - a))
    made = ends.select(point.alias("p")).select(*[F.col("p")[i].alias(f) for i, f in enumerate(features)],
                                               F.lit(1).cast(dict(df.dtypes)[label]).alias(label))
    return df.unionByName(made, allowMissingColumns=True)


def prepare_training_data(df: DataFrame, features: Sequence[str], label: str = "isFraud",
                          strategy: float = SMOTE_TARGET_RATIO, seed: int = 42, method: str = "cluster_smote") -> DataFrame:
    """BAL4: strategy 0 -> unchanged; else ``method`` at minority / majority =
    ``strategy``: "cluster_smote" (BAL2, or BAL3 where no cluster qualifies), "smote" (BAL3) or
    "oversample" (BAL1, whose customary ratio is ``OVERSAMPLE_MAX_RATIO``).  The caller chooses; no
    size changes the method."""
    if method not in METHODS:
        raise ValueError(f"unknown balancing method {method!r}")
    if not strategy or strategy <= 0:
        return df
    if method == "oversample":
        return random_oversample(df, label, strategy, seed)
    return smote(df, features, label, strategy, seed=seed, use_clusters=method == "cluster_smote")

"""Hard negatives by exact integer scores, multiplied in a residue number system.

Components become integers.  For a pair of tiles, anchors against rows, the scores are computed
modulo a few small primes: residues of both sides lie around zero, so that a product of up to
``DEPTH`` components sums to less than 2**24 and a float32 matrix product is exact.
The Chinese remainder theorem (mixed radix, digits around zero) gives the signed score.

Two passes over the tile pairs: the first keeps each anchor's best rows of its own label, the
second, with the positives' scores known, the first rows of other labels inside each positive's
window.  A tile's best few merge with those of other tiles, so no task holds an anchor's row of scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm import text as T
from txnwatch.session import cut_lineage

#: Anchors and rows of a tile pair, about, and anchors that are multiplied at once.
ANCHORS, ROWS, STRIP = 4096, 1024, 256
#: Components of one float32 product.
DEPTH = 64
#: Squared lengths up to which a vector takes part: scores, and 100 times a score, then fit a long.
LONGEST = 1 << 56
#: Shuffle partitions of the tile pairs at most; further pairs share one and come after each other.
TASKS = 1 << 15


def primes(bound: int, depth: int = DEPTH) -> list[int]:
    """Primes whose product exceeds ``2 * bound + 1`` and whose centred residues keep a product of ``depth`` terms below 2**24."""
    out, product = [], 1
    p = 2 * math.isqrt(((1 << 24) - 1) // depth) + 1
    while product <= 2 * bound + 1:
        if p % 2 and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 1
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integers modulo ``p``, from -(p - 1) / 2 to (p - 1) / 2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


def scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products of integer rows, as long; none may exceed ``bound`` in size."""
    out, radix = None, 1
    for p in primes(bound):
        r = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], DEPTH):
            part = residues(a[:, k:k + DEPTH], p).astype(np.float32) @ residues(b[:, k:k + DEPTH], p).astype(np.float32).T
            r += part.astype(np.int64)
        if out is None:
            out = residues(r, p)
        else:
            out += np.int64(radix) * residues(residues(r - out, p) * pow(radix, -1, p), p)
        radix *= p
    return out


def _prepared(df: DataFrame, scale: float) -> DataFrame:
    """(id, label, anchor, dim, x) of the rows that take part; x holds the components as int32."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            good = np.asarray(pc.and_(lists.is_valid(), batch.column(1).is_valid()))
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # null: nan
            row = np.repeat(np.arange(len(size)), size)
            fits = np.isfinite(x) & (np.abs(x) <= 1 << 28)
            x = np.where(fits, x, 0)
            good &= np.bincount(row, ~fits, len(size)) == 0
            good &= np.bincount(row, x * x, len(size)) <= LONGEST
            at, comps = np.cumsum(size) - size, x.astype(np.int32)
            keep = np.flatnonzero(good)
            own = [comps[at[i]:at[i] + size[i]].tobytes() for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep)) for c in range(3)), pa.array(size[keep].astype(np.int32)), pa.array(own, pa.binary())],
                                             names=["id", "label", "anchor", "dim", "x"])

    return df.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, anchor boolean, dim int, x binary")


def _tiles(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(dim, i, j, side, row, id, label, x, want): the rows of every tile pair, anchors on side 1 with the scores that they want."""
    count = lambda df, n, size: df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
    grid = count(anchors, "a", ANCHORS).join(count(rows, "r", ROWS), "dim")
    pairs = cut_lineage(grid)
    tasks = pairs.agg(F.sum(F.col("a") * F.col("r"))).first()[0] or 1
    cols = ["dim", "i", "j", "side", "row", "id", "label", "x", "want"]
    none = F.lit(None).cast("array<bigint>").alias("want")
    b = rows.join(pairs, "dim").withColumn("j", F.pmod(F.xxhash64("row"), "r").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a") - 1)))
    a = anchors.join(pairs, "dim").withColumn("i", F.pmod(F.xxhash64("row"), "a").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    both = b.withColumn("side", F.lit(0)).select(*cols[:-1], none).union(a.withColumn("side", F.lit(1)).select(*cols))
    return both.repartition(min(TASKS, int(tasks)), "dim", "i", "j").sortWithinPartitions("dim", "i", "j")


def _ranked(g: pa.Table):
    """Yield (anchor, scores, order) strips of a tile pair: columns are the pair's rows, in ``order`` by falling score and then by id."""
    d, side = g["dim"][0].as_py(), g["side"].to_numpy()
    code = pc.rank(g["id"], null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    row = g["row"].to_numpy()
    right = np.flatnonzero(side == 0)
    right = right[np.lexsort((row[right], code[right]))]
    left = np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return
    x = np.frombuffer(b"".join(g["x"].to_pylist()), np.int32).reshape(len(side), d).astype(np.int64)
    most = (x * x).sum(axis=1)
    bound = math.isqrt(int(most[left].max()) * int(most[right].max())) + 1
    for s in range(0, len(left), STRIP):
        own = left[s:s + STRIP]
        found = scores(x[own], x[right], bound)
        order = np.argsort(-found, axis=1, kind="stable")
        yield own, right, np.take_along_axis(found, order, axis=1), order


def _best_of_label(tiles: DataFrame, positives: int) -> DataFrame:
    """(anchor, other, id, score): an anchor's best rows of its own label in each tile."""
    kind = tiles.schema["id"].dataType.simpleString()

    def run(batches):
        for g in T.groups(batches, ["dim", "i", "j"]):
            g = g.combine_chunks()
            row, label = g["row"].to_numpy(), pc.rank(g["label"], tiebreaker="dense").to_numpy()
            for own, right, score, order in _ranked(g):
                at = right[order]
                same = (label[at] == label[own][:, None]) & (row[at] != row[own][:, None])
                i, j = np.nonzero(same & (np.cumsum(same, axis=1) <= positives))
                yield pa.RecordBatch.from_arrays([pa.array(row[own[i]]), pa.array(row[at[i, j]]), g["id"].combine_chunks().take(pa.array(at[i, j])), pa.array(score[i, j])],
                                                 names=["anchor", "other", "id", "score"])

    return tiles.mapInArrow(run, f"anchor long, other long, id {kind}, score long")


def _in_windows(tiles: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """(anchor, positive_score, other, id, score): the first rows of other labels in each window, tile by tile."""
    kind = tiles.schema["id"].dataType.simpleString()

    def run(batches):
        for g in T.groups(batches, ["dim", "i", "j"]):
            g = g.combine_chunks()
            row, label, want = g["row"].to_numpy(), pc.rank(g["label"], tiebreaker="dense").to_numpy(), g["want"].to_pylist()
            for own, right, score, order in _ranked(g):
                anchor, window, at, found = [], [], [], []
                for i, a in enumerate(own.tolist()):
                    col = np.flatnonzero(label[right[order[i]]] != label[a])
                    down = -score[i, col]  # rising
                    for p in want[a]:
                        # low * p <= 100 * score <= high * p, in whole numbers
                        first = np.searchsorted(down, -((high * p) // 100), "left")
                        last = np.searchsorted(down, (-low * p) // 100, "right")
                        take = col[first:min(last, first + negatives)]
                        anchor += [row[a]] * len(take)
                        window += [p] * len(take)
                        at.append(right[order[i, take]])
                        found.append(score[i, take])
                if anchor:
                    at = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor, pa.int64()), pa.array(window, pa.int64()), pa.array(row[at]), g["id"].combine_chunks().take(pa.array(at)), pa.array(np.concatenate(found))],
                        names=["anchor", "positive_score", "other", "id", "score"])

    return tiles.mapInArrow(run, f"anchor long, positive_score long, other long, id {kind}, score long")


def _first(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group by falling score, then by the lesser id (null last), with their ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "other")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ``negatives`` rows at most for each anchor and positive.

    A score is the inner product of vectors whose components are floor(scale * component).  Of the
    rows where ``anchors`` holds, each has as positives the ``positives`` best other rows of its label, and
    as hard negatives of each the best rows of other labels with scores of ``low`` to ``high`` hundredths of
    the positive's.  Ties go to the lesser id, a null id being the greatest; rows that share
    an id are separate rows (each anchor of them has its own result), and a row is never its own positive.

    Rows with a null label or vector, or a null or non-finite component, take no part, nor do those
    of a squared length over ``LONGEST`` in whole numbers.  Vectors of different dimension have no score.
    """
    rows = cut_lineage(_prepared(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("x")), scale))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    asked = rows.filter("anchor")
    best = _best_of_label(_tiles(rows, asked.withColumn("want", F.lit(None).cast("array<bigint>"))), positives)
    chosen = cut_lineage(_first(best, ["anchor"], positives).drop("rank"))
    want = chosen.groupBy("anchor").agg(F.collect_set("score").alias("want"))  # ``positives`` scores at most
    wanting = asked.drop("anchor").join(want.withColumnRenamed("anchor", "row"), "row")
    near = _first(_in_windows(_tiles(rows, wanting), negatives, low, high), ["anchor", "positive_score"], negatives)
    named = chosen.select(F.col("anchor").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    found = near.select(F.col("anchor").alias("row"), "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

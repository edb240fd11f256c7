"""A random forest of many rows (MOD1), grown from histograms in one barrier stage.

The forest is ``pyspark.ml``'s: Poisson(1) bootstraps, Gini gain, splits at quantiles, a draw of the square root of all features
for each node, siblings that predict the same class joined, class shares of the leaves averaged.  The library keeps
a bootstrap count and a node id of each row and tree beside the rows; here a task keeps its rows as bytes and
grows as many trees at a time as there are tasks, level by level.  Each tree has an owner among the tasks, who adds up
all tasks' class counts per node, drawn feature and bin, finds the splits and hands them back, through small files in
the checkpoint folder (as ``boosting``).  The draws follow from the seed, the tree, the level and the task.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.boosting import barrier_slots, binned, exchange_folder, filled, read_whole, write_whole

#: Bins of a feature, and the quantiles they are made of: a feature of fewer values than bins is parted at all it shows there.
BINS, QUANTILES, BIN_ACCURACY = 32, 256, 10_000
LEAST_ROWS = 10
#: Rows that are counted at once, at least.
CHUNK = 65_536
#: How often a bootstrap draws a row, by a uniform number of 16 bits: Poisson(1).
DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])[:-1], (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


@dataclass
class GrownForest:
    """A fitted forest.  Node i of a tree has children ``left[i]`` (bin up to ``cut[i]``) and ``left[i] + 1``; ``feature`` is -1 at leaves."""
    features: list[str]
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature, cut, left, share of label 1
    importances: np.ndarray
    depth: int

    def transform(self, df: DataFrame, out_col: str = "score") -> DataFrame:
        """Add the probability of label 1, computed on Arrow batches."""
        shared = df.sparkSession.sparkContext.broadcast((self.edges, self.trees))
        fields = [f for f in df.schema.fields if f.name != out_col]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        width, depth = len(self.features), self.depth

        def run(batches):
            edges, trees = shared.value
            for batch in batches:
                bins = binned(batch.column(len(fields)).flatten().to_numpy().reshape(-1, width), edges)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(shares(bins, trees, depth))], names=[*(f.name for f in fields), out_col])

        return df.select(*[f.name for f in fields], F.array(*[filled(F.col(c)) for c in self.features]).alias("__x")).mapInArrow(run, f"{ddl}, `{out_col}` double")


def shares(bins: np.ndarray, trees: Sequence[tuple], depth: int) -> np.ndarray:
    """The mean share of label 1 of the leaves where each row ends."""
    total, flat, base = np.zeros(len(bins)), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    for feature, cut, left, share in trees:
        rows, node, value = base, np.zeros(len(bins), np.int32), np.full(len(bins), share[0])
        at = np.arange(len(bins))
        for _ in range(depth):
            f = feature[node]
            inner = f >= 0
            if not inner.all():
                rows, node, at, f = rows[inner], node[inner], at[inner], f[inner]
            if not len(at):
                break
            node = left[node] + (flat[rows + f] > cut[node])
            value[at] = share[node]
        total += value
    return total / max(len(trees), 1)


class _Tree:
    """One tree as it grows; every task keeps the same."""

    def __init__(self):
        self.feature, self.cut, self.left = np.array([-1], np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32)
        self.gain, self.counts, self.open = np.zeros(1), np.zeros((1, 2)), np.zeros(1, np.int64)

    def split(self, found: tuple, last: bool) -> np.ndarray:
        """Add the splits of the open nodes; per open node the numbers of its children among the next open ones (-1: a leaf)."""
        feature, cut, gain, left, right = found
        if len(self.feature) == 1:
            self.counts[0] = left[0] + right[0]
        some, n = np.flatnonzero(feature >= 0), len(self.feature)
        at, counts = self.open[some], np.stack([left[some], right[some]], axis=1).reshape(-1, 2)
        self.feature[at], self.cut[at], self.gain[at], self.left[at] = feature[some], cut[some], gain[some], n + 2 * np.arange(len(some))
        more = len(counts)
        for name, fill in (("feature", -1), ("cut", 0), ("gain", 0), ("left", 0)):
            own = getattr(self, name)
            setattr(self, name, np.append(own, np.full(more, fill, own.dtype)))
        self.counts = np.concatenate([self.counts, counts])
        goes_on = (counts.min(axis=1) > 0) & (not last)
        self.open = n + np.flatnonzero(goes_on)
        children = np.full((len(feature), 2), -1, np.int32)
        children[some] = np.where(goes_on, np.cumsum(goes_on) - 1, -1).reshape(-1, 2)
        return children

    def finish(self, width: int) -> tuple[tuple, np.ndarray]:
        """(feature, cut, left, share) with siblings of one class joined, and each feature's share of the gain."""
        predicted = self.counts[:, 1] > self.counts[:, 0]
        for i in range(len(self.feature) - 1, -1, -1):
            a = self.left[i]
            if self.feature[i] >= 0 and self.feature[a] < 0 and self.feature[a + 1] < 0 and predicted[a] == predicted[a + 1]:
                self.feature[i] = -1
        total, keep, stack = np.zeros(width), [], [0]
        number = np.zeros(len(self.feature), np.int32)
        for i in stack:  # in the order of the children's numbers
            keep.append(i)
            if self.feature[i] >= 0:
                number[i] = len(stack)
                total[self.feature[i]] += self.gain[i] * self.counts[i].sum()
                stack += [self.left[i], self.left[i] + 1]
        counts = self.counts[keep]
        share = counts[:, 1] / np.maximum(counts.sum(axis=1), 1)
        return (self.feature[keep], self.cut[keep], number[keep], share), total / total.sum() if total.sum() > 0 else total


def best_splits(hist: np.ndarray, drawn: np.ndarray, least_rows: int = LEAST_ROWS) -> tuple:
    """(feature or -1, bin, gain, left counts, right counts) of each node by Gini gain, from class counts (node, drawn feature, bin, class)."""
    left = np.cumsum(hist, axis=2, dtype=np.float64)
    total = left[:, :1, -1:, :]
    right = total - left
    nl, nr = left.sum(axis=-1), right.sum(axis=-1)
    n = np.maximum(total.sum(axis=-1), 1)
    squares = lambda c, m: (c * c).sum(axis=-1) / np.maximum(m, 1)
    gain = (squares(left, nl) + squares(right, nr) - squares(total, n)) / n
    gain = np.where((nl >= least_rows) & (nr >= least_rows), gain, 0).reshape(len(hist), -1)
    where = gain.argmax(axis=1)
    node = np.arange(len(hist))
    k, b = np.divmod(where, hist.shape[2])
    gain = gain[node, where]
    return np.where(gain > 1e-15, drawn[node, k], -1), b, gain, left[node, k, b], right[node, k, b]


def node_counts(x2: np.ndarray, y: np.ndarray, rows: np.ndarray, weight: np.ndarray, node: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Class counts (node, drawn feature, bin, class) of drawn rows; ``x2`` has a row's bins, doubled."""
    n, m = drawn.shape
    size, width, flat = n * 2 * BINS, x2.shape[1], x2.ravel()
    out, step = np.zeros((m, size)), max(CHUNK, size)
    for a in range(0, len(rows), step):
        own, at = rows[a:a + step], node[a:a + step]
        base, key, w = own.astype(np.intp) * width, at.astype(np.intp) * (2 * BINS) + y[own], weight[a:a + step].astype(np.float64)
        for k in range(m):
            out[k] += np.bincount(key + flat[base + drawn[at, k]], w, size)
    return out.reshape(m, n, BINS, 2).transpose(1, 0, 2, 3)


class _Owners:
    """Tree j of those that grow together is owned by task j modulo the tasks: it sees the sums of all tasks and finds the splits."""

    def __init__(self, folder: str, part: int, parts: int):
        self.folder, self.part, self.parts, self.steps = folder, part, parts, 0

    def _path(self, step: int, *names: int) -> str:
        return os.path.join(self.folder, "-".join(map(str, (step, *names))))

    def splits(self, hists: list[np.ndarray], drawn: list[np.ndarray]) -> list[tuple]:
        owners = range(min(self.parts, len(hists)))
        for o in owners:
            write_whole(self._path(self.steps, o, self.part), [h.astype(np.int32) for h in hists[o::self.parts]])
        if self.part in owners:
            sums = None
            for q in range(self.parts):
                more = read_whole(path := self._path(self.steps, self.part, q))
                os.unlink(path)
                sums = [h.astype(np.int64) for h in more] if sums is None else [a + b for a, b in zip(sums, more)]
            if self.steps and os.path.exists(old := self._path(self.steps - 1, self.part)):  # who is at this step has read the former one's splits
                os.unlink(old)
            write_whole(self._path(self.steps, self.part), [best_splits(h, d) for h, d in zip(sums, drawn[self.part::self.parts])])
        found: list = [None] * len(hists)
        for o in owners:
            found[o::self.parts] = read_whole(self._path(self.steps, o))
        self.steps += 1
        return found


def grow(x: np.ndarray, y: np.ndarray, numbers: Sequence[int], depth: int, seed: int, part: int, owners) -> list[_Tree]:
    """Some trees over the tasks' rows (bins and labels), level by level."""
    x2, width = (x * 2).astype(np.uint8), x.shape[1]
    m = math.ceil(math.sqrt(width))
    trees, held = [_Tree() for _ in numbers], []
    for t in numbers:
        weight = DRAWS[np.random.default_rng([seed, t, part]).integers(0, 65_536, len(y), np.uint16)]
        rows = np.flatnonzero(weight).astype(np.int32)
        held.append((rows, weight[rows], np.zeros(len(rows), np.int32)))
    for level in range(depth):
        going = [i for i, tree in enumerate(trees) if len(tree.open)]
        if not going:
            break
        drawn = []
        for i in going:
            rng = np.random.default_rng([seed, numbers[i], level, 1 << 20])
            drawn.append(rng.random((len(trees[i].open), width)).argpartition(m - 1, axis=1)[:, :m])
        hists = [node_counts(x2, y, *held[i], d) for i, d in zip(going, drawn)]
        for i, found in zip(going, owners.splits(hists, drawn)):
            children = trees[i].split(found, level + 1 == depth)
            rows, weight, node = held[i]
            f = found[0][node]
            inner = np.flatnonzero(f >= 0)
            node, rows, weight = node[inner], rows[inner], weight[inner]
            right = x2.ravel()[rows.astype(np.intp) * width + f[inner]] > 2 * found[1][node]
            node = children[node, right.astype(np.intp)]
            stay = node >= 0
            held[i] = rows[stay], weight[stay], node[stay]
    return trees


def bin_edges(df: DataFrame, width: int) -> list[np.ndarray]:
    """Edges that part each feature of ``x`` into ``BINS`` quantiles at most."""
    cuts = [i / QUANTILES for i in range(1, QUANTILES)]
    r = df.agg(*[F.percentile_approx(F.col("x")[k], cuts, BIN_ACCURACY).alias(f"e{k}") for k in range(width)]).first()
    out = []
    for k in range(width):
        fine = np.array(r[f"e{k}"] or [], np.float64)
        some = np.unique(fine)
        out.append(some if len(some) < BINS else np.unique(fine[np.arange(1, BINS) * QUANTILES // BINS - 1]))
    return out


def fit_grown_forest(train: DataFrame, features: Sequence[str], seed: int, trees: int, depth: int, label: str = "isFraud") -> GrownForest | None:
    """Fit on all rows, which are read twice; None where no barrier stage can run or tasks share no mounted checkpoint folder."""
    spark, width = train.sparkSession, len(features)
    sc = spark.sparkContext
    together = barrier_slots(sc)
    folder = exchange_folder(spark) if together else None
    if not folder:
        return None
    rows = train.filter(F.col(label).isNotNull()).select((F.col(label) > 0).alias("y"), F.array(*[filled(F.col(c)) for c in features]).alias("x"))
    edges = bin_edges(rows, width)
    shared = sc.broadcast(edges)

    def blocks(batches):
        for batch in batches:
            bins = binned(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8), bins)], names=["y", "x"])

    def grown(held):
        ys, xs = [np.zeros(0, np.uint8)], [np.zeros((0, width), np.uint8)]
        for r in held:
            ys.append(np.frombuffer(r[0], np.uint8))
            xs.append(np.frombuffer(r[1], np.uint8).reshape(-1, width))
        y, x, ys, xs = np.concatenate(ys), np.concatenate(xs), None, None
        task = BarrierTaskContext.get()
        part = task.partitionId()
        # a folder of its own for each attempt of the stage, named by the first task
        where = os.path.join(folder, task.allGather(uuid.uuid4().hex)[0])
        os.makedirs(where, exist_ok=True)
        owners = _Owners(where, part, together)
        for a in range(0, trees, together):
            found = grow(x, y, range(a, min(a + together, trees)), depth, seed, part, owners)
            if not part:
                yield from (tree.finish(width) for tree in found)

    # dealt in turn, so that equal rows spread too; their order, which the draws go by, follows from their hash
    dealt = rows.repartition(together).sortWithinPartitions(F.xxhash64("y", "x"), "y", "x")
    try:
        found = dealt.mapInArrow(blocks, "y binary, x binary").rdd.barrier().mapPartitions(grown).collect()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        shared.unpersist()
    total = np.sum([gains for _, gains in found], axis=0)
    return GrownForest(list(features), edges, [tree for tree, _ in found], total / total.sum() if total.sum() > 0 else total, depth)

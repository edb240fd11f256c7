"""Gradient-boosted trees from histograms (MOD2-MOD4), many boosters in one pass.

Features are binned once, by quantiles of the training rows, into a byte matrix.  The
rows stay in blocks spread over the cluster, each with its raw scores.  A growth step is one job:
every task adds up the gradient and hessian histograms of the nodes that are asked for, and
one tree aggregate merges them.  Only the smaller child of a split is counted, its sibling
is the parent less that child.  The driver sees histograms and trees, never rows.

A tree takes a step per level: best-first growth under a leaf limit is the same tree whether
a node's split is found when its turn comes or one level ahead, so all nodes of a level are
counted together and the limit is applied to the finished levels, best gain first.  Boosters
(other models, other folds) grow in the same steps, each until its validation loss has not fallen
for ``patience`` rounds.  A group of at most ``LOCAL_ROWS`` rows needs no merging: its boosters grow by the
same code, each in a task of its own.  Larger groups grow in one barrier stage: every task keeps its share of the rows
from the first tree to the last, runs the same growth and adds up its histograms with the others' through
small files in the checkpoint folder.  Where that folder is no mounted one, or tasks can't all run at once, a step is
a job as described.

``growth`` is "leaf" (best first, up to ``leaves`` leaves), "level" (all nodes) or "symmetric"
(one split for all nodes of a level).
"""

from __future__ import annotations

import heapq
import os
import pickle
import shutil
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.session import checkpoint_dir

#: Rows of a block, at most; a block is what a task works on at once (about 60 bytes a row at 13 features).
BLOCK_ROWS = 131_072
#: Rows of a group that a task grows a booster on alone, at most (about 150 megabytes at 13 features).
LOCAL_ROWS = 1_000_000
#: Seconds that a task of a barrier stage waits for another one's histograms, at most.
LONGEST_WAIT = 3600
#: Rounds after which the rows' lineage is cut by a reliable checkpoint.
CHECKPOINT_ROUNDS = 40
#: Relative accuracy of the quantiles that part the bins.
BIN_ACCURACY = 10_000
FILL = -999.0


@dataclass(frozen=True)
class Boosting:
    """How a booster grows; ``columns`` and ``rows`` are shares drawn for each tree."""
    rounds: int
    rate: float
    depth: int
    growth: str = "level"
    leaves: int = 0
    least_rows: int = 1
    least_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    least_gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    patience: int = 30
    bins: int = 64


@dataclass
class Trees:
    """A fitted booster.  Node i of a tree has children 2i + 1 (bin up to ``bin``) and 2i + 2; ``feature`` is -1 at leaves."""
    features: list[str]
    edges: list[np.ndarray]
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gains: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)

    @property
    def importances(self) -> np.ndarray:
        """Each feature's share of the total gain."""
        total = self.gains.sum()
        return self.gains / total if total > 0 else self.gains

    def parts(self) -> tuple:
        stack = lambda xs, kind: np.stack(xs).astype(kind) if xs else np.zeros((0, 1), kind)
        return self.edges, self.base, stack(self.feature, np.int16), stack(self.bin, np.uint8), stack(self.value, np.float32)

    def transform(self, df: DataFrame, out_col: str = "score") -> DataFrame:
        """Add the probability of label 1, computed on Arrow batches."""
        shared = df.sparkSession.sparkContext.broadcast(self.parts())
        x = F.array(*[filled(F.col(c)) for c in self.features])
        fields = [f for f in df.schema.fields if f.name != out_col]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        width = len(self.features)

        def run(batches):
            edges, base, feature, cut, value = shared.value
            for batch in batches:
                bins = binned(batch.column(len(fields)).flatten().to_numpy().reshape(-1, width), edges)
                raw = base + sum_trees(bins, feature, cut, value)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(sigmoid(raw))], names=[*(f.name for f in fields), out_col])

        return df.select(*[f.name for f in fields], x.alias("__x")).mapInArrow(run, f"{ddl}, `{out_col}` double")


def filled(c):
    """A feature as the models see it: a double, missing ones ``FILL``."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(FILL)), F.lit(FILL))


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(raw.astype(np.float64), -40, 40)))


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows of features: how many of a feature's edges are below the value."""
    return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)]).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _descend_by(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The node of one tree where each row ends, from ``node`` on; ``columns`` has a row per feature."""
    rows = np.arange(columns.shape[1])
    for _ in range(len(feature).bit_length()):
        f = feature[node]
        inner = np.flatnonzero(f >= 0) if node.any() or f.min(initial=0) < 0 else rows
        if not len(inner):
            break
        at = node[inner]
        node = node.copy()
        node[inner] = 2 * at + 1 + (columns[f[inner], inner] > cut[at])
    return node


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of one tree where each row ends."""
    return _descend_by(np.ascontiguousarray(bins.T), feature, cut, np.zeros(len(bins), np.int64))


def sum_trees(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    total, columns, root = np.zeros(len(bins)), np.ascontiguousarray(bins.T), np.zeros(len(bins), np.int64)
    for f, c, v in zip(feature, cut, value, strict=True):
        total += v[_descend_by(columns, f, c, root)]
    return total


def _gain_of(g: np.ndarray, h: np.ndarray, p: Boosting) -> np.ndarray:
    t = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)
    return t * t / np.maximum(h + p.l2, 1e-12)


def split_gains(hist: np.ndarray, p: Boosting) -> tuple[np.ndarray, np.ndarray]:
    """Gains of all splits of histograms (node, feature, bin, [gradient, hessian, rows]), -inf where a child is too
    small, and the left children's sums; a split at bin b sends bins up to b to the left."""
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    gain = (_gain_of(left[..., 0], left[..., 1], p) + _gain_of(right[..., 0], right[..., 1], p)
            - _gain_of(total[..., 0], total[..., 1], p) - p.least_gain)
    ok = ((left[..., 2] >= p.least_rows) & (right[..., 2] >= p.least_rows)
          & (left[..., 1] >= p.least_hessian) & (right[..., 1] >= p.least_hessian))
    return np.where(ok, gain, -np.inf), left


class _Growing:
    """One booster on the driver: its finished trees and the one that grows."""

    def __init__(self, number: int, group: int, params: Boosting, seed: int, model: Trees):
        self.number, self.group, self.p, self.seed, self.model = number, group, params, seed, model
        self.best, self.best_round, self.done = np.inf, 0, params.rounds == 0
        self.start()

    def start(self) -> None:
        size = 2 ** (self.p.depth + 1) - 1
        self.feature, self.cut = np.full(size, -1, np.int16), np.zeros(size, np.uint8)
        self.sums, self.gain = np.zeros((size, 3)), np.zeros(size)
        n = len(self.model.features)
        rng = np.random.default_rng([self.seed, len(self.model.value)])
        self.columns = np.sort(rng.choice(n, max(1, round(self.p.columns * n)), replace=False))
        self.asked, self.parents = [0], {}

    def request(self) -> tuple:
        return (self.number, self.group, self.asked, self.feature, self.cut, self.columns, self.p.bins, self.p.rows, self.seed, len(self.model.value))

    def take(self, hist: np.ndarray, level: int) -> None:
        """The merged histograms of the nodes asked for: find this level's splits and ask for the next one's."""
        hists = {}
        for k, node in enumerate(self.asked):
            hists[node] = hist[k]
            if node:
                other = node + 1 if node % 2 else node - 1
                hists[other] = self.parents[(node - 1) // 2] - hist[k]
        nodes = sorted(hists)
        stack = np.stack([hists[n] for n in nodes])
        if not level:
            self.sums[0] = stack[0, 0].sum(axis=0)
        gain, left = split_gains(stack, self.p)
        if self.p.growth == "symmetric":
            # a node that can't be split so adds nothing, and passes its rows to whichever side they fall
            each = np.where(np.isfinite(gain), np.maximum(gain, 0), 0)
            where = np.full(len(nodes), int(each.sum(axis=0).argmax()))
            keep = np.full(len(nodes), each.sum(axis=0).max() > 0)
            value = each.reshape(len(nodes), -1)[np.arange(len(nodes)), where]
        else:
            flat = gain.reshape(len(nodes), -1)
            where = flat.argmax(axis=1)
            value = flat[np.arange(len(nodes)), where]
            keep = np.isfinite(value) & (value > 0)
        self.asked, self.parents = [], {}
        for k, node in enumerate(nodes):
            if not keep[k]:
                continue
            f, b = divmod(int(where[k]), gain.shape[2])
            self.feature[node], self.cut[node], self.gain[node] = self.columns[f], b, value[k]
            self.sums[2 * node + 1] = left[k, f, b]
            self.sums[2 * node + 2] = self.sums[node] - left[k, f, b]
            if level + 1 < self.p.depth:
                small = 2 * node + 1 + int(self.sums[2 * node + 2, 2] < self.sums[2 * node + 1, 2])
                self.asked.append(small)
                self.parents[node] = hists[node]

    def finish(self) -> None:
        """Apply the leaf limit, best gain first, and add the tree."""
        if self.p.growth == "leaf":
            kept, heap = set(), [(-self.gain[0], 0)] if self.feature[0] >= 0 else []
            while heap and len(kept) + 1 < self.p.leaves:
                _, node = heapq.heappop(heap)
                kept.add(node)
                for child in (2 * node + 1, 2 * node + 2):
                    if child < len(self.feature) and self.feature[child] >= 0:
                        heapq.heappush(heap, (-self.gain[child], child))
            cut_off = np.array([n not in kept for n in range(len(self.feature))])
            self.feature[cut_off] = -1
        g, h = self.sums[:, 0], self.sums[:, 1]
        value = -self.p.rate * np.sign(g) * np.maximum(np.abs(g) - self.p.l1, 0) / np.maximum(h + self.p.l2, 1e-12)
        inner = self.feature >= 0
        np.add.at(self.model.gains, self.feature[inner], self.gain[inner])
        self.model.feature.append(self.feature)
        self.model.bin.append(self.cut)
        self.model.value.append(np.where(self.sums[:, 2] > 0, value, 0.0))

    def judge(self, loss: float | None) -> None:
        """The validation loss after the last tree: stop where it hasn't fallen for ``patience`` rounds."""
        rounds = len(self.model.value)
        if loss is not None:
            self.model.losses.append(loss)
            if loss < self.best - 1e-12:
                self.best, self.best_round = loss, rounds
            self.done = rounds - self.best_round >= self.p.patience
        self.done |= rounds >= self.p.rounds
        if self.done and loss is not None:
            for trees in (self.model.feature, self.model.bin, self.model.value):
                del trees[self.best_round:]


def _parted(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, held: list[tuple]) -> list[tuple]:
    """The rows of (node, rows) handed down one tree to where they end, in their order; ``columns`` has a row per feature."""
    out, todo = [], list(held)
    while todo:
        node, rows = todo.pop()
        f = feature[node]
        if f < 0:
            out.append((node, rows))
            continue
        right = (columns[f] if isinstance(rows, slice) else columns[f].take(rows.astype(np.intp), mode="clip")) > cut[node]
        left = ~right
        todo += [(2 * node + 1 + k, np.flatnonzero(x).astype(np.int32) if isinstance(rows, slice) else rows.compress(x)) for k, x in enumerate((left, right))]
    return out


def _under(feature: np.ndarray, node: int) -> int:
    """The first leaf on the way from the root to a node, or else the node."""
    way = [node]
    while way[-1]:
        way.append((way[-1] - 1) // 2)
    return next((n for n in reversed(way) if feature[n] < 0), node)


def _drawn(keys: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Which rows a tree draws, by a hash of the row: the same wherever the row is."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03 + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _histograms(block: tuple, requests: list[tuple], memo: dict | None = None) -> dict[int, np.ndarray]:
    """Per booster, the histograms of the nodes it asks for over the training rows of one block.

    With a ``memo`` that is kept between the steps of a tree, drawn rows go down one level from where they
    were instead of all the way from the root.
    """
    group, keys, columns, y, is_val, raw, slots = block
    out, memo = {}, {} if memo is None else memo
    for b, g, asked, feature, cut, drawn, n_bins, share, seed, tree in requests:
        if g != group or not asked or b not in slots:
            continue
        known = memo.get(b)
        if known is None or known[0] != tree:
            use = ~is_val & _drawn(keys, share, seed, tree) if share < 1 else ~is_val
            rows, rest = np.flatnonzero(use).astype(np.int32), np.flatnonzero(~use).astype(np.int32)
            p = sigmoid(raw[slots[b]][rows])
            grad, hess = np.empty(len(y)), np.empty(len(y))  # of drawn rows only
            grad[rows], hess[rows] = p - y[rows], p * (1 - p)
            known = [tree, grad, hess, [(0, rows if len(rest) else slice(None))], rest]
        memo[b] = known
        known[3] = _parted(columns, feature, cut, known[3])
        _, grad, hess, held, _ = known
        held = dict(held)
        hist = np.zeros((len(asked), len(drawn), n_bins, 3))
        for i, node in enumerate(asked):
            some = held[node]
            own = slice(None) if isinstance(some, slice) else some.astype(np.intp)
            weights = (grad[own], hess[own], None)
            for k, c in enumerate(drawn):
                key = (columns[c] if isinstance(own, slice) else columns[c].take(own, mode="clip")).astype(np.intp)
                for channel, w in enumerate(weights):
                    hist[i, k, :, channel] = np.bincount(key, w, n_bins)
        out[b] = hist
    return out


def _add_tree(block: tuple, trees: dict[int, tuple], memo: dict) -> None:
    """Add a tree to the block's raw scores; rows that the ``memo`` has at a node don't start from the root again."""
    _, _, columns, _, _, raw, slots = block
    for b, slot in slots.items():
        if b in trees:
            feature, cut, value = trees[b]
            known = memo.pop(b, None)
            held = [(_under(feature, node), rows) for node, rows in known[3]] + [(0, known[4])] if known else [(0, slice(None))]
            known = None
            own = raw[slot]
            for node, rows in _parted(columns, feature, cut, held):
                own[rows] += value[node]


def _losses(block: tuple) -> dict[int, np.ndarray]:
    """Per booster, the sum of the log losses of the validation rows, and their number."""
    _, _, _, y, is_val, raw, slots = block
    if not is_val.any():
        return {}
    z, own = raw[:, is_val], y[is_val]
    return {b: np.array([(np.logaddexp(0, z[slot]) - own * z[slot]).sum(), len(own)]) for b, slot in slots.items()}


def _merged(a: dict, b: dict) -> dict:
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


def bin_edges(df: DataFrame, features: Sequence[str], bins: int, by: str = "group") -> dict[int, tuple[list[np.ndarray], int, int]]:
    """Per group of (group, y, is_val, x...): edges that part each feature's training values into ``bins`` quantiles, rows and positives."""
    cuts = [i / bins for i in range(1, bins)]
    own = df.filter(~F.col("is_val")).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"),
        *[F.percentile_approx(F.col("x")[k], cuts, BIN_ACCURACY).alias(f"e{k}") for k in range(len(features))])
    return {r[by]: ([np.unique(np.array(r[f"e{k}"], np.float64)) for k in range(len(features))], int(r.n), int(r.p)) for r in own.collect()}


class _LocalRows:
    """The blocks of one task, as what a booster grows on."""

    def __init__(self, blocks: list[tuple]):
        self.blocks, self.memos = blocks, [{} for _ in blocks]

    def step(self, requests: list[tuple], with_loss: bool) -> tuple[dict, dict]:
        hist, loss = {}, {}
        for block, memo in zip(self.blocks, self.memos):
            _merged(hist, _histograms(block, requests, memo))
            if with_loss:
                _merged(loss, _losses(block))
        return hist, loss

    def add(self, trees: dict[int, tuple]) -> None:
        for block, memo in zip(self.blocks, self.memos):
            _add_tree(block, trees, memo)
            memo.clear()  # of boosters that are done too


class _SharedRows:
    """The blocks of all tasks: a step is a job with one tree aggregate, and the raw scores after a tree are a new version of the blocks."""

    def __init__(self, data, tasks: int):
        self.data, self.depth, self.old, self.rounds = data.persist(StorageLevel.MEMORY_AND_DISK), 1 if tasks <= 32 else 2, [], 0

    def step(self, requests: list[tuple], with_loss: bool) -> tuple[dict, dict]:
        work = lambda rows: [_LocalRows(list(rows)).step(requests, with_loss)]
        found = self.data.mapPartitions(work).treeReduce(lambda a, b: (_merged(a[0], b[0]), _merged(a[1], b[1])), depth=self.depth)
        for x in self.old:
            x.unpersist()
        self.old = []
        return found

    def add(self, trees: dict[int, tuple]) -> None:
        self.rounds += 1
        def with_tree(block):
            block = (*block[:5], block[5].copy(), block[6])
            _add_tree(block, trees, {})
            return block

        fresh = self.data.map(with_tree).persist(StorageLevel.MEMORY_AND_DISK)
        if self.rounds % CHECKPOINT_ROUNDS == 0:
            fresh.checkpoint()
        self.old.append(self.data)
        self.data = fresh

    def release(self) -> None:
        for x in [self.data, *self.old]:
            x.unpersist()


def write_whole(path: str, found) -> None:
    """Write a file that other tasks see whole or not at all."""
    with open(f"{path}.part", "wb") as f:
        pickle.dump(found, f, pickle.HIGHEST_PROTOCOL)
    os.replace(f"{path}.part", path)


def read_whole(path: str):
    """What another task writes to a file, as soon as it is there."""
    since = time.monotonic()
    while True:
        try:
            with open(path, "rb") as f:
                return pickle.load(f)
        except FileNotFoundError:
            waited = time.monotonic() - since
            if waited > LONGEST_WAIT:
                raise TimeoutError(f"no sums of another task in {path}") from None
            time.sleep(min(max(0.0002, 0.1 * waited), 0.01))


class _ExchangedRows:
    """The blocks of one task of a barrier stage.  The tasks are a binary heap: each adds its children's sums to its own and
    hands that to its parent, and all read the first task's, so every task sees the same sums, bit for bit."""

    def __init__(self, blocks: list[tuple], folder: str, part: int, parts: int):
        self.own, self.folder, self.part, self.parts, self.steps = _LocalRows(blocks), folder, part, parts, 0

    def _path(self, step: int, part: int) -> str:
        return os.path.join(self.folder, f"{step}-{part}")

    def _write(self, found: tuple[dict, dict]) -> None:
        write_whole(self._path(self.steps, self.part), found)

    def _read(self, part: int) -> tuple[dict, dict]:
        return read_whole(self._path(self.steps, part))

    def step(self, requests: list[tuple], with_loss: bool) -> tuple[dict, dict]:
        hist, loss = self.own.step(requests, with_loss)
        for child in (2 * self.part + 1, 2 * self.part + 2):
            if child < self.parts:
                more = self._read(child)
                hist, loss = _merged(hist, more[0]), _merged(loss, more[1])
                os.unlink(self._path(self.steps, child))
        self._write((hist, loss))
        if self.part:
            hist, loss = self._read(0)
        elif self.steps:  # who is at this step has read the former one's sum
            os.unlink(self._path(self.steps - 1, 0))
        self.steps += 1
        return hist, loss

    def add(self, trees: dict[int, tuple]) -> None:
        self.own.add(trees)


def exchange_folder(spark) -> str | None:
    """A new folder that all tasks can write to, in the checkpoint folder; None if that isn't a mounted one."""
    url = urlparse(checkpoint_dir(spark))
    return os.path.join(unquote(url.path), f"boosting-{uuid.uuid4().hex}") if url.scheme in ("", "file") else None


def barrier_slots(sc) -> int:
    """How many tasks can run at the same time, as the scheduler checks it for a barrier stage (0: none of those here)."""
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    jsc = sc._jsc.sc()
    return int(jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile()))


def _grow(boosters: list[_Growing], rows, has_val: set[int]) -> None:
    """Grow all boosters on ``rows`` until each is done, one tree each in a round, one step per level."""
    rounds = 0
    while growing := [b for b in boosters if not b.done]:
        for b in growing:
            b.start()
        for level in range(max(b.p.depth for b in growing)):
            asking = [b for b in growing if level < b.p.depth and b.asked]
            if not asking:
                break
            hist, loss = rows.step([b.request() for b in asking], level == 0 and rounds > 0)
            if level == 0 and rounds:
                for b in growing:
                    b.judge(loss[b.number][0] / loss[b.number][1] if b.group in has_val and b.number in loss else None)
            for b in asking:
                if not b.done:
                    b.take(hist[b.number], level)
            growing = [b for b in growing if not b.done]
        if not growing:
            break
        for b in growing:
            b.finish()
        rows.add({b.number: (b.model.feature[-1], b.model.bin[-1], b.model.value[-1]) for b in growing})
        rounds += 1


def fit_boosters(frames: dict[int, tuple[DataFrame, DataFrame | None, Sequence[str]]], asks: Sequence[tuple[int, Boosting, int]],
                 label: str = "isFraud", block_rows: int | None = None, local_rows: int | None = None) -> list[Trees]:
    """Fit one booster for each (group, parameters, seed) of ``asks``.

    ``frames`` has each group's training rows, validation rows (None: no early stopping) and
    features.  Missing feature values are ``FILL``; null labels take no part.  A group
    without rows, or with one class, gives boosters of no tree.

    A group of at most ``local_rows`` rows (``LOCAL_ROWS``, or ``block_rows`` where that is given) isn't merged between
    tasks: each of its boosters grows in a task of its own, all at the same time.  Larger groups grow in shared steps.
    Both run the same growth, and which rows and columns a tree draws doesn't depend on it.
    """
    local_rows = local_rows or block_rows or LOCAL_ROWS
    block_rows = block_rows or BLOCK_ROWS
    first = next(iter(frames.values()))[0]
    spark = first.sparkSession
    sc = spark.sparkContext
    bins = max((p.bins for _, p, _ in asks), default=2)
    both = None
    for g, (train, val, features) in frames.items():
        for rows, is_val in ((train, False), (val, True)):
            if rows is not None:
                own = rows.filter(F.col(label).isNotNull()).select(
                    F.lit(g).alias("group"), F.col(label).cast("double").alias("y"), F.lit(is_val).alias("is_val"),
                    F.array(*[filled(F.col(c)) for c in features]).alias("x"))
                both = own if both is None else both.unionByName(own)
    checkpoint_dir(spark)
    both = both.checkpoint()  # blocks are cut from it again if an executor is lost
    sizes = {r["group"]: r["count"] for r in both.groupBy("group").count().collect()}
    widths = {g: len(fs) for g, (_, _, fs) in frames.items()}
    edges = {}
    for width in set(widths.values()):
        own = both.filter(F.col("group").isin([g for g, w in widths.items() if w == width]))
        edges |= bin_edges(own, range(width), bins)
    boosters = []
    for k, (g, p, seed) in enumerate(asks):
        own, n, pos = edges.get(g, ([np.zeros(0)] * widths[g], 0, 0))
        base = float(np.log(pos / (n - pos))) if 0 < pos < n else (40.0 if n and pos == n else -40.0)
        model = Trees(list(frames[g][2]), own, base, gains=np.zeros(widths[g]))
        boosters.append(_Growing(k, g, p, seed, model))
        boosters[-1].done |= not 0 < pos < n
    slots = {g: {b.number: i for i, b in enumerate(x for x in boosters if x.group == g)} for g in frames}
    bases = {g: np.array([b.model.base for b in boosters if b.group == g]) for g in frames}
    has_val = {g for g, (_, val, _) in frames.items() if val is not None}
    shared_edges = sc.broadcast({g: e for g, (e, _, _) in edges.items()})
    n_rows = sum(sizes.values())
    tasks = max(1, min(sc.defaultParallelism, -(-n_rows // 2000)), -(-n_rows // block_rows))
    ddl = "group int, keys binary, bins binary, y binary, is_val binary"

    def blocks(batches):
        for batch in batches:
            group = batch.column(0).to_numpy()
            for g in np.unique(group).tolist():
                own = batch.filter(pa.array(group == g))
                x = own.column(3).flatten().to_numpy().reshape(own.num_rows, widths[g])
                parts = (own.column(4).to_numpy(), binned(x, shared_edges.value.get(g, [np.zeros(0)] * widths[g])).T, own.column(1).to_numpy(),
                         own.column(2).to_numpy(zero_copy_only=False).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)],
                                                 names=["group", "keys", "bins", "y", "is_val"])

    keyed = both.withColumn("key", F.xxhash64("y", "x"))
    # the hash of the row deals equal rows alike and the sort fixes their order, so a recomputed block is the same block
    dealt = keyed.repartition(tasks, F.xxhash64("group", "is_val", "key")).sortWithinPartitions("group", "is_val", "key", "x")

    def opened(r) -> tuple:
        """A block: group, keys, bins by feature, labels, validation flags, raw scores by booster, the boosters' places among them."""
        g, y = r[0], np.frombuffer(r[3], np.float64)
        few = y.astype(np.uint8)
        return (g, np.frombuffer(r[1], np.uint64), np.frombuffer(r[2], np.uint8).reshape(widths[g], len(y)), few if (few == y).all() else y,
                np.frombuffer(r[4], bool), np.repeat(bases[g][:, None], len(y), axis=1), slots[g])

    data = dealt.mapInArrow(blocks, ddl).rdd.map(opened)

    def joined(own: list[tuple]) -> list:
        """The keys, bins, labels and validation flags of some blocks as one; the list is emptied."""
        parts = [np.concatenate([block[c] for block in own], axis=-1) for c in range(1, 5)]
        own.clear()
        return parts

    small = [b for b in boosters if sizes.get(b.group, 0) <= local_rows]
    large = [b for b in boosters if sizes.get(b.group, 0) > local_rows and not b.done]
    if small:
        # tasks start in the order of their numbers: the longest first
        small.sort(key=lambda b: -sizes.get(b.group, 0) * b.p.rounds * b.p.depth)
        number = {b.number: i for i, b in enumerate(small)}

        def grown(rows):
            own = sorted(rows, key=lambda kv: kv[1][1][:1].tobytes())
            if own:
                at, own = own[0][0], [kv[1] for kv in own]
                booster = small[at]  # a few kilobytes each, sent with the task
                parts = joined(own)
                raw = np.full((1, len(parts[2])), booster.model.base)
                _grow([booster], _LocalRows([(booster.group, *parts, raw, {booster.number: 0})]), has_val)
                m = booster.model
                yield at, m.feature, m.bin, m.value, m.gains, m.losses

        dealt_out = data.flatMap(lambda block: [(number[b], block) for b in block[6] if b in number]).partitionBy(len(small), lambda k: k)
        for i, *found in dealt_out.mapPartitions(grown).collect():
            m = small[i].model
            m.feature, m.bin, m.value, m.gains, m.losses = found
    together = min(barrier_slots(sc), tasks) if large else 0
    folder = exchange_folder(spark) if together else None
    if folder:
        groups = sorted({b.group for b in large})

        def grown_together(rows):
            own = {g: [] for g in groups}
            for block in rows:
                own[block[0]].append(block)
            held = [(g, *(parts := joined(bs)), np.repeat(bases[g][:, None], len(parts[2]), axis=1), slots[g]) for g, bs in own.items() if bs]
            task = BarrierTaskContext.get()
            # a folder of its own for each attempt of the stage, named by the first task
            where = os.path.join(folder, task.allGather(uuid.uuid4().hex)[0])
            os.makedirs(where, exist_ok=True)
            _grow(large, _ExchangedRows(held, where, task.partitionId(), together), has_val)
            if not task.partitionId():
                for i, m in enumerate(b.model for b in large):
                    yield i, m.feature, m.bin, m.value, m.gains, m.losses

        rows = keyed.filter(F.col("group").isin(groups)).repartition(together, F.xxhash64("group", "is_val", "key"))
        shares = rows.sortWithinPartitions("group", "is_val", "key", "x").mapInArrow(blocks, ddl).rdd.map(opened)
        try:
            for i, *found in shares.barrier().mapPartitions(grown_together).collect():
                m = large[i].model
                m.feature, m.bin, m.value, m.gains, m.losses = found
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    elif large:
        rows = _SharedRows(data, tasks)
        _grow(large, rows, has_val)
        rows.release()
    shared_edges.unpersist()
    return [b.model for b in boosters]

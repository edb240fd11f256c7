"""Focal-loss networks trained on the cluster (MOD5 feed-forward, MOD6 LSTM), several in one pass.

An epoch is as many steps as its rows make mini-batches.  All of them run in one barrier stage: a task keeps its share of the rows (in a
file of its own beyond ``HELD_BYTES``), back-propagates through its part of each mini-batch, adds up the gradients with the other
tasks' through small files in the checkpoint folder (as ``boosting`` does its histograms) and moves its own copy of the weights by Adam,
so that all tasks have the same.  Where that folder is no mounted one, or executors come and go, a step
is one job: the weights go out as a broadcast, a tree aggregate sums the gradients and the driver moves the weights.
Which rows make up a mini-batch, and which units drop out, follow from the seed, the epoch, the step
and the number of the task's first block, so a task that is run again computes the same gradient.  Every epoch is run; the
weights of the epoch with the least validation loss are kept.  Networks of other folds
take their steps together.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.boosting import _ExchangedRows, barrier_slots, exchange_folder, filled, sigmoid
from txnwatch.session import checkpoint_dir

ALPHA, GAMMA = 0.75, 2.0
#: Rows of a block at most.
BLOCK_ROWS = 20_000
#: Bytes of inputs that a task keeps in memory; where it has more, they are in a file of its own.
HELD_BYTES = 128 << 20
#: Standard deviations that a scaled input is kept within.
FAR = 10.0


@dataclass(frozen=True)
class Training:
    epochs: int
    rate: float
    batch_rows: int = 4096


# --- the two networks: shapes, forward pass, gradients ---------------------------------------------------

@dataclass(frozen=True)
class FeedForward:
    """Hidden layers with ReLU and dropout, one logit."""
    inputs: int
    hidden: tuple[int, ...] = (256, 128, 64)
    drop: tuple[float, ...] = (0.3, 0.3, 0.2)
    #: Rows that go through at once (None: all).
    piece = None

    @property
    def width(self) -> int:
        return self.inputs

    def start(self, rng) -> list[np.ndarray]:
        sizes = [self.inputs, *self.hidden, 1]
        out = []
        for a, b in zip(sizes, sizes[1:]):
            bound = 1 / np.sqrt(a)
            out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        return out

    def forward(self, w, x, rng=None):
        """(logits, what the backward pass needs); with ``rng`` units drop out."""
        kept, h = [], x
        for k, share in enumerate(self.drop):
            z = h @ w[2 * k] + w[2 * k + 1]
            gate = (z > 0).astype(x.dtype)
            if rng is not None:
                gate *= (rng.random(z.shape, np.float32) >= share).astype(x.dtype) / x.dtype.type(1 - share)
            kept.append((h, gate))
            h = z * gate
        return (h @ w[-2] + w[-1])[:, 0], (kept, h)

    def backward(self, w, memory, dz):
        kept, h = memory
        d = dz[:, None]
        grads = [h.T @ d, d.sum(axis=0)]
        d = d @ w[-2].T
        for k in range(len(kept) - 1, -1, -1):
            h, gate = kept[k]
            d = d * gate
            grads = [h.T @ d, d.sum(axis=0), *grads]
            if k:
                d = d @ w[2 * k].T
        return grads


@dataclass(frozen=True)
class Lstm:
    """Stacked LSTM layers over a sequence (rows of ``steps * inputs`` numbers), the last state through one ReLU layer to a logit."""
    inputs: int
    steps: int = 10
    units: int = 64
    layers: int = 2
    head: int = 32
    drop: float = 0.3
    #: Rows that go through at once: their states of all steps stay in the processor's cache.
    piece = 256

    @property
    def width(self) -> int:
        return self.inputs * self.steps

    def start(self, rng) -> list[np.ndarray]:
        out, bound = [], 1 / np.sqrt(self.units)
        for k in range(self.layers):
            width = self.units if k else self.inputs
            out += [rng.uniform(-bound, bound, (width, 4 * self.units)), rng.uniform(-bound, bound, (self.units, 4 * self.units)), rng.uniform(-bound, bound, 4 * self.units)]
        for a, b in ((self.units, self.head), (self.head, 1)):
            out += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
        return out

    def _mask(self, rng, shape, dtype):
        return None if rng is None else (rng.random(shape, np.float32) >= self.drop).astype(dtype) / dtype.type(1 - self.drop)

    def masks(self, rng, n, dtype) -> list:
        """What drops out of ``n`` rows: of the inputs of each layer, and of the head."""
        inner = [self._mask(rng, (self.steps, n, self.units), dtype) for _ in range(1, self.layers)]
        return [None, *inner, self._mask(rng, (n, self.head), dtype)]

    def forward(self, w, x, rng=None, masks=None):
        """As of ``FeedForward``; inside, rows are the columns, so that a gate of all rows is one piece of memory."""
        n, u = len(x), self.units
        masks = masks or self.masks(rng, n, x.dtype)
        seq = np.ascontiguousarray(x.reshape(n, self.steps, self.inputs).transpose(1, 2, 0))  # step, input, row
        layers = []
        for k in range(self.layers):
            wx, wh, b = w[3 * k:3 * k + 3]
            mask = None if masks[k] is None else masks[k].transpose(0, 2, 1)
            own = seq if mask is None else seq * mask
            h, c = np.zeros((u, n), x.dtype), np.zeros((u, n), x.dtype)
            gates, cells, states = [], [], []
            for t in range(self.steps):
                g = wx.T @ own[t]
                g += b[:, None]
                g += wh.T @ h
                s, cand = g[:3 * u], g[3 * u:]  # input, forget, output; candidates
                np.clip(s, -30, 30, out=s)
                np.negative(s, out=s)
                np.exp(s, out=s)
                s += 1
                np.divide(1, s, out=s)
                np.tanh(cand, out=cand)
                before = c
                c = g[u:2 * u] * c
                c += g[:u] * cand
                tanh = np.tanh(c)
                states.append(h)
                h = g[2 * u:3 * u] * tanh
                gates.append(g)
                cells.append((before, tanh))
            layers.append((own, mask, gates, cells, states))
            seq = np.stack([*states[1:], h])
        z = h.T @ w[-4] + w[-3]
        gate = (z > 0).astype(x.dtype)
        gate = gate if masks[-1] is None else gate * masks[-1]
        top = z * gate
        return (top @ w[-2] + w[-1])[:, 0], (layers, h, gate, top)

    def backward(self, w, memory, dz):
        layers, last, gate, top = memory
        u, grads = self.units, [None] * len(w)
        d = dz[:, None]
        grads[-2], grads[-1] = top.T @ d, d.sum(axis=0)
        d = (d @ w[-2].T) * gate
        grads[-4], grads[-3] = last @ d, d.sum(axis=0)
        n = len(dz)
        above = np.zeros((self.steps, u, n), dz.dtype)  # what each state gets from the layer above
        above[-1] = w[-4] @ d.T
        for k in range(self.layers - 1, -1, -1):
            wx, wh, _ = w[3 * k:3 * k + 3]
            own, mask, gates, cells, states = layers[k]
            dh, dc = np.zeros((u, n), dz.dtype), np.zeros((u, n), dz.dtype)
            dg, below = np.empty((4 * u, n), dz.dtype), np.empty_like(above) if k else None
            dwx, dwh, db = (np.zeros_like(a) for a in w[3 * k:3 * k + 3])
            for t in range(self.steps - 1, -1, -1):
                g, (before, tanh) = gates[t], cells[t]
                i, f, o, c = (g[a * u:(a + 1) * u] for a in range(4))
                dh += above[t]
                dc += dh * o * (1 - tanh * tanh)
                np.multiply(dc, c, out=dg[:u])
                np.multiply(dc, before, out=dg[u:2 * u])
                np.multiply(dh, tanh, out=dg[2 * u:3 * u])
                dg[:3 * u] *= g[:3 * u] * (1 - g[:3 * u])
                np.multiply(dc * i, 1 - c * c, out=dg[3 * u:])
                dwx += own[t] @ dg.T
                dwh += states[t] @ dg.T
                db += dg.sum(axis=1)
                dh = wh @ dg
                dc *= f
                if k:
                    below[t] = wx @ dg
            grads[3 * k], grads[3 * k + 1], grads[3 * k + 2] = dwx, dwh, db
            if k:
                above = below if mask is None else below * mask
        return grads


def focal(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Focal losses of logits and their derivatives."""
    s = 2 * y - 1
    u = s * z
    log_p = -np.logaddexp(0, -u)
    p = np.exp(log_p)
    alpha = np.where(y > 0, ALPHA, 1 - ALPHA)
    rest = (1 - p) ** GAMMA
    return -alpha * rest * log_p, s * alpha * rest * (GAMMA * p * log_p - (1 - p))


def logits(shape, w, x: np.ndarray) -> np.ndarray:
    """Logits of rows, a piece at a time."""
    piece = shape.piece or max(len(x), 1)
    found = [shape.forward(w, x[a:a + piece])[0] for a in range(0, len(x), piece)]
    return np.concatenate(found) if found else np.zeros(0, x.dtype)


def gradients(shape, w, x: np.ndarray, y: np.ndarray, rng) -> np.ndarray:
    """Gradients of the rows' summed loss, flat, a piece at a time; what drops out doesn't depend on the pieces."""
    piece, total = shape.piece or max(len(x), 1), 0
    masks = shape.masks(rng, len(x), x.dtype) if shape.piece else None
    for a in range(0, max(len(x), 1), piece):
        own = {"masks": [m if m is None else m[..., a:a + piece, :] for m in masks]} if masks else {"rng": rng}
        z, memory = shape.forward(w, x[a:a + piece], **own)
        _, dz = focal(z.astype(np.float64), y[a:a + piece])
        total = total + _flat(shape.backward(w, memory, dz.astype(np.float32)))
    return total


# --- training -----------------------------------------------------------------------------------------------

@dataclass
class Network:
    """A fitted network with the scaling of its inputs and its validation losses by epoch."""
    shape: FeedForward | Lstm
    features: list[str]
    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    sequence: str | None = None
    losses: tuple[float, ...] = ()

    def transform(self, df: DataFrame, out_col: str = "score") -> DataFrame:
        """Add the probability of label 1, computed on Arrow batches."""
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.spread, [w.astype(np.float32) for w in self.weights]))
        fields, shape = [f for f in df.schema.fields if f.name != out_col], self.shape
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        x = inputs_of(self.features, self.sequence)

        def run(batches):
            mean, spread, weights = shared.value
            for batch in batches:
                rows = scaled(batch.column(len(fields)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), mean, spread)
                p = [sigmoid(logits(shape, weights, rows[a:a + 4096])) for a in range(0, len(rows), 4096)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(np.concatenate(p) if p else np.zeros(0))],
                                                 names=[*(f.name for f in fields), out_col])

        return df.select(*[f.name for f in fields], x.alias("__x")).mapInArrow(run, f"{ddl}, `{out_col}` double")


def inputs_of(features: Sequence[str], sequence: str | None):
    """What a network reads of a row: its features, or the sequence column (steps of already standardised features)."""
    return F.flatten(F.col(sequence)) if sequence else F.array(*[filled(F.col(c)) for c in features])


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised inputs (of a sequence, each step); missing ones are 0."""
    k = x.shape[1] // len(mean) if len(mean) else 1
    z = np.clip((x - np.tile(mean, k)) / np.tile(spread, k), -FAR, FAR)
    return np.where(np.isnan(z), 0, z).astype(np.float32)


def _flat(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float64)


def _split(flat: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, ends[:-1]), like)]


def _add(a: dict, b: dict) -> dict:
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


class _HeldRows:
    """The rows of one task, by group: what its networks learn from and are judged by."""

    def __init__(self, blocks, shapes: dict, seeds: dict[int, int], steps: dict[int, int]):
        self.shapes, self.seeds, self.steps, self.order = shapes, seeds, steps, {}
        self.labels, self.number, pieces, held, self.inputs = {}, {}, {}, 0, {}
        self.file = None
        for g, is_val, number, x, y in blocks:
            key = g, is_val
            self.number.setdefault(key, number)
            self.labels.setdefault(key, []).append(y)
            pieces.setdefault(key, []).append(x)
            held += x.nbytes
            if held > HELD_BYTES:
                held = 0
                self.file = self.file or tempfile.TemporaryFile()
                for k, own in pieces.items():
                    for x in own:
                        self.inputs.setdefault(k, []).append((self.file.tell(), len(x)))
                        self.file.write(x)
                pieces = {}
        if self.file:
            self.file.flush()
        self.labels = {k: np.concatenate(y) for k, y in self.labels.items()}
        # per group: where each of its rows is in the file (then those in memory follow), and those in memory
        self.places = {k: np.concatenate([at + np.arange(n, dtype=np.int64) * 4 * shapes[k[0]].width for at, n in own]) for k, own in self.inputs.items()}
        self.inputs = {k: np.concatenate(own) for k, own in pieces.items()}

    def rows(self, key: tuple, own: np.ndarray) -> np.ndarray:
        """The inputs of some rows of a group."""
        places = self.places.get(key)
        if places is None:
            return self.inputs[key][own]
        x = np.empty((len(own), self.shapes[key[0]].width), np.float32)
        for i in np.flatnonzero(own < len(places)):
            os.preadv(self.file.fileno(), [x[i]], int(places[own[i]]))
        late = own >= len(places)
        if late.any():
            x[late] = self.inputs[key][own[late] - len(places)]
        return x

    def step(self, asked: tuple, _) -> tuple[dict, dict]:
        """Per group the summed gradients of this task's part of a mini-batch and its rows; with ``step`` None the validation loss and rows."""
        weights, epoch, step = asked
        out: dict = {}
        for key, y in self.labels.items():
            g, is_val = key
            if is_val != (step is None) or (step is not None and step >= self.steps[g]):
                continue
            known = [a.astype(np.float32) for a in weights[g]]
            if is_val:
                total = 0.0
                for a in range(0, len(y), BLOCK_ROWS):
                    own = np.arange(a, min(a + BLOCK_ROWS, len(y)))
                    total += focal(logits(self.shapes[g], known, self.rows(key, own)).astype(np.float64), y[own])[0].sum()
                out[g] = np.array([total, len(y)])
                continue
            if self.order.get(g, (None,))[0] != epoch:
                self.order[g] = epoch, np.random.default_rng([self.seeds[g], epoch, self.number[key]]).permutation(len(y))
            own = self.order[g][1][step::self.steps[g]]
            rng = np.random.default_rng([self.seeds[g], epoch, step, self.number[key]])
            out[g] = np.append(gradients(self.shapes[g], known, self.rows(key, own), y[own], rng), len(own))
        return out, {}


def _train(shapes: dict, training: Training, seeds: dict[int, int], steps: dict[int, int], summed: Callable) -> dict[int, tuple[list[np.ndarray], tuple[float, ...]]]:
    """Per group the weights of the best epoch and the validation losses; ``summed(weights, epoch, step)`` adds up what the tasks' ``_HeldRows.step`` gives."""
    weights = {g: shape.start(np.random.default_rng(seeds[g])) for g, shape in shapes.items()}
    adam = {g: [np.zeros_like(_flat(w)), np.zeros_like(_flat(w)), 0] for g, w in weights.items()}
    best = {g: (np.inf, weights[g]) for g in shapes}
    losses: dict[int, list[float]] = {g: [] for g in shapes}
    for epoch in range(training.epochs):
        for step in range(max(steps.values(), default=0)):
            for g, total in summed(weights, epoch, step).items():
                if not total[-1]:
                    continue
                grad, (m, v, t) = total[:-1] / total[-1], adam[g]
                m, v, t = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad, t + 1
                adam[g] = [m, v, t]
                move = training.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
                weights[g] = _split(_flat(weights[g]) - move, weights[g])
        found = summed(weights, epoch, None)
        for g in shapes:
            if g in found:
                losses[g].append(float(found[g][0] / found[g][1]))
                if losses[g][-1] < best[g][0]:
                    best[g] = (losses[g][-1], weights[g])
            else:
                best[g] = (np.inf, weights[g])
    return {g: (w, tuple(losses[g])) for g, (_, w) in best.items()}


def fit_networks(frames: dict[int, tuple[DataFrame, DataFrame | None, Sequence[str]]], kind: str, training: Training, seeds: dict[int, int],
                 label: str = "isFraud", sequence: str | None = None, shape: dict | None = None) -> dict[int, Network]:
    """Fit one ``kind`` ("feed_forward" or "lstm") for each group of ``frames`` (training rows, validation rows or None, features), in the same steps.

    An LSTM reads ``sequence``, a column of steps of standardised features, zeros where there is no row.  Features
    are standardised here, by the training rows.
    Null labels take no part; a group without training rows gives a network with its first weights.
    """
    first = next(iter(frames.values()))[0]
    spark, both = first.sparkSession, None
    sc = spark.sparkContext
    width = {g: len(fs) for g, (_, _, fs) in frames.items()}
    for g, (train, val, features) in frames.items():
        for rows, is_val in ((train, False), (val, True)):
            if rows is not None:
                own = rows.filter(F.col(label).isNotNull()).select(F.lit(g).alias("group"), F.col(label).cast("double").alias("y"), F.lit(is_val).alias("is_val"),
                                                                   inputs_of(features, sequence).alias("x"))
                both = own if both is None else both.unionByName(own)
    both = both.withColumn("key", F.xxhash64("group", "is_val", "x", "y"))
    if sequence:  # already scaled: what is learned from, in half the bytes
        both = both.withColumn("x", F.col("x").cast("array<float>"))
    checkpoint_dir(spark)
    both = both.checkpoint()
    sizes = {(r["group"], r["is_val"]): r["count"] for r in both.groupBy("group", "is_val").count().collect()}
    n_rows = sum(sizes.values())
    moments = {g: (np.zeros(w), np.ones(w), 0) for g, w in width.items()}
    for g, w in width.items():
        own = both.filter((F.col("group") == g) & ~F.col("is_val"))
        if sequence:
            moments[g] = np.zeros(w), np.ones(w), sizes.get((g, False), 0)
            continue
        r = own.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[k]).alias(f"{a}{k}") for k in range(w) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if r.n:
            spread = np.array([r[f"s{k}"] for k in range(w)])
            moments[g] = np.array([r[f"m{k}"] for k in range(w)]), np.where(spread > 1e-12, spread, 1.0), r.n
    make = {"feed_forward": FeedForward, "lstm": Lstm}[kind]
    shapes = {g: make(w, **(shape or {})) for g, w in width.items()}
    tasks = max(1, min(sc.defaultParallelism, -(-n_rows // 500)) if n_rows <= BLOCK_ROWS * sc.defaultParallelism else -(-n_rows // BLOCK_ROWS))
    scaling = sc.broadcast({g: m[:2] for g, m in moments.items()})

    wide = {g: shapes[g].width for g in frames}

    def blocks(batches):
        """Blocks of at most ``BLOCK_ROWS`` rows of a group, numbered in the task as they are full."""
        part, number = TaskContext.get().partitionId(), 0
        held: dict[tuple, list] = {}

        def cut(key):
            nonlocal number
            own = held.pop(key)
            number += 1
            y, x = (np.concatenate([piece[k] for piece in own]) for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.bool_()), pa.array([part * 1_000_000 + number], pa.int64()),
                                               pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["group", "is_val", "number", "x", "y"])

        for batch in batches:
            group, y, is_val = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            ends = np.flatnonzero((group[1:] != group[:-1]) | (is_val[1:] != is_val[:-1])) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(group)]):
                if a == b:
                    continue
                key = (int(group[a]), bool(is_val[a]))
                x = scaled(batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, wide[key[0]]), *scaling.value[key[0]])
                while a < b:
                    take = min(b - a, BLOCK_ROWS - sum(len(piece[0]) for piece in held.get(key, [])))
                    held.setdefault(key, []).append((y[a:a + take], x[:take]))
                    a, x = a + take, x[take:]
                    if sum(len(piece[0]) for piece in held[key]) >= BLOCK_ROWS:
                        yield cut(key)
        for key in list(held):
            yield cut(key)

    def opened(r) -> tuple:
        y = np.frombuffer(r[4], np.float64)
        return r[0], r[1], r[2], np.frombuffer(r[3], np.float32).reshape(len(y), wide[r[0]]), y

    def dealt(k: int):
        rows = both.repartition(k, "key").sortWithinPartitions("group", "is_val", "y", "x").select("group", "y", "is_val", "x")
        return rows.mapInArrow(blocks, "group int, is_val boolean, number long, x binary, y binary").rdd.map(opened)

    steps = {g: -(-moments[g][2] // training.batch_rows) for g in frames}
    together = min(barrier_slots(sc), tasks) if n_rows else 0
    folder = exchange_folder(spark) if together else None
    if folder:
        def trained(rows):
            held, task = _HeldRows(rows, shapes, seeds, steps), BarrierTaskContext.get()
            # a folder of its own for each attempt of the stage, named by the first task
            where = os.path.join(folder, task.allGather(uuid.uuid4().hex)[0])
            os.makedirs(where, exist_ok=True)
            exchange = _ExchangedRows([], where, task.partitionId(), together)
            exchange.own = held
            found = _train(shapes, training, seeds, steps, lambda *asked: exchange.step(asked, False)[0])
            if not task.partitionId():
                yield from found.items()

        try:
            fitted = dict(dealt(together).barrier().mapPartitions(trained).collect())
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    else:
        data, depth = dealt(tasks).persist(StorageLevel.MEMORY_AND_DISK), 1 if tasks <= 32 else 2

        def summed(*asked):
            sent = sc.broadcast(asked)
            found = data.mapPartitions(lambda rows: [_HeldRows(rows, shapes, seeds, steps).step(sent.value, False)[0]]).treeAggregate({}, _add, _add, depth=depth)
            sent.unpersist()
            return found

        fitted = _train(shapes, training, seeds, steps, summed)
        data.unpersist()
    scaling.unpersist()
    return {g: Network(shapes[g], list(frames[g][2]), moments[g][0], moments[g][1], fitted[g][0], sequence, fitted[g][1]) for g in frames}

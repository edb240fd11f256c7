"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

1. A document becomes ``STATISTICS``: shares, lengths and repetition rates of its whole text.
2. Standardised statistics go through ``FEATURES`` random cosines, whose products approximate a
   Gaussian kernel of ``WIDTH``.
3. Each task sums the normal equations of its rows, one set for each of ``FOLDS`` folds; the
   sums are added up in a tree.  As they are additive, the equations without a fold are a
   difference, so every fold's out-of-fold ridge fit and the choice of the penalty cost no other
   pass over the data.
4. Out-of-fold scores, counted in a grid of ``GRID`` cells, give the isotonic calibration.

All labelled documents are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T
from txnwatch.session import cut_lineage

STATISTICS = ("bytes", "words", "word_length", "word_spread", "letters", "capitals", "digits", "marks", "blanks", "beyond_ascii",
              "sentence_ends", "doubled_marks", "capital_words", "wordless", "same_as_before", "lines", "line_length", "line_ends", "short_lines", "repeated_lines",
              "distinct_words", "top_word", "repeated_runs", "entropy", "long_words")
#: Random cosines, their kernel's width in standard deviations of all statistics, and the seed of their directions.
FEATURES, WIDTH, SEED = 256, 4.0, 20240612
FOLDS = 5
#: Penalties per labelled row, of which the one with the least out-of-fold error is taken.
PENALTIES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
#: Cells of the calibration's grid over raw scores from LOW to HIGH.
GRID, LOW, HIGH = 4096, -1.0, 2.0
#: Standard deviations beyond which a statistic counts no further.
FAR = 6.0
#: Labelled rows of a task that sums normal equations, about.
ROWS_PER_TASK = 25_000

_LETTER, _CAPITAL, _DIGIT, _BLANK = (np.zeros(256, bool) for _ in range(4))
_CAPITAL[65:91] = True
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_DIGIT[48:58] = True
_BLANK[32] = _BLANK[9:14] = True
_MARK = ~(_LETTER | _DIGIT | _BLANK)
_MARK[:32] = _MARK[127] = False
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False


def _repeats(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each of ``n`` documents has, and how often its most frequent one occurs."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """``STATISTICS`` of each text of a column; a null or empty text has zeros only."""
    out = np.zeros((len(column), len(STATISTICS)))
    for at, data, offs in T.slices(column):
        n, size = len(offs) - 1, np.diff(offs)
        own = np.repeat(np.arange(n), size)

        def total(mask, bounds=offs):
            c = np.concatenate([[0.0], np.cumsum(mask, dtype=np.float64)])
            return c[bounds[1:]] - c[bounds[:-1]]

        def share(x, y):
            return np.divide(x, y, out=np.zeros(n), where=np.asarray(y) > 0)

        letter, capital, mark = _LETTER[data], _CAPITAL[data], _MARK[data]
        # The capitals of two-byte Latin letters: C3 80 to C3 9E.
        wide = np.zeros(len(data), bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        again = np.zeros(len(data), bool)
        again[1:] = (data[1:] == data[:-1]) & (own[1:] == own[:-1])
        starts, ends, first = T.word_bounds(data, offs, T.SPACED_BYTES)
        doc = np.repeat(np.arange(n), np.diff(first))
        words, length = np.diff(first), (ends - starts).astype(np.float64)
        of_word = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(mask)]))
        per_word = lambda mask: share(np.bincount(doc, mask, n), words)
        letters, capitals = of_word(letter), of_word(capital | wide)
        hashes = T.word_hashes(data, starts, ends)
        distinct, top = _repeats(hashes, doc, n)
        three = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
        runs, _ = _repeats(T.mix(hashes[three] * T.M1 + T.mix(hashes[three + 1] * T.M2 + hashes[three + 2])), doc[three], n)
        l0, l1, lines_at = T.word_bounds(data, offs, _LINE)
        line_doc, lines, span = np.repeat(np.arange(n), np.diff(lines_at)), np.diff(lines_at), (l1 - l0).astype(np.float64)
        per_line = lambda mask: share(np.bincount(line_doc, mask, n), lines)
        kinds, _ = _repeats(T.word_hashes(data, l0, l1), line_doc, n)
        counts = np.bincount(own * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
        mean = per_word(length)
        out[at:at + n] = np.column_stack([
            np.log1p(size), np.log1p(words), np.log1p(mean), np.sqrt(np.maximum(per_word(length ** 2) - mean ** 2, 0)) / (1 + mean),
            share(total(letter), size), share(total(capital | wide), total(letter)), share(total(_DIGIT[data]), size), share(total(mark), size),
            share(total(_BLANK[data]), size), share(total(data >= 128), size),
            per_word(_END[data[ends - 1]]), per_word((length > 1) & mark[ends - 1] & again[ends - 1]), per_word((capitals > 1) & (capitals * 2 >= letters)),
            per_word(letters == 0), share(total(again), size),
            np.log1p(lines), np.log1p(per_line(span)), per_line(_END[data[l1 - 1]]), per_line(span < 20), share(lines - kinds, lines),
            share(distinct, words), share(top, words), share(np.bincount(doc[three], minlength=n) - runs, np.bincount(doc[three], minlength=n)),
            -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(axis=1), per_word(length > 25)])
    return out


def measured(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, x): the statistics of each row's text as an array."""
    df = docs.select(*keep, F.col(text_col).alias("__text"))
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), T.list_column(list(x), pa.float64())], names=[*keep, "__x"])

    return df.mapInArrow(run, ddl + ", __x array<double>")


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), len(STATISTICS))


def directions(n: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the cosines."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((len(STATISTICS), n)) / width, rng.uniform(0, 2 * np.pi, n)


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, freq: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, and a one."""
    z = np.clip((x - mean) / spread, -FAR, FAR)
    return np.column_stack([np.sqrt(2 / len(phase)) * np.cos(z @ freq + phase), np.ones(len(x))])


def pooled(y: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float]]:
    """Blocks (first, last, mean) of the least-squares rising fit to ``y`` with weights ``w`` (pool adjacent violators)."""
    blocks: list[list] = []
    for i, (v, k) in enumerate(zip(y.tolist(), w.tolist(), strict=True)):
        blocks.append([i, i, v, k])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, last, b, kb = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0], last, (a[2] * a[3] + b * kb) / (a[3] + kb), a[3] + kb]
    return [(a, b, v) for a, b, v, _ in blocks]


def _sums(train: DataFrame, shared, folds: int) -> np.ndarray:
    """Normal equations of each fold: (fold, row, column), the last column holding the right side and the last row its square."""
    def run(rows):
        mean, spread, freq, phase = shared.value
        size = len(phase) + 1
        total = np.zeros((folds, size + 1, size + 1))
        held: list = []

        def add():
            x, y, w, fold = (np.array(c) for c in zip(*held, strict=True))
            z = np.column_stack([fourier(x, mean, spread, freq, phase), y])
            for k in range(folds):
                own = z[fold == k]
                total[k] += (own * w[fold == k][:, None]).T @ own

        for r in rows:
            held.append((r[0], r[1], r[2], r[3]))
            if len(held) == 4096:
                add()
                held.clear()
        if held:
            add()
        yield total

    return train.select("__x", "y", "w", "fold").rdd.mapPartitions(run).treeReduce(np.add, depth=3)


def fit(measured_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """A model (plain arrays) from the rows of ``measured`` that ``labels`` (id, 0 or 1) covers.

    Null ids and labels take no part; several labels of an id count by their mean.  Rows of equal
    statistics share a fold, so that copies don't confirm each other.  If only one class is
    labelled, or none, every score is the share of the label (0.5 without any).
    """
    spark = measured_docs.sparkSession
    y = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    own = measured_docs.select(F.col(id_col).alias("__own"), "__x")
    train = own.join(y, F.col("__own") == F.col("__id")).select("__x", "y", F.lit(1.0).alias("w"), F.pmod(F.xxhash64("__x"), F.lit(FOLDS)).cast("int").alias("fold"))
    # Copies are one row with a weight: a group of any size is one addend of the sums.
    train = cut_lineage(train.groupBy("__x", "y", "fold").agg(F.sum("w").alias("w")))
    moments = train.select("w", "y", F.posexplode("__x").alias("k", "v")).groupBy("k").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("q"), F.sum(F.col("w") * F.col("y")).alias("y"),
        F.count(F.lit(1)).alias("rows")).orderBy("k").collect()
    n = moments[0].n if moments else 0.0
    share = moments[0].y / n if n else 0.5
    model = {"share": share, "beta": None}
    if not n or share in (0.0, 1.0):
        return model
    mean = np.array([r.s / n for r in moments])
    spread = np.sqrt(np.maximum(np.array([r.q / n for r in moments]) - mean ** 2, 0))
    spread = np.where(spread > 1e-9 * (1 + np.abs(mean)), spread, 1.0)
    freq, phase = directions()
    shared = spark.sparkContext.broadcast((mean, spread, freq, phase))
    tasks = max(1, -(-moments[0].rows // ROWS_PER_TASK))
    sums = _sums(train.coalesce(tasks), shared, FOLDS)
    shared.unpersist()
    every, size = sums.sum(axis=0), len(phase) + 1

    def solve(a: np.ndarray, penalty: float) -> np.ndarray:
        ridge = penalty * a[size - 1, size - 1] * np.eye(size)
        ridge[-1, -1] = 1e-9  # the constant isn't shrunk
        return np.linalg.solve(a[:size, :size] + ridge, a[:size, size])

    def error(a: np.ndarray, b: np.ndarray) -> float:
        return float(b @ a[:size, :size] @ b - 2 * b @ a[:size, size] + a[size, size])

    tried = {p: [solve(every - sums[k], p) if (every - sums[k])[-2, -2] > 0 else np.zeros(size) for k in range(FOLDS)] for p in PENALTIES}
    penalty = min(PENALTIES, key=lambda p: sum(error(sums[k], tried[p][k]) for k in range(FOLDS)))
    model |= {"mean": mean, "spread": spread, "freq": freq, "phase": phase, "beta": solve(every, penalty), "penalty": penalty}
    cells = _out_of_fold(train, spark.sparkContext.broadcast(model | {"folds": np.array(tried[penalty])}))
    at, count, good = (np.array([r[c] for r in cells], float) for c in ("cell", "n", "y"))
    blocks = pooled(good / count, count)
    centre = LOW + (HIGH - LOW) * (at + 0.5) / GRID
    # Each block stands at the mean of its cells; between blocks the score rises in a line.
    model["steps"] = np.array([np.average(centre[a:b + 1], weights=count[a:b + 1]) for a, b, _ in blocks])
    model["chances"] = np.array([v for _, _, v in blocks])
    return model


def _out_of_fold(train: DataFrame, shared) -> list:
    """(cell, n, y): rows and labels of each cell of the grid of out-of-fold scores, in order; ``GRID`` rows at most."""
    def run(batches):
        m = shared.value
        for batch in batches:
            z = fourier(matrix(batch.column(0)), m["mean"], m["spread"], m["freq"], m["phase"])
            raw = (z * m["folds"][batch.column(1).to_numpy()]).sum(axis=1)
            cell = np.clip(np.floor((raw - LOW) / (HIGH - LOW) * GRID), 0, GRID - 1).astype(np.int64)
            w = batch.column(3).to_numpy()
            own, at = np.unique(cell, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, w)), pa.array(np.bincount(at, w * batch.column(2).to_numpy()))], names=["cell", "n", "y"])

    found = train.select("__x", "fold", "y", "w").mapInArrow(run, "cell long, n double, y double")
    return found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("cell").collect()


def chances(model: dict, x: np.ndarray) -> np.ndarray:
    """The calibrated chance of label 1 for rows of statistics."""
    if model["beta"] is None:
        return np.full(len(x), model["share"])
    raw = fourier(x, model["mean"], model["spread"], model["freq"], model["phase"]) @ model["beta"]
    return np.clip(np.interp(raw, model["steps"], model["chances"]), 0.0, 1.0)


def score(measured_docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score) of each row of ``measured``; texts that are null or empty are scored by their zeros."""
    shared = measured_docs.sparkSession.sparkContext.broadcast(model)
    df = measured_docs.select(*keep, "__x")
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            p = chances(shared.value, matrix(batch.column(len(keep)))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(p, pa.float64())], names=[*keep, "score"])

    return df.mapInArrow(run, ddl + ", score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, score) of every row of ``docs``, by a model of the rows that ``labels`` covers.

    Each text is measured once; fitting and scoring read the statistics, 200 bytes a document.
    """
    x = cut_lineage(measured(docs, text_col, (id_col,)))
    return score(x, fit(x, labels, id_col, label_col), (id_col,))

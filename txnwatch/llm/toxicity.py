"""Toxicity by maximum-scoring segments over token log-odds.

Fit, on labelled documents:

1. Tokens are lower-cased words and their prefixes of ``PREFIXES`` bytes.  The
   log-odds of a token is that of the classes' document counts, with a Dirichlet
   prior of ``PRIOR`` documents dealt to the classes as its longest known prefix
   has them (the shortest prefix: as the classes are).  A word takes the log-odds of its
   longest known form; one with no known form that of a token seen in
   ``PRIOR`` clean documents only.  Each is lowered by ``DRIFT``.
   Then, ``ROUNDS`` times, each toxic document deals its one count to its words in
   proportion to their odds, and the log-odds are taken anew: a word that only
   keeps company with toxic ones, as in copies of one text, loses its count to them.
2. The score distribution of the words of clean documents gives Karlin and
   Altschul's lambda, the maxima of clean documents give K.
3. A document's sum of -ln p over its segments and its best segment's score,
   both counted in a grid, give a logistic calibration.

Scoring finds, in one linear scan, all maximal segments of a document (Ruzzo and
Tompa) and aggregates them through the fitted extreme-value law.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T

#: Byte lengths of the prefixes that words are backed off to, shortest first.
PREFIXES = (4, 6)
PRIOR = 5.0
DRIFT = 0.25
#: Toxic documents that must have a token before it gets a log-odds of its own.
LEAST_DOCS = 2
ROUNDS = 2
#: Labelled documents that a fit uses at most (about; chosen by a hash of the id); their ids are broadcast, and the
#: model, with every token that ``LEAST_DOCS`` toxic ones of them have.
MAX_FIT = 1_000_000
#: Expected number of such segments by chance, in a document of its length, up to which a segment is reported.
REPORTED = 0.05
SCORE_STEP, P_STEP = 0.25, 0.5


@dataclasses.dataclass
class Model:
    """Sorted token hashes with their log-odds, the extreme-value law and the calibration."""

    tokens: np.ndarray
    scores: np.ndarray
    unknown: float
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def word_scores(self, levels: list[np.ndarray]) -> np.ndarray:
        """``levels``: hashes of each word's forms, shortest prefix first."""
        out = np.full(len(levels[0]), self.unknown)
        if len(self.tokens):
            for h in levels:
                at = np.searchsorted(self.tokens, h)
                at[at == len(self.tokens)] = 0
                out = np.where(self.tokens[at] == h, self.scores[at], out)
        return out - DRIFT

    def surprise(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-ln of the chance that a clean document of n words has a segment of score s or more."""
        e = self.k * np.maximum(n, 1) * np.exp(-self.lam * s)
        return np.where(e < 1e-9, self.lam * s - np.log(self.k * np.maximum(n, 1)), -np.log(-np.expm1(-np.maximum(e, 1e-12))))

    def probability(self, x1, x2):
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a + b * x1 + c * x2, -500, 500)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence with their scores, in order (Ruzzo and Tompa)."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before it, sum at its end, the nearest earlier one with a lesser sum before
    for i in np.flatnonzero(scores > 0).tolist():
        a, start, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            a, low = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append([a, start, low, high, j])
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _levels(data, starts, ends) -> list[np.ndarray]:
    forms = [T.word_hashes(data, starts, np.minimum(ends, starts + p)) ^ np.uint64(p) for p in PREFIXES]
    return [*forms, T.word_hashes(data, starts, ends)]


def _documents(column: pa.Array):
    """Yield (row, forms of its words) for each document of a column."""
    for at, data, offs in T.slices(pc.utf8_lower(column)):
        starts, ends, first = T.word_bounds(data, offs, T.WORD_BYTES)
        levels = _levels(data, starts, ends)
        for i in range(len(offs) - 1):
            yield at + i, [h[first[i]:first[i + 1]] for h in levels]


def _tally(df: DataFrame, known=None) -> DataFrame:
    """(token, docs): in how many documents of (text) each form occurs; of ``known`` ones only, if given."""
    def run(batches):
        held, size = [], 0

        def out():
            token, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(docs)], names=["token", "docs"])

        for batch in batches:
            for _, levels in _documents(batch.column(0)):
                h = np.unique(np.concatenate(levels))
                if known is not None:
                    at = np.searchsorted(known.value, h)
                    at[at == len(known.value)] = 0
                    h = h[known.value[at] == h] if len(known.value) else h[:0]
                held.append(h)
                size += len(h)
                if size > 500_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return df.mapInArrow(run, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of (token, value) rows, sorted, and their values."""
    rows = np.fromiter(((r[0], r[1]) for r in df.toLocalIterator()), np.dtype([("token", np.int64), ("value", np.int64)]))
    token = rows["token"].view(np.uint64)
    by = np.argsort(token)
    return token[by], rows["value"][by]


def _spread(known: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values of known tokens in the order of ``known``, 0 for those without one."""
    out = np.zeros(len(known), value.dtype)
    out[np.searchsorted(known, token)] = value
    return out


def _parents(train: DataFrame, known) -> DataFrame:
    """(token, parent): the longest known shorter form of each known one."""
    def run(batches):
        keep = known.value
        for batch in batches:
            rows = []
            for _, levels in _documents(batch.column(0)):
                parent = np.zeros(len(levels[0]), np.uint64)
                for h in levels:
                    at = np.searchsorted(keep, h)
                    at[at == len(keep)] = 0
                    hit = keep[at] == h
                    rows.append(np.unique(np.stack([h[hit], parent[hit]], axis=1), axis=0))
                    parent = np.where(hit, h, parent)
            if rows:
                both = np.unique(np.concatenate(rows), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["token", "parent"])

    return train.mapInArrow(run, "token long, parent long").groupBy("token").agg(F.max("parent").alias("parent"))


def _credits(toxic: DataFrame, model) -> DataFrame:
    """(token, credit): what the toxic documents deal to each known form, in millionths of a document."""
    def run(batches):
        m = Model(*model.value)
        for batch in batches:
            tokens, shares = [], []
            for _, levels in _documents(batch.column(0)):
                if not len(levels[0]):
                    continue
                _, one = np.unique(levels[-1], return_index=True)
                forms = [h[one] for h in levels]
                odds = np.exp(m.word_scores(forms))
                share = np.round(1e6 * odds / odds.sum()).astype(np.int64)
                tokens += forms
                shares += [share] * len(forms)
            if tokens:
                h, c = np.concatenate(tokens), np.concatenate(shares)
                if not len(m.tokens):
                    continue
                at = np.searchsorted(m.tokens, h)
                at[at == len(m.tokens)] = 0
                hit = m.tokens[at] == h
                t = pa.table({"token": h[hit].view(np.int64), "credit": c[hit]}).group_by("token").aggregate([("credit", "sum")])
                yield from t.select(["token", "credit_sum"]).rename_columns(["token", "credit"]).to_batches()

    return toxic.mapInArrow(run, "token long, credit long").groupBy("token").agg(F.sum("credit").alias("credit"))


def _grid(df: DataFrame, model, what: str) -> DataFrame:
    """Counts over (y, a, b): with ``what`` "scores" of clean words' scores, "best" of best scores and ln of lengths, "pairs" of the calibration's inputs."""
    def run(batches):
        m = Model(*model.value)
        for batch in batches:
            y, cells = batch.column(1).to_numpy(zero_copy_only=False), []
            for i, levels in _documents(batch.column(0)):
                s, n = m.word_scores(levels), len(levels[0])
                if what == "scores":
                    a, c = np.unique(np.round(s / 0.05).astype(np.int64), return_counts=True)
                    cells.append(np.stack([np.full(len(a), y[i]), a, np.zeros(len(a), np.int64), c], axis=1))
                    continue
                found = segments(s)
                best = max((x[2] for x in found), default=0.0)
                a, b = (best, math.log(max(n, 1))) if what == "best" else (document_inputs(m, found, n))
                cells.append(np.array([[y[i], round(a / P_STEP), round(b / SCORE_STEP), 1]], np.int64))
            if cells:
                t = pa.table(dict(zip("yabc", np.concatenate(cells).T, strict=True))).group_by(["y", "a", "b"]).aggregate([("c", "sum")])
                yield from pa.table([t["y"], t["a"], t["b"], t["c_sum"]], names=["y", "a", "b", "c"]).to_batches()

    return df.mapInArrow(run, "y long, a long, b long, c long").groupBy("y", "a", "b").agg(F.sum("c").alias("c"))


def document_inputs(m: Model, found: list, n: int) -> tuple[float, float]:
    """(sum of -ln p over the segments, best score), each up to 40."""
    if not found:
        return 0.0, 0.0
    s = np.array([x[2] for x in found])
    return min(40.0, float(m.surprise(s, np.full(len(s), n)).sum())), min(40.0, float(s.max()))


def _lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(lambda s) = 1; 1 if there is none."""
    f = lambda x: float((weights * np.exp(x * scores)).sum() / weights.sum()) - 1
    if not len(scores) or scores.max() <= 0 or f(1e-3) >= 0:
        return 1.0
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Logistic weights (bias, x1, x2) by Newton steps with a slight ridge."""
    z, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (y - p)) - 1e-3 * beta
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(3), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT) -> Model:
    """Fit a model on the documents that ``labels`` (id, 0 or 1) covers.

    Null ids or labels and null texts take no part; of contradicting labels the
    toxic one counts.  Without a toxic or without a clean document every text gets the
    score of the prior.
    """
    sc = docs.sparkSession.sparkContext
    y = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("long")).alias("y"))
    n = y.count()
    if n > max_fit:
        y = y.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * max_fit / n))
    texts = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("text")).filter("text is not null")
    train = texts.join(F.broadcast(y), F.col("__own") == F.col("__id")).select("text", "y")
    size = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        p = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, weights=(math.log(p / (1 - p)), 0.0, 0.0))
    toxic, clean = train.filter("y = 1").select("text"), train.filter("y = 0").select("text")
    known, pos = _columns(_tally(toxic).filter(F.col("docs") >= LEAST_DOCS))
    shared = sc.broadcast(known)
    neg = _spread(known, *_columns(_tally(clean, shared)))
    longer, shorter = _columns(_parents(toxic, shared))
    shared.unpersist()
    shorter = _spread(known, longer, shorter).view(np.uint64)
    child = np.flatnonzero(shorter)
    parent = np.searchsorted(known, shorter[child])
    base = n_pos / (n_pos + n_neg)
    odds = lambda q: math.log(q / (1 - q)) - math.log(base / (1 - base))

    def log_odds(pos: np.ndarray) -> np.ndarray:
        """Of the toxic share of each token's documents, with its prior; a token has at most len(PREFIXES) shorter forms."""
        prior = np.full(len(known), base)
        for _ in range(len(PREFIXES) + 1):
            share = (pos + PRIOR * prior) / (pos + neg + PRIOR)
            prior[child] = share[parent]
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share)) - math.log(base / (1 - base))

    model = Model(known, log_odds(pos), odds(PRIOR * base / (PRIOR + PRIOR)))
    def with_model(make, rows):
        """``rows`` of the frame that ``make`` gives for the model as it stands, whose broadcast goes afterwards."""
        sent = sc.broadcast(T.parts(model))
        found = rows(make(sent))
        sent.unpersist()
        return found

    for _ in range(ROUNDS):
        dealt = _spread(known, *with_model(lambda m: _credits(toxic, m), _columns))
        model.scores = log_odds(dealt / 1e6)
    collected = lambda df: df.collect()
    rows = with_model(lambda m: _grid(train.filter("y = 0"), m, "scores"), collected)
    model.lam = _lambda(np.array([r.a for r in rows]) * 0.05, np.array([r.c for r in rows], float))
    rows = with_model(lambda m: _grid(train.filter("y = 0"), m, "best"), collected)
    shift = sum(r.c * (model.lam * r.a * P_STEP - r.b * SCORE_STEP) for r in rows) / sum(r.c for r in rows)
    model.k = math.exp(min(max(shift - 0.5772, -20), 20))
    rows = with_model(lambda m: _grid(train, m, "pairs"), collected)
    model.weights = _calibrate(np.array([[r.a * P_STEP, r.b * SCORE_STEP] for r in rows]), np.array([float(r.y) for r in rows]), np.array([float(r.c) for r in rows]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: (*keep, n_words, score, passages).

    ``score`` is the calibrated chance of the toxic label; ``passages`` lists the
    significant segments as word numbers [first, last), raw score and expected
    number by chance.  A null or wordless text has no segment.
    """
    shared = docs.sparkSession.sparkContext.broadcast(T.parts(model))
    carried = keep if text_col in keep else (*keep, text_col)
    df = docs.select(*carried)
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            sizes, probs, passages = [], [], []
            for _, levels in _documents(batch.column(carried.index(text_col))):
                found, n = segments(m.word_scores(levels)), len(levels[0])
                x1, x2 = document_inputs(m, found, n)
                sizes.append(n)
                probs.append(float(m.probability(x1, x2)))
                rated = [(a, b, s, m.k * n * math.exp(-m.lam * s)) for a, b, s in found]
                passages.append([dict(zip(("first", "last", "score", "expected"), r, strict=True)) for r in rated if r[3] <= REPORTED])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(probs, pa.float64()), pa.array(passages, kind)],
                                             names=[*keep, "n_words", "score", "passages"])

    return df.mapInArrow(run, ddl + ", n_words long, score double, passages array<struct<first:int,last:int,score:double,expected:double>>")

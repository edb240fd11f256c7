"""Language identification by rank-order profiles of character n-grams.

A profile is the ``TOP`` most frequent n-grams (one to three letters of a word,
with a blank before and after it) in order.  A document is compared with each
language by the out-of-place distance: the sum over its own profile of how far
each n-gram stands from its place in the language's, or ``TOP`` where it has none.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm import text as T

#: N-grams of a profile.
TOP = 300
UNKNOWN = "und"


def _is_letter() -> np.ndarray:
    known = T.worker_cache()
    if "letters" not in known:
        known["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return known["letters"]


def _grams(column: pa.Array):
    """Yield (first row, n-grams, bounds) for the slices of a column: n-grams as 64-bit codes (21 bits a letter, a blank is 0) of each letter in turn."""
    for at, data, offs in T.slices(pc.utf8_lower(column)):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        letter = _is_letter()[points]
        c = np.zeros(len(points) + 2, np.int64)
        c[1:-1] = np.where(letter, points, 0)
        # A document ends its last word and begins its first.
        cut = np.zeros(len(points) + 2, bool)
        cut[begins + 1] = True
        i = np.flatnonzero(letter) + 1
        before, own, after = np.where(cut[i], 0, c[i - 1]), c[i], np.where(cut[i + 1], 0, c[i + 1])
        two = np.int64(1) << 42
        grams = np.stack([own, two | before << 21 | own, np.where(after == 0, two | own << 21, -1), before << 42 | own << 21 | after], axis=1)
        yield at, grams, np.searchsorted(i - 1, begins)


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.unique(grams, return_counts=True)
    return (code[1:], count[1:]) if len(code) and code[0] < 0 else (code, count)


@dataclasses.dataclass
class Profiles:
    """Languages, all n-grams of their profiles (sorted), and each one's place in each language (``TOP`` if it has none)."""

    languages: list[str]
    codes: np.ndarray
    places: np.ndarray

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The language at the least distance (of equal ones the first by name), and 1 less its share of the greatest distance."""
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        code, count = _counted(grams)
        own = code[np.argsort(-count, kind="stable")[:TOP]]
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        place = np.where((self.codes[at] == own)[:, None], self.places[at], TOP)
        far = np.where(place == TOP, TOP, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.languages[best], 1.0 - float(far[best]) / (TOP * len(own))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all languages of ``docs``, counted over all of their documents.

    Null texts and null languages take no part; of equally frequent n-grams
    that of the lesser code comes first.  Only the profiles come to the driver.
    """
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            langs, codes, counts = [], [], []
            for lang, parts in held.items():
                code, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                count = np.zeros(len(code), np.int64)
                np.add.at(count, where, np.concatenate([p[1] for p in parts]))
                langs += [lang] * len(code)
                codes.append(code)
                counts.append(count)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "code", "n"])

        for batch in batches:
            lang, names = pc.rank(batch.column(1), tiebreaker="dense").to_numpy(), batch.column(1).to_pylist()
            for at, grams, bounds in _grams(batch.column(0)):
                own = np.repeat(lang[at:at + len(bounds) - 1], np.diff(bounds))
                for k in np.unique(lang[at:at + len(bounds) - 1]).tolist():
                    part = _counted(grams[own == k])
                    held.setdefault(names[int(np.flatnonzero(lang == k)[0])], []).append(part)
                    size += len(part[0])
                if size > 500_000:
                    yield out()
                    held, size = {}, 0
        if size:
            yield out()

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = known.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP).select("lang", "code", "place").collect()
    languages = sorted({r.lang for r in rows})
    codes = np.array(sorted({r.code for r in rows}), np.int64)
    places = np.full((len(codes), len(languages)), TOP, np.int64)
    column = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        places[np.searchsorted(codes, r.code), column[r.lang]] = r.place - 1
    return Profiles(languages, codes, places)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: (*keep, lang_pred, score).

    A null text, one without letters, or any text if no language is known,
    is ``und`` with a score of 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(T.parts(profiles))
    df = docs.select(*keep, F.col(text_col).alias("__text"))
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        p = Profiles(*shared.value)
        for batch in batches:
            found = []
            for _, grams, bounds in _grams(batch.column(len(keep))):
                found += [p.nearest(grams[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    return df.mapInArrow(run, ddl + ", lang_pred string, score double")

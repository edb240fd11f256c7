"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one task.  Its words become symbols: those of
the test phrases keep a number each, any run of other words is one separator.
Runs too short for the shortest phrase are left out of the index, as no phrase
fits in.  Over the rest the shard builds a suffix order (prefix doubling;
separators differ from each other), the Burrows-Wheeler transform in a wavelet
matrix of packed bits, and sampled suffix positions.  All phrases are searched
backward at once; occurrences are located by stepping to a sampled position.

The phrases are made in tasks and broadcast, as arrays, in blocks of about ``BLOCK_WORDS``; the
shards run once for each block and hand the spans found so far on.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T
from txnwatch.session import cut_lineage

#: Symbols after which a shard's index is built.
SHARD_SYMBOLS = 1 << 20
#: Every so many suffix positions are kept.
SAMPLE = 16
#: Words of benchmark items, each with the phrase that begins there, that are broadcast at once (about 150 bytes each).
BLOCK_WORDS = 500_000


class WaveletMatrix:
    """Symbols of an array with rank(c, i): how often c occurs before i."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.levels = len(symbols), max(1, int(top).bit_length())
        self.bits, self.before, self.zeros, s = [], [], [], symbols
        for level in range(self.levels - 1, -1, -1):
            b = (s >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([b, np.zeros(64 + -len(b) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate([s[b == 0], s[b == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for k in range(self.levels):
            one = (c >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = self._ones(k, lo), self._ones(k, i)
            lo, i = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions ``i``."""
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a = self._ones(k, i)
            out = out << 1 | one
            i = np.where(one, self.zeros[k] + a, i - a)
        return out


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of ``s``, which ends with 0, in order of their suffixes; each 0 is a separator of its own, ordered by position."""
    n = len(s)
    pad = np.concatenate([s, np.zeros(4, s.dtype)]).astype(np.uint64)
    wide = 16 if int(s.max(initial=0)) < 1 << 16 else 32
    first = 64 // wide
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(first):
        x = np.where(open_, pad[j:j + n], np.uint64(0))
        key |= x << np.uint64(64 - wide * (j + 1))
        open_ &= x != 0
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(where: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """``where``: slots of ``order`` that were sorted by ``keys``.  New ranks; the slots that are still tied."""
        pos = order[where]
        same = np.zeros(len(where), bool)
        if len(where) > 1:
            same[1:] = open_[pos[1:]] & open_[pos[:-1]] & (where[1:] == where[:-1] + 1)
            for x in keys:
                same[1:] &= x[1:] == x[:-1]
        head = np.where(same, 0, np.arange(len(where)))
        rank[pos] = where[np.maximum.accumulate(head)]
        tied = same.copy()
        tied[:-1] |= same[1:]
        return where[tied]

    tied, h = regroup(np.arange(n), (key[order],)), first
    while len(tied):
        pos = order[tied]
        after = rank[pos + h]
        by = np.lexsort((pos, after, rank[pos]))
        order[tied] = pos[by]
        own, after = rank[pos][by], after[by]
        # A suffix stays open while no separator is in its first 2h words; one whose follower is closed is closed too.
        open_[order[tied]] &= open_[order[tied] + h]
        tied, h = regroup(tied, (own, after)), 2 * h
    return order


class FMIndex:
    """Backward search and location over one array of symbols (0: separator)."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        s = np.append(s, 0)  # the last word too has a suffix after it
        n, top = len(s), int(s.max(initial=0))
        order = suffix_order(s)
        before = np.where(order > 0, s[order - 1], 0)
        self.bwt = WaveletMatrix(before, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        self.top, self.n = top, n
        sampled = (order % sample == 0) | (before == 0)
        packed = np.packbits(np.concatenate([sampled, np.zeros(64 + -n % 64, bool)]), bitorder="little").view(np.uint64)
        self.marks, self.marks_before = packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        self.kept = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases, given as rows of symbols that end in the last column."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(width):
            on = np.flatnonzero((lengths > k) & (lo < hi))
            c = phrases[on, width - 1 - k]
            known = (c > 0) & (c <= self.top)
            hi[on[~known]] = lo[on[~known]]
            on, c = on[known], c[known]
            start = self.first[c]
            lo[on], hi[on] = start + self.bwt.rank(c, lo[on]), start + self.bwt.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.marks[word] >> bit & np.uint64(1)).astype(bool)
            place = self.marks_before[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = self.kept[place[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt.access(at)
            at, steps = self.first[c] + self.bwt.rank(c, at), steps + 1
        return out


@dataclasses.dataclass
class Phrases:
    """Windows of benchmark items as rows of symbols, numbers of the sorted ``vocabulary`` of word hashes from 1
    on, right-aligned, with their lengths; ``items`` are numbers of ``names``, those of window k from ``at[k]`` to ``at[k + 1]``."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    items: np.ndarray
    names: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.lengths.min(initial=self.symbols.shape[1]))

    def names_of(self, k: int) -> list[str]:
        return self.names[self.items[self.at[k]:self.at[k + 1]]].tolist()

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that no phrase has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def phrase_rows(items: DataFrame, size: int) -> DataFrame:
    """(phrase, item), once each: the word hashes of ``size`` consecutive words, or of all of an item of fewer, as bytes."""
    def run(batches):
        for batch in batches:
            names, phrases = [], []
            for at, data, offs in T.slices(batch.column(1)):
                starts, ends, first = T.word_bounds(data, offs, T.WORD_BYTES)
                h = T.word_hashes(data, starts, ends)
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b > a:
                        rows = np.lib.stride_tricks.sliding_window_view(h[a:b], min(size, b - a))
                        phrases.append(T.binary_column(np.ascontiguousarray(rows).view(np.uint8)))
                        names += [at + i] * len(rows)
            if names:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(phrases), batch.column(0).take(pa.array(names))], names=["phrase", "item"])

    return items.mapInArrow(run, "phrase binary, item string").distinct()


def phrase_table(rows: pa.Table, size: int) -> Phrases:
    """The phrases of (phrase, item) rows, sorted by the phrase."""
    rows = rows.combine_chunks()
    phrase, n = rows["phrase"].combine_chunks() if rows.num_rows else pa.array([], pa.binary()), rows.num_rows
    fresh = np.ones(n, bool)
    if n > 1:
        fresh[1:] = ~np.asarray(pc.equal(phrase.slice(1), phrase.slice(0, n - 1)))
    head = np.flatnonzero(fresh)
    keys = phrase.take(pa.array(head))
    lengths = np.asarray(pc.binary_length(keys)).astype(np.int64) // 8
    words = np.frombuffer(b"".join(keys.to_pylist()), np.uint64)
    vocabulary = np.unique(words)
    symbols = np.zeros((len(head), size), np.int64)
    symbols[np.arange(size) >= size - lengths[:, None]] = np.searchsorted(vocabulary, words) + 1
    item = rows["item"].combine_chunks() if n else pa.array([], pa.string())
    named = np.asarray(item.is_valid())
    names, numbers = np.unique(np.array(item.drop_null().to_pylist(), dtype=object).astype(str), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(named)])[np.append(head, n)]
    return Phrases(vocabulary, symbols, lengths, at, numbers.astype(np.int64), names)


def _runs(symbols: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word numbers) of all runs of phrase words inside a document that a phrase fits in, each after a separator."""
    n = len(symbols)
    known = symbols > 0
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    begin, end = known.copy(), known.copy()
    begin[1:] &= ~known[:-1] | edge[1:n]
    end[:-1] &= ~known[1:] | edge[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= shortest
    a, size = a[long], (b - a)[long]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.cumsum(size + 1) - size - 1  # where each run's separator goes
    word = np.arange(int((size + 1).sum())) - np.repeat(out, size + 1) - 1 + np.repeat(a, size + 1)
    s = symbols[np.maximum(word, 0)]
    s[out] = 0
    return s, word


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint sorted [start, end) rows that cover the same words."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > far[:-1]]))
    return np.stack([spans[new, 0], far[np.concatenate([new[1:] - 1, [len(spans) - 1]])]], axis=1)


def _pass(df: DataFrame, phrases, last: bool, clean: bool) -> DataFrame:
    """Add the spans and items of one block of phrases; the last block also merges the spans."""
    own = [f for f in df.schema.fields if f.name not in ("spans", "items")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own if f.name != "text")
    if not last:
        ddl += ", text string"
    ddl += ", spans array<int>, items array<string>" + ", n_words long, n_hit long, clean string" * last

    def finish(shard):
        """Index a shard, given as (first row, first words, symbols) of its slices: the phrases found in each row as (first word, last word, phrase)."""
        p = Phrases(*phrases.value)
        s, doc, word = [], [], []
        for at, first, symbols in shard:
            x, w = _runs(symbols, first, p.shortest)
            s.append(x)
            own = np.maximum(np.searchsorted(first, w, "right") - 1, 0)  # of separators, which are never located, anything
            word.append(w - first[own])
            doc.append(at + own)
        found: dict[int, list] = {}
        s = np.concatenate(s) if s else np.zeros(0, np.int64)
        if len(s):
            word, doc = np.concatenate(word), np.concatenate(doc)
            index = FMIndex(s)
            lo, hi = index.search(p.symbols, p.lengths)
            hit = np.flatnonzero(lo < hi)
            times = hi[hit] - lo[hit]
            which = np.repeat(hit, times)
            rows = np.repeat(lo[hit] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            for c in range(0, len(rows), 1 << 20):
                pos = index.locate(rows[c:c + (1 << 20)])
                for d, w, k in zip(doc[pos].tolist(), word[pos].tolist(), which[c:c + (1 << 20)].tolist(), strict=True):
                    found.setdefault(d, []).append((w, w + int(p.lengths[k]), k))
        return found

    def run(batches):
        p = Phrases(*phrases.value)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column(batch.schema.get_field_index("text"))
            old_spans, old_items = (batch.column(batch.schema.get_field_index(c)) for c in ("spans", "items"))
            spans, items = [np.zeros(0, np.int64)] * n, [set() for _ in range(n)]
            words, hits, cleaned = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
            shard, held, found = [], 0, {}
            for at, data, offs in T.slices(texts):
                starts, ends, first = T.word_bounds(data, offs, T.WORD_BYTES)
                symbols = p.of(T.word_hashes(data, starts, ends))
                words[at:at + len(offs) - 1] = np.diff(first)
                shard.append((at, first, symbols))
                held += len(symbols)
                if held >= SHARD_SYMBOLS:
                    found |= finish(shard)
                    shard, held = [], 0
            found |= finish(shard)
            for i in {*found, *np.flatnonzero(np.diff(np.asarray(old_spans.offsets))).tolist()}:
                got = np.array([x[:2] for x in found.get(i, [])], np.int64).reshape(-1, 2)
                both = merged(np.concatenate([np.asarray(old_spans[i].as_py() or [], np.int64).reshape(-1, 2), got]))
                spans[i] = both.ravel()
                items[i] = {*(old_items[i].as_py() or []), *(y for x in found.get(i, []) for y in p.names_of(x[2]))}
                hits[i] = int((both[:, 1] - both[:, 0]).sum())
                if last and clean and len(both):
                    cleaned[i] = cut_words(texts[i].as_py(), both)
            cols = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in own if f.name != "text"}
            if not last:
                cols["text"] = texts
            cols |= {"spans": T.list_column(spans, pa.int32()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            if last:
                cols |= {"n_words": pa.array(words), "n_hit": pa.array(hits), "clean": _replaced(texts, cleaned) if clean else pa.nulls(n, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.mapInArrow(run, ddl)


def _replaced(column: pa.Array, new: dict[int, str]) -> pa.Array:
    """``column`` with the values at some rows replaced."""
    if not new:
        return column
    mask = np.zeros(len(column), bool)
    mask[list(new)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in sorted(new)], column.type))


def cut_words(text: str, spans: np.ndarray) -> str:
    """``text`` without the words of disjoint sorted spans, and without what stands between them."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = T.word_bounds(data, np.array([0, len(data)]), T.WORD_BYTES)
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(raw[at:starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = 10, clean: bool = True, keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: (id_col, *keep, n_words, n_hit, spans, items, clean).

    A phrase is ``window`` consecutive words of a benchmark item, or all of an
    item of fewer; words are lower-cased runs of digits, letters and
    characters beyond ASCII.  ``spans`` lists [start, end) word numbers, merged;
    ``items`` the ids, as strings, of items with a phrase in the text; ``clean`` is the
    text without the spans (as it was where there are none; null if ``clean`` is off).
    Null texts have no words.  An item without words has no phrase, one
    without id marks words but is not listed; repeated items count once.
    """
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    phrases = cut_lineage(phrase_rows(items, window))
    blocks = max(1, -(-phrases.count() // block_words))
    carried = [F.col(c) for c in keep]
    df = docs.select(F.col(id_col), *carried, F.col(text_col).alias("text"),
                     F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        part = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        known = spark.sparkContext.broadcast(T.parts(phrase_table(part.orderBy("phrase").toArrow(), window)))
        df = _pass(df, known, b == blocks - 1, clean)
    return df

"""Byte-level BPE, encoded and decoded inside Spark tasks.

A word's parts are kept as boundaries in one contiguous array, with the rank of
each adjacent pair beside it: the least rank is found by a scan, its boundary
deleted, and the two neighbouring ranks are refreshed.  That is quadratic, so words of over
``SHORT`` bytes keep their pairs in a heap with the same order of merges.
Each task remembers the words it has encoded, up to ``CACHE`` of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T

#: Bytes up to which a word is merged by scans.
SHORT = 128
#: Tokens after which a task hands on what it has.
FLUSH = 500_000
#: Words that a task remembers before it starts afresh.
CACHE = 250_000
#: Fixed value: how byte-level BPE splits a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints in Latin-1, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in prints else chr(free))
        free += b not in prints
    return out


class ByteBPE:
    """A vocabulary file of the tokenizers library, byte-level BPE."""

    def __init__(self, spec: dict):
        import regex
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        raw = lambda s: b"".join(byte_of[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"].pop("merges"))
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        self.letters = [self.ids.get(bytes([b]), -2) for b in range(256)]
        self.rank_of = {self.ids[a] << 32 | self.ids[b]: n for n, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        pieces = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        sizes = np.zeros(max(pieces) + 1, np.int64)
        for v, b in pieces.items():
            sizes[v] = len(b)
        self.sizes, self.at = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(pieces.get(v, b"") for v in range(len(sizes))), np.uint8)
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, str] = {}

    def merge(self, word: bytes) -> tuple[list[int], list[int]]:
        """Token ids of one word, and the byte offsets where its tokens begin (with the end)."""
        if len(word) > SHORT:
            return self._merge_long(word)
        rank_of, made, cut = self.rank_of, self.made, [*range(len(word) + 1)]
        part = [self.letters[b] for b in word]
        rank = [rank_of.get(a << 32 | b, NEVER) for a, b in zip(part, part[1:], strict=False)]
        while rank:
            least = min(rank)
            if least == NEVER:
                break
            k = rank.index(least)
            part[k] = made[least]
            del cut[k + 1], part[k + 1], rank[k]
            if k:
                rank[k - 1] = rank_of.get(part[k - 1] << 32 | part[k], NEVER)
            if k < len(rank):
                rank[k] = rank_of.get(part[k] << 32 | part[k + 1], NEVER)
        return part, cut

    def _merge_long(self, word: bytes) -> tuple[list[int], list[int]]:
        """The same merges with the pairs in a heap, for words where scans would be quadratic."""
        n, rank_of, made = len(word), self.rank_of, self.made
        part, end, back = [self.letters[b] for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank_of.get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = end[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], end[i] = made[r], -1, end[j]
            if end[i] < n:
                back[end[i]] = i
            for x in (i, back[i]):
                if x >= 0 and end[x] < n and (r := rank_of.get(part[x] << 32 | part[end[x]])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[end[x]]))
        cut, i = [0], 0
        while i < n:
            i = end[i]
            cut.append(i)
        return [part[i] for i in cut[:-1]], cut

    def encode(self, text: str) -> str:
        """Ids of a text in decimal, joined by commas."""
        known, out = self.known, []
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(str(self.special[piece]))
                continue
            words = self.words.findall(piece)
            for w in set(words).difference(known):
                known[w] = ",".join(map(str, self.merge(w.encode())[0]))
            out.extend(map(known.__getitem__, words))
            if len(known) >= CACHE:
                known = self.known = {}
        return ",".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.at[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes().decode("utf-8", "replace")


def parse_ids(text: str) -> np.ndarray:
    return np.fromstring(text, np.int64, sep=",") if text else np.zeros(0, np.int64)


def _vocabulary(spark, path: str):
    """Digest and broadcast text of a vocabulary file; its size is that of the file, not of the data."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return hashlib.sha256(spec.encode()).hexdigest(), spark.sparkContext.broadcast(spec)


def _tokenizer(digest: str, spec) -> ByteBPE:
    """A worker's tokenizer for a broadcast vocabulary, built once and kept with its words."""
    built = T.worker_cache()
    if digest not in built:
        built[digest] = ByteBPE(json.loads(spec.value))
    return built[digest]


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: (*keep, n_tokens, token_ids, ids_sha256, decoded_sha256, round_trip).

    ``vocabulary`` is a byte-level BPE file of the tokenizers library, read on the driver.  Special tokens in a text
    are matched as such.  ``token_ids`` is an int array (null if ``ids`` is off); ``round_trip`` tells
    whether the decoded text equals the given one.  A null text is encoded
    as the empty one, which has no tokens.
    """
    digest, spec = _vocabulary(docs.sparkSession, vocabulary)
    df = docs.select(*keep, F.col(text_col).alias("__text"))
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    ddl += ", n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches):
        bpe = _tokenizer(digest, spec)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                first, n, codes, rows = at, [], [], []
                while at < batch.num_rows and sum(n) < FLUSH:
                    text = batch.column(len(keep))[at].as_py() or ""
                    joined = bpe.encode(text)
                    found = parse_ids(joined)
                    back = bpe.decode(found)
                    n.append(len(found))
                    codes.append(found.astype(np.int32) if ids else None)
                    rows.append((hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
                    at += 1
                digests = list(zip(*rows, strict=True))
                lists = T.list_column(codes, pa.int32()) if ids else pa.nulls(len(n), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, at - first) for i in range(len(keep))), pa.array(n, pa.int64()), lists,
                     pa.array(digests[0], pa.string()), pa.array(digests[1], pa.string()), pa.array(digests[2], pa.bool_())],
                    names=[*keep, "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "round_trip"])
        bpe.known = {}  # the words go with the task; the tables stay with the worker

    return df.mapInArrow(run, ddl)

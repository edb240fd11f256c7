"""Word kernels over Arrow string columns.

The functions work on the UTF-8 buffer of a whole Arrow slice at once, so no
Python object is made per word.  A slice holds whole documents only; a document
longer than ``SLICE_BYTES`` is a slice of its own.
"""

from __future__ import annotations

import dataclasses
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the kernels handle at once; bounds their scratch memory.
SLICE_BYTES = 1 << 18
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, however often this code is shipped to it."""
    return sys.modules.setdefault("txnwatch_worker_cache", types.ModuleType("txnwatch_worker_cache")).__dict__


def parts(x) -> tuple:
    """The fields of a dataclass object.  Broadcasts carry these, as a broadcast object of a
    class of this package could only be read where the package is installed."""
    return tuple(getattr(x, f.name) for f in dataclasses.fields(x))


def _lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lowered()
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE = _RANDOM[LOWER]

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: digits, letters, all beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Words [^\x20\x09-\x0D]+.
SPACED_BYTES = np.ones(256, bool)
SPACED_BYTES[32] = SPACED_BYTES[9:14] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    known = worker_cache().get("powers")
    if known is None or len(known[0]) < n:
        known = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, 2 * SLICE_BYTES), b, np.uint64)
            x[0] = 1
            known.append(np.multiply.accumulate(x))
        worker_cache()["powers"] = known
    return known[0][:n], known[1][:n]


def slices(column: pa.Array, limit: int | None = None):
    """Yield ``(first row, data, offsets)`` of runs of whole documents; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    limit, at = limit or SLICE_BYTES, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, data[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
        at = to


def word_bounds(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each document's words begin (one entry more than documents)."""
    inside = table[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased: a polynomial over the bytes by prefix sums."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * M3)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingles of each document as 64-bit hashes; fewer words are one shingle, none are none."""
    odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 | 1) for j in range(k)]
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled += mix(hashes[j:n - k + 1 + j] + odd[j]) * odd[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64) * M3
            for j in range(b - a):
                whole = mix((whole + hashes[a + j:a + j + 1]) * odd[j])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def binary_column(matrix: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as a binary column."""
    n, width = matrix.shape
    offs = np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[:n + 1] if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def list_column(parts: list, kind: pa.DataType) -> pa.Array:
    """Numpy arrays as one list column."""
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offs[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def groups(batches, keys: list[str]):
    """Tables of the rows of each key, from batches that are sorted by the keys."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, now]).combine_chunks() if rest is not None and rest.num_rows else now
        cols = [rest[c].to_numpy() for c in keys]
        at = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist()]
        for p, q in zip(at[:-1], at[1:], strict=True):
            yield rest.slice(p, q - p)
        rest = rest.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest

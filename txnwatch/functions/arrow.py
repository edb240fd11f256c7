"""Small helpers over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def key_groups(batches, keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by the keys (whole numbers)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
        rest = rest.combine_chunks()
        cols = [rest[c].to_numpy() for c in keys]
        borders = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *borders.tolist()[:-1]], borders.tolist()):
            yield rest.slice(a, b - a)
        if len(borders):
            rest = rest.slice(int(borders[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def vectors(column, width: int) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

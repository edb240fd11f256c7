"""Near-duplicate embeddings by int8 tile products with rigorous bounds.

Each vector is scaled to length 1 and rounded to int8; what rounding took away is
measured, so the product of two rounded vectors bounds their cosine from both
sides.  Vectors are dealt to tiles of about ``TILE``; a task takes a pair of tiles, in int8 only.  Pairs whose
upper bound reaches the threshold are candidates and those whose lower bound
does are links.  Nodes with a pair between the two go on to a second pass, which brings their
vectors for just those tile pairs and computes the pairs between in double precision.

Equal vectors are one node with a count.  A task gives, for each of its nodes, how
many vectors it links to, and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T
from txnwatch.llm.components import connected_components
from txnwatch.session import cut_lineage

#: Nodes of a tile, about.
TILE = 4096
#: Rows of a tile that are multiplied with the other tile at once.
STRIP = 256
#: Slack for the rounding of the bounds themselves.
SLACK = 1e-5


def rescaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between 1/2 and 1: the same cosines, without overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` as int8, their scales, and the lengths of what is kept and of what rounding takes away, for vectors of length 1."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def _prepared(df: DataFrame) -> DataFrame:
    """(id, dim, node, vec, q, scale, kept, lost) of (id, embedding); node is null for vectors that link with nothing."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            lists = batch.column(1)
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null: nan; no -0.0
            at = np.cumsum(size) - size
            node, vec, q = [None] * n, [None] * n, [None] * n
            scale, kept, lost = np.zeros(n), np.zeros(n), np.zeros(n)
            for d in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == d)
                x = values[at[rows][:, None] + np.arange(d)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[good], x[good]
                if not len(rows):
                    continue
                x = rescaled(x)
                small, scale[rows], kept[rows], lost[rows] = quantise(x)
                for i, r in enumerate(rows.tolist()):
                    vec[r], q[r] = x[i].tobytes(), small[i].tobytes()
                    node[r] = hashlib.blake2b(vec[r], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int32)), *(pa.array(c, pa.binary()) for c in (node, vec, q)), *map(pa.array, (scale, kept, lost))],
                names=["id", "dim", "node", "vec", "q", "scale", "kept", "lost"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, dim int, node binary, vec binary, q binary, scale double, kept double, lost double")


def _pairs(g: pa.Table, threshold: float, exact: bool):
    """Yield (left rows, right rows, rows with a pair between the bounds) of a tile pair, strip by strip.

    The pairs are those that the bounds make sure of; with ``exact``, those between the bounds that reach
    the threshold in double precision.
    """
    d, side = g["dim"][0].as_py(), g["tile"].to_numpy()
    same = g["i"][0].as_py() == g["j"][0].as_py()
    left, right = (np.flatnonzero(side == g[c][0].as_py()) for c in ("i", "j"))
    wide = lambda name, kind: np.frombuffer(b"".join(g[name].to_pylist()), kind).reshape(-1, d)
    # Sums of d products of int8 are whole numbers below 2**24 up to d = 1040, exact in single precision.
    q = wide("q", np.int8).astype(np.float32 if d <= 1040 else np.float64)
    scale, kept, lost = (g[c].to_numpy() for c in ("scale", "kept", "lost"))
    if exact:
        vec = wide("vec", np.float64)
        length = np.linalg.norm(vec, axis=1)
    other = np.ascontiguousarray(q[right].T)
    most = kept.max() * lost.max() + lost.max()  # no error bound is larger: the length of a unit vector is 1
    none = np.zeros(0, np.int64)
    for s in range(0, len(left), STRIP):
        own = left[s:s + STRIP]
        product = q[own] @ other
        product *= (scale[own].astype(product.dtype))[:, None]
        product *= (scale[right].astype(product.dtype))[None, :]
        a, b = np.nonzero(product >= threshold - most - SLACK)
        near, a, b = product[a, b].astype(np.float64), own[a], right[b]
        if same:
            near, a, b = near[a < b], a[a < b], b[a < b]
        bound = kept[a] * lost[b] + lost[a] * kept[b] + lost[a] * lost[b] + SLACK
        sure = near - bound >= threshold
        between = np.flatnonzero((near + bound >= threshold) & ~sure)
        if not exact:
            yield a[sure], b[sure], np.unique(np.concatenate([a[between], b[between]]))
            continue
        for c in range(0, len(between), 65536):
            k = between[c:c + 65536]
            k = k[np.einsum("ij,ij->i", vec[a[k]], vec[b[k]]) / (length[a[k]] * length[b[k]]) >= threshold]
            yield a[k], b[k], none


def _linked(tiles: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """(node, other, links, dim, i, j): how many vectors a node links to in a tile pair (links set), a forest of the links (other
    set), and the nodes with a pair between the bounds (i and j set)."""
    def of(g):
        n, times = g.num_rows, g["n"].to_numpy()
        links, root, edges, open_ = np.zeros(n, np.int64), np.arange(n), [], np.zeros(n, bool)
        for a, b, between in _pairs(g, threshold, exact):
            open_[between] = True
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            while len(fresh := np.flatnonzero(root[a] != root[b])):
                # One link of each pair of components joins them; the rest are looked at again.
                u, v = np.minimum(root[a[fresh]], root[b[fresh]]), np.maximum(root[a[fresh]], root[b[fresh]])
                _, one = np.unique(v, return_index=True)
                edges += list(zip(a[fresh[one]].tolist(), b[fresh[one]].tolist(), strict=True))
                up = np.arange(n)
                up[v[one]] = u[one]
                while (up[up] != up).any():
                    up = up[up]
                root = up[root]
        node, (d, i, j) = g["node"].to_pylist(), (g[c][0].as_py() for c in ("dim", "i", "j"))
        return ([(node[k], None, int(links[k]), None, None, None) for k in np.flatnonzero(links).tolist()]
                + [(node[a], node[b], None, None, None, None) for a, b in edges]
                + [(node[k], None, None, d, i, j) for k in np.flatnonzero(open_).tolist()])

    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for g in T.groups(batches, ["dim", "i", "j"]):
            rows = of(g.combine_chunks())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["node", "other", "links", "dim", "i", "j"])

    return tiles.mapInArrow(run, "node binary, other binary, links long, dim int, i int, j int")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: (id_col, n_links, component_id, kept).

    Vectors of one dimension link if their cosine is ``threshold`` (above 0)
    or more.  Null, zero and empty vectors and those with null or non-finite
    components link with nothing; length doesn't matter, from the least to the greatest doubles.  ``component_id`` is the least id reachable, ``kept`` marks
    the rows that carry it; a null id is never the least one unless there is no other.  Rows
    that share an id stay separate vectors.
    """
    each = cut_lineage(_prepared(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))))
    valid = each.filter("node is not null")
    nodes = valid.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("dim").alias("dim"),
                                      *[F.first(c).alias(c) for c in ("vec", "q", "scale", "kept", "lost")])
    nodes = cut_lineage(nodes)
    parts = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiled = nodes.drop("least").join(parts, "dim").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    keys = F.explode(F.expr("transform(sequence(0, tiles - 1), j -> struct(least(tile, j) as i, greatest(tile, j) as j))"))
    small = ["tile", "node", "n", "q", "scale", "kept", "lost"]
    tiles = tiled.drop("vec").withColumn("key", keys).select("dim", "key.i", "key.j", *small)
    tasks = max(1, sum(math.comb(r.tiles + 1, 2) for r in parts.collect()))
    dealt = lambda df: df.repartition(tasks, "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "node")
    bounded = cut_lineage(_linked(dealt(tiles), threshold, False))
    between = bounded.filter("i is not null").select("dim", "i", "j", "node").join(tiled.drop("dim"), "node").select("dim", "i", "j", *small, "vec")
    found = cut_lineage(bounded.filter("i is null").union(_linked(dealt(between), threshold, True)))
    links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("other is not null"), "node", "other")
    rooted = nodes.select("node", "n", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    both = valid.select("id", "node").join(known, "node").select("id", "n_links", "component_id")
    alone = each.filter("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return both.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

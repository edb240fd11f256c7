"""Near-duplicate documents by MinHash.

1. Every document becomes the set of its distinct word shingles; ``bands * rows``
   universal hash functions give its minima, ``rows`` minima each give a band key.
   Documents of one set are one *node* (a 128-bit set fingerprint).
2. Candidates of the first round are stars: each node with ``HUBS`` members of its
   buckets, so n nodes give O(n) pairs whatever their buckets hold.
3. A candidate pair is first verified on signatures (its estimated similarity
   may be ``SIGMAS`` standard errors below the threshold), then on full sets.
4. Links give components by alternating large-star and small-star.
5. Buckets that still hold several components go through a second round in
   tiles of bounded size.  Every pair of nodes of different components is
   compared by signature; nodes with a plausible partner meet again with their
   full sets, and a tile gives a spanning forest of its links.  So no pair that
   shares a band goes untested, and no group's pairs are written out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T
from txnwatch.llm.components import connected_components, release_shuffles
from txnwatch.session import cut_lineage

#: Standard errors below the threshold at which a signature still counts as plausible.
SIGMAS = 4.5
#: Hubs of a node in the first round.
HUBS = 3
#: Nodes of one side of a tile in the second round.
TILE = 2048
#: Chance to miss a pair that is exactly at the threshold.
MISS = 1e-5


def plan_bands(threshold: float) -> tuple[int, int]:
    """(bands, rows): about the steepest curve that misses a pair at the threshold with a chance below ``MISS``."""
    rows = 6 if threshold >= 0.85 else 5
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)), rows


def _sets(column: pa.Array, k: int):
    """Yield (first row, sets of a slice)."""
    for at, data, offs in T.slices(column):
        starts, ends, first = T.word_bounds(data, offs, T.SPACED_BYTES)
        yield at, T.shingle_sets(T.word_hashes(data, starts, ends), first, k)


def _node(s: np.ndarray) -> tuple[int, int]:
    """An order-free 128-bit fingerprint of a set."""
    return int(T.mix(s).sum(dtype=np.uint64)), int(T.mix(s * T.M3 + T.M1).sum(dtype=np.uint64))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, h, node, bands, sig): set size, 64 and 128 bits of the fingerprint, band keys, 16 bits of each minimum."""
    def run(batches):
        rng = np.random.default_rng(7)
        a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        salt = T.mix(np.arange(1, rows + 1, dtype=np.uint64) * T.M3) | np.uint64(1)
        band = T.mix(np.arange(1, bands + 1, dtype=np.uint64) * T.M1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size, node = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            keys, sig = [np.zeros(0, np.int64)] * n, np.zeros((n, bands * rows), np.uint16)
            for at, sets in _sets(batch.column(1), k):
                for i, s in enumerate(sets, at):
                    if not len(s):
                        continue
                    low = np.full(bands * rows, 2**64 - 1, np.uint64)
                    for c in range(0, len(s), 1024):
                        np.minimum(low, (a[:, None] * s[None, c:c + 1024] + b[:, None]).min(axis=1), out=low)
                    size[i], node[i] = len(s), _node(s)
                    sig[i] = low.astype(np.uint16)
                    keys[i] = T.mix((T.mix(low).reshape(bands, rows) * salt).sum(axis=1, dtype=np.uint64) + band).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size), pa.array(np.ascontiguousarray(node[:, 0]).view(np.int64)),
                T.binary_column(node.view(np.uint8).reshape(n, 16)), T.list_column(keys, pa.int64()), T.binary_column(sig.view(np.uint8).reshape(n, -1))],
                names=["id", "n", "h", "node", "bands", "sig"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n long, h long, node binary, bands array<long>, sig binary")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(h, node, shingles) of each row of (id, text)."""
    def run(batches):
        for batch in batches:
            sets = [s for _, part in _sets(batch.column(1), k) for s in part]
            if not sets:
                continue
            node = np.array([_node(s) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ascontiguousarray(node[:, 0]).view(np.int64)), T.binary_column(node.view(np.uint8).reshape(len(sets), 16)),
                T.list_column([s.view(np.int64) for s in sets], pa.int64())], names=["h", "node", "shingles"])

    return docs.mapInArrow(run, "h long, node binary, shingles array<long>")


def _plausible(pairs: DataFrame, info: DataFrame, num: int, den: int, lanes: int) -> DataFrame:
    """Signature verification of (a, b), 64 bits of a node each."""
    cut = _cut(num, den, lanes)

    def run(batches):
        for x in batches:
            x = x.filter(pc.and_(
                pc.greater_equal(pc.multiply(x["na"], den), pc.multiply(x["nb"], num)),
                pc.greater_equal(pc.multiply(x["nb"], den), pc.multiply(x["na"], num))))
            if x.num_rows:
                sa, sb = (_lanes(x[c], lanes) for c in ("sa", "sb"))
                x = x.filter(pa.array((sa == sb).mean(axis=1) >= cut))
            yield x.select(["a", "b"])

    one = info.select("h", "n", "sig")
    both = pairs.join(one.toDF("a", "na", "sa"), "a").join(one.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def _cut(num: int, den: int, lanes: int) -> float:
    t = num / den
    return t - SIGMAS * math.sqrt(t * (1 - t) / lanes)


def _lanes(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], np.uint16)[: (column.offset + len(column)) * lanes].reshape(-1, lanes)[column.offset:]


def _sets_of(wanted: DataFrame, docs: DataFrame, sig: DataFrame, k: int, unique: bool) -> DataFrame:
    """(h, node, shingles) of each set whose fingerprint ``h`` is in ``wanted``; only texts that hold them are read again.

    ``unique``: no two rows share an id and none is null, so each set comes from one row."""
    ids = sig.join(wanted, "h", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct()
    texts = docs.join(ids.withColumnRenamed("id", "want"), F.col("id").eqNullSafe(F.col("want")), "left_semi")
    sets = _full_sets(texts, k)
    return cut_lineage(sets if unique else sets.join(wanted, "h", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between nodes among the candidate pairs (a, b), on full sets."""
    one = lambda s: sets.select(F.col("h").alias(s), F.col("node").alias("node_" + s), F.col("shingles").alias("s_" + s))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    both = both.withColumn("inter", F.size(F.array_intersect("s_a", "s_b")).cast("long")).withColumn("uni", F.size("s_a") + F.size("s_b") - F.col("inter"))
    return cut_lineage(both.filter(F.lit(den) * F.col("inter") >= F.lit(num) * F.col("uni")).select(F.col("node_a").alias("u"), F.col("node_b").alias("v")))


def _sides(g: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a tile's two sides, and whether the sides are the same."""
    t, minor = g["t"].to_numpy(), g["minor"].to_numpy(zero_copy_only=False)
    kind, i, j = (g[c][0].as_py() for c in ("kind", "i", "j"))
    return (np.flatnonzero(minor), np.flatnonzero(~minor), False) if kind else (np.flatnonzero(t == i), np.flatnonzero(t == j), i == j)


def _tiles(members: DataFrame, info: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bh, kind, i, j, band, minor, t, h, r) of the tiles of all buckets that hold several components."""
    node = info.join(labels, "node", "left").select("h", F.xxhash64(F.coalesce("root", "node")).alias("r"))
    rooted = members.join(node, "h")
    still = rooted.groupBy("bh").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo != hi").select("bh")
    rooted = cut_lineage(rooted.join(still, "bh").select("bh", "band", "h", "r"))
    sizes = rooted.groupBy("bh", "r").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("bh").agg(F.sum("c").alias("all"), F.max(F.struct("c", "r")).alias("top"))
    sizes = sizes.select("bh", F.col("top.r").alias("major"), F.ceil((F.col("all") - F.col("top.c")) / TILE).cast("int").alias("mt"),
                         F.ceil(F.col("top.c") / TILE).cast("int").alias("jt"))
    x = rooted.join(sizes, "bh").withColumn("minor", F.col("r") != F.col("major"))
    x = x.withColumn("t", F.pmod(F.xxhash64("h"), F.when(F.col("minor"), F.col("mt")).otherwise(F.col("jt"))).cast("int"))
    # A tile i of the lesser components meets their tiles j >= i and every tile of the largest one, whose tiles don't meet each other.
    lesser = "transform(sequence(0, mt - 1), j -> struct(0 as kind, least(t, j) as i, greatest(t, j) as j))"
    largest = "transform(sequence(0, jt - 1), j -> struct(1 as kind, t as i, j as j))"
    back = "transform(sequence(0, mt - 1), i -> struct(1 as kind, i as i, t as j))"
    x = x.withColumn("key", F.explode(F.expr(f"if(minor, concat({lesser}, {largest}), {back})")))
    return x.select("bh", "key.kind", "key.i", "key.j", "band", "minor", "t", "h", "r")


KEYS = ["bh", "kind", "i", "j"]


def _candidates(tiles: DataFrame, info: DataFrame, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """The rows of ``tiles`` that have a plausible partner of another component in their tile; a pair counts in the first bucket that it shares."""
    lanes = bands * rows
    cut = _cut(num, den, lanes)
    x = tiles.join(info.select("h", "n", "sig"), "h").select(*KEYS, "band", "minor", "t", "h", "r", "n", "sig")

    def run(batches):
        for g in T.groups(batches, KEYS):
            r, n, sig, band = g["r"].to_numpy(), g["n"].to_numpy(), _lanes(g["sig"].combine_chunks(), lanes), g["band"][0].as_py()
            left, right, same = _sides(g)
            some = np.zeros(g.num_rows, bool)
            for p in left.tolist():
                near = right[right > p] if same else right
                near = near[(r[near] != r[p]) & (n[near] * den >= n[p] * num) & (n[p] * den >= n[near] * num)]
                if len(near):
                    equal = sig[near] == sig[p]
                    near = near[(equal.mean(axis=1) >= cut) & ~equal[:, :band * rows].reshape(len(near), band, rows).all(axis=2).any(axis=1)]
                    some[near] = True
                    some[p] |= len(near) > 0
            if some.any():
                yield from g.select([*KEYS, "minor", "t", "h", "r"]).filter(pa.array(some)).combine_chunks().to_batches()

    ddl = "bh long, kind int, i int, j int, minor boolean, t int, h long, r long"
    return x.repartition(*KEYS).sortWithinPartitions(*KEYS, "h").mapInArrow(run, ddl)


def _tile_links(tiles: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between components inside each tile, on full sets; a spanning forest of them."""
    x = tiles.join(sets.select("h", "node", "shingles"), "h").select(*KEYS, "minor", "t", "r", "node", "shingles")

    def forest(g):
        node, r = g["node"].to_pylist(), g["r"].to_numpy()
        lists = g["shingles"].combine_chunks()
        size = np.diff(np.asarray(lists.offsets))
        owner = np.repeat(np.arange(len(node)), size)
        code = np.unique(np.asarray(lists.flatten()), return_inverse=True)[1]
        by = np.argsort(code, kind="stable")
        posting, at = owner[by], np.concatenate([[0], np.cumsum(np.bincount(code))])
        begins = np.concatenate([[0], np.cumsum(size)])
        left, right, same = _sides(g)
        root = np.unique(r, return_inverse=True)[1]
        for p in left.tolist():
            near = right[right > p] if same else right
            near = near[root[near] != root[p]]
            if not len(near):
                continue
            inter = np.bincount(np.concatenate([posting[at[c]:at[c + 1]] for c in code[begins[p]:begins[p + 1]].tolist()]), minlength=len(node))[near]
            for q in near[inter * den >= num * (size[p] + size[near] - inter)].tolist():
                if root[q] != root[p]:
                    root[root == root[q]] = root[p]
                    yield node[p], node[q]

    def run(batches):
        for g in T.groups(batches, KEYS):
            if found := list(forest(g)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["u", "v"])

    return x.repartition(*KEYS).sortWithinPartitions(*KEYS, "node").mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, node, component_id, kept).

    Two documents are linked if ``den * |A & B| >= num * |A | B|`` of their
    sets of ``shingle`` words.  ``component_id`` is the least id reachable by
    links (``node``, the set's fingerprint, tells exact copies); ``kept`` marks the
    rows that carry it.  Null or wordless texts have an empty set, link with
    nothing and are kept.  A null id never is the least one unless its
    component has no other; rows that share an id stay separate rows.  Further
    columns of ``docs`` play no part.
    """
    bands, rows = plan_bands(num / den)
    lanes = bands * rows
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = cut_lineage(signatures(src, "id", "text", shingle, bands, rows))
    ids = sig.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).first()
    unique = ids.n == ids.d
    info = cut_lineage(sig.filter("n > 0").select("h", "node", "n", "sig", "bands").dropDuplicates(["node"]))
    each = info.select("h", F.posexplode("bands").alias("band", "bh"))
    info = info.drop("bands")
    # Under each salt a node's hub is the member of its buckets whose salted fingerprint is least: a pair for each node and salt at most.
    salts = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**63 for i in range(HUBS)]
    hub = [F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(f"p{i}") for i, x in enumerate(salts)]
    shared = each.groupBy("bh").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("bh")
    members = cut_lineage(each.join(shared, "bh"))
    release_shuffles(docs.sparkSession)
    hubs = members.join(members.groupBy("bh").agg(*hub), "bh").groupBy("h").agg(*[F.min(f"p{i}").alias(f"p{i}") for i in range(HUBS)])
    pairs = hubs.select("h", F.explode(F.array(*[F.col(f"p{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(salts)])).alias("hub")).filter("h != hub")
    pairs = cut_lineage(pairs.select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct())
    plausible = cut_lineage(_plausible(pairs, info, num, den, lanes))
    wanted = plausible.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    sets = _sets_of(wanted, src, sig, shingle, unique)
    release_shuffles(docs.sparkSession)
    first = _verified(plausible, sets, num, den)
    labels = connected_components(first, "u", "v")
    tiles = cut_lineage(_candidates(_tiles(members, info, labels), info, num, den, bands, rows))
    release_shuffles(docs.sparkSession)
    wanted = tiles.select("h").distinct().join(sets.select("h").distinct(), "h", "left_anti")
    sets = sets.union(_sets_of(wanted, src, sig, shingle, unique))
    release_shuffles(docs.sparkSession)
    second = cut_lineage(_tile_links(tiles, sets, num, den))
    labels = connected_components(first.union(second), "u", "v")
    rooted = sig.select("id", "n", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut_lineage(rooted)
    least = rooted.filter("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    found = rooted.filter("n > 0").join(least, "root")
    alone = rooted.filter("n = 0").withColumn("component_id", F.col("id"))
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")]
    return found.select(*cols).union(alone.select(*cols))

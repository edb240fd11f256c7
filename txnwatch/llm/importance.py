"""Importance resampling towards a target distribution, over bucketed word n-grams.

An untrained ``Split`` pre-tokeniser returns the words of the ASCII-lowered text with
their offsets.  A window of n consecutive offset pairs is a feature, its words joined by one
blank, and the CRC of its bytes is its bucket.  Each document is tokenised once: its sparse
histogram is written to the shared folder, and everything after it (the histograms of the
corpus and the target, the gains of the buckets, the sum of a document's gains)
works on that table.  Documents are drawn without replacement by the Gumbel trick: the
highest sums of weight and noise, the noise being a hash of the id.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import text as T
from txnwatch.operators.scan import add_global_position
from txnwatch.session import checkpoint_dir

#: Words of an ASCII-lowered text: digits, letters, all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Characters that the pre-tokeniser gets at once, about; a piece ends where a word does.
PIECE = 4_000
#: Features whose buckets a worker remembers before it starts afresh.
CACHE = 250_000


def _splitter():
    """The worker's pre-tokeniser, and the pattern of what stands between words."""
    held = T.worker_cache()
    if "word_split" not in held:
        import re

        from tokenizers import Regex, pre_tokenizers
        held["word_split"] = (pre_tokenizers.Split(Regex(WORDS), behavior="removed", invert=True), re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"))
    return held["word_split"]


def pieces(text: str, limit: int = PIECE):
    """Yield parts of ``text`` of ``limit`` characters or more that cut no word."""
    between, at = _splitter()[1], 0
    while len(text) - at > limit:
        end = between.search(text, at + limit)
        if end is None:
            break
        yield text[at:end.start()]
        at = end.start()
    yield text[at:]


def windows(text: str, ngram: int) -> tuple[int, list[str]]:
    """The number of words of a lowered text, and its features: all runs of 1 to ``ngram`` words, joined by one blank."""
    split = _splitter()[0].pre_tokenize_str
    if ngram == 1:
        words = [w for part in pieces(text) for w, _ in split(part)]
        return len(words), words
    n, out, held = 0, [], []  # held: the last words of the parts before
    for part in pieces(text):
        spans = [s for _, s in split(part)]
        own = held + [part[a:b] for a, b in spans]
        fresh = len(held)
        n += len(spans)
        for end in range(fresh, len(own)):
            out += [" ".join(own[begin:end + 1]) for begin in range(max(0, end + 1 - ngram), end + 1)]
        held = own[-(ngram - 1):]
    return n, out


class _Buckets(dict):
    """Buckets of features, kept as they are asked for."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[feature] = found = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % self.n
        return found


def histograms(df: DataFrame, id_col: str, text_col: str, ngram: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, bucket, times) of each row: its sparse histogram as two arrays."""
    kind = df.schema[id_col].dataType.simpleString()
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        known = _Buckets(buckets)
        for batch in batches:
            sizes, totals, own, times = [], [], [], []
            for text in pc.ascii_lower(batch.column(1)):
                n, features = windows(text.as_py() or "", ngram)
                code = np.fromiter(map(known.__getitem__, features), np.int32, len(features))
                code, count = np.unique(code, return_counts=True)
                sizes.append(n)
                totals.append(len(features))
                own.append(code)
                times.append(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), T.list_column(own, pa.int32()), T.list_column(times, pa.int64())],
                names=["id", "n_words", "n_features", "bucket", "times"])

    return df.mapInArrow(run, f"id {kind}, n_words long, n_features long, bucket array<int>, times array<bigint>")


def bucket_totals(rows: DataFrame) -> DataFrame:
    """(bucket, n): a histogram over all rows of ``histograms``."""
    each = rows.select(F.explode(F.arrays_zip("bucket", "times")).alias("f"))
    return each.groupBy(F.col("f.bucket").alias("bucket")).agg(F.sum("f.times").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, 1000 times the log of its smoothed share in the target over that in the corpus, floored."""
    spark = corpus.sparkSession
    both = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"]))
    rows = both.select("bucket", "s", "t").toPandas().sort_values("bucket")  # ``buckets`` rows
    s, t = rows["s"].to_numpy(np.float64), rows["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each row's features, 0 without any."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        g = shared.value
        for batch in batches:
            lists, times = batch.column(3), batch.column(4)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            each = g[lists.flatten().to_numpy()] * times.flatten().to_numpy()
            total = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(size)
            n = batch.column(2).to_numpy()
            weight = np.where(n > 0, (total[ends] - total[ends - size]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
                        ngram: int = 1, buckets: int = BUCKETS, seed: str = "2024", least_words: int = 20, percent: int = 10) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_words, n_features, weight, score, rank).

    ``weight`` is the floored mean gain of the document's features, ``score`` that and
    Gumbel noise, both in thousandths.  Of the documents with at least ``least_words`` words,
    ``percent`` in a hundred (rounded down) are drawn, by score and then by the lesser id; ``rank``
    is a drawn one's place from 1, else null.  Null and empty texts have no features and a weight of
    0; a null id is hashed as an empty one and comes before others at ties; rows that
    share an id are separate documents, in ties those with fewer features first.  Without
    documents, or without a target, every gain compares with an empty histogram.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/importance-{uuid.uuid4().hex}"
    histograms(docs, id_col, text_col, ngram, buckets).write.parquet(path)
    rows = spark.read.parquet(path)
    gain = gains(bucket_totals(rows), bucket_totals(histograms(target, target_id, target_text, ngram, buckets)), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = f"{path}-weighed"
    weigh(rows, gain).withColumn("score", F.col("weight") + noise).write.parquet(weighed)
    scored = spark.read.parquet(weighed)
    may = F.col("n_words") >= least_words
    # Scores are whole numbers in a range that the logarithms bound, so this table stays small however many rows there are.
    counts = scored.filter(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)
    drawn = int(counts["n"].sum()) * percent // 100
    above = counts["n"].cumsum()
    cut = int(counts["score"].iloc[int((above < drawn).sum())]) if drawn else None
    first = may & (F.col("score") >= cut) if drawn else F.lit(False)
    out = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    rest = scored.filter(~first).select(*out, F.lit(None).cast("long").alias("rank"))
    if not drawn:
        return rest
    near = scored.filter(first).withColumn("down", -F.col("score")).withColumn("row", F.monotonically_increasing_id())
    placed = add_global_position(near, ("down", "id", "n_features", "row"), "place", n_rows=int(above.iloc[int((above < drawn).sum())]))
    return placed.select(*out, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")).union(rest)

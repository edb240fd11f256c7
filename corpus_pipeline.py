"""A corpus-cleaning pipeline over ``documents``: five stages, each one operator.

Each stage gets what its predecessor kept and returns what it keeps itself, in
the columns of ``documents``; the last one returns token ids.  ``run`` writes every
stage's result as Parquet in the shared checkpoint folder and reads it back,
so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from txnwatch.session import checkpoint_dir

#: Score from which a document counts as toxic.
TOXIC = 0.3


def _as_documents(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with ``text`` for the text, and its length where it is stored."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``TOXIC``, by a model of all labelled ones."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=tuple(docs.columns))
    return scored.filter(F.col("score") < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; one that loses all its lines goes."""
    found = line_dedup.dedup_lines(docs).filter((F.col("n_lines") == 0) | (F.size("removed") < F.col("n_lines")))
    return _as_documents(found, docs, "clean_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a similarity of 0.8.

    The one that stays has the least (doc_id, hash of the text); of rows equal in both one stays.
    """
    key = F.struct("doc_id", F.xxhash64("text"))
    found = minhash.near_duplicates(docs.select(key.alias("__key"), "text"), "__key", "text", shingle=5, num=80, den=100)
    found = found.select("__key", "kept").groupBy("__key").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    changed = found.filter("not kept or n > 1").select("__key", F.col("kept").alias("__kept"))
    marked = docs.withColumn("__key", key).join(changed, "__key", "left")
    untouched = marked.filter("__kept is null").select(*docs.columns)
    repeated = marked.filter("__kept").dropDuplicates(["__key"]).select(*docs.columns)
    return untouched.unionByName(repeated)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; one that consists of them goes."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    return _as_documents(found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))), docs, "clean")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, with their digests and whether they decode to the text."""
    import public_tokenizers
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"),
                             keep=tuple(c for c in docs.columns if c != "text"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("MinHash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_benchmark), ("BPE encoding and decoding", tokenize)]

#: Scores, near copies and tokens have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

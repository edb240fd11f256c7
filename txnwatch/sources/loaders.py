"""Dataset readers into the canonical transaction schema (SRC1-SRC7, PRJ1)."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.operators.encode import factorize
from txnwatch.operators.scan import add_global_position
from txnwatch.session import cut_lineage
from txnwatch.sources import fs

# PaySim column contract and candidate file names.
PAYSIM_REQUIRED = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
                   "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud"]
PAYSIM_OPTIONAL = ["isFlaggedFraud"]
PAYSIM_CANDIDATES = ["PS_20174392719_1491204439457_log.csv", "paysim.csv", "PaySim.csv", "transactions.csv"]
PAYSIM_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()), T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()), T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()), T.StructField("isFraud", T.ByteType()),
    T.StructField("isFlaggedFraud", T.ByteType()),
])
IEEE_FILES = ("train_transaction.csv", "train_identity.csv")
STEP_BLOCK_SIZE = 24
SECONDS_PER_STEP = 3600


def canonicalize_paysim(raw: DataFrame, order_col: str = "TransactionID", preserve_ids: bool = True,
                        step_block_size: int | None = STEP_BLOCK_SIZE) -> DataFrame:
    """PRJ1: PaySim columns -> canonical transaction schema.

    ``order_col`` is the file order used for first-appearance codes and, when
    ``preserve_ids`` is false, for ``TransactionID = 1..n``.
    """
    df = factorize(raw, "nameOrig", order_col, "card1")
    df = factorize(df, "nameDest", order_col, "addr1")
    if not preserve_ids:
        df = add_global_position(df, order_cols=(order_col,), pos_col="_file_pos")
        df = df.withColumn("TransactionID", F.col("_file_pos") + 1).drop("_file_pos")
    cols = {
        "TransactionDT": (F.col("step").cast("long") * SECONDS_PER_STEP),
        "TransactionAmt": F.col("amount").cast("double"),
        "card4": F.col("type"),
        "D1": F.lit(0.0),
        "isFraud": F.coalesce(F.col("isFraud").cast("int"), F.lit(0)),
        "origin_delta": F.col("oldbalanceOrg") - F.col("newbalanceOrig"),
        "dest_delta": F.col("newbalanceDest") - F.col("oldbalanceDest"),
        "balance_gap": F.col("oldbalanceOrg") - F.col("oldbalanceDest"),
    }
    if step_block_size:
        cols["StepBlock"] = F.floor(F.col("step") / step_block_size).cast("int")
    out = df.withColumns(cols)
    keep = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "addr1", "card4", "D1", "isFraud",
            "origin_delta", "dest_delta", "balance_gap"] + (["StepBlock"] if step_block_size else [])
    return out.select(*keep)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floating values as NULL, so that averages and windows skip them."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def load_ieee(spark: SparkSession, data_dir: str, transaction_schema: T.StructType | str,
              identity_schema: T.StructType | str) -> DataFrame:
    """SRC2: transactions LEFT JOIN identity on TransactionID; label NULL -> 0;
    NaN -> NULL.  The schemas, in column order of the files, are required, so
    each file is read in a single pass."""
    paths = [f"{data_dir.rstrip('/')}/{f}" for f in IEEE_FILES]
    missing = [p for p in paths if not fs.exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"IEEE files not found: {missing}")
    trans, ident = (spark.read.option("header", True).schema(s).csv(p)
                    for p, s in zip(paths, (transaction_schema, identity_schema)))
    df = nan_to_null(trans.join(ident, "TransactionID", "left"))  # JN1
    return df.withColumn("isFraud", F.coalesce(F.col("isFraud").cast("int"), F.lit(0)))


def _header(spark: SparkSession, path: str) -> list[str]:
    try:
        return [c.strip().strip('"') for c in fs.first_line(spark, path).strip().split(",")]
    except Exception:  # noqa: BLE001 - unreadable files are skipped
        return []


def _folder(path: str) -> str:
    return path.rsplit("/", 1)[0]


def _is_part_file(path: str) -> bool:
    return path.rsplit("/", 1)[-1].startswith("part-")


def resolve_paysim_path(spark: SparkSession, data_dir: str) -> str:
    """SRC5: a candidate name in the root, then recursively, then the first
    (sorted) CSV whose header holds every required column.  A folder of
    ``part-`` files (a Spark CSV output) is judged by its first part."""
    root = data_dir.rstrip("/")
    for name in PAYSIM_CANDIDATES:
        if fs.exists(spark, f"{root}/{name}"):
            return f"{root}/{name}"
    files = fs.list_files(spark, root, ".csv")
    for f in files:
        if f.rsplit("/", 1)[-1] in PAYSIM_CANDIDATES:
            return _folder(f) if _is_part_file(f) else f
    missing_best = None
    seen_folders = set()
    for f in files:
        target = f
        if _is_part_file(f):
            target = _folder(f)
            if target in seen_folders:
                continue
            seen_folders.add(target)
        hdr = set(_header(spark, f))
        if not hdr or hdr == {""}:
            continue
        missing = sorted(set(PAYSIM_REQUIRED) - hdr)
        if not missing:
            return target
        if missing_best is None or len(missing) < len(missing_best):
            missing_best = missing
    raise FileNotFoundError(f"No PaySim CSV under {data_dir}; missing columns: {missing_best or PAYSIM_REQUIRED}")


def discover_by_schema(spark: SparkSession, data_dir: str, required: Sequence[str] = PAYSIM_REQUIRED) -> DataFrame:
    """SRC5 at scale: one distributed pass reads the first line of every CSV
    under ``data_dir`` and keeps the files whose header has all ``required``."""
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(data_dir)
             .filter("_metadata.file_block_start = 0")  # the split that holds the header
             .select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row")))
    first = lines.groupBy("path").agg(F.min_by("value", "row").alias("header"))
    cols = F.split(F.regexp_replace(F.col("header"), '"', ""), ",")
    ok = F.lit(True)
    for c in required:
        ok = ok & F.array_contains(F.transform(cols, lambda x: F.trim(x)), c)
    return first.select("path", ok.alias("matches"))


def with_file_position(df: DataFrame, pos_col: str = "_fpos") -> DataFrame:
    """Attach each row's 0-based position in the files: by file path, then byte offset of the split, then order in the split.

    A file scan bin-packs splits by size, so partition order alone is not file order; but the rows of a split come one
    after the other in one partition.  So a split's rows are counted (one row per split), the splits before it give its
    offset, and the increasing id less the split's least one the place in it: no sort of the rows.
    """
    meta = df.select("*", F.col("_metadata.file_path").alias("_fp"), F.col("_metadata.file_block_start").alias("_fb"),
                     F.monotonically_increasing_id().alias("_fr"))
    splits = cut_lineage(meta.groupBy("_fp", "_fb").agg(F.count(F.lit(1)).alias("_fn"), F.min("_fr").alias("_f0")))
    before = Window.orderBy("_fp", "_fb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_fp", "_fb", (F.coalesce(F.sum("_fn").over(before), F.lit(0)) - F.col("_f0")).alias("_fo"))
    return (meta.join(F.broadcast(offsets), ["_fp", "_fb"])  # a row per split of the files
            .withColumn(pos_col, F.col("_fo") + F.col("_fr")).drop("_fp", "_fb", "_fr", "_fo"))


def first_files(files: Sequence[str], max_rows: int, count) -> list[str]:
    """The shortest known prefix of ``files`` with at least ``max_rows`` rows (or all of them).

    ``count`` tells the rows of some files.  The prefix grows by what the rows counted so far
    suggest, so little more than is needed is ever opened, and each file is counted once.
    """
    taken, rows, step = 0, 0, 1
    while taken < len(files) and rows < max_rows:
        rows += count(files[taken:taken + step])
        taken = min(len(files), taken + step)
        missing = max_rows - rows
        # files that the rows so far suggest, a tenth more; at most as many again as were taken
        step = max(1, min(taken, math.ceil(1.1 * missing * taken / rows))) if rows else taken
    return list(files[:taken])


def load_paysim(spark: SparkSession, data_dir: str, max_rows: int | None = None,
                step_block_size: int | None = STEP_BLOCK_SIZE) -> DataFrame:
    """SRC3/SRC4: typed by the PaySim contract, in header order; ``max_rows``
    keeps the first rows in file order (a position filter over the first files that hold
    them, never a bare ``limit``; later files aren't opened); ids are 1..n in file order."""
    files = fs.list_files(spark, data_dir, ".csv")
    if fs.is_dir(spark, data_dir) and not all(_is_part_file(f) and _folder(f) == data_dir.rstrip("/")
                                               for f in files):
        path = resolve_paysim_path(spark, data_dir)
    else:
        path = data_dir
    own = fs.list_files(spark, path, ".csv") or [path]
    hdr = _header(spark, own[0])
    types = {f.name: f.dataType for f in PAYSIM_SCHEMA.fields}
    # CSV columns bind by position: the schema follows the header order
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in hdr])
    reader = spark.read.schema(schema).option("header", True)
    if max_rows is not None:
        own = first_files(own, max(1, max_rows), lambda some: reader.csv(list(some)).count())
    raw = with_file_position(reader.csv(path if max_rows is None else own))
    if max_rows is not None:
        raw = raw.filter(F.col("_fpos") < max_rows)
    raw = raw.withColumn("TransactionID", F.col("_fpos") + 1).drop("_fpos")
    return canonicalize_paysim(raw, order_col="TransactionID", preserve_ids=True, step_block_size=step_block_size)


def load_dataset(spark: SparkSession, data_dir: str, dataset: str, **kwargs) -> DataFrame:
    """SRC1: dispatch on the dataset name."""
    name = dataset.strip().lower()
    if name == "ieee":
        return load_ieee(spark, data_dir, **kwargs)
    if name == "paysim":
        return load_paysim(spark, data_dir, **kwargs)
    raise ValueError(f"Unknown dataset: {dataset!r} (expected 'ieee' or 'paysim')")


load_and_merge = load_dataset  # legacy alias


# --- SRC7: feature cache ------------------------------------------------------------

def _fingerprint(spark: SparkSession, paths: Sequence[str], tag: str, params: dict) -> dict:
    """What a cached table depends on: of each input path, how many files it has and a
    digest of every file's path, size and modification time (listed by Spark)."""
    files = {}
    for p in paths:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "length", "modificationTime")
        r = listed.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"),
                       F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("digest")).first()
        files[p] = {"files": r["n"], "bytes": r["bytes"], "digest": str(r["digest"])}
    return {"inputs": files, "pipeline": tag, "params": params}


def cached_features(spark: SparkSession, cache_dir: str, inputs: Sequence[str], tag: str, params: dict,
                    build) -> DataFrame:
    """SRC7: the feature table of the current fingerprint (every input file's path, size and modification
    time, pipeline tag, parameters) if it has been built, else what ``build`` gives, kept for the next call.

    A table is written once, into a folder of its own below ``cache_dir``, and is never changed.  A
    pointer file named by the fingerprint's digest commits it: the pointer is written whole beside its place
    and renamed into it.  A build that breaks off leaves no pointer, so nothing is ever read under another
    fingerprint than its own; of two builds at once the first to commit is the one that counts, and readers
    of another version go on reading theirs.
    """
    root = cache_dir.rstrip("/")
    want = json.dumps(_fingerprint(spark, inputs, tag, params), sort_keys=True)
    pointer = f"{root}/{hashlib.sha256(want.encode()).hexdigest()}.json"

    def committed() -> str | None:
        text = fs.read_text(spark, pointer)
        found = json.loads(text) if text else None
        return found["table"] if found and json.dumps(found["fingerprint"], sort_keys=True) == want and fs.exists(spark, f"{found['table']}/_SUCCESS") else None

    table = committed()
    if table is None:
        table = f"{root}/features-{uuid.uuid4().hex}.parquet"
        build().write.parquet(table)
        fs.write_text(spark, f"{table}.pointer", json.dumps({"table": table, "fingerprint": json.loads(want)}, sort_keys=True))
        if not fs.rename(spark, f"{table}.pointer", pointer):
            table = committed() or table  # another build came first (or its table is gone: ours serves this call)
    return spark.read.parquet(table)

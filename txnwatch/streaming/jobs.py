"""Streaming jobs: ADWIN per key (STR2), scoring + routing (STR3), windowed
score PSI (STR4), and a runner that drains a stream with ``availableNow``
into the cluster's shared checkpoint folder (EVL13 reads its progress)."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from txnwatch.operators import features as FE
from txnwatch.operators import route as RT
from txnwatch.operators.models import CalibratedLinear, LinearModel
from txnwatch.session import checkpoint_dir
from txnwatch.sources import fs
from txnwatch.streaming.adwin import Adwin
from txnwatch.streaming.features import FAR, ReleasedByTime, by_bucket, closing_marker

# --- runner --------------------------------------------------------------------------------


PROGRESS_KEPT = 1_000_000


#: State of ``StatefulProcessor`` queries lives in RocksDB, on the executors' disks and in the checkpoint.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, name: str, output_mode: str = "append", then=None) -> tuple[DataFrame, list[dict]]:
    """Drain ``stream`` (``availableNow``) into a parquet folder under the
    shared checkpoint directory; return the written rows and the progress
    reports of the query.  Waits until the stream has ended; a failure raises.

    ``then``, if given, runs after that (it may add files to a source), and the query goes on from its checkpoint
    until the stream has ended again.

    In update mode each micro-batch's changed rows are kept with its ``epoch``:
    a row's last version is the one of the greatest epoch."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", PROGRESS_KEPT)  # a small report per micro-batch
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"
    out, ckpt = f"{base}/out", f"{base}/_checkpoint"

    def drained() -> list[dict]:
        if output_mode == "append":
            q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                 .outputMode("append").trigger(availableNow=True).start())
        else:
            def sink(batch_df, epoch):
                batch_df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated batch replaces itself
            q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
                 .outputMode(output_mode).trigger(availableNow=True).start())
        q.awaitTermination()
        return list(q.recentProgress)

    progress = drained()
    if then is not None:
        then()
        progress += drained()
    return spark.read.parquet(out), progress


def run_closed(job, stream: DataFrame, name: str) -> tuple[DataFrame, list[dict]]:
    """Drain ``job(stream)``, then close the stream with a marker and drain what was still waiting."""
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/streams/closing-{uuid.uuid4().hex[:8]}"
    marker = closing_marker(stream)
    marker.limit(0).write.parquet(folder)
    both = stream.unionByName(spark.readStream.schema(marker.schema).parquet(folder))
    return run_to_table(job(both), name, then=lambda: marker.write.mode("append").parquet(folder))


# --- STR2: ADWIN per key -------------------------------------------------------------------------

ADWIN_STATE = T.StructType([T.StructField("adwin", T.StringType())])
ADWIN_OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("position", T.LongType()),
                          T.StructField("window_width", T.LongType())])


def _adwin_state_fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values("position")
    det = Adwin.from_json(state.get[0]) if state.exists else Adwin()
    hits = []
    for pos, v in zip(pdf["position"], pdf["value"]):
        if pd.notna(v) and det.update(float(v)):
            hits.append((str(key[0]), int(pos), int(det.width)))
    state.update((det.to_json(),))
    if hits:
        yield pd.DataFrame(hits, columns=["key", "position", "window_width"])


def stream_adwin(stream: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """STR2: one ADWIN detector per key as bounded keyed state."""
    src = stream.select(F.col(key).cast("string").alias("key"), F.col(position).cast("long").alias("position"),
                        F.col(value).cast("double").alias("value"))
    return src.groupBy("key").applyInPandasWithState(_adwin_state_fn, ADWIN_OUT, ADWIN_STATE, "append",
                                                     GroupStateTimeout.NoTimeout)


# --- STR3: score + route ------------------------------------------------------------------------------

HISTORY_OUT = T.StructType([T.StructField("TransactionID", T.LongType()), T.StructField("TransactionAmt", T.DoubleType()),
                            T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("Card_Prior_Txn_Count", T.LongType()),
                            T.StructField("is_new_client", T.IntegerType())])


class ClientHistory(ReleasedByTime):
    """How many transactions of a card came before, and whether the client is new, its rows released by event time.

    State: a count, one map entry per client (the day it was last seen, forgotten after ``ttl_days``) and one per
    bucket that waits.  An entry is read and written by itself, so no value grows with the card.
    Keys that begin with "u" are clients without a card, which have no prior count.
    """

    def __init__(self, ttl_days: int | None = None):
        self.ttl_days = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle, "dt array<long>, id array<long>, uid array<long>, amt array<double>, scores array<array<double>>")
        self.seen = handle.getValueState("seen", "n long")
        self.clients = handle.getMapState("clients", "uid long", "day long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            amt = [None if math.isnan(v) else v for v in pdf["TransactionAmt"].to_numpy(dtype=float).tolist()]
            scores = [[None if v is None or math.isnan(v) else float(v) for v in s] for s in pdf["scores"]]
            self.hold(by_bucket(pdf["ms"], *(pdf[c].astype("int64").tolist() for c in ("TransactionDT", "TransactionID", "uid")), amt, scores))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last_day = None, None
        for group in self.released(timerValues.getCurrentWatermarkInMs()):
            if n is None:
                n = self.seen.get()[0] if self.seen.exists() else 0
                any_client = n > 0
            out, known = [], {}  # the group's clients: the day of their last row
            for b, _, i, uid, amt, scores in sorted(zip(*group), key=lambda r: r[:3]):
                if uid not in known:
                    last = self.clients.getValue((uid,)) if any_client else None
                    known[uid] = None if last is None else last[0]
                last = known[uid]
                fresh = last is None or (self.ttl_days and b - last > self.ttl_days)
                out.append((i, amt, list(scores), n if str(key[0]).startswith("c") else None, int(bool(fresh))))
                known[uid] = last_day = b
                n += 1
            any_client = True
            for uid, day in known.items():
                self.clients.updateValue((uid,), (day,))
            pdf = pd.DataFrame(out, columns=HISTORY_OUT.fieldNames())
            yield pdf.astype({"Card_Prior_Txn_Count": "Int64", "is_new_client": "int32"})
        if n is None:
            return
        self.seen.update((n,))
        if self.ttl_days:
            for uid in [k[0] for k, v in self.clients.iterator() if last_day - v[0] > self.ttl_days]:
                self.clients.removeKey((uid,))


def stream_history(stream: DataFrame, delay: str = "1 hour", scores: tuple[str, ...] = ("fraud_score",), ttl_days: int | None = None) -> DataFrame:
    """Per card, how many transactions came before and whether the client (UID) is new, beside the row's ``scores``.

    Rows may be ``delay`` older than the newest seen; they are taken in time order whatever order they come in.
    """
    src = FE.build_uid(stream).withWatermark("event_time", delay)
    uid = F.xxhash64("UID")
    key = F.when(F.col("card1").isNotNull(), F.concat(F.lit("c"), F.col("card1").cast("string"))).otherwise(F.concat(F.lit("u"), uid.cast("string")))
    rows = src.filter(F.col("event_time") < F.lit(FAR).cast("timestamp")).select(
        key.alias("key"), uid.alias("uid"), F.col("TransactionDT").cast("long"), F.col("TransactionID").cast("long"), F.col("TransactionAmt").cast("double"),
        F.array(*[F.col(c).cast("double") for c in scores]).alias("scores"), "event_time", (F.unix_micros("event_time") / 1000).cast("long").alias("ms"))
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=ClientHistory(ttl_days), outputStructType=HISTORY_OUT,
                                                         outputMode="Append", timeMode="EventTime")
    return out.select("*", *[F.col("scores")[k].alias(c) for k, c in enumerate(scores)]).drop("scores")


@dataclass(frozen=True)
class ScoringSnapshot:
    """What a stream scores with: gate weights and the calibrated stack of one training run.

    A snapshot is a small JSON file, numbered; a job reads the newest when it starts and its numbers become
    literals of the plan, so every micro-batch of the job scores alike.
    """
    version: int
    weights: dict[str, float]
    meta: CalibratedLinear

    def proba(self) -> Column:
        gated = {m: F.col(m) * F.lit(w) for m, w in self.weights.items()}
        parts = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * m.logit_of(gated) + F.lit(b)))) for m, a, b in self.meta.folds]
        if not parts:
            return self.meta.base.proba_of(gated)
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total / len(parts)


def save_snapshot(spark: SparkSession, folder: str, weights: DataFrame, meta: CalibratedLinear) -> int:
    """Write the next snapshot of ``folder`` (weights: one row per model) and return its number; a number is given once."""
    line = lambda m: {"features": m.features, "coef": m.coef, "intercept": m.intercept}
    body = {"weights": {r.model: r.gate_weight for r in weights.collect()}, "base": line(meta.base), "folds": [[line(m), a, b] for m, a, b in meta.folds]}
    version = max([0, *_versions(spark, folder)]) + 1
    temp = f"{folder}/_next-{uuid.uuid4().hex}"
    fs.write_text(spark, temp, json.dumps(body))
    while not fs.rename(spark, temp, f"{folder}/snapshot-{version:08d}.json"):
        version += 1
    return version


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(f.rsplit("-", 1)[1][:8]) for f in fs.list_files(spark, folder, ".json")]


def load_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> ScoringSnapshot:
    """A snapshot of ``folder``, the newest by default."""
    version = max(_versions(spark, folder)) if version is None else version
    body = json.loads(fs.read_text(spark, f"{folder}/snapshot-{version:08d}.json"))
    return ScoringSnapshot(version, body["weights"], CalibratedLinear(LinearModel(**body["base"]), [(LinearModel(**m), a, b) for m, a, b in body["folds"]]))


def stream_routing(stream: DataFrame, amount_p95: float, score: str = "fraud_score", amount: str = "TransactionAmt",
                   prior_count: str | None = None, new_client: str | None = None) -> DataFrame:
    """Routing of a scored stream; with the columns of :func:`stream_history`
    also by cold start and new client.  The amount percentile is a snapshot
    from a reference table (a literal), not recomputed per batch."""
    s = F.col(score)
    decision = (F.when(s >= RT.AUTO_BLOCK_THRESHOLD, F.lit(RT.AUTO_BLOCK))
                .when(s >= RT.REVIEW_THRESHOLD, F.lit(RT.HITL_REVIEW)).otherwise(F.lit(RT.ALLOW)))
    promote = (F.col(amount) > F.lit(amount_p95)) & (s >= RT.REVIEW_THRESHOLD)
    soft = s >= RT.SOFT_REVIEW_THRESHOLD
    if prior_count is not None:
        promote = promote | ((F.col(prior_count) < RT.COLD_START_LIMIT) & soft)
    if new_client is not None:
        promote = promote | ((F.col(new_client) == 1) & soft)
    return stream.withColumn("decision", F.when((decision == RT.ALLOW) & promote, F.lit(RT.HITL_REVIEW)).otherwise(decision))


# --- STR4: PSI per event-time window ----------------------------------------------------------------

def stream_window_bins(stream: DataFrame, breakpoints: list[float], score: str = "fraud_score",
                       event_time: str = "event_time", window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per tumbling event-time window, counts per reference bin (values
    outside the reference range dropped; last bin closed).  For update mode:
    a window's counts may change until it is ``watermark`` old, then its state goes."""
    nb = len(breakpoints) - 1
    x = F.col(score)
    b = F.lit(0)
    for e in breakpoints[1:-1]:
        b = b + F.when(x >= F.lit(e), F.lit(1)).otherwise(F.lit(0))
    inside = (x >= F.lit(breakpoints[0])) & (x <= F.lit(breakpoints[-1]))
    return (stream.withWatermark(event_time, watermark).filter(inside)
            .withColumn("bin", F.least(b, F.lit(nb - 1)))
            .groupBy(F.window(event_time, window).alias("w"), "bin").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "bin", "n"))


def latest_bins(updates: DataFrame) -> DataFrame:
    """The last version of each (window, bin) of an update-mode table."""
    return updates.groupBy("window_start", "bin").agg(F.max_by("n", "epoch").alias("n"))


def window_psi(bins: DataFrame, reference_counts: DataFrame) -> DataFrame:
    """PSI of each window's bin counts against reference bin counts
    (``bin, ref_n``), +1 smoothing over all reference bins."""
    nb = reference_counts.count()
    windows = bins.select("window_start").distinct()
    grid = windows.crossJoin(F.broadcast(reference_counts))  # windows x bins (bins bounded by n_bins)
    g = grid.join(bins, ["window_start", "bin"], "left").fillna(0, ["n"])
    tot = g.groupBy("window_start").agg(F.sum("n").alias("A"), F.sum("ref_n").alias("E"))
    g = g.join(tot, "window_start")
    e = (F.col("ref_n") + 1) / (F.col("E") + nb)
    a = (F.col("n") + 1) / (F.col("A") + nb)
    return g.groupBy("window_start").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


# --- EVL13: throughput from streaming progress -------------------------------------------------------

def progress_report(progress: list[dict], wall_s: float) -> list[tuple]:
    rows = sum(int(p.get("numInputRows", 0) or 0) for p in progress)
    batch_ms = [int((p.get("durationMs") or {}).get("triggerExecution", 0) or 0) for p in progress]
    med = sorted(batch_ms)[len(batch_ms) // 2] if batch_ms else 0
    return [("rows", float(rows)), ("micro_batches", float(len(progress))),
            ("median_batch_ms", float(med)), ("wall_seconds", float(wall_s)),
            ("rows_per_second", float(rows / wall_s) if wall_s > 0 else 0.0)]


def timed(fn):
    t0 = time.time()
    out = fn()
    return out, time.time() - t0


def to_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "metric string, value double")

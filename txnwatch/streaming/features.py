"""Structured Streaming versions of the causal operators (STR1-STR4).

STR1 is a ``StatefulProcessor`` per card.  Rows may come in any order within the watermark's delay:
they wait in map state, one entry for each ``BUCKET`` of event time, and an event-time timer releases
the buckets whose end the watermark has passed, ``RELEASE_ROWS`` and a bucket at most in a frame.  Released rows are taken in (time, id) order against two values of state,
the moments (count, Welford mean and M2) and the ring of the last 30 amounts.  So results don't
depend on which files share a micro-batch, they equal the batch operators WIN1/2/6/7/8, and of a card with any
number of rows only so many are ever in one frame.  Rows older than the watermark are dropped by
Spark; rows without a card are no entity and pass by the state, as in the batch.

A stream that has an end gets a closing marker (:func:`closing_marker`): a row of the far future that moves
the watermark past everything that still waits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txnwatch.functions.columns import seconds_since
from txnwatch.sources import fs
from txnwatch.sources.fixtures import TXN_EPOCH

RING = 30
WINDOWS = [(7, "7d"), (14, "14d"), (30, "30d")]
SPENDING = 10

#: Seconds of event time that wait, and are released, together.
BUCKET = 86400
#: Released buckets, one after the other, share a frame until it has so many rows; a key with no more rows waiting is read at once.
RELEASE_ROWS = 10_000
#: Event time of a closing marker.
FAR = "2200-01-01 00:00:00"

OUTPUT_SCHEMA = T.StructType([
    T.StructField("card1", T.LongType()), T.StructField("TransactionID", T.LongType()),
    T.StructField("TransactionDT", T.LongType()), T.StructField("TransactionAmt", T.DoubleType()),
    T.StructField("Card_Tx_Count", T.LongType()), T.StructField("Card_Prior_Txn_Count", T.LongType()),
    T.StructField("card_amt_mean", T.DoubleType()), T.StructField("card_amt_std", T.DoubleType()),
    *[T.StructField(f"Card_Velocity_{lab}", T.DoubleType()) for _, lab in WINDOWS],
    *[T.StructField(f"Card_Amt_Std_{lab}", T.DoubleType()) for _, lab in WINDOWS],
    T.StructField("Card_Spending_Velocity", T.DoubleType()), T.StructField("late", T.IntegerType()),
])


def _vectorized_batch(key, pdf: pd.DataFrame, st: tuple) -> tuple[pd.DataFrame, tuple]:
    """All rows in order after the state: rolling windows over (ring + batch)
    and expanding moments from cumulative sums about the carried mean."""
    n0, na0, mean0, m20, ring = st
    amt = pd.to_numeric(pdf["TransactionAmt"], errors="coerce").to_numpy(dtype=float)
    k = len(amt)
    full = pd.Series(list(ring) + list(amt), dtype=float)
    tail = slice(len(full) - k, len(full))
    out = pd.DataFrame({"card1": int(key[0]), "TransactionID": pdf["TransactionID"].astype("int64").to_numpy(),
                        "TransactionDT": pdf["TransactionDT"].astype("int64").to_numpy(), "TransactionAmt": amt})
    cnt = n0 + np.arange(1, k + 1)
    out["Card_Tx_Count"] = cnt
    out["Card_Prior_Txn_Count"] = cnt - 1
    m = ~np.isnan(amt)
    cna = na0 + np.cumsum(m)
    d = np.where(m, amt - mean0, 0.0)
    s1, s2 = np.cumsum(d), np.cumsum(d * d)
    safe = np.maximum(cna, 1)
    mean = np.where(cna > 0, mean0 + s1 / safe, 0.0)
    m2 = np.maximum(m20 + s2 - s1 * s1 / safe, 0.0)
    out["card_amt_mean"] = mean
    out["card_amt_std"] = np.where(cna >= 2, np.sqrt(m2 / np.maximum(cna - 1, 1)), 0.0)
    for w, lab in WINDOWS:
        out[f"Card_Velocity_{lab}"] = full.rolling(w, min_periods=1).mean().to_numpy()[tail]
        out[f"Card_Amt_Std_{lab}"] = full.rolling(w, min_periods=2).std().fillna(0.0).to_numpy()[tail]
    out["Card_Spending_Velocity"] = full.rolling(SPENDING, min_periods=1).count().to_numpy()[tail]
    out["late"] = 0
    ring_new = [None if np.isnan(v) else float(v) for v in full.to_numpy()[-RING:]]
    new_state = (int(cnt[-1]), int(cna[-1]), float(mean[-1]), float(m2[-1]), ring_new)
    out = out.astype({"Card_Tx_Count": "int64", "Card_Prior_Txn_Count": "int64"})
    out["TransactionAmt"] = out["TransactionAmt"].where(~np.isnan(amt), None)
    return out[[f.name for f in OUTPUT_SCHEMA.fields]], new_state


class ReleasedByTime(StatefulProcessor):
    """Rows wait in the map state ``waiting``, an entry per bucket; one timer, at the end of the earliest bucket, releases what
    the watermark has passed."""

    def wait(self, handle: StatefulProcessorHandle, columns: str) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", columns)
        self.timer = handle.getValueState("timer", "at long, n_rows long")  # set while rows wait

    def hold(self, buckets: dict[int, tuple]) -> None:
        """Add rows, given as columns by bucket."""
        at, n = self.timer.get() if self.timer.exists() else (None, 0)
        for b, fresh in buckets.items():
            held = self.waiting.getValue((b,)) if n else None
            self.waiting.updateValue((b,), fresh if held is None else tuple([*x, *y] for x, y in zip(held, fresh)))
        first = (min(buckets) + 1) * BUCKET * 1000
        if at is None or first < at:
            self.handle.registerTimer(first)
            at = first
        self.timer.update((at, n + sum(len(x[0]) for x in buckets.values())))

    def released(self, watermark: int) -> Iterator[tuple]:
        """The rows of the buckets that the watermark has passed, as columns with the bucket first, in order of
        buckets and some of them together; the timer moves on to the first of the others."""
        if not self.timer.exists():
            return
        n = self.timer.get()[1]
        known = {k[0]: v for k, v in self.waiting.iterator()} if n <= RELEASE_ROWS else None
        all_ = sorted(known if known is not None else (k[0] for k in self.waiting.keys()))
        due = [b for b in all_ if (b + 1) * BUCKET * 1000 <= watermark]
        if not due:
            return
        at_once = known is not None and len(due) == len(all_)
        if at_once:
            self.waiting.clear()
        group: list[list] = []
        for b in due:
            rows = known[b] if known is not None else self.waiting.getValue((b,))
            if not at_once:
                self.waiting.removeKey((b,))
            own = ([b] * len(rows[0]), *rows)
            n -= len(rows[0])
            group = [[*x, *y] for x, y in zip(group, own)] if group else [list(x) for x in own]
            if len(group[0]) >= RELEASE_ROWS:
                yield tuple(group)
                group = []
        if group:
            yield tuple(group)
        if len(due) < len(all_):
            then = (all_[len(due)] + 1) * BUCKET * 1000
            self.handle.registerTimer(then)
            self.timer.update((then, n))
        else:
            self.timer.clear()

    def close(self) -> None:
        pass


def by_bucket(ms: pd.Series, *columns: list) -> dict[int, tuple]:
    """Columns of rows dealt to the buckets of their event times (milliseconds), in the order they come in."""
    out: dict[int, tuple] = {}
    for i, b in enumerate((ms.to_numpy() // (BUCKET * 1000)).tolist()):
        own = out.setdefault(b, tuple([] for _ in columns))
        for x, c in zip(own, columns):
            x.append(c[i])
    return out


class CardState(ReleasedByTime):
    """Expanding and rolling statistics of one card, its rows released by event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle, "dt array<long>, id array<long>, amt array<double>")
        self.moments = handle.getValueState("moments", "n long, n_amt long, mean double, m2 double")
        self.ring = handle.getValueState("ring", "last array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:  # Arrow batches of bounded size
            amt = [None if math.isnan(v) else v for v in pdf["TransactionAmt"].to_numpy(dtype=float).tolist()]
            self.hold(by_bucket(pdf["ms"], pdf["TransactionDT"].astype("int64").tolist(), pdf["TransactionID"].astype("int64").tolist(), amt))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All buckets that the watermark has passed, in order."""
        moments = None
        for _, dt, ids, amt in self.released(timerValues.getCurrentWatermarkInMs()):
            if moments is None:
                moments = self.moments.get() if self.moments.exists() else (0, 0, 0.0, 0.0)
                ring = self.ring.get()[0] if self.ring.exists() else []
            pdf = pd.DataFrame({"TransactionDT": dt, "TransactionID": ids, "TransactionAmt": pd.Series(amt, dtype="float64")})
            out, (*moments, ring) = _vectorized_batch(key, pdf.sort_values(["TransactionDT", "TransactionID"]), (*moments, ring))
            yield out
        if moments is None:
            return
        self.moments.update(tuple(moments))
        self.ring.update((list(ring),))


def closing_marker(df: DataFrame) -> DataFrame:
    """One row in the columns of a transaction stream that closes it: no card, far in the future."""
    fixed = {"event_time": F.lit(FAR).cast("timestamp")}
    return df.sparkSession.range(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def stream_card_features(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """STR1 over a streaming frame with card1, TransactionID, TransactionDT, TransactionAmt and event_time.

    ``delay`` is how much older than the newest row seen another may be.
    """
    src = stream.select(F.col("card1").cast("long").alias("card1"), F.col("TransactionID").cast("long"), F.col("TransactionDT").cast("long"),
                        F.col("TransactionAmt").cast("double"), "event_time").withWatermark("event_time", delay)
    # the conditions name the event time, so that none is evaluated below the watermark: it has to see every row
    ahead = F.col("event_time") < F.lit(FAR).cast("timestamp")
    ms = (F.unix_micros("event_time") / 1000).cast("long").alias("ms")
    known = src.filter(F.when(ahead, F.col("card1").isNotNull()).otherwise(F.lit(False))).select("*", ms).groupBy("card1").transformWithStateInPandas(
        statefulProcessor=CardState(), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="EventTime")
    own = set(src.columns)
    fixed = {**{f"Card_Amt_Std_{lab}": 0.0 for _, lab in WINDOWS}, "late": 0}
    missing = src.filter(F.when(ahead, F.col("card1").isNull()).otherwise(F.lit(False))).select(
        *[(F.col(f.name) if f.name in own else F.lit(fixed.get(f.name))).cast(f.dataType).alias(f.name) for f in OUTPUT_SCHEMA.fields])
    return known.unionByName(missing)


# --- sources -------------------------------------------------------------------------------

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``events`` (a file or a folder of files) as a file stream.

    A micro-batch holds all files that are there, or ``max_files_per_trigger``
    of them; rows are put in order within a micro-batch only."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    if fs.is_dir(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream reads folders


def txn_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The canonical transaction columns derived per micro-batch (stateless)."""
    ev = events_stream(spark, sf_dir, max_files_per_trigger)
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value")
    return ev.select(
        F.col("event_id").alias("TransactionID"), seconds_since("ts", TXN_EPOCH).cast("long").alias("TransactionDT"),
        value.alias("TransactionAmt"), F.col("user_id").alias("card1"), F.col("event_type").alias("card4"),
        F.when(F.pmod("user_id", F.lit(7)) != 0, F.pmod("user_id", F.lit(7))).cast("int").alias("addr1"),
        F.when(F.pmod(k, F.lit(10)) != 0, F.floor(seconds_since("ts", TXN_EPOCH).cast("long") / F.lit(86400.0)).cast("double")
               - F.pmod("user_id", F.lit(5))).cast("double").alias("D1"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when((F.col("event_type") == "error") & (value > 75), F.lit(1)).otherwise(F.lit(0)).alias("isFraud"),
        F.round(F.lit(0.6) * F.when(F.col("event_type") == "error", F.least(value / F.lit(150.0), F.lit(1.0)))
                .otherwise(F.lit(0.0)) + F.lit(0.4) * k / F.lit(100.0), 3).alias("fraud_score"))

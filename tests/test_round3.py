"""Findings of the third round: whole results at odd values, and steps whose cost grows as the rows do."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_balance_of_minus_one_gives_an_infinite_ratio(spark):
    from txnwatch.functions import columns as C
    raw = spark.createDataFrame([(1, 5.0, -1.0, 0.0), (1, -5.0, -1.0, 0.0), (1, 6.0, 2.0, 0.0), (1, 0.0, -1.0, 0.0), (1, 5.0, None, 0.0)],
                                "step int, amount double, oldbalanceOrg double, newbalanceOrig double")
    got = [r.x for r in raw.select(C.r6(C.paysim_balance_columns()["amt_to_balance"]).alias("x")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and got[2] == 2.0 and math.isnan(got[3]) and got[4] is None


def test_bounded_paysim_query_reads_the_whole_log(spark):
    import __spark_entry__ as E
    from txnwatch.sources.fixtures import paysim_raw
    n = paysim_raw(spark, SF_SMALL).count()
    got = E.queries()["src4"](spark, SF_SMALL)
    assert got.count() == n and "LIMIT" not in E.oracle_sql()["src4"]


def test_file_positions_of_split_files_need_no_sort_of_rows(spark, tmp_path):
    from txnwatch.sources import loaders as LD
    d = tmp_path / "log"
    d.mkdir()
    want = []
    for k in range(5):
        rows = [f"{k}-{i}" for i in range(400 if k == 2 else 30 * k)]
        (d / f"part-{k:02d}.csv").write_text("x\n" + "".join(f"{v}\n" for v in rows))
        want += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # several splits a file, several files a partition
    try:
        df = LD.with_file_position(spark.read.schema("x string").option("header", True).csv(f"file://{d}"))
        got = {r["_fpos"]: r.x for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [got[i] for i in range(len(got))] == want
    assert "Exchange rangepartitioning" not in plan and "Exchange hashpartitioning" not in plan


def _brute(x, row, y, other, k):
    d2 = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    want = {}
    for i, r in enumerate(row):
        found = sorted((d2[i, j], o) for j, o in enumerate(other) if o != r)[:k]
        want[r] = [(o, d) for d, o in found]
    return want, np.sqrt(d2).sum()


@pytest.mark.parametrize("case", ["spread", "ties", "equal", "few", "apart"])
def test_tile_neighbours_equal_brute_force(case):
    from txnwatch.operators import balance as BA
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=(300, 13)) * 100, "ties": rng.integers(0, 3, (300, 4)).astype(float), "equal": np.full((90, 5), 7.25),
         "few": rng.normal(size=(3, 2)), "apart": np.where(rng.random((300, 6)) < 0.3, -999.0, rng.integers(0, 2, (300, 6)) * 0.01)}[case]
    rows = np.arange(len(x)) + 40
    half = len(x) // 2
    for a, b in ((slice(None), slice(None)), (slice(0, half), slice(half, None)), (slice(half, None), slice(0, half))):
        own, other, d2, total = BA._nearest_in_tile(x[a], rows[a], x[b], rows[b], 5, True)
        got = {}
        for r, o, d in zip(*(np.concatenate(v) for v in (own, other, d2))):
            got.setdefault(r, []).append((o, d))
        want, far = _brute(x[a], rows[a], x[b], rows[b], 5)
        assert got == {r: v for r, v in want.items() if v}
        assert total == pytest.approx(far, rel=1e-9, abs=1e-12)
    if case == "equal":
        assert total == 0


def test_tiles_are_faster_than_pairwise_differences():
    import time

    from txnwatch.operators import balance as BA
    x = np.random.default_rng(1).normal(size=(1500, 13))
    rows = np.arange(len(x))
    t0 = time.perf_counter()
    BA._nearest_in_tile(x, rows, x, rows, 5, True)
    mine = time.perf_counter() - t0
    t0 = time.perf_counter()
    for s in range(0, len(x), 32):  # as it was done before
        d2 = ((x[s:s + 32][:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        np.sqrt(d2).sum()
        np.argsort(d2, axis=1, kind="stable")
    assert mine < (time.perf_counter() - t0) / 2


class _Handle:
    """State of one key in memory, counting the calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def _state(self):
        outer = self

        class State:
            def __init__(self):
                self.d = {}

            def __getattribute__(self, name):
                if name in ("getValue", "updateValue", "removeKey", "keys", "iterator", "clear", "exists", "get", "update"):
                    outer.calls += 1
                return object.__getattribute__(self, name)

            def getValue(self, k):
                return self.d.get(k)

            def updateValue(self, k, v):
                self.d[k] = v

            def removeKey(self, k):
                del self.d[k]

            def keys(self):
                return iter(list(self.d))

            def iterator(self):
                return iter(list(self.d.items()))

            def clear(self):
                self.d = {}

            def exists(self):
                return bool(self.d)

            def get(self):
                return self.d.get("v")

            def update(self, v):
                self.d["v"] = v
        return State()

    def getMapState(self, *_):
        return self._state()

    def getValueState(self, *_):
        return self._state()

    def registerTimer(self, at):
        self.timers.append(at)


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_released_buckets_come_in_order_whatever_shares_a_frame(monkeypatch, most):
    import pandas as pd

    from txnwatch.streaming import features as SF
    monkeypatch.setattr(SF, "RELEASE_ROWS", most)
    rng = np.random.default_rng(5)
    day = rng.integers(0, 20, 90)
    pdf = pd.DataFrame({"ms": day * 86_400_000 + 5, "TransactionDT": day * 86400, "TransactionID": np.arange(90), "TransactionAmt": rng.random(90)})

    def features(parts, marks):
        h, card = _Handle(), SF.CardState()
        card.init(h)
        out = []
        for part, mark in zip(parts, marks):
            card.handleInputRows(("7",), iter([part] if len(part) else []), None)
            out += list(card.handleExpiredTimer(("7",), type("T", (), {"getCurrentWatermarkInMs": lambda self, m=mark: m})(), None))
        return h, pd.concat(out).reset_index(drop=True)

    h, got = features([pdf[:50], pdf[50:], pdf[:0]], [0, 10 * 86_400_000, 10**15])
    want = SF._vectorized_batch(("7",), pdf.sort_values(["TransactionDT", "TransactionID"]), (0, 0, 0.0, 0.0, []))[0]
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True), rtol=1e-9, atol=1e-9)
    if most > 90:
        once, _ = features([pdf], [10**15])
        assert once.calls < 40  # 4 calls a bucket before: held, written, read again, removed


def test_groups_of_several_blocks_grow_in_tasks_of_their_own(spark, monkeypatch):
    from txnwatch.operators import boosting as B
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    monkeypatch.setattr(B, "_SharedRows", None)  # no step of its own job
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2)).round(2)  # few equal gains, which rounding would decide
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 1, 400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "x0 double, x1 double, isFraud int")
    p = B.Boosting(12, 0.3, 3, "leaf", 5, least_rows=5, rows=0.8, patience=3)
    (alone,) = B.fit_boosters({0: (df.filter("x1 < 1"), df.filter("x1 >= 1"), ["x0", "x1"])}, [(0, p, 1)])
    monkeypatch.undo()
    (shared,) = B.fit_boosters({0: (df.filter("x1 < 1"), df.filter("x1 >= 1"), ["x0", "x1"])}, [(0, p, 1)], block_rows=64)
    assert len(alone.value) == len(shared.value) > 0 and np.allclose(alone.losses, shared.losses)

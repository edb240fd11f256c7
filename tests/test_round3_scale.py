"""Findings of the third round on bytes moved: entity scans without needless chunks."""

from txnwatch.operators import features as FE
from txnwatch.operators import scan as SC


def _log(spark, hot):
    """300 rows of 30 cards and, in ``hot`` logs, 120 more of a null card."""
    rows = [(i, (i * 7919) % 1000, i % 30, float(i % 11)) for i in range(300)]
    rows += [(1000 + i, (i * 7907) % 1000, None, float(i % 5)) for i in range(120 if hot else 0)]
    return spark.createDataFrame(rows, "TransactionID long, TransactionDT long, card1 long, TransactionAmt double")


def test_entities_are_cut_only_where_one_is_too_long(spark, monkeypatch):
    monkeypatch.setattr(SC, "DEFAULT_ROWS_PER_BUCKET", 100)
    df, chunk, own = SC.split_entities(_log(spark, hot=False), "card1", FE.ORDER)
    assert chunk is None and not own and "_entity_chunk" not in df.columns  # 300 rows, but 10 a card
    df, chunk, own = SC.split_entities(_log(spark, hot=True), "card1", FE.ORDER)  # a null card is an entity too
    assert chunk == "_entity_chunk" and own == [chunk] and df.select(chunk).distinct().count() > 1


def test_velocity_shuffles_once_and_stays_the_same(spark, monkeypatch):
    def plain(df):
        return {r.TransactionID: [None if v is None else round(v, 6) for v in r[4:]] for r in df.collect()}

    for hot in (False, True):
        log = _log(spark, hot)
        want = plain(FE.engineer_velocity(log, chunk_col=None))
        monkeypatch.setattr(SC, "DEFAULT_ROWS_PER_BUCKET", 100)
        out = FE.engineer_velocity(log)
        assert plain(out) == want
        if not hot:
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Join") == 0 and "Generate" not in plan  # chunks take both, and two more shuffles
        monkeypatch.undo()

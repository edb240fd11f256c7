"""Independent DuckDB twins of the registered queries.

Plain SQL over the raw tables (``events``, ``orders``, ...): the transaction
view is re-derived here with DuckDB functions, and every window is written as
a direct SQL window, so these strings share no code with the Spark side.
Doubles are reported as ``round(x + 1e-9, 6) + 0.0`` (the Spark side uses the
same report rounding).
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def R(x: str) -> str:
    """Report rounding of a double expression."""
    return f"(round(({x}) + 1e-9, 6) + 0.0)"


TXN = r"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INTEGER) AS k,
         CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS dt
  FROM events
),
txn AS (
  SELECT event_id AS TransactionID, dt AS TransactionDT, value AS TransactionAmt,
         user_id AS card1,
         CAST(CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 7 END AS INTEGER) AS addr1,
         event_type AS card4,
         CASE WHEN k % 10 = 0 THEN NULL
              ELSE CAST(floor(dt / 86400e0) AS DOUBLE) - user_id % 5 END AS D1,
         CAST(CASE WHEN k % 15 = 0 THEN NULL ELSE k % 15 END AS DOUBLE) AS D15,
         CAST(k % 5 AS DOUBLE) AS C1,
         CAST(k % 13 AS DOUBLE) AS C13,
         CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE k % 7 END AS DOUBLE) AS C14,
         CASE WHEN k % 3 = 0 THEN 'T' WHEN k % 3 = 1 THEN 'F' END AS M4,
         CASE WHEN k % 4 = 0 THEN 'T' WHEN k % 4 = 1 THEN 'F' END AS M9,
         CASE WHEN event_type = 'error' AND value > 75 THEN 1 ELSE 0 END AS isFraud,
         round(0.6::DOUBLE * CASE WHEN event_type = 'error' THEN least(value / 150e0, 1e0) ELSE 0e0 END
               + 0.4::DOUBLE * k / 100e0, 3) AS fraud_score,
         round(0.5::DOUBLE * CASE WHEN event_type = 'error' THEN least(value / 157e0, 1e0) ELSE 0e0 END
               + 0.4::DOUBLE * ((k * 37 + user_id) % 100) / 100e0, 3) AS score_b,
         value * 1 + k % 3 AS V1, value * 2 + k % 4 AS V2, value * 3 + k % 5 AS V3, value * 4 + k % 6 AS V4,
         CASE WHEN k % 4 = 0 THEN NULL ELSE value END * 5 + k % 7 AS V5,
         CASE WHEN k % 4 = 0 THEN NULL ELSE value END * 6 + k % 8 AS V6,
         CASE WHEN k % 4 = 0 THEN NULL ELSE value END * 7 + k % 9 AS V7,
         CASE WHEN k % 4 = 0 THEN NULL ELSE value END * 8 + k % 10 AS V8,
         CASE WHEN k % 4 <> 0 THEN NULL ELSE value END * 9 + k % 11 AS V9,
         CASE WHEN k % 4 <> 0 THEN NULL ELSE value END * 10 + k % 12 AS V10,
         CASE WHEN k % 4 <> 0 THEN NULL ELSE value END * 11 + k % 13 AS V11,
         CASE WHEN k % 4 <> 0 THEN NULL ELSE value END * 12 + k % 14 AS V12
  FROM ev
),
feat AS (
  SELECT t.*,
         CAST((TransactionDT % 86400) // 3600 AS INTEGER) AS hour,
         CAST((TransactionDT // 86400) % 7 AS INTEGER) AS day_of_week,
         CAST(trunc(coalesce(round_even(TransactionDT / 86400e0, 0) - D1, -999)) AS INTEGER) AS D1n
  FROM txn t
),
feat2 AS (
  SELECT f.*,
         CASE WHEN hour >= 22 OR hour <= 5 THEN 1 ELSE 0 END AS is_night,
         CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
         CAST(card1 AS VARCHAR) || '_' || CAST(coalesce(CAST(trunc(addr1) AS INTEGER), -1) AS VARCHAR)
           || '_' || CAST(D1n AS VARCHAR) AS UID
  FROM feat f
)"""

# UID expanding frame and card frames (ROWS, ordered by time then id)
WUID = ("PARTITION BY UID ORDER BY TransactionDT, TransactionID "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
WUID_ORD = "PARTITION BY UID ORDER BY TransactionDT, TransactionID"
WCARD_ORD = "PARTITION BY card1 ORDER BY TransactionDT, TransactionID"


def wcard(k: int) -> str:
    return f"{WCARD_ORD} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"


def with_txn(body: str) -> str:
    return f"WITH {TXN}\n{body}"


def mflag(c: str) -> str:
    return f"(CASE WHEN {c} = 'T' THEN 1e0 WHEN {c} = 'F' THEN 0e0 ELSE -1e0 END)"


UIDAGG = f"""
uidagg AS (
  SELECT f.*,
    coalesce(avg(TransactionAmt) OVER ({WUID}), 0) AS UID_amt_mean,
    coalesce(stddev_samp(TransactionAmt) OVER ({WUID}), 0) AS UID_amt_std,
    CAST(row_number() OVER ({WUID_ORD}) AS INTEGER) AS UID_txn_count,
    coalesce(avg(C1) OVER ({WUID}), 0) AS C1_uid_mean, coalesce(stddev_samp(C1) OVER ({WUID}), 0) AS C1_uid_std,
    coalesce(avg(C13) OVER ({WUID}), 0) AS C13_uid_mean, coalesce(stddev_samp(C13) OVER ({WUID}), 0) AS C13_uid_std,
    coalesce(avg(C14) OVER ({WUID}), 0) AS C14_uid_mean, coalesce(stddev_samp(C14) OVER ({WUID}), 0) AS C14_uid_std,
    coalesce(avg({mflag('M4')}) OVER ({WUID}), 0) AS M4_uid_mean,
    coalesce(avg({mflag('M9')}) OVER ({WUID}), 0) AS M9_uid_mean,
    {mflag('M4')} AS M4f,
    coalesce(avg(D1) OVER ({WUID}), 0) AS D1_uid_mean, coalesce(stddev_samp(D1) OVER ({WUID}), 0) AS D1_uid_std,
    coalesce(D1 - lag(D1) OVER ({WUID_ORD}), 0) AS D1_uid_diff,
    coalesce(CASE WHEN lag(D1) OVER ({WUID_ORD}) = 0 THEN NULL
                  ELSE D1 / lag(D1) OVER ({WUID_ORD}) - 1 END, 0) AS D1_uid_pct,
    coalesce(avg(D15) OVER ({WUID}), 0) AS D15_uid_mean, coalesce(stddev_samp(D15) OVER ({WUID}), 0) AS D15_uid_std,
    coalesce(D15 - lag(D15) OVER ({WUID_ORD}), 0) AS D15_uid_diff,
    coalesce(CASE WHEN lag(D15) OVER ({WUID_ORD}) = 0 THEN NULL
                  ELSE D15 / lag(D15) OVER ({WUID_ORD}) - 1 END, 0) AS D15_uid_pct
  FROM feat2 f
)"""

VELO = f"""
velo AS (
  SELECT f.*,
    avg(TransactionAmt) OVER ({wcard(7)}) AS Card_Velocity_7d,
    avg(TransactionAmt) OVER ({wcard(14)}) AS Card_Velocity_14d,
    avg(TransactionAmt) OVER ({wcard(30)}) AS Card_Velocity_30d,
    coalesce(stddev_samp(TransactionAmt) OVER ({wcard(7)}), 0) AS Card_Amt_Std_7d,
    coalesce(stddev_samp(TransactionAmt) OVER ({wcard(14)}), 0) AS Card_Amt_Std_14d,
    coalesce(stddev_samp(TransactionAmt) OVER ({wcard(30)}), 0) AS Card_Amt_Std_30d,
    CAST(count(TransactionAmt) OVER ({wcard(10)}) AS DOUBLE) AS Card_Spending_Velocity,
    CAST(row_number() OVER ({WCARD_ORD}) AS BIGINT) AS Card_Tx_Count,
    CAST(row_number() OVER ({WCARD_ORD}) - 1 AS BIGINT) AS Card_Prior_Txn_Count
  FROM feat2 f
)"""


def q(name: str, body: str, extra_ctes: str = "") -> None:
    ctes = TXN + ("," + extra_ctes if extra_ctes else "")
    ORACLES[name] = f"WITH {ctes}\n{body}"


# --- projections -------------------------------------------------------------------
q("prj3", "SELECT TransactionID, hour, day_of_week, is_night, is_weekend FROM feat2")
q("prj4", "SELECT TransactionID, D1n FROM feat2")
q("prj5", "SELECT TransactionID, UID FROM feat2")
q("prj6", f"""SELECT CAST(count(DISTINCT UID) AS BIGINT) AS n_uid, CAST(count(*) AS BIGINT) AS n_rows,
              {R('count(DISTINCT UID) / count(*)')} AS granularity FROM feat2""")
q("prj7", f"SELECT TransactionID, {mflag('M4')} AS M4_flag, {mflag('M9')} AS M9_flag FROM txn")
q("prj8", f"""SELECT TransactionID, {R('TransactionAmt * hour')} AS Amt_x_Hour,
              {R('TransactionAmt * is_weekend')} AS Amt_x_isWeekend,
              {R('TransactionAmt * is_night')} AS Amt_x_isNight FROM feat2""")
q("prj9", """SELECT TransactionID, UID_txn_count,
             CASE WHEN UID_txn_count < 2 THEN 1 ELSE 0 END AS is_new_client FROM uidagg""", UIDAGG)

# --- UID windows -------------------------------------------------------------------
q("win1", f"SELECT TransactionID, UID, {R('UID_amt_mean')} AS UID_amt_mean, {R('UID_amt_std')} AS UID_amt_std "
          "FROM uidagg", UIDAGG)
q("win2", f"""SELECT TransactionID, {R('UID_amt_mean')} AS UID_amt_mean, {R('UID_amt_std')} AS UID_amt_std,
              UID_txn_count, {R('(TransactionAmt - UID_amt_mean) / (UID_amt_std + 1e-6)')} AS UID_amt_zscore
              FROM uidagg""", UIDAGG)
q("win3", "SELECT TransactionID, " + ", ".join(
    f"{R(f'{c}_uid_{s}')} AS {c}_uid_{s}" for c in ("C1", "C13", "C14") for s in ("mean", "std"))
  + " FROM uidagg", UIDAGG)
q("win4", f"SELECT TransactionID, {R('M4f')} AS M4, {R('M4_uid_mean')} AS M4_uid_mean, "
          f"{R('M9_uid_mean')} AS M9_uid_mean FROM uidagg", UIDAGG)
q("win5", "SELECT TransactionID, " + ", ".join(
    f"{R(f'{d}_uid_{s}')} AS {d}_uid_{s}" for d in ("D1", "D15") for s in ("mean", "std", "diff", "pct"))
  + " FROM uidagg", UIDAGG)

# --- card windows --------------------------------------------------------------------
q("win6", "SELECT TransactionID, " + ", ".join(
    f"{R(f'Card_{p}_{lab}')} AS Card_{p}_{lab}" for p in ("Velocity", "Amt_Std") for lab in ("7d", "14d", "30d"))
  + " FROM velo", VELO)
q("win7", f"SELECT TransactionID, {R('Card_Spending_Velocity')} AS Card_Spending_Velocity FROM velo", VELO)
q("win8", "SELECT TransactionID, Card_Prior_Txn_Count, Card_Tx_Count FROM velo", VELO)
q("win9", f"""SELECT TransactionID,
              {R('(TransactionAmt - Card_Velocity_7d) / (Card_Amt_Std_7d + 1)')} AS Amt_Deviation,
              {R('TransactionAmt / (Card_Velocity_30d + 1)')} AS Amt_to_Mean_Ratio FROM velo""", VELO)
q("win10", """SELECT CAST(count(*) FILTER (WHERE Card_Prior_Txn_Count < 3) AS BIGINT) AS n_cold_start,
              CAST(count(*) AS BIGINT) AS n_rows FROM velo""", VELO)

# --- routing ---------------------------------------------------------------------------
BASE_DECISION = ("CASE WHEN fraud_score >= 0.6 THEN 'AUTO_BLOCK' "
                 "WHEN fraud_score >= 0.35 THEN 'HITL_REVIEW' ELSE 'ALLOW' END")
q("rte1", f"SELECT TransactionID, {BASE_DECISION} AS decision FROM txn")
q("rte2", f"""SELECT TransactionID,
   CASE WHEN TransactionAmt > (SELECT quantile_cont(TransactionAmt, 0.95) FROM txn)
             AND fraud_score >= 0.2 AND {BASE_DECISION} = 'ALLOW' THEN 'HITL_REVIEW'
        ELSE {BASE_DECISION} END AS decision FROM txn""")
q("rte3", f"""SELECT TransactionID,
   CASE WHEN Card_Prior_Txn_Count < 3 AND {BASE_DECISION} = 'ALLOW' AND fraud_score >= 0.2 THEN 'HITL_REVIEW'
        ELSE {BASE_DECISION} END AS decision FROM velo""", VELO)
q("rte4", f"""SELECT TransactionID,
   CASE WHEN UID_txn_count < 2 AND {BASE_DECISION} = 'ALLOW' AND fraud_score >= 0.2 THEN 'HITL_REVIEW'
        ELSE {BASE_DECISION} END AS decision FROM uidagg""", UIDAGG)
_ROUTED = f"""SELECT TransactionID, CASE WHEN v.Card_Prior_Txn_Count < 3 AND dec0 = 'ALLOW' AND v.fraud_score >= 0.2 THEN 'HITL_REVIEW'
                 WHEN u.UID_txn_count < 2 AND dec0 = 'ALLOW' AND v.fraud_score >= 0.2 THEN 'HITL_REVIEW'
                 ELSE dec0 END AS decision
     FROM (SELECT v.*, CASE WHEN TransactionAmt > (SELECT quantile_cont(TransactionAmt, 0.95) FROM txn)
                              AND fraud_score >= 0.35 AND {BASE_DECISION} = 'ALLOW' THEN 'HITL_REVIEW'
                         ELSE {BASE_DECISION} END AS dec0 FROM velo v) v
     JOIN uidagg u USING (TransactionID)"""
q("rte5", f"""SELECT decision, CAST(count(*) AS BIGINT) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS rate
   FROM ({_ROUTED}) GROUP BY decision""", VELO + "," + UIDAGG)
q("str3", _ROUTED, VELO + "," + UIDAGG)
q("agg5", f"""SELECT decision, CAST(count(*) AS BIGINT) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS rate
   FROM (SELECT {BASE_DECISION} AS decision FROM txn) GROUP BY decision""")


# ============================ positions, splits ======================================
POS = """
pos AS (SELECT t.*, CAST(row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS BIGINT) AS pos FROM txn t),
prm AS (SELECT count(*) AS n, count(*) // 6 AS fs,
               100 AS gap FROM txn),
hb AS (SELECT n, gap, CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT) AS train_end,
              CASE WHEN CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT) + gap >= n
                   THEN CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT)
                   ELSE CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT) + gap END AS test_start FROM prm)"""

q("spl0", "SELECT TransactionID, pos FROM pos", POS)
q("srt1", "SELECT TransactionID, TransactionDT, pos FROM pos ORDER BY pos", POS)
q("spl1", """SELECT p.TransactionID, f.fold, CASE WHEN p.pos < f.train_end THEN 'train' ELSE 'val' END AS role
  FROM pos p JOIN (
    SELECT CAST(i AS INTEGER) AS fold, fs * (i + 1) AS train_end, fs * (i + 1) + gap AS val_start,
           least(fs * (i + 1) + gap + fs, n) AS val_end
    FROM prm, range(5) r(i) WHERE fs * (i + 1) + gap < n) f
  ON p.pos < f.train_end OR (p.pos >= f.val_start AND p.pos < f.val_end)""", POS)
q("spl2", """SELECT TransactionID, CASE WHEN pos < train_end THEN 'train' WHEN pos >= test_start THEN 'test'
              ELSE 'gap' END AS role FROM pos, hb""", POS)
q("spl3", """SELECT TransactionID,
    CASE WHEN pos < ie_end THEN 'fit' WHEN pos >= ie_start THEN 'internal_val' ELSE 'gap' END AS inner_role
  FROM pos, (SELECT train_end AS m,
                    CAST(floor(train_end * (1 - 0.10::DOUBLE)) AS BIGINT) AS ie_end,
                    CASE WHEN CAST(floor(train_end * (1 - 0.10::DOUBLE)) AS BIGINT) + gap >= train_end
                         THEN CAST(floor(train_end * (1 - 0.10::DOUBLE)) AS BIGINT)
                         ELSE CAST(floor(train_end * (1 - 0.10::DOUBLE)) AS BIGINT) + gap END AS ie_start
             FROM hb) ie
  WHERE pos < m""", POS)
q("set1", """SELECT TransactionID, 0 AS part, CAST(NULL AS VARCHAR) AS card4 FROM pos, prm WHERE pos < n // 2
  UNION ALL SELECT TransactionID, 1 AS part, card4 FROM pos, prm WHERE pos >= n // 2""", POS)
q("set3", """SELECT TransactionID, fraud_score, 'train' AS src FROM pos, hb WHERE pos < train_end
  UNION ALL SELECT TransactionID, fraud_score, 'observed' AS src FROM pos, hb WHERE pos >= test_start""", POS)

# ============================ encoders / canonicalisation / joins ==========================
PRAW = """
ns AS (SELECT count(*) AS n_supp FROM supplier),
praw AS (
  SELECT o.o_orderkey AS TransactionID,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) * 24 AS INTEGER) AS step,
         o.o_orderstatus AS type, o.o_totalprice AS amount,
         'C' || CAST(o.o_custkey AS VARCHAR) AS nameOrig,
         'M' || CAST(o.o_orderkey % ns.n_supp AS VARCHAR) AS nameDest,
         c.c_acctbal AS oldbalanceOrg, greatest(c.c_acctbal - o.o_totalprice, 0e0) AS newbalanceOrig,
         s.s_acctbal AS oldbalanceDest, s.s_acctbal + o.o_totalprice AS newbalanceDest,
         CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 400000 THEN 1 ELSE 0 END AS isFraud
  FROM orders o CROSS JOIN ns
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON s.s_suppkey = o.o_orderkey % ns.n_supp),
oc AS (SELECT nameOrig, CAST(row_number() OVER (ORDER BY min(TransactionID)) - 1 AS BIGINT) AS orig_code
       FROM praw GROUP BY nameOrig),
dc AS (SELECT nameDest, CAST(row_number() OVER (ORDER BY min(TransactionID)) - 1 AS BIGINT) AS dest_code
       FROM praw GROUP BY nameDest)"""

q("enc1", """SELECT p.TransactionID, coalesce(oc.orig_code, -1) AS orig_code, coalesce(dc.dest_code, -1) AS dest_code
  FROM praw p LEFT JOIN oc USING (nameOrig) LEFT JOIN dc USING (nameDest)""", PRAW)
q("enc2", "SELECT p.TransactionID, coalesce(oc.orig_code, -1) AS orig_code FROM praw p LEFT JOIN oc USING (nameOrig)",
  PRAW)
q("prj1", f"""SELECT p.TransactionID, CAST(step AS BIGINT) * 3600 AS TransactionDT, {R('amount')} AS TransactionAmt,
    coalesce(oc.orig_code, -1) AS card1, coalesce(dc.dest_code, -1) AS addr1, type AS card4, 0e0 AS D1,
    isFraud, {R('oldbalanceOrg - newbalanceOrig')} AS origin_delta,
    {R('newbalanceDest - oldbalanceDest')} AS dest_delta, {R('oldbalanceOrg - oldbalanceDest')} AS balance_gap,
    CAST(floor(step / 24) AS INTEGER) AS StepBlock
  FROM praw p LEFT JOIN oc USING (nameOrig) LEFT JOIN dc USING (nameDest)""", PRAW)


def _fit_codes(col: str, keep_null_as_missing: bool = True) -> str:
    v = f"coalesce({col}, '__MISSING__')" if keep_null_as_missing else col
    where = "" if keep_null_as_missing else f" AND {col} IS NOT NULL"
    return (f"c_{col} AS (SELECT v, CAST(row_number() OVER (ORDER BY mp) - 1 AS BIGINT) AS code FROM ("
            f"SELECT {v} AS v, min(pos) AS mp FROM pos, hb WHERE pos < train_end{where} GROUP BY 1))")


q("enc3", """SELECT p.TransactionID, coalesce(a.code, -1) AS card4, coalesce(b.code, -1) AS M4,
                    coalesce(c.code, -1) AS M9
  FROM pos p
  LEFT JOIN c_card4 a ON coalesce(p.card4, '__MISSING__') = a.v
  LEFT JOIN c_M4 b ON coalesce(p.M4, '__MISSING__') = b.v
  LEFT JOIN c_M9 c ON coalesce(p.M9, '__MISSING__') = c.v""",
  POS + "," + ",".join(_fit_codes(c) for c in ("card4", "M4", "M9")))
q("enc4", "SELECT TransactionID, " + ", ".join(
    f"{R(f'({c} - mu_{c}) / CASE WHEN coalesce(sd_{c}, 0) = 0 THEN 1 ELSE sd_{c} END')} AS {c}"
    for c in ("TransactionAmt", "C1", "D1")) + """ FROM pos, (
      SELECT avg(TransactionAmt) AS mu_TransactionAmt, stddev_pop(TransactionAmt) AS sd_TransactionAmt,
             avg(C1) AS mu_C1, stddev_pop(C1) AS sd_C1, avg(D1) AS mu_D1, stddev_pop(D1) AS sd_D1
      FROM pos, hb WHERE pos < train_end) s""", POS)
q("jn1", """SELECT e.event_id AS TransactionID,
    CASE WHEN e.event_id % 4 = 0 THEN (CASE WHEN e.k % 2 = 0 THEN 'mobile' ELSE 'desktop' END) END AS DeviceType
  FROM ev e""")
q("jn2", "SELECT p.TransactionID, coalesce(c.code, -1) AS M9_code FROM pos p LEFT JOIN c_M9 c ON p.M9 = c.v",
  POS + "," + _fit_codes("M9", keep_null_as_missing=False))
q("jn3", f"""SELECT TransactionID, {R('avg(TransactionAmt) OVER (PARTITION BY card1)')} AS card_mean_amt,
              CAST(count(*) OVER (PARTITION BY card1) AS BIGINT) AS card_n FROM txn""")
q("jn4", """SELECT TransactionID, UID, isFraud, fraud_score AS model_a, score_b AS model_b FROM feat2""")
q("jn5", f"""SELECT TransactionID, {R('p95')} AS amt_p95, CASE WHEN TransactionAmt > p95 THEN 1 ELSE 0 END AS above_p95
  FROM txn, (SELECT quantile_cont(TransactionAmt, 0.95) AS p95 FROM txn)""")

# ============================ sorts / top-k ==============================================
q("srt2", "SELECT TransactionID, fraud_score FROM pos ORDER BY fraud_score DESC, pos LIMIT 1", POS)
q("srt3", "SELECT TransactionID, fraud_score FROM pos ORDER BY fraud_score DESC, pos LIMIT 10", POS)
_TOPK = ", ".join(f"({p}::DOUBLE)" for p in (0.001, 0.005, 0.01, 0.02, 0.05, 0.10))
q("srt6", f"""SELECT {R('p * 100')} AS top_percent, n_top AS n_reviewed,
    CAST(coalesce((SELECT sum(isFraud) FROM rk WHERE rk.r < n_top), 0) AS BIGINT) AS fraud_captured,
    {R('coalesce((SELECT sum(isFraud) FROM rk WHERE rk.r < n_top), 0) / n_top')} AS precision,
    {R('coalesce((SELECT sum(isFraud) FROM rk WHERE rk.r < n_top), 0) / greatest(Fr, 1)')} AS recall,
    {R('CASE WHEN Fr > 0 THEN (coalesce((SELECT sum(isFraud) FROM rk WHERE rk.r < n_top), 0) / n_top) / (Fr / N) END')}
      AS lift
  FROM (SELECT p, CAST(greatest(1, ceil(N * p)) AS BIGINT) AS n_top, N, Fr
        FROM (VALUES {_TOPK}) v(p), (SELECT count(*) AS N, sum(isFraud) AS Fr FROM txn))""",
  "rk AS (SELECT isFraud, row_number() OVER (ORDER BY fraud_score DESC, TransactionID) - 1 AS r FROM txn)")

# ============================ aggregates ====================================================
_TXN_COLS = (["TransactionID", "TransactionDT", "TransactionAmt", "card1", "addr1", "card4", "D1", "D15", "C1",
              "C13", "C14", "M4", "M9", "isFraud", "fraud_score", "score_b"] + [f"V{i}" for i in range(1, 13)])
q("agg1", "SELECT " + ", ".join(f"{R(f'avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END)')} AS {c}"
                                for c in _TXN_COLS) + " FROM txn")
q("agg2", "SELECT " + ", ".join(
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS nunique_{c}"
    for c in ("UID", "D1", "addr1", "M4")) + " FROM feat2")
q("agg3", f"""SELECT isFraud, CAST(count(*) AS BIGINT) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS rate
              FROM txn GROUP BY isFraud""")
_AGG4 = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)] + [(f"d{i}", i / 10) for i in range(1, 10)]
q("agg4", "SELECT " + ", ".join(f"{R(f'quantile_cont(TransactionAmt, {p})')} AS {n}" for n, p in _AGG4)
  + " FROM txn")
q("agg6", f"""SELECT score_decile, CAST(count(*) AS BIGINT) AS n, CAST(sum(isFraud) AS BIGINT) AS fraud_n,
    {R('avg(isFraud)')} AS fraud_rate, {R('avg(fraud_score)')} AS mean_score,
    {R('min(fraud_score)')} AS min_score, {R('max(fraud_score)')} AS max_score
  FROM (SELECT isFraud, fraud_score,
               CAST(greatest(0, (r0 * 10 + (n - 1) - 1) // (n - 1) - 1) AS INTEGER) AS score_decile
        FROM (SELECT isFraud, fraud_score, row_number() OVER (ORDER BY fraud_score, TransactionID) - 1 AS r0,
                     count(*) OVER () AS n FROM txn))
  GROUP BY score_decile""")


def _edges_sql(n_bins: int = 10) -> list[str]:
    step = 1.0 / n_bins
    return [f"({repr(i * step)})::DOUBLE" for i in range(n_bins)] + ["1.0::DOUBLE"]


def _bin_expr(s: str, closed_last: bool) -> str:
    e = _edges_sql()
    cnt = " + ".join(f"CASE WHEN {s} >= {e[i]} THEN 1 ELSE 0 END" for i in range(10)) + " - 1"
    if closed_last:
        return f"CASE WHEN {s} >= 0 AND {s} <= 1.0 THEN least({cnt}, 9) END"
    return f"CASE WHEN {s} >= 0 AND {s} < 1.0 THEN {cnt} END"


DAYCURVE = f"""
dd AS (SELECT *, CAST(floor(TransactionDT / 86400) AS INTEGER) AS day FROM txn),
pts AS (SELECT day, fraud_score AS s, sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM dd GROUP BY day, fraud_score),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY day ORDER BY s DESC) AS tp,
               sum(neg) OVER (PARTITION BY day ORDER BY s DESC) AS fp,
               sum(pos) OVER (PARTITION BY day) AS P, sum(neg) OVER (PARTITION BY day) AS N FROM pts),
dm AS (SELECT day, sum(neg * (2 * tp - pos)) / nullif(2.0 * max(P) * max(N), 0) AS roc_auc,
              sum(pos * tp / (tp + fp)) / nullif(max(P), 0) AS pr_auc FROM cum GROUP BY day),
db AS (SELECT day, avg((fraud_score - isFraud) ^ 2) AS brier, count(*) AS nday FROM dd GROUP BY day),
de AS (SELECT day, sum(n / nday * abs(conf - acc)) AS ece_10bin FROM (
         SELECT day, b, count(*) AS n, avg(fraud_score) AS conf, avg(isFraud) AS acc
         FROM (SELECT day, fraud_score, isFraud, {_bin_expr('fraud_score', True)} AS b FROM dd) WHERE b IS NOT NULL
         GROUP BY day, b) JOIN db USING (day) GROUP BY day),
runs AS (SELECT 'roc_auc' AS metric, roc_auc AS value FROM dm UNION ALL SELECT 'pr_auc', pr_auc FROM dm
         UNION ALL SELECT 'brier', brier FROM db UNION ALL SELECT 'ece_10bin', ece_10bin FROM de)"""
q("agg7", f"""SELECT metric, CAST(count(value) AS BIGINT) AS n_runs, {R('avg(value)')} AS mean,
    {R('CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0 END')} AS std,
    {R('min(value)')} AS min, {R('max(value)')} AS max,
    {R('avg(value) - CASE WHEN count(value) > 1 THEN (CASE WHEN count(value) = 3 THEN 4.303 ELSE 1.96 END) * stddev_samp(value) / sqrt(count(value)) ELSE 0 END')} AS ci95_low,
    {R('avg(value) + CASE WHEN count(value) > 1 THEN (CASE WHEN count(value) = 3 THEN 4.303 ELSE 1.96 END) * stddev_samp(value) / sqrt(count(value)) ELSE 0 END')} AS ci95_high
  FROM runs GROUP BY metric""", DAYCURVE)

# ============================ evaluation ======================================================
CURVE = """
pts AS (SELECT fraud_score AS threshold, CAST(sum(isFraud) AS BIGINT) AS pos,
               CAST(count(*) - sum(isFraud) AS BIGINT) AS neg FROM txn GROUP BY fraud_score),
cum AS (SELECT *, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp,
               CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM pts),
pr AS (SELECT *, tp / (tp + fp) AS precision, tp / P AS recall FROM cum)"""
q("evl0", f"SELECT {R('threshold')} AS threshold, pos, neg, tp, fp FROM cum", CURVE)
q("evl1", f"SELECT {R('sum(neg * (2 * tp - pos)) / nullif(2.0 * max(P) * max(N), 0)')} AS roc_auc FROM cum", CURVE)
q("evl2", f"SELECT {R('sum(pos * tp / (tp + fp)) / max(P)')} AS pr_auc FROM cum", CURVE)
q("evl4", f"""SELECT {R('threshold')} AS threshold, {R('f1')} AS f1, {R('precision')} AS precision,
    {R('recall')} AS recall FROM (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr)
  ORDER BY f1 DESC, threshold ASC LIMIT 1""", CURVE)
q("evl4b", f"""SELECT {R('threshold')} AS threshold, {R('precision')} AS precision, {R('recall')} AS recall,
    {R('f1')} AS f1 FROM (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM pr)
  ORDER BY f1 DESC, threshold ASC LIMIT 1""", CURVE)
CM = """cm AS (SELECT count(*) FILTER (WHERE fraud_score < 0.5 AND isFraud = 0) AS tn,
                  count(*) FILTER (WHERE fraud_score >= 0.5 AND isFraud = 0) AS fp,
                  count(*) FILTER (WHERE fraud_score < 0.5 AND isFraud = 1) AS fn,
                  count(*) FILTER (WHERE fraud_score >= 0.5 AND isFraud = 1) AS tp FROM txn)"""


def _p(tp, fp):
    return f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END"


def _f1(tp, fp, fn):
    return f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END"


q("evl3", f"""SELECT '0' AS label, {R(_p('tn', 'fn'))} AS precision, {R(_p('tn', 'fp'))} AS recall,
    {R(_f1('tn', 'fn', 'fp'))} AS f1, tn + fp AS support FROM cm
  UNION ALL SELECT '1', {R(_p('tp', 'fp'))}, {R(_p('tp', 'fn'))}, {R(_f1('tp', 'fp', 'fn'))}, tp + fn FROM cm
  UNION ALL SELECT 'accuracy', NULL, NULL, {R('(tp + tn) / (tp + tn + fp + fn)')}, tp + tn + fp + fn FROM cm
  UNION ALL SELECT 'macro avg', {R(f"({_p('tn', 'fn')} + {_p('tp', 'fp')}) / 2")},
    {R(f"({_p('tn', 'fp')} + {_p('tp', 'fn')}) / 2")}, {R(f"({_f1('tn', 'fn', 'fp')} + {_f1('tp', 'fp', 'fn')}) / 2")},
    tp + tn + fp + fn FROM cm
  UNION ALL SELECT 'weighted avg',
    {R(f"(({_p('tn', 'fn')}) * (tn + fp) + ({_p('tp', 'fp')}) * (tp + fn)) / (tp + tn + fp + fn)")},
    {R(f"(({_p('tn', 'fp')}) * (tn + fp) + ({_p('tp', 'fn')}) * (tp + fn)) / (tp + tn + fp + fn)")},
    {R(f"(({_f1('tn', 'fn', 'fp')}) * (tn + fp) + ({_f1('tp', 'fp', 'fn')}) * (tp + fn)) / (tp + tn + fp + fn)")},
    tp + tn + fp + fn FROM cm""", CM)
q("evl9", "SELECT tn, fp, fn, tp FROM cm", CM)
q("evl5", f"""SELECT {R('t')} AS t, {R(_f1('tp', 'fp', 'P - tp'))} AS f1, {R(_p('tp', 'fp'))} AS precision,
    {R(_p('tp', 'P - tp'))} AS recall
  FROM (SELECT t, count(*) FILTER (WHERE fraud_score >= t AND isFraud = 1) AS tp,
               count(*) FILTER (WHERE fraud_score >= t AND isFraud <> 1) AS fp,
               (SELECT count(*) FROM txn WHERE isFraud = 1) AS P
        FROM txn, (SELECT 0.05::DOUBLE + i * 0.05::DOUBLE AS t FROM range(18) r(i)) GROUP BY t)""")
q("evl6", f"""SELECT {R('sum(n / total * abs(acc - conf))')} AS ece FROM (
    SELECT b, count(*) AS n, avg(fraud_score) AS conf, avg(isFraud) AS acc, any_value(total) AS total
    FROM (SELECT *, {_bin_expr('fraud_score', False)} AS b, count(*) OVER () AS total FROM txn)
    WHERE b IS NOT NULL GROUP BY b)""")
_E = _edges_sql()
q("evl7", f"""SELECT bins.bin, {R(f"[{', '.join(_E[:-1])}][bins.bin + 1]")} AS score_min,
    {R(f"[{', '.join(_E[1:])}][bins.bin + 1]")} AS score_max, coalesce(s.n, 0) AS n,
    {R('s.mean_score')} AS mean_score, {R('s.fraud_rate')} AS fraud_rate, {R('abs(s.mean_score - s.fraud_rate)')} AS abs_gap
  FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(10) r(i)) bins LEFT JOIN (
    SELECT b AS bin, count(*) AS n, avg(fraud_score) AS mean_score, avg(isFraud) AS fraud_rate
    FROM (SELECT *, {_bin_expr('fraud_score', True)} AS b FROM txn) WHERE b IS NOT NULL GROUP BY b) s
  ON bins.bin = s.bin""")
q("evl8", f"SELECT {R('avg((fraud_score - isFraud) ^ 2)')} AS brier FROM txn")
_DEC = "CASE WHEN fraud_score >= 0.6 THEN 'AUTO_BLOCK' WHEN fraud_score >= 0.35 THEN 'HITL_REVIEW' ELSE 'ALLOW' END"
q("evl10", f"""SELECT policy, tp, fp, tn, fn, {R(_p('tp', 'fp'))} AS precision, {R(_p('tp', 'fn'))} AS recall,
    {R(_f1('tp', 'fp', 'fn'))} AS f1, {R('(tp + fp) / (tp + fp + tn + fn)')} AS review_or_block_rate
  FROM (SELECT policy,
          count(*) FILTER (WHERE hit AND isFraud = 1) AS tp, count(*) FILTER (WHERE hit AND isFraud <> 1) AS fp,
          count(*) FILTER (WHERE NOT hit AND isFraud <> 1) AS tn, count(*) FILTER (WHERE NOT hit AND isFraud = 1) AS fn
        FROM (SELECT 'auto_block_only' AS policy, ({_DEC}) = 'AUTO_BLOCK' AS hit, isFraud FROM txn
              UNION ALL SELECT 'auto_block_or_hitl', ({_DEC}) IN ('AUTO_BLOCK', 'HITL_REVIEW'), isFraud FROM txn)
        GROUP BY policy)""")
q("evl11", f"""SELECT n_holdout, fraud_n, {R('fraud_rate')} AS fraud_rate, {R('roc_auc')} AS roc_auc,
    {R('pr_auc')} AS pr_auc, {R('brier')} AS brier, {R('ece_10bin')} AS ece_10bin,
    {R('bt')} AS best_f1_threshold, {R('bp')} AS best_f1_precision, {R('br')} AS best_f1_recall,
    {R('bf')} AS best_f1,
    (SELECT count(*) FROM txn WHERE fraud_score >= bt AND isFraud = 1) AS tp_at_best_f1,
    (SELECT count(*) FROM txn WHERE fraud_score >= bt AND isFraud = 0) AS fp_at_best_f1,
    (SELECT count(*) FROM txn WHERE fraud_score < bt AND isFraud = 0) AS tn_at_best_f1,
    (SELECT count(*) FROM txn WHERE fraud_score < bt AND isFraud = 1) AS fn_at_best_f1
  FROM (SELECT count(*) AS n_holdout, CAST(sum(isFraud) AS BIGINT) AS fraud_n, avg(isFraud) AS fraud_rate,
               avg((fraud_score - isFraud) ^ 2) AS brier FROM txn),
       (SELECT sum(neg * (2 * tp - pos)) / nullif(2.0 * max(P) * max(N), 0) AS roc_auc, sum(pos * tp / (tp + fp)) / max(P) AS pr_auc
        FROM cum),
       (SELECT sum(n / total * abs(conf - acc)) AS ece_10bin FROM (
          SELECT b, count(*) AS n, avg(fraud_score) AS conf, avg(isFraud) AS acc, any_value(total) AS total
          FROM (SELECT *, {_bin_expr('fraud_score', True)} AS b, count(*) OVER () AS total FROM txn)
          WHERE b IS NOT NULL GROUP BY b)),
       (SELECT threshold AS bt, precision AS bp, recall AS br, f1 AS bf FROM (
          SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM pr)
        ORDER BY f1 DESC, threshold ASC LIMIT 1)""", CURVE)
q("evl12", f"""SELECT g.isFraud, g.bin, coalesce(c.n, 0) AS n,
    {R('coalesce(c.n, 0) / (g.cn * CASE WHEN g.hi - g.lo > 0 THEN (g.hi - g.lo) / 50 ELSE 1 END)')} AS density
  FROM (SELECT r.isFraud, r.lo, r.hi, r.cn, CAST(i AS INTEGER) AS bin FROM (
          SELECT isFraud, min(fraud_score) AS lo, max(fraud_score) AS hi, count(*) AS cn FROM txn GROUP BY isFraud) r,
        range(50) b(i)) g
  LEFT JOIN (SELECT t.isFraud, CAST(CASE WHEN r.hi - r.lo > 0
                  THEN least(floor((t.fraud_score - r.lo) * 50 / (r.hi - r.lo)), 49) ELSE 0 END AS INTEGER) AS bin,
                  count(*) AS n
             FROM txn t JOIN (SELECT isFraud, min(fraud_score) AS lo, max(fraud_score) AS hi FROM txn GROUP BY isFraud) r
             USING (isFraud) GROUP BY 1, 2) c
  ON g.isFraud = c.isFraud AND g.bin = c.bin""")

# ============================ statistics ========================================================
q("sta1", f"""SELECT b, c, {R('CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1.0) ^ 2 / (b + c) END')} AS statistic,
    b + c AS discordant
  FROM (SELECT count(*) FILTER (WHERE ((fraud_score >= 0.5)::INT = isFraud) AND NOT ((score_b >= 0.5)::INT = isFraud)) AS b,
               count(*) FILTER (WHERE NOT ((fraud_score >= 0.5)::INT = isFraud) AND ((score_b >= 0.5)::INT = isFraud)) AS c
        FROM txn)""")
q("sta2", f"""SELECT count(d) AS n, {R('CASE WHEN count(d) < 2 THEN NULL WHEN stddev_samp(d) = 0 THEN 0 ELSE avg(d) / stddev_samp(d) END')} AS cohens_d
  FROM (SELECT fraud_score - score_b AS d FROM txn)""")
q("sta3", f"""SELECT count(d) AS n, {R('CASE WHEN count(d) < 2 THEN NULL ELSE avg(d) * sqrt(count(d)) / stddev_samp(d) END')} AS statistic,
    count(d) - 1 AS dof FROM (SELECT fraud_score - score_b AS d FROM txn)""")

# ============================ drift =============================================================
_DRIFT = ["TransactionAmt", "C1", "C13", "C14", "D1", "D15", "V1", "V5", "V9"]


def _long(where: str, side: str, fill: bool) -> str:
    sel = ", ".join((f"coalesce({c}, -999e0) AS {c}" if fill else c) for c in _DRIFT)
    return (f"SELECT '{side}' AS side, feature, value FROM (UNPIVOT (SELECT {sel} FROM pos, hb WHERE {where}) "
            f"ON {', '.join(_DRIFT)} INTO NAME feature VALUE value)")


PSI_PROBS = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"


def _psi_sql(long_cte: str, tiers: str) -> str:
    return f"""{long_cte},
bp AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {PSI_PROBS}))) AS bp
       FROM lf WHERE side = 'e' GROUP BY feature),
bj AS (SELECT l.side, l.feature, l.value, b.bp, len(b.bp) - 1 AS nb FROM lf l JOIN bp b USING (feature)
       WHERE l.value >= b.bp[1] AND l.value <= b.bp[len(b.bp)]),
cnt AS (SELECT feature, CASE WHEN nb <= 1 THEN 0 ELSE len(list_filter(bp[2:nb], lambda e: e <= value)) END AS bin,
               count(*) FILTER (WHERE side = 'e') AS ec, count(*) FILTER (WHERE side = 'a') AS ac
        FROM bj GROUP BY 1, 2),
grid AS (SELECT feature, len(bp) - 1 AS nb, unnest(range(0, len(bp) - 1)) AS bin FROM bp),
g AS (SELECT grid.feature, grid.nb, grid.bin, coalesce(cnt.ec, 0) AS ec, coalesce(cnt.ac, 0) AS ac
      FROM grid LEFT JOIN cnt USING (feature, bin)),
g2 AS (SELECT *, sum(ec) OVER (PARTITION BY feature) AS E, sum(ac) OVER (PARTITION BY feature) AS A FROM g),
psi AS (SELECT feature, CASE WHEN max(nb) + 1 < 3 THEN 0e0 ELSE
          sum(((ac + 1) / (A + nb) - (ec + 1) / (E + nb)) * ln(((ac + 1) / (A + nb)) / ((ec + 1) / (E + nb)))) END AS psi
        FROM g2 GROUP BY feature),
allf AS (SELECT bp.feature, coalesce(psi.psi, 0e0) AS psi FROM bp LEFT JOIN psi USING (feature))
SELECT feature, {R('psi')} AS psi, {tiers} AS tier FROM allf"""


_TIER = ("CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.10 THEN 'moderate' ELSE 'stable' END")
_STIER = ("CASE WHEN psi >= 1.0 THEN 'extreme' WHEN psi >= 0.25 THEN 'significant' "
          "WHEN psi >= 0.10 THEN 'moderate' ELSE 'stable' END")
ORACLES["drf1"] = "WITH " + TXN + "," + POS + "," + _psi_sql(
    f"lf AS ({_long('pos < train_end', 'e', True)} UNION ALL {_long('pos >= test_start', 'a', True)})", _TIER)
ORACLES["drf2"] = "WITH " + TXN + "," + POS + "," + _psi_sql(
    """lf AS (SELECT 'e' AS side, 'fraud_score' AS feature, fraud_score AS value FROM pos, hb WHERE pos < train_end
              AND fraud_score IS NOT NULL
              UNION ALL SELECT 'a', 'fraud_score', fraud_score FROM pos, hb WHERE pos >= test_start
              AND fraud_score IS NOT NULL)""", _STIER)

WASS = f"""
lf AS ({_long('pos < train_end', '0', False)} UNION ALL {_long('pos >= test_start', '1', False)}),
vc AS (SELECT feature, value, count(*) FILTER (WHERE side = '0') AS ca, count(*) FILTER (WHERE side = '1') AS cb
       FROM lf WHERE value IS NOT NULL GROUP BY 1, 2),
nn AS (SELECT feature, sum(ca) AS na, sum(cb) AS nb FROM vc GROUP BY 1 HAVING sum(ca) > 0 AND sum(cb) > 0),
cdf AS (SELECT v.feature, v.value,
          sum(ca) OVER w / na AS Fa, sum(cb) OVER w / nb AS Fb,
          lead(v.value) OVER (PARTITION BY v.feature ORDER BY v.value) AS nxt
        FROM vc v JOIN nn USING (feature)
        WINDOW w AS (PARTITION BY v.feature ORDER BY v.value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
wd AS (SELECT feature, coalesce(sum(abs(Fa - Fb) * (nxt - value)), 0) AS wasserstein_distance FROM cdf GROUP BY feature)"""
q("drf3", f"""SELECT feature, {R('wasserstein_distance')} AS wasserstein_distance,
    CASE WHEN wasserstein_distance > 0.1 THEN 'DRIFT' ELSE 'STABLE' END AS status FROM wd""", POS + "," + WASS)
q("srt4", f"""SELECT feature, {R('wasserstein_distance')} AS wasserstein_distance,
    CASE WHEN wasserstein_distance > 0.1 THEN 'DRIFT' ELSE 'STABLE' END AS status FROM wd
  ORDER BY wasserstein_distance DESC, feature LIMIT 5""", POS + "," + WASS)

# ============================ fairness ===========================================================
FAIR = f"""
rt AS (SELECT card4, isFraud, ({_DEC}) AS decision FROM txn WHERE card4 IS NOT NULL),
dpg AS (SELECT card4, CAST(count(*) AS BIGINT) AS size,
               round_even(avg(CASE WHEN decision = 'AUTO_BLOCK' THEN 1e0 ELSE 0e0 END), 4) AS block_rate
        FROM rt GROUP BY card4),
dpd AS (SELECT CASE WHEN count(*) >= 2 THEN max(block_rate) - min(block_rate) ELSE 0e0 END AS dp_difference FROM dpg),
eog AS (SELECT card4, CAST(count(*) AS BIGINT) AS size,
          round_even(CASE WHEN count(*) FILTER (WHERE isFraud = 1) > 0 THEN
            count(*) FILTER (WHERE isFraud = 1 AND decision = 'AUTO_BLOCK') / count(*) FILTER (WHERE isFraud = 1)
            ELSE 0e0 END, 4) AS tpr,
          round_even(CASE WHEN count(*) FILTER (WHERE isFraud <> 1) > 0 THEN
            count(*) FILTER (WHERE isFraud <> 1 AND decision = 'AUTO_BLOCK') / count(*) FILTER (WHERE isFraud <> 1)
            ELSE 0e0 END, 4) AS fpr
        FROM rt GROUP BY card4),
eod AS (SELECT CASE WHEN count(*) >= 2 THEN max(tpr) - min(tpr) ELSE 0e0 END AS tpr_difference,
               CASE WHEN count(*) >= 2 THEN max(fpr) - min(fpr) ELSE 0e0 END AS fpr_difference FROM eog)"""
q("fai1", f"SELECT card4, size, {R('block_rate')} AS block_rate, {R('dp_difference')} AS dp_difference FROM dpg, dpd",
  FAIR)
q("fai2", f"""SELECT card4, size, {R('tpr')} AS tpr, {R('fpr')} AS fpr, {R('tpr_difference')} AS tpr_difference,
    {R('fpr_difference')} AS fpr_difference FROM eog, eod""", FAIR)
q("fai3", f"""SELECT d.card4, d.size, {R('block_rate')} AS block_rate, {R('dp_difference')} AS dp_difference,
    {R('tpr')} AS tpr, {R('fpr')} AS fpr, {R('tpr_difference')} AS tpr_difference,
    {R('fpr_difference')} AS fpr_difference,
    CASE WHEN dp_difference >= 0.05 OR tpr_difference >= 0.05 OR fpr_difference >= 0.05 THEN 1 ELSE 0 END AS warning
  FROM dpg d JOIN eog e USING (card4), dpd, eod""", FAIR)


# ============================ models / stacking (SQL-checkable parts) =====================
q("mod7", f"""SELECT {R('avg((0.75 * y + 0.25 * (1 - y)) * pow(1 - exp(-bce), 2) * bce)')} AS focal_loss FROM (
    SELECT y, -(y * ln(p) + (1 - y) * ln(1 - p)) AS bce FROM (
      SELECT CAST(isFraud AS DOUBLE) AS y, least(greatest(fraud_score, 1e-7), 1 - 1e-7) AS p FROM txn))""")


def _auc_of(col: str) -> str:
    return f"""(SELECT sum(neg * (2 * tp - pos)) / nullif(2.0 * max(P) * max(N), 0) FROM (
      SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM (
        SELECT {col} AS s, sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM txn GROUP BY {col})))"""


GATES = f"""gates AS (
  SELECT 'fraud_score' AS model, {_auc_of('fraud_score')} AS auc UNION ALL
  SELECT 'score_b', {_auc_of('score_b')}),
gw AS (SELECT model, auc, least(1.0, pow(auc / 0.6, 2)) AS gate_weight FROM gates)"""
q("stk1", f"SELECT model, {R('auc')} AS auc, {R('gate_weight')} AS gate_weight FROM gw", GATES)
q("stk2", f"""SELECT TransactionID,
    {R("fraud_score * (SELECT gate_weight FROM gw WHERE model = 'fraud_score')")} AS fraud_score_gated,
    {R("score_b * (SELECT gate_weight FROM gw WHERE model = 'score_b')")} AS score_b_gated FROM txn""", GATES)
q("stk6", f"""SELECT TransactionID, {R('CASE WHEN count(fraud_score) OVER (PARTITION BY UID) >= 2 '
    'THEN 0.7 * fraud_score + (1.0 - 0.7) * avg(fraud_score) OVER (PARTITION BY UID) ELSE fraud_score END')}
    AS fraud_score FROM feat2""")
q("stk7", f"SELECT TransactionID, {R('avg(fraud_score) OVER (PARTITION BY UID)')} AS uid_mean_score FROM feat2")

_VS = [f"V{i}" for i in range(1, 13)]
q("enc5", """SELECT CAST(dense_rank() OVER (ORDER BY f.first_ord) - 1 AS INTEGER) AS pca_group, masks.v AS v_column
  FROM masks JOIN (SELECT m, min(ord) AS first_ord FROM masks GROUP BY m) f USING (m)""",
  POS + ", fitm AS (SELECT * FROM pos, hb WHERE pos < train_end), masks AS ("
  + " UNION ALL ".join(f"SELECT '{v}' AS v, {i} AS ord, "
                       f"string_agg(CASE WHEN {v} IS NULL THEN '1' ELSE '0' END, '' ORDER BY pos) AS m FROM fitm"
                       for i, v in enumerate(_VS)) + ")")

# ============================ explanations with unit weights =============================
_XF = ["TransactionAmt", "C1", "C13", "C14", "D1", "D15", "V1", "V5"]
_XSEL = ", ".join(f"coalesce(CAST({c} AS DOUBLE), -999e0) AS {c}" for c in _XF)
_XIDX = ", ".join(f"('{c}', {i})" for i, c in enumerate(_XF))
XAI = f"""
bgl AS (SELECT feature, value FROM (UNPIVOT (SELECT {_XSEL} FROM pos, hb WHERE pos < train_end)
        ON {', '.join(_XF)} INTO NAME feature VALUE value)),
bgs AS (SELECT feature, quantile_cont(value, 0.5) AS med, stddev_pop(value) + 1e-6 AS sc,
               quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM bgl GROUP BY feature),
fidx AS (SELECT * FROM (VALUES {_XIDX}) v(feature, idx)),
xl AS (SELECT TransactionID, fraud_score, feature, value FROM (UNPIVOT (SELECT TransactionID, fraud_score, {_XSEL} FROM pos)
       ON {', '.join(_XF)} INTO NAME feature VALUE value)),
contrib AS (SELECT x.TransactionID, x.fraud_score, x.feature, f.idx, x.value, b.q1, b.q3,
                   (x.value - b.med) / b.sc * 1.0 AS contribution
            FROM xl x JOIN bgs b USING (feature) JOIN fidx f USING (feature)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY TransactionID ORDER BY abs(contribution) DESC, idx DESC) AS rank
           FROM contrib)"""
q("agg9", f"SELECT feature, {R('med')} AS median, {R('sc')} AS scale, {R('q1')} AS q1, {R('q3')} AS q3 FROM bgs",
  POS + "," + XAI)
q("xai3", f"SELECT TransactionID, feature, {R('contribution')} AS contribution FROM contrib", POS + "," + XAI)
q("xai4", f"""SELECT TransactionID, CAST(rank AS INTEGER) AS rank, feature, {R('contribution')} AS weight
  FROM ranked WHERE rank <= 10""", POS + "," + XAI)
q("srt5", "SELECT TransactionID, CAST(rank AS INTEGER) AS rank, feature FROM ranked WHERE rank <= 3", POS + "," + XAI)
q("xai6", f"""SELECT TransactionID, CAST(rank AS INTEGER) AS rank, feature,
    CASE WHEN value >= q3 THEN '>=' WHEN value <= q1 THEN '<=' ELSE 'between' END AS kind,
    {R('q1')} AS q1, {R('q3')} AS q3,
    {R('greatest(fraud_score, 1 - fraud_score)')} AS anchor_precision,
    {R('1.0 / 3')} AS anchor_coverage
  FROM ranked WHERE rank <= 3""", POS + "," + XAI)


# ============================ sequence views =============================================
def _seq_sql(where: str, out_where: str) -> str:
    return f"""
s AS (SELECT TransactionID, pos, coalesce(list(CAST(round(TransactionAmt * 100) AS BIGINT) || ',' || hour || ','
             || CAST(C1 AS BIGINT)) OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID
                                           ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []::VARCHAR[]) AS hist
      FROM (SELECT p.*, CAST((TransactionDT % 86400) // 3600 AS INTEGER) AS hour FROM pos p, hb WHERE {where}))
SELECT TransactionID, CAST(len(hist) AS INTEGER) AS seq_len,
       array_to_string(list_concat(list_transform(range(10 - len(hist)), lambda x: '0,0,0'), hist), ',') AS seq_flat
FROM s, hb WHERE {out_where}"""


ORACLES["win12"] = "WITH " + TXN + "," + POS + "," + _seq_sql("TRUE", "TRUE")
ORACLES["win13"] = "WITH " + TXN + "," + POS + "," + _seq_sql("pos < train_end OR pos >= test_start",
                                                              "pos >= test_start")


# ============================ sources / sinks ===========================================
_PS = f"""SELECT CAST(r AS BIGINT) AS TransactionID, CAST(step AS BIGINT) * 3600 AS TransactionDT,
    {R('amount')} AS TransactionAmt, CAST(c1 AS INTEGER) AS card1, CAST(a1 AS INTEGER) AS addr1, type AS card4,
    0e0 AS D1, isFraud, {R('oldbalanceOrg - newbalanceOrig')} AS origin_delta,
    {R('newbalanceDest - oldbalanceDest')} AS dest_delta, {R('oldbalanceOrg - oldbalanceDest')} AS balance_gap,
    CAST(floor(step / 24) AS INTEGER) AS StepBlock
  FROM (SELECT p.*, row_number() OVER (ORDER BY TransactionID) AS r,
               dense_rank() OVER (ORDER BY fo) - 1 AS c1, dense_rank() OVER (ORDER BY fd) - 1 AS a1
        FROM (SELECT *, min(TransactionID) OVER (PARTITION BY nameOrig) AS fo,
                        min(TransactionID) OVER (PARTITION BY nameDest) AS fd FROM praw_in) p)"""
ORACLES["src1"] = "WITH " + PRAW + ", praw_in AS (SELECT * FROM praw)\n" + _PS
ORACLES["src3"] = ORACLES["src1"]
ORACLES["src4"] = ORACLES["src1"]
q("spl5", "SELECT TransactionID FROM txn ORDER BY md5(TransactionID || ':42'), TransactionID LIMIT 500")
q("snk2", f"""SELECT (SELECT count(*) FROM dm) AS n_seeds, metric, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std
  FROM runs WHERE metric <> 'ece_10bin' GROUP BY metric""", DAYCURVE)
q("src2", f"""SELECT e.event_id AS TransactionID, {R('e.value')} AS TransactionAmt,
    CASE WHEN e.event_type = 'error' AND e.value > 75 THEN 1 ELSE 0 END AS isFraud,
    CASE WHEN e.event_id % 4 = 0 THEN (CASE WHEN e.k % 2 = 0 THEN 'mobile' ELSE 'desktop' END) END AS DeviceType
  FROM ev e""")
q("src7", "SELECT TransactionID, hour, day_of_week FROM feat2")
q("snk1", f"SELECT TransactionID, UID, isFraud, {R('fraud_score')} AS fraud_score, {_DEC} AS decision FROM feat2")
q("snk6", """SELECT TransactionID, 1 AS seed FROM pos, hb WHERE pos < train_end
  UNION ALL SELECT TransactionID, 2 FROM pos, hb WHERE pos >= test_start
  UNION ALL SELECT TransactionID, -1 FROM pos, hb WHERE pos >= test_start""", POS)

# ============================ documented extensions ======================================
_RANGES = [(3600, "1h"), (21600, "6h"), (86400, "24h"), (604800, "7d"), (1209600, "14d"), (2592000, "30d")]
q("doc1", "SELECT TransactionID, " + ", ".join(
    f"CAST(count(*) OVER (PARTITION BY card1 ORDER BY TransactionDT RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)"
    f" AS BIGINT) AS txn_count_{lab}, "
    f"{R(f'coalesce(sum(TransactionAmt) OVER (PARTITION BY card1 ORDER BY TransactionDT RANGE BETWEEN {s} PRECEDING AND CURRENT ROW), 0)')}"
    f" AS amt_sum_{lab}, "
    f"{R(f'avg(TransactionAmt) OVER (PARTITION BY card1 ORDER BY TransactionDT RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)')}"
    f" AS amt_mean_{lab}" for s, lab in _RANGES) + " FROM txn")
q("doc2", f"""SELECT TransactionID, {R('oldbalanceOrg - amount - newbalanceOrig')} AS balance_error,
    {R('amount / (oldbalanceOrg + 1.0)')} AS amt_to_balance,
    CASE WHEN oldbalanceOrg > 0 AND amount >= oldbalanceOrg THEN 1 ELSE 0 END AS is_full_transfer,
    {R('sin(CAST(step % 24 AS DOUBLE) * (2 * pi() / 24))')} AS hour_sin,
    {R('cos(CAST(step % 24 AS DOUBLE) * (2 * pi() / 24))')} AS hour_cos FROM praw""", PRAW)
q("doc3", """SELECT TransactionID, CAST(sum(first_seen) OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS distinct_counterparties
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY card1, card4 ORDER BY TransactionDT, TransactionID) = 1
                  THEN 1 ELSE 0 END AS first_seen FROM txn)""")
q("doc5", f"""SELECT policy, {R('threshold')} AS threshold, {R('precision')} AS precision, {R('recall')} AS recall,
    {R('f2')} AS f2, {R('cost')} AS cost FROM (
  SELECT 'best_f2' AS policy, * FROM (SELECT * FROM pc ORDER BY f2 DESC, threshold ASC LIMIT 1)
  UNION ALL SELECT 'recall_at_precision', * FROM (SELECT * FROM pc ORDER BY CASE WHEN precision >= 0.5 THEN recall ELSE -1 END DESC, threshold ASC LIMIT 1)
  UNION ALL SELECT 'min_cost', * FROM (SELECT * FROM pc ORDER BY cost ASC, threshold ASC LIMIT 1))""",
  CURVE.strip() + """,
pc AS (SELECT threshold, precision, recall,
              CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2,
              1.0 * fp + 10.0 * (P - tp) AS cost FROM pr)""")
_DAYAUC = """
dd2 AS (SELECT *, CAST(floor(TransactionDT / 86400) AS INTEGER) AS block FROM txn),
lng AS (SELECT block, isFraud, 'fraud_score' AS model, fraud_score AS s FROM dd2
        UNION ALL SELECT block, isFraud, 'score_b', score_b FROM dd2),
pts2 AS (SELECT model, block, s, sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM lng GROUP BY 1, 2, 3),
cum2 AS (SELECT *, sum(pos) OVER (PARTITION BY model, block ORDER BY s DESC) AS tp,
                sum(pos) OVER (PARTITION BY model, block) AS P, sum(neg) OVER (PARTITION BY model, block) AS N FROM pts2),
auc2 AS (SELECT model, block, sum(neg * (2 * tp - pos)) / nullif(2.0 * max(P) * max(N), 0) AS roc_auc FROM cum2 GROUP BY 1, 2),
rec AS (SELECT model, avg(roc_auc) AS recent_mean_auc, CAST(count(*) AS BIGINT) AS n_blocks FROM auc2
        WHERE block > (SELECT max(block) FROM dd2) - 7 GROUP BY model)"""
q("doc6", f"""SELECT model, {R('recent_mean_auc')} AS recent_mean_auc, n_blocks,
    CASE WHEN model = (SELECT model FROM rec ORDER BY recent_mean_auc DESC, model DESC LIMIT 1) THEN 1 ELSE 0 END
      AS selected FROM rec""", _DAYAUC)
q("doc7", f"""SELECT p.TransactionID,
    {R('(coalesce(s.sy, 0) + 10.0 * pr.prior) / (coalesce(s.n, 0) + 10.0)')} AS card4_te
  FROM pos p LEFT JOIN (SELECT card4, sum(isFraud) AS sy, count(*) AS n FROM pos, hb WHERE pos < train_end GROUP BY card4) s
    ON p.card4 = s.card4,
  (SELECT avg(isFraud) AS prior FROM pos, hb WHERE pos < train_end) pr""", POS)
q("doc7_folds", f"""SELECT v.TransactionID, v.fold,
    {R('(coalesce(a.sy, 0) + 10.0 * pr.prior) / (coalesce(a.n, 0) + 10.0)')} AS card4_te,
    {R('(coalesce(b.sy, 0) + 10.0 * pr.prior) / (coalesce(b.n, 0) + 10.0)')} AS card1_te, d.degree
  FROM (SELECT p.*, f.fold FROM pos p JOIN f ON p.pos >= f.val_start AND p.pos < f.val_end) v
  LEFT JOIN (SELECT fold, card4, sum(isFraud) AS sy, count(*) AS n FROM pos JOIN f ON pos < f.train_end GROUP BY ALL) a ON a.fold = v.fold AND a.card4 = v.card4
  LEFT JOIN (SELECT fold, card1, sum(isFraud) AS sy, count(*) AS n FROM pos JOIN f ON pos < f.train_end GROUP BY ALL) b ON b.fold = v.fold AND b.card1 = v.card1
  JOIN (SELECT fold, avg(isFraud) AS prior FROM pos JOIN f ON pos < f.train_end GROUP BY ALL) pr ON pr.fold = v.fold
  JOIN (SELECT TransactionID, CAST(sum(first_seen) OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS degree
        FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY card1, card4 ORDER BY TransactionDT, TransactionID) = 1
                        THEN 1 ELSE 0 END AS first_seen FROM pos)) d ON d.TransactionID = v.TransactionID""", POS + """,
f AS (SELECT CAST(i AS INTEGER) AS fold, fs * (i + 1) AS train_end, fs * (i + 1) + gap AS val_start, least(fs * (i + 1) + gap + fs, n) AS val_end
      FROM prm, range(5) r(i) WHERE fs * (i + 1) + gap < n)""")
q("doc8", f"""SELECT TransactionID,
    {R('CASE WHEN Card_Prior_Txn_Count < 3 THEN (SELECT avg(isFraud) FROM pos, hb WHERE pos < train_end) ELSE score_b END')}
      AS seq_score,
    CASE WHEN Card_Prior_Txn_Count < 3 THEN 0 ELSE 1 END AS view_mask_seq FROM velo""", POS + "," + VELO)
q("doc9", f"""SELECT 'fraud_score' AS model_a, 'fraud_score' AS model_b, {R('corr(fraud_score, fraud_score)')} AS corr FROM txn
  UNION ALL SELECT 'fraud_score', 'score_b', {R('corr(fraud_score, score_b)')} FROM txn
  UNION ALL SELECT 'score_b', 'score_b', {R('corr(score_b, score_b)')} FROM txn""")


# ============================ remaining projections =====================================
_TXN_ALL = _TXN_COLS
_ratio = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS null_ratio FROM fitv"
    for c in _TXN_ALL)
ORACLES["prj10"] = ("WITH " + TXN + "," + POS + ", fitv AS (SELECT * FROM pos, hb WHERE pos < train_end), "
                    f"r AS ({_ratio})\nSELECT \"column\", {R('null_ratio')} AS null_ratio, "
                    "CASE WHEN null_ratio IS NULL OR null_ratio < 0.7 OR \"column\" = 'TransactionID' "
                    "THEN 1 ELSE 0 END AS kept FROM r")
_MCOLS = ["TransactionAmt", "addr1", "D1", "D15", "C1", "C13", "C14"] + [f"V{i}" for i in range(1, 13)]
q("prj11", "SELECT TransactionID, " + ", ".join(
    f"{R(f'coalesce(CAST({c} AS DOUBLE), -999e0)')} AS {c}" for c in _MCOLS) + " FROM txn")
q("prj12", "SELECT TransactionID, " + ", ".join(
    f"{R(f'CAST({c} AS DOUBLE)')} AS {c}" for c in reversed(_MCOLS)) + " FROM txn")
q("prj13", """SELECT TransactionID, 'fraud_only' AS predicate FROM velo WHERE isFraud = 1
  UNION ALL SELECT TransactionID, 'group_non_null' FROM velo WHERE card4 IS NOT NULL
  UNION ALL SELECT TransactionID, 'cold_start' FROM velo WHERE Card_Prior_Txn_Count < 3
  UNION ALL SELECT TransactionID, 'finite_scores' FROM velo WHERE fraud_score IS NOT NULL AND NOT isnan(fraud_score)
            AND score_b IS NOT NULL AND NOT isnan(score_b)""", VELO)


# ============================ explanations of a fixed linear model ==========================
_W = {"fraud_score": "3.0::DOUBLE", "score_b": "1.5::DOUBLE"}
_Z0 = "(-1.25::DOUBLE + 3.0::DOUBLE * fraud_score + 1.5::DOUBLE * score_b)"
META = """
hold AS (SELECT p.* FROM pos p, hb WHERE pos >= test_start),
bgm AS (SELECT avg(fraud_score) AS m_fraud_score, avg(score_b) AS m_score_b,
               quantile_cont(fraud_score, 0.5) AS med1, quantile_cont(score_b, 0.5) AS med2,
               stddev_pop(fraud_score) + 1e-6 AS sc1, stddev_pop(score_b) + 1e-6 AS sc2
        FROM pos, hb WHERE pos < train_end),
ml AS (""" + " UNION ALL ".join(
    f"SELECT TransactionID, day_of_week, fraud_score AS s, '{f}' AS meta_feature, {f} AS x, m_{f} AS bg, {w} AS w, ({f} - m_{f}) * {w} AS c "
    f"FROM (SELECT h.*, CAST((TransactionDT // 86400) % 7 AS INTEGER) AS day_of_week FROM hold h), bgm" for f, w in _W.items()) + """),
steps AS (
  SELECT *, CASE WHEN a1 > a2 THEN 1 ELSE 2 END AS top FROM (
    SELECT h.*, b.*, abs((fraud_score - med1) / sc1 * 3.0) AS a1, abs((score_b - med2) / sc2 * 1.5) AS a2,
           3.0::DOUBLE * (med1 - fraud_score) AS dl1, 1.5::DOUBLE * (med2 - score_b) AS dl2, """ + _Z0 + """ AS z0
    FROM hold h, bgm b)),
cf AS (SELECT *, 1 / (1 + exp(-(z0 + CASE WHEN top = 1 THEN dl1 ELSE dl2 END))) AS s1, 1 / (1 + exp(-(z0 + dl1 + dl2))) AS s2 FROM steps)"""
_MTAB = f"""meta_feature, {R('avg(x)')} AS holdout_mean_score, {R('avg(c)')} AS mean_signed_contribution,
  {R('avg(abs(c))')} AS mean_abs_contribution, {R('coalesce(stddev_samp(c), 0)')} AS std_contribution,
  {R('avg(CASE WHEN c > 0 THEN 1e0 ELSE 0e0 END)')} AS positive_contribution_rate, max(w) AS coefficient, {R('max(bg)')} AS background_mean_score"""
q("xai1", f"SELECT {_MTAB} FROM ml GROUP BY meta_feature", POS + "," + META)
ORACLES["snk3"] = ORACLES["xai1"]
q("xai2", f"""SELECT TransactionID, meta_feature, {R('x')} AS base_model_score, {R('bg')} AS background_mean_score, w AS coefficient,
    {R('c')} AS local_contribution, {R('abs(c)')} AS abs_local_contribution
  FROM ml WHERE TransactionID = (SELECT TransactionID FROM hold ORDER BY fraud_score DESC, TransactionID LIMIT 1)""", POS + "," + META)
q("agg8", f"""SELECT meta_feature, {R('avg(ma)')} AS mean_abs_contribution_mean, {R('stddev_samp(ma)')} AS mean_abs_contribution_std,
    {R('avg(ms)')} AS mean_signed_contribution_mean, avg(w) AS coefficient_mean, {R('avg(hm)')} AS holdout_mean, {R('avg(bg)')} AS background_mean
  FROM (SELECT meta_feature, day_of_week, avg(abs(c)) AS ma, avg(c) AS ms, max(w) AS w, avg(x) AS hm, max(bg) AS bg FROM ml GROUP BY 1, 2)
  GROUP BY meta_feature""", POS + "," + META)
q("xai5", f"""SELECT TransactionID, 0 AS step, CASE WHEN top = 1 THEN 'fraud_score' ELSE 'score_b' END AS feature,
    {R('CASE WHEN top = 1 THEN fraud_score ELSE score_b END')} AS original_value, {R('CASE WHEN top = 1 THEN med1 ELSE med2 END')} AS suggested_value,
    {R('s1')} AS new_score, s1 < 0.5 AS flipped FROM cf
  UNION ALL SELECT TransactionID, 1, CASE WHEN top = 1 THEN 'score_b' ELSE 'fraud_score' END,
    {R('CASE WHEN top = 1 THEN score_b ELSE fraud_score END')}, {R('CASE WHEN top = 1 THEN med2 ELSE med1 END')}, {R('s2')}, s2 < 0.5
  FROM cf WHERE NOT s1 < 0.5""", POS + "," + META)
q("xai9", f"SELECT TransactionID, {R('1 / (1 + exp(-z0)) - s2')} AS frd_proxy FROM cf", POS + "," + META)
q("xai11", f"""SELECT TransactionID, {R('CASE WHEN s1 < 0.5 THEN 1 WHEN s2 < 0.5 THEN 0.5 ELSE 0 END')} AS dice_validity_rate,
    {R('greatest(1 / (1 + exp(-z0)), 1 - 1 / (1 + exp(-z0)))')} AS anchor_precision_m, 1e0 AS nl_completeness FROM cf""", POS + "," + META)


# ============================ streams, resampling, discovery ================================
_EXP = f"{WCARD_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
q("str1", f"""SELECT CAST(card1 AS BIGINT) AS card1, TransactionID, TransactionDT, {R('TransactionAmt')} AS TransactionAmt, Card_Tx_Count, Card_Prior_Txn_Count,
    {R(f'avg(TransactionAmt) OVER ({_EXP})')} AS card_amt_mean, {R(f'coalesce(stddev_samp(TransactionAmt) OVER ({_EXP}), 0)')} AS card_amt_std,
    {', '.join(f"{R(f'Card_{k}_{w}')} AS Card_{k}_{w}" for k in ('Velocity', 'Amt_Std') for w in ('7d', '14d', '30d'))},
    {R('Card_Spending_Velocity')} AS Card_Spending_Velocity, 0 AS late FROM velo""", VELO)
q("str4", f"""SELECT window_day, {R('sum((a - e) * ln(a / e))')} AS psi FROM (
    SELECT window_day, (n + 1) / (sum(n) OVER w + nb) AS a, (ref_n + 1) / (sum(ref_n) OVER w + nb) AS e FROM g WINDOW w AS (PARTITION BY window_day))
  GROUP BY window_day""", POS + f""",
bp AS (SELECT list_sort(list_distinct(quantile_cont(fraud_score, {PSI_PROBS}))) AS bp FROM pos, hb WHERE pos < train_end),
binned AS (SELECT p.pos, strftime(to_timestamp(1704067200 + TransactionDT) AT TIME ZONE 'UTC', '%Y-%m-%d') AS window_day, len(bp) - 1 AS nb,
                  len(list_filter(bp[2:len(bp) - 1], lambda x: x <= fraud_score)) AS bin
           FROM pos p, bp WHERE fraud_score >= bp[1] AND fraud_score <= bp[len(bp)]),
ref AS (SELECT bin, count(*) AS ref_n FROM binned, hb WHERE pos < train_end GROUP BY bin),
obs AS (SELECT window_day, bin, count(*) AS n FROM binned GROUP BY 1, 2),
g AS (SELECT d.window_day, b.bin, b.nb, coalesce(o.n, 0) AS n, coalesce(r.ref_n, 0) AS ref_n
      FROM (SELECT DISTINCT window_day FROM obs) d CROSS JOIN (SELECT unnest(range(0, len(bp) - 1)) AS bin, len(bp) - 1 AS nb FROM bp) b
      LEFT JOIN obs o ON o.window_day = d.window_day AND o.bin = b.bin LEFT JOIN ref r ON r.bin = b.bin)""")
_OVERSAMPLED = """SELECT TransactionID, isFraud FROM pos, hb WHERE pos < train_end
  UNION ALL SELECT m.TransactionID, m.isFraud
  FROM (SELECT CAST('0x' || substr(md5(i || ':42'), 1, 15) AS BIGINT) % np AS k
        FROM (SELECT count(*) FILTER (WHERE isFraud = 1) AS np, count(*) FILTER (WHERE isFraud <> 1) AS nn FROM pos, hb WHERE pos < train_end),
             LATERAL (SELECT unnest(range(0, greatest(0, CAST(floor({ratio}::DOUBLE * nn) AS BIGINT) - np))) AS i)) d
  JOIN (SELECT TransactionID, isFraud, row_number() OVER (ORDER BY TransactionID) - 1 AS k FROM pos, hb WHERE pos < train_end AND isFraud = 1) m USING (k)"""
q("bal1", _OVERSAMPLED.replace("{ratio}", "0.10"), POS)
q("bal4", _OVERSAMPLED.replace("{ratio}", "0.30"), POS)
q("src5", "SELECT * FROM (VALUES ('deeper/log', true), ('decoy', false)) v(folder, matches)")

# ============================ out-of-fold coverage, tables, narratives =========================
#: The rows of all validation windows of the training slice: what an out-of-fold run scores.
q("spl4", """SELECT CAST(count(*) AS BIGINT) AS n_covered, CAST(coalesce(sum(isFraud), 0) AS BIGINT) AS n_positive
  FROM pos, hb WHERE EXISTS (
    SELECT 1 FROM (SELECT unnest(range(0, 5)) AS i) f
    WHERE pos >= (train_end // 6) * (i + 1) + gap AND pos < least((train_end // 6) * (i + 2) + gap, train_end))""", POS)
q("prj2", "SELECT " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" if c in ("TransactionAmt", "D1", "D15", "C1", "C13", "C14", "fraud_score", "score_b") else c
                                for c in ("TransactionID", "TransactionDT", "TransactionAmt", "card1", "addr1", "D1", "D15", "C1", "C13", "C14",
                                          "isFraud", "fraud_score", "score_b")) + " FROM txn")
ORACLES["snk4"] = " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", CAST(count(*) AS BIGINT) AS n_rows FROM ({ORACLES[of]})"
    for name, of in (("calibration_bins", "evl7"), ("score_deciles", "agg6"), ("topk", "srt6"), ("policy", "evl10")))
_TIER = "CASE WHEN fraud_score >= 0.6 THEN 'HIGH' WHEN fraud_score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END"
q("xai7", f"""SELECT TransactionID, '## Fraud Risk Assessment' || chr(10) || '**Risk Level: ' || any_value({_TIER}) || '** (Score: '
    || printf('%.2f', any_value(fraud_score) * 100) || '%)' || chr(10) || chr(10) || '### Key Factors (SHAP):' || chr(10)
    || string_agg('- **' || feature || '**: ' || CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END
                  || ' fraud risk (impact: ' || printf('%.4f', abs(contribution)) || ')' || chr(10), '' ORDER BY rank)
    || chr(10) || '### Local Explanation (LIME):' || chr(10)
    || string_agg('- ' || feature || ': weight = ' || printf('%.4f', contribution) || chr(10), '' ORDER BY rank) AS narrative
  FROM ranked WHERE rank <= 5 GROUP BY TransactionID""", POS + "," + XAI)
q("set2", """SELECT 'real' AS origin, isFraud, CAST(count(*) AS BIGINT) AS n FROM pos, hb WHERE pos < train_end GROUP BY isFraud
  UNION ALL SELECT 'synthetic', 1, CAST(floor(0.30::DOUBLE * count(*) FILTER (isFraud <> 1)) AS BIGINT) - count(*) FILTER (isFraud = 1)
  FROM pos, hb WHERE pos < train_end""", POS)

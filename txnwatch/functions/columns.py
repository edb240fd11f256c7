"""Scalar column helpers (all JVM-side Spark expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Round a double to 6 places for reporting.

    A 1e-9 nudge keeps exact decimal halves (means of cent amounts) away from
    the rounding boundary so that two engines whose sums differ in the last
    bit still print the same value.
    """
    return F.round(col(c) + F.lit(1e-9), 6)



def seconds_since(ts, epoch: str = "2024-01-01 00:00:00") -> Column:
    """Whole seconds (floor) from ``epoch`` to a TIMESTAMP_NTZ.

    Built from the date difference and the wall-clock fields, which never
    consult the session time zone (a zone-based cast would shift by an hour
    across a daylight-saving change)."""
    c = col(ts).cast("timestamp_ntz")
    e_date, _, e_time = epoch.partition(" ")
    hh, mm, ss = (int(x) for x in (e_time or "00:00:00").split(":"))
    days = F.datediff(c.cast("date"), F.lit(e_date).cast("date")).cast("long")
    return (days * SECONDS_PER_DAY + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
            - F.lit(hh * 3600 + mm * 60 + ss)).cast("long")


def days_since(ts, epoch: str = "1995-01-01") -> Column:
    return F.datediff(col(ts).cast("timestamp_ntz").cast("date"), F.lit(epoch).cast("date"))


# --- PRJ3: time features (day of week is relative to the dataset epoch) -----

def hour_of_day(dt) -> Column:
    return F.floor(F.pmod(col(dt), F.lit(SECONDS_PER_DAY)) / 3600).cast("int")


def day_of_week(dt) -> Column:
    return F.pmod(F.floor(col(dt) / SECONDS_PER_DAY), F.lit(7)).cast("int")


def time_feature_columns(dt="TransactionDT") -> dict[str, Column]:
    hour = hour_of_day(dt)
    dow = day_of_week(dt)
    return {
        "hour": hour,
        "day_of_week": dow,
        "is_night": ((hour >= 22) | (hour <= 5)).cast("int"),
        "is_weekend": (dow >= 5).cast("int"),
    }


# --- PRJ4/PRJ5: pseudo-client UID -------------------------------------------

def d1_normalized(dt="TransactionDT", d1="D1") -> Column:
    """``round_half_even(dt / 86400) - D1``; missing -> -999; truncated to int."""
    raw = F.rint(col(dt) / F.lit(float(SECONDS_PER_DAY))) - col(d1)
    return F.coalesce(raw, F.lit(-999.0)).cast("int")


def uid_column(card1="card1", addr1="addr1", d1n="D1n") -> Column:
    # coalesce before concatenation: concat_ws silently drops NULL parts
    addr = F.coalesce(col(addr1).cast("double").cast("int"), F.lit(-1))
    return F.concat_ws("_", col(card1).cast("string"), addr.cast("string"), col(d1n).cast("string"))


# --- PRJ7: match flags --------------------------------------------------------

def match_flag(c) -> Column:
    """'T' -> 1, 'F' -> 0, anything else -> -1."""
    return (F.when(col(c) == "T", F.lit(1.0))
            .when(col(c) == "F", F.lit(0.0))
            .otherwise(F.lit(-1.0)))


# --- PRJ8/PRJ9 ----------------------------------------------------------------

def cross_feature_columns(amount="TransactionAmt", hour="hour",
                          is_weekend="is_weekend", is_night="is_night",
                          columns: list[str] | None = None) -> dict[str, Column]:
    present = set(columns or [hour, is_weekend, is_night])
    if hour not in present:
        return {}
    wk = col(is_weekend) if is_weekend in present else F.lit(0)
    nt = col(is_night) if is_night in present else F.lit(0)
    return {
        "Amt_x_Hour": col(amount) * col(hour),
        "Amt_x_isWeekend": col(amount) * wk,
        "Amt_x_isNight": col(amount) * nt,
    }


def new_client_flag(count_col="UID_txn_count") -> Column:
    return (col(count_col) < 2).cast("int")


# --- DOC2: PaySim balance features -----------------------------------------------------

def paysim_balance_columns(step="step", amount="amount", old_orig="oldbalanceOrg", new_orig="newbalanceOrig",
                           ) -> dict[str, Column]:
    """Balance error, amount-to-balance ratio (``amount / (old balance + 1)``),
    full-transfer flag (the whole positive balance moved) and cyclical hour."""
    import math
    hour = F.pmod(col(step), F.lit(24)).cast("double")
    base = col(old_orig) + F.lit(1.0)
    return {
        "balance_error": col(old_orig) - col(amount) - col(new_orig),
        # a balance of -1 divides by zero, which is an error in Spark's SQL: the ratio is infinite there, as in IEEE arithmetic
        "amt_to_balance": F.when(base == 0, col(amount) * F.lit(math.inf)).otherwise(F.try_divide(col(amount), base)),
        "is_full_transfer": ((col(old_orig) > 0) & (col(amount) >= col(old_orig))).cast("int"),
        "hour_sin": F.sin(hour * F.lit(2 * math.pi / 24)),
        "hour_cos": F.cos(hour * F.lit(2 * math.pi / 24)),
    }

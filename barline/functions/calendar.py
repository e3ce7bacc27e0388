"""Clock and calendar expressions (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blackout windows in minutes of the day, both ends included.
BLACKOUT_MINUTES = (
    (745, 755),
    (805, 815),
    (835, 839),
    (840, 850),
    (895, 899),
    (900, 910),
    (1320, 1330),
    (0, 10),
    (50, 59),
)
# Named clock windows, minute of the day, [start, end).
CLUSTERS = {
    "london_open": (475, 480),
    "tokyo_fix": (55, 60),
    "ny_close_sell": (1259, 1264),
    "ny_post_close": (1265, 1270),
    "london_burst": (595, 600),
    "london_continuation": (601, 606),
}
# Sessions by UTC hour, [start, end).
SESSIONS = {"Asian": (0, 8), "London": (8, 13), "Overlap": (13, 17), "NY_late": (17, 22)}
ALWAYS_OPEN = ("BTCUSD", "ETHUSD")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def second_of_day(ts: Column) -> Column:
    return minute_of_day(ts) * 60 + F.second(ts).cast("int")



def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def is_blackout(ts: Column) -> Column:
    m = minute_of_day(ts)
    hit = F.lit(False)
    for lo, hi in BLACKOUT_MINUTES:
        hit = hit | m.between(lo, hi)
    return hit


def in_cluster(ts: Column, name: str) -> Column:
    if name not in CLUSTERS:
        return F.lit(False)
    lo, hi = CLUSTERS[name]
    m = minute_of_day(ts)
    return (m >= lo) & (m < hi)


def cluster_name(ts: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name in CLUSTERS:
        expr = F.when(in_cluster(ts, name), name).otherwise(expr)
    return expr


def session_name(ts: Column) -> Column:
    h = F.hour(ts)
    expr = F.lit("closed")
    for name, (lo, hi) in SESSIONS.items():
        expr = F.when((h >= lo) & (h < hi), name).otherwise(expr)
    return expr


def is_market_closed(symbol: Column, ts: Column, always_open: tuple[str, ...] = ALWAYS_OPEN) -> Column:
    """Friday 22:00 to Sunday 22:00, except for symbols that always trade."""
    d, h = F.weekday(ts), F.hour(ts)
    closed = ((d == 4) & (h >= 22)) | (d == 5) | ((d == 6) & (h < 22))
    return closed & ~symbol.isin(*always_open)


def month_position(ts: Column) -> Column:
    day = F.dayofmonth(ts)
    return F.when(day <= 10, "early").when(day <= 20, "mid").otherwise("late")


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def is_first_friday(ts: Column) -> Column:
    return (F.dayofmonth(ts) <= 7) & (F.weekday(ts) == 4)


def duration_bucket(hold_bars: Column, bar_minutes: Column) -> Column:
    return F.when(hold_bars * bar_minutes <= 60, "0-60m").otherwise("60-120m")

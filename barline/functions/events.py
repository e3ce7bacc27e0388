"""Scheduled macro events: fixed calendars and the windows around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Announcement date, UTC hour, direction (+1, 0, -1).
FOMC = (
    ("2022-01-26", 19, -1),
    ("2022-03-16", 18, 1),
    ("2022-05-04", 18, 1),
    ("2022-06-15", 18, 1),
    ("2022-07-27", 18, 1),
    ("2022-09-21", 18, 1),
    ("2022-11-02", 18, 1),
    ("2022-12-14", 19, 1),
    ("2023-01-25", 19, 1),
    ("2023-03-22", 18, 1),
    ("2023-05-03", 18, 0),
    ("2023-06-14", 18, -1),
    ("2023-07-26", 18, -1),
    ("2023-09-20", 18, 0),
    ("2023-11-01", 18, 0),
    ("2023-12-13", 19, 1),
    ("2024-01-31", 19, 1),
    ("2024-03-20", 18, 1),
    ("2024-05-01", 18, 1),
    ("2024-06-12", 18, 1),
    ("2024-07-31", 18, -1),
    ("2024-09-18", 18, -1),
    ("2024-11-07", 19, -1),
    ("2024-12-18", 19, 1),
    ("2025-01-29", 19, 1),
    ("2025-03-19", 18, 1),
    ("2025-05-07", 18, 1),
    ("2025-06-18", 18, 1),
    ("2025-07-30", 18, 1),
    ("2025-09-17", 18, -1),
    ("2025-10-29", 18, 1),
    ("2025-12-10", 19, 1),
    ("2026-01-28", 19, 1),
    ("2026-03-18", 18, 1),
)
ECB = (
    ("2022-02-03", 13, 0),
    ("2022-03-10", 13, 1),
    ("2022-04-14", 12, 1),
    ("2022-06-09", 12, 1),
    ("2022-07-21", 12, 1),
    ("2022-09-08", 12, 1),
    ("2022-10-27", 12, 1),
    ("2022-12-15", 13, 1),
    ("2023-02-02", 13, 1),
    ("2023-03-16", 13, 1),
    ("2023-05-04", 12, 1),
    ("2023-06-15", 12, 0),
    ("2023-07-27", 12, -1),
    ("2023-09-07", 12, -1),
    ("2023-10-26", 12, -1),
    ("2023-12-07", 13, -1),
    ("2024-01-25", 13, 0),
    ("2024-03-07", 13, 0),
    ("2024-04-11", 12, 0),
    ("2024-06-06", 12, -1),
    ("2024-07-18", 12, 0),
    ("2024-09-12", 12, -1),
    ("2024-10-17", 12, -1),
    ("2024-12-12", 13, -1),
    ("2025-01-30", 13, -1),
    ("2025-03-06", 13, -1),
    ("2025-04-17", 12, -1),
    ("2025-06-05", 12, -1),
    ("2025-07-24", 12, 0),
    ("2025-09-11", 12, 0),
    ("2025-10-30", 13, 0),
    ("2025-12-18", 13, 0),
)
NFP = (
    ("2022-01-07", 13, 1),
    ("2022-02-04", 13, 1),
    ("2022-03-04", 13, 1),
    ("2022-04-01", 12, 1),
    ("2022-05-06", 12, 1),
    ("2022-06-03", 12, 1),
    ("2022-07-01", 12, 1),
    ("2022-08-05", 12, -1),
    ("2022-09-02", 12, -1),
    ("2022-10-07", 12, -1),
    ("2022-11-04", 12, -1),
    ("2022-12-02", 13, 1),
    ("2023-01-06", 13, 1),
    ("2023-02-03", 13, 0),
    ("2023-03-10", 13, 1),
    ("2023-04-07", 12, -1),
    ("2023-05-05", 12, -1),
    ("2023-06-02", 12, 0),
    ("2023-07-07", 12, 1),
    ("2023-08-04", 12, 0),
    ("2023-09-01", 12, -1),
    ("2023-10-06", 12, 0),
    ("2023-11-03", 12, -1),
    ("2023-12-01", 13, 0),
    ("2024-01-05", 13, 1),
    ("2024-02-02", 13, 1),
    ("2024-03-08", 13, 1),
    ("2024-04-05", 12, 1),
    ("2024-05-03", 12, -1),
    ("2024-06-07", 12, 1),
    ("2024-07-05", 12, 0),
    ("2024-08-02", 12, -1),
    ("2024-09-06", 12, -1),
    ("2024-10-04", 12, 1),
    ("2024-11-01", 12, -1),
    ("2024-12-06", 13, 1),
    ("2025-01-10", 13, 1),
    ("2025-02-07", 13, -1),
    ("2025-03-07", 13, 0),
    ("2025-04-04", 12, 1),
    ("2025-05-02", 12, 1),
    ("2025-06-06", 12, 0),
    ("2025-07-03", 12, 1),
    ("2025-08-01", 12, -1),
    ("2025-09-05", 12, -1),
    ("2025-12-16", 13, 1),
)
# BOJ windows run 02:00-06:00 and carry no direction (long only).
BOJ = (
    ("2024-01-23", 2, 1),
    ("2024-03-19", 2, 1),
    ("2024-04-26", 2, 1),
    ("2024-06-14", 2, 1),
    ("2024-07-31", 2, 1),
    ("2024-09-20", 2, 1),
    ("2024-10-31", 2, 1),
    ("2024-12-19", 2, 1),
    ("2025-01-24", 2, 1),
    ("2025-03-19", 2, 1),
    ("2025-05-01", 2, 1),
    ("2025-06-17", 2, 1),
    ("2025-07-31", 2, 1),
    ("2025-09-19", 2, 1),
    ("2025-10-30", 2, 1),
    ("2025-12-19", 2, 1),
)
WINDOW_HOURS = {"boj": 4, "ecb": 1, "fomc": 1, "nfp": 1}
# Smallest entry offset in bars after a window's end.
MIN_OFFSET = {"boj": 1, "ecb": 2, "fomc": 2, "nfp": 2}


def calendar_rows(source: str) -> list[tuple[str, str, int, int]]:
    return [(source, *event) for event in {"boj": BOJ, "ecb": ECB, "fomc": FOMC, "nfp": NFP}[source]]


def event_windows(spark: SparkSession, sources: tuple[str, ...] = ("boj", "ecb", "fomc", "nfp")) -> DataFrame:
    """``source, day, start, end, direction``: union of the calendars (112 rows)."""
    rows = [r for s in sources for r in calendar_rows(s)]
    hours = F.create_map(*[F.lit(x) for kv in WINDOW_HOURS.items() for x in kv])
    cal = spark.createDataFrame(rows, "source STRING, day STRING, hour INT, direction INT")
    start = F.to_timestamp(F.concat_ws(" ", "day", F.format_string("%02d:00:00", "hour")))
    return cal.select(
        "source",
        F.to_date("day").alias("day"),
        start.alias("start"),
        (start + F.make_dt_interval(hours=hours[F.col("source")])).alias("end"),
        "direction",
    )

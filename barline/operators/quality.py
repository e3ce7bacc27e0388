"""Filters, guards, contracts and quarantine splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.bars import TIMEFRAME_MINUTES
from barline.operators.indicators import by


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_or(c: Column, default: float | None) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(default))


def in_unit_range(c: Column) -> Column:
    """Finite and in (0, 1]; NULL and NaN are rejected."""
    return is_finite(c) & (c > 0) & (c <= 1)


def last_days(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Rows within ``days`` of the latest timestamp in the data."""
    latest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= latest - F.expr(f"INTERVAL {days} DAY"))


def active_pool(cells: DataFrame, stances: Sequence[str]) -> DataFrame:
    """Passing, not killed, wanted stance; absent columns do not filter."""
    out = cells
    if "pass_flag" in cells.columns:
        out = out.filter("pass_flag")
    if "kill" in cells.columns:
        out = out.filter("NOT kill")
    if "stance" in cells.columns:
        out = out.filter(F.col("stance").isin(*stances))
    return out


def bucket_filter(cells: DataFrame, labels: DataFrame, allowed: Sequence[str], mode: str) -> DataFrame:
    """Keep flag by volatility bucket; in neutral mode every cell passes."""
    joined = cells.join(labels, "cell_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("VOL_NA")))
    joined = joined.withColumn("bucket", F.regexp_replace("bucket", "^VOL_", ""))
    keep = F.lit(True) if mode == "neutral" else F.col("bucket").isin(*allowed)
    return joined.withColumn("pass_flag", keep).withColumn("mode", F.lit(mode))


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text trade rows split into typed rows and ``(row_index, field, reason)``.

    The first failing field in a fixed order names the reason.
    """
    ts = F.try_to_timestamp("ts_text", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    price, amount = F.expr("try_cast(price AS DOUBLE)"), F.expr("try_cast(amount AS DOUBLE)")
    fault = (
        F.when(ts.isNull(), "timestamp:unparsable")
        .when(~F.col("side").isin("buy", "sell"), "side:not_allowed")
        .when(price.isNull(), "price:not_numeric")
        .when(price <= 0, "price:not_positive")
        .when(amount.isNull(), "amount:not_numeric")
        .when(amount <= 0, "amount:not_positive")
    )
    checked = raw.withColumn("_fault", fault)
    good = checked.filter("_fault IS NULL").select(
        "row_index", ts.alias("ts"), "side", price.alias("price"), amount.alias("amount")
    )
    part = F.split("_fault", ":")
    bad = checked.filter("_fault IS NOT NULL").select(
        "row_index", part.getItem(0).alias("field"), part.getItem(1).alias("reason")
    )
    return good, bad


def bar_violations(bars: DataFrame, timeframe: str) -> DataFrame:
    """Rows that break the bar contract, with the first rule they break."""
    prev = F.lag("ts").over(by(["symbol"]))
    step = F.unix_micros("ts") - F.unix_micros(prev)
    bad_value = F.lit(False)
    for c in ("open", "high", "low", "close", "volume"):
        bad_value = bad_value | ~is_finite(F.col(c))
    rule = (
        F.when(step <= 0, "not_increasing")
        .when(step != TIMEFRAME_MINUTES[timeframe] * 60_000_000, "gap")
        .when(bad_value, "non_finite")
        .when(F.col("close") <= 0, "non_positive_close")
    )
    return bars.withColumn("violation", rule).filter("violation IS NOT NULL").select("symbol", "ts", "violation")


def unexpected_values(df: DataFrame, required: Sequence[str], column: str, allowed: Sequence[str]) -> DataFrame:
    """Values of ``column`` outside ``allowed``; missing columns are an error."""
    missing = [c for c in [*required, column] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    outside = df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))
    return outside.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def embargo_violations(df: DataFrame, input_ts: str, limit: Column) -> DataFrame:
    """Rows whose latest input is not strictly before the limit."""
    return df.filter(F.col(input_ts) >= limit)


def sign_of(trades: Column, pf: Column) -> Column:
    """0 without trades or profit factor, else +1 from 1.0 on, else -1."""
    return F.when((trades == 0) | pf.isNull(), 0).when(pf >= 1.0, 1).otherwise(-1)

"""Indicators over bars, as window expressions per key.

Bars are bounded per key by ``time span / timeframe``, so a window partitioned
by the key is a bounded task.  Undefined values are NULL until the full period
is there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(keys: Sequence[str], order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _full(c: Column, n: int, frame: WindowSpec, value: Column) -> Column:
    return F.when(F.count(c).over(frame) == n, value)


def sma(c: Column, n: int, w: WindowSpec, nulls_stick: bool = False) -> Column:
    """Mean of the last ``n`` values.

    ``nulls_stick`` keeps the result undefined from the first undefined input
    on, as a running sum does.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    value = _full(c, n, frame, F.avg(c).over(frame))
    if not nulls_stick:
        return value
    seen = F.max(c.isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(~seen, value)


def true_range(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    hl = F.col("high") - F.col("low")
    return F.greatest(hl, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def rolling_std(c: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return _full(c, n, frame, F.stddev_samp(c).over(frame))


def rolling_max(c: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) == n, F.max(c).over(frame))


def rolling_min(c: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) == n, F.min(c).over(frame))


def rolling_quantile(c: Column, n: int, q: float, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return _full(c, n, frame, F.percentile(c, F.lit(q)).over(frame))


def rolling_median(c: Column, n: int, w: WindowSpec) -> Column:
    return rolling_quantile(c, n, 0.5, w)


def roc(c: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(c, F.lag(c, n).over(w)) - 1


def parkinson(n: int, w: WindowSpec) -> Column:
    term = F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0)) / (4 * math.log(2))
    frame = w.rowsBetween(-(n - 1), 0)
    return _full(term, n, frame, F.sqrt(F.avg(term).over(frame)))


def log_return(w: WindowSpec) -> Column:
    return F.log(F.col("close") / F.lag("close").over(w))


def with_atr(df: DataFrame, keys: Sequence[str], n: int, name: str = "atr") -> DataFrame:
    w = by(keys)
    return df.withColumn("_tr", true_range(w)).withColumn(name, sma(F.col("_tr"), n, w)).drop("_tr")


def with_recursive_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    alpha: float,
    name: str,
    seed_row: int = 1,
    order: str = "ts",
) -> DataFrame:
    """``y = a*x + (1-a)*y_prev`` from ``y = x`` at ``seed_row``.

    The recursion is linear, so it splits into blocks: inside a block a prefix
    sum of decayed values, plus the three blocks before it (their decay is 1e-6
    per block, so older ones are below the precision of a double).  Three
    prefix sums instead of a frame of hundreds of rows per row.
    """
    keep = 1.0 - alpha
    size = max(1, math.ceil(math.log(1e-6) / math.log(keep))) if keep > 0 else 1
    w = by(keys, order)
    pos = F.col("_pos") - seed_row
    j = F.pmod(F.col("_pos") - seed_row, F.lit(size)).cast("double")
    work = df.withColumn("_pos", F.row_number().over(w)).withColumn("_blk", F.floor(pos / size))
    weight = F.when(F.col("_pos") == seed_row, 1.0).when(F.col("_pos") > seed_row, alpha)
    work = work.withColumn("_x", value * weight).withColumn("_j", j)
    inside = Window.partitionBy(*keys, "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = F.pow(F.lit(keep), F.col("_j")) * F.sum(F.col("_x") * F.pow(F.lit(keep), -F.col("_j"))).over(inside)
    tail = F.col("_x") * F.pow(F.lit(keep), size - 1 - F.col("_j"))
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    carry = sum(
        (F.coalesce(F.sum(tail).over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) * keep ** (size * (k - 1)) for k in (1, 2, 3)),
        F.lit(0.0),
    )
    result = local + F.pow(F.lit(keep), F.col("_j") + 1) * carry
    return work.withColumn(name, F.when(F.col("_pos") >= seed_row, result)).drop("_pos", "_blk", "_x", "_j")


def with_ema(df: DataFrame, keys: Sequence[str], value: Column, span: int, name: str) -> DataFrame:
    """Exponential mean, a = 2/(span+1), seeded by the first value."""
    return with_recursive_mean(df, keys, value, 2.0 / (span + 1), name)


def with_wilder_atr(df: DataFrame, keys: Sequence[str], n: int = 14, name: str = "watr") -> DataFrame:
    """Wilder ATR: mean of the first ``n`` true ranges, then a = 1/n."""
    w = by(keys)
    work = df.withColumn("_tr", true_range(w))
    work = work.withColumn("_rn", F.row_number().over(w)).withColumn("_m", sma(F.col("_tr"), n, w))
    work = work.withColumn("_seeded", F.when(F.col("_rn") == n, F.col("_m")).otherwise(F.col("_tr")))
    done = with_recursive_mean(work, keys, F.col("_seeded"), 1.0 / n, name, seed_row=n)
    return done.drop("_tr", "_rn", "_m", "_seeded")


def with_rsi(df: DataFrame, keys: Sequence[str], n: int, value: Column | None = None, name: str = "rsi") -> DataFrame:
    """Wilder RSI seeded by the first change; 100 when there is no loss."""
    w = by(keys)
    x = F.col("close") if value is None else value
    work = df.withColumn("_d", x - F.lag(x).over(w))
    work = work.withColumn("_up", F.greatest(F.col("_d"), F.lit(0.0))).withColumn(
        "_down", F.greatest(-F.col("_d"), F.lit(0.0))
    )
    work = with_recursive_mean(work, keys, F.col("_up"), 1.0 / n, "_gain", seed_row=2)
    work = with_recursive_mean(work, keys, F.col("_down"), 1.0 / n, "_loss", seed_row=2)
    work = work.withColumn("_rn", F.row_number().over(w))
    level = F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.try_divide("_gain", "_loss"))).otherwise(100.0)
    return work.withColumn(name, F.when(F.col("_rn") >= max(3, n + 1), level)).drop(
        "_d", "_up", "_down", "_gain", "_loss", "_rn"
    )

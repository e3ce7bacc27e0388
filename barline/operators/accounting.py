"""Position and return accounting over signal and price columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.indicators import by

BOTH, LONG_ONLY, SHORT_ONLY = 0, 1, 2


def hour_cost_factor(ts: Column) -> Column:
    """Cost multiplier by UTC hour (0-1: 0.8, 21: 2.0, else 1.0)."""
    h = F.hour(ts)
    return F.when(h.isin(0, 1), 0.8).when(h == 21, 2.0).otherwise(1.0)


def sticky_position(keys: Sequence[str], mode: int = BOTH, flatten: bool = True) -> Column:
    """Position held on a bar: the last non-zero signal before it.

    +-2 flattens; where ``flatten`` is off those codes count as directions.
    """
    earlier = by(keys).rowsBetween(Window.unboundedPreceding, -1)
    sig = F.col("signal")
    held = F.coalesce(F.last(F.when(sig != 0, sig), ignorenulls=True).over(earlier), F.lit(0)).cast("int")
    if flatten:
        held = F.when(F.abs(held) == 2, 0).otherwise(held)
    if mode == LONG_ONLY:
        return F.greatest(held, F.lit(0))
    if mode == SHORT_ONLY:
        return F.least(held, F.lit(0))
    return held


def account(
    df: DataFrame,
    keys: Sequence[str],
    fee: float | Column,
    mode: int = BOTH,
    size: float = 1.0,
    hourly_fee: bool = False,
) -> DataFrame:
    """Per-bar ``position``, ``traded``, ``ret`` and ``equity`` for each key.

    A signal moves the position on the next bar, and a position earns from the
    bar after: two bars from signal to return.  The hour-dependent fee variant
    does not know the flatten code.
    """
    w = by(keys)
    work = df.withColumn("position", sticky_position(keys, mode, flatten=not hourly_fee))
    work = work.withColumn("_prev", F.lag("position").over(w)).withColumn("_pc", F.lag("close").over(w))
    traded = F.coalesce(F.abs(F.col("position") - F.col("_prev")), F.lit(0))
    cost = F.lit(fee) if not isinstance(fee, Column) else fee
    if hourly_fee:
        cost = cost * hour_cost_factor(F.col("ts"))
    move = F.col("_prev") * (F.col("close") - F.col("_pc")) / F.col("_pc")
    work = work.withColumn("traded", traded).withColumn(
        "ret", F.coalesce((move - F.col("traded") * cost) * size, F.lit(0.0))
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return work.withColumn("equity", F.product(1 + F.col("ret")).over(so_far)).drop("_prev", "_pc")


def with_drawdown(df: DataFrame, keys: Sequence[str], equity: str = "equity") -> DataFrame:
    peak = F.max(equity).over(by(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("peak", peak).withColumn("drawdown", (F.col(equity) - F.col("peak")) / F.col("peak"))


def performance(accounted: DataFrame, keys: Sequence[str], ppy: float) -> DataFrame:
    """Metrics per key; ``profit_factor`` is NULL when there is no loss."""
    dd = with_drawdown(accounted, keys)
    ret = F.col("ret")
    gain = F.sum(F.when(ret > 0, ret).otherwise(0.0))
    loss = F.sum(F.when(ret < 0, -ret).otherwise(0.0))
    trades = F.count_if(F.col("traded") > 0)
    wins = F.count_if((F.col("traded") > 0) & (ret > 0))
    spread = F.stddev_samp("ret")
    return (
        dd.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("bars"),
            (F.max_by("equity", "ts") - 1).alias("total_return"),
            F.when(spread > 0, F.avg("ret") / spread * math.sqrt(ppy)).otherwise(0.0).alias("sharpe"),
            F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
            F.coalesce(F.try_divide(wins, trades), F.lit(0.0)).alias("win_rate"),
            trades.alias("trades"),
            gain.alias("gross_profit"),
            loss.alias("gross_loss"),
        )
        .withColumn("profit_factor", F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")))
    )

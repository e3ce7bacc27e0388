"""Weights, combined equity and portfolio metrics over slots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.stats import correlation
from barline.operators.coverage import present_in_all
from barline.operators.indicators import by

TINY = 1e-12


def slot_returns(equity: DataFrame) -> DataFrame:
    """Returns between consecutive common timestamps: ``slot, ts, r``."""
    common = present_in_all(equity, "slot", "ts")
    prev = F.lag("equity").over(by(["slot"]))
    r = F.when(F.abs(prev) > TINY, F.col("equity") / prev - 1).otherwise(0.0)
    return common.withColumn("_p", prev).withColumn("r", r).filter("_p IS NOT NULL").select("slot", "ts", "r")


def weights(returns: DataFrame) -> DataFrame:
    """Equal and inverse-volatility weights per slot.

    A slot without volatility gets no weight; without any volatility at all,
    weights are equal.  One row per slot.
    """
    vol = returns.groupBy("slot").agg(F.stddev_pop("r").alias("vol"))
    inv = vol.withColumn("_inv", F.when(F.col("vol") < TINY, 0.0).otherwise(F.try_divide(F.lit(1.0), "vol")))
    every = Window.partitionBy(F.lit(1))
    total, n = F.sum("_inv").over(every), F.count(F.lit(1)).over(every)
    return inv.select(
        "slot",
        "vol",
        (1.0 / n).alias("equal"),
        F.when(total < TINY, 1.0 / n).otherwise(F.col("_inv") / total).alias("inverse_vol"),
    )


def combined_returns(returns: DataFrame, w: DataFrame, weight: str) -> DataFrame:
    """Weighted portfolio return per timestamp (a sum over slots)."""
    joined = returns.join(w.select("slot", F.col(weight).alias("_w")), "slot")
    return joined.groupBy("ts").agg(F.sum(F.col("r") * F.col("_w")).alias("r"))


def combined_equity(portfolio: DataFrame) -> DataFrame:
    """Equity from 1.0; one row per bar of the common clock."""
    w = Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return portfolio.withColumn("equity", F.product(1 + F.col("r")).over(w))


def portfolio_metrics(portfolio: DataFrame, ppy: float) -> DataFrame:
    """Sharpe (population sd), max drawdown, CAGR and Calmar."""
    w = Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    eq = combined_equity(portfolio)
    eq = eq.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(1.0)))
    sd = F.stddev_pop("r")
    agg = eq.agg(
        F.count(F.lit(1)).alias("bars"),
        F.when(sd < TINY, 0.0).otherwise(F.avg("r") / sd * math.sqrt(ppy)).alias("sharpe"),
        F.least(F.min((F.col("equity") - F.col("peak")) / F.col("peak")), F.lit(0.0)).alias("max_drawdown"),
        F.max_by("equity", "ts").alias("last_equity"),
    )
    ratio = F.col("last_equity")
    cagr = F.when(ratio <= 0, -1.0).otherwise(F.pow(ratio, ppy / (F.col("bars") + 1)) - 1)
    agg = agg.withColumn("cagr", cagr)
    return agg.withColumn(
        "calmar", F.when(F.abs("max_drawdown") < TINY, 0.0).otherwise(F.col("cagr") / F.abs("max_drawdown"))
    )


def mean_pairwise_correlation(returns: DataFrame) -> DataFrame:
    """Mean Pearson correlation over slot pairs; null over 0 pairs where there are fewer than two series.

    The series that have a return at a time are one row (as many as the portfolio
    has slots), which unfolds to its pairs; the moments of the pairs are partial
    sums, so there is no self join and no name leaves the executors.
    """
    at_once = returns.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("slot", "r"))).alias("s"))
    pair = lambda x, i: F.transform(
        F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x["slot"].alias("a"), y["slot"].alias("b"), x["r"].alias("x"), y["r"].alias("y"))
    )
    pairs = at_once.select(F.explode(F.flatten(F.transform("s", pair))).alias("p")).select("p.*")
    each = pairs.filter("a <> b").groupBy("a", "b").agg(correlation("x", "y").alias("c"))
    return each.agg(F.avg("c").alias("mean_correlation"), F.count("c").alias("pairs"))

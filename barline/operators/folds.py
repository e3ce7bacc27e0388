"""Trade and fold metrics per key; history splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.indicators import by
from barline.operators.quantiles import exact_percentiles


def profit_factor(df: DataFrame, keys: Sequence[str], pnl: Column) -> DataFrame:
    """Gross sums and profit factor; NULL plus a flag when there is no loss."""
    agg = df.groupBy(*keys).agg(
        F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("gross_profit"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)).alias("gross_loss"),
    )
    gp, gl = F.col("gross_profit"), F.col("gross_loss")
    return agg.withColumn("pf", F.when(gl > 0, gp / gl).when(gp > 0, None).otherwise(0.0)).withColumn(
        "pf_infinite", (gl <= 1e-12) & (gp > 0)
    )


def costed_metrics(trades: DataFrame, keys: Sequence[str], scenarios: dict[str, tuple[float, float]]) -> DataFrame:
    """Net metrics per scenario ``name -> (cost bps, turnover multiplier)``."""
    specs = F.array(
        *[F.struct(F.lit(n).alias("scenario"), F.lit(c * t).alias("total_cost"), F.lit(t).alias("turn")) for n, (c, t) in scenarios.items()]
    )
    work = trades.select(*keys, "pnl", F.explode(specs).alias("s")).select(*keys, "pnl", "s.*")
    net = F.col("pnl") - F.col("total_cost")
    gain, loss = F.sum(F.when(net > 0, net).otherwise(0.0)), F.sum(F.when(net < 0, -net).otherwise(0.0))
    out = work.groupBy("scenario", *keys, "total_cost", "turn").agg(
        F.count(F.lit(1)).alias("trades"),
        F.try_divide(gain, loss).alias("net_pf"),
        F.avg(net).alias("expectancy"),
    )
    return out.withColumn("turnover", F.col("turn") * F.col("trades")).drop("turn")


def expected_shortfall(df: DataFrame, keys: Sequence[str], pnl: Column, q: float = 0.05, min_rows: int = 20) -> DataFrame:
    """|mean| of the rows at or below the q-quantile; NULL below ``min_rows``."""
    limit = exact_percentiles(df, keys, pnl, {"_cut": q})
    tail = df.join(limit, list(keys)).groupBy(*keys).agg(
        F.max("n").alias("n"), F.abs(F.avg(F.when(pnl <= F.col("_cut"), pnl))).alias("es")
    )
    return tail.withColumn("es", F.when(F.col("n") >= min_rows, F.col("es")))


def daily(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and day (so at most one per day in later windows)."""
    return df.groupBy(*keys, F.date_trunc("day", "ts").alias("ts")).agg(
        F.sum("pnl").alias("pnl"), (F.max("qty") > 40).cast("int").alias("flag")
    )


def turnover_sharpe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily mean / population sd, divided by flag transitions per day."""
    days = daily(df, keys).withColumn("d", F.abs(F.col("flag") - F.lag("flag").over(by(keys))))
    per_day = F.sum("d") / F.count(F.lit(1))
    raw = F.try_divide(F.avg("pnl"), F.stddev_pop("pnl"))
    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("d").alias("transitions"),
        (raw / F.when(per_day > 0, per_day).otherwise(1.0)).alias("turnover_sharpe"),
    )


def calmar(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Annualised return over maximum drawdown of the daily equity."""
    so_far = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    eq = daily(df, keys).withColumn("e", 1 + F.sum(F.col("pnl") / 10_000).over(so_far))
    eq = eq.withColumn("peak", F.max("e").over(so_far)).withColumn("dd", (F.col("peak") - F.col("e")) / F.col("peak"))
    agg = eq.groupBy(*keys).agg(
        F.max_by("e", "ts").alias("last_equity"),
        F.min_by("e", "ts").alias("first_equity"),
        F.max("dd").alias("max_dd"),
        F.count(F.lit(1)).alias("n"),
    )
    annual = F.pow(F.col("last_equity") / F.col("first_equity"), 252.0 / F.col("n")) - 1
    return agg.select(*keys, "last_equity", "max_dd", F.try_divide(annual, F.col("max_dd")).alias("calmar"))


def rule_shares(df: DataFrame, rule: str) -> DataFrame:
    """Count, share, profit factor and mean per exit rule."""
    p = F.col("pnl")
    agg = df.groupBy(rule).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))).alias("pf"),
        F.avg(p).alias("mean_pnl"),
    )
    total = agg.agg(F.sum("n")).scalar()
    return agg.withColumn("share", F.col("n") / total)

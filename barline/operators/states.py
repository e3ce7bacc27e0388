"""Streaks, holds, deferred signals, clusters and other ordered states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.stats import correlation
from barline.operators.indicators import by
from barline.operators.series import Run, rolling, running


def rolling_z(c: Column, n: int, w: WindowSpec) -> Column:
    """(x - mean) / sample sd of the last ``n`` rows; 0 where undefined."""
    f = w.rowsBetween(-(n - 1), 0)
    sd = F.when(F.count(c).over(f) == n, F.stddev_samp(c).over(f))
    return F.coalesce(F.try_divide(c - F.avg(c).over(f), sd), F.lit(0.0))


def pooled_quantiles(df: DataFrame, value: str, window_rows: int, qs: dict[str, float], order: Sequence[str]) -> DataFrame:
    """Rolling quantiles over all symbols together, in time order.

    The pooled series is one sequence; it is cut into blocks with a halo of
    ``window_rows`` rows, so no task sees all of it.
    """

    def exprs(w):
        f = w.rowsBetween(-(window_rows - 1), 0)
        return {n: F.percentile(value, F.lit(q)).over(f) for n, q in qs.items()}

    one = df.withColumn("_all", F.lit(1))
    return rolling(one, ["_all"], list(order), exprs, back=window_rows - 1, block_rows=max(20_000, window_rows)).drop("_all")


def vol_bucket(v: Column, q33: Column, q67: Column) -> Column:
    return F.when(v.isNull(), "VOL_NA").when(v < q33, "VOL_LOW").when(v < q67, "VOL_MID").otherwise("VOL_HIGH")


def daily_equity(trades: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Equity 1 + sum of daily pnl; at most one row per key and day."""
    day = trades.groupBy(*keys, "ts").agg((F.sum("pnl") / 10_000).alias("p"))
    return day.withColumn("equity", 1 + F.sum("p").over(by(list(keys)).rowsBetween(Window.unboundedPreceding, 0)))


def overlay_equity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First equity plus the running sum of ``m_t`` times the equity change."""
    w = by(keys)
    change = F.coalesce((F.col("equity") - F.lag("equity").over(w)) * F.col("m_t"), F.lit(0.0))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_c", change).withColumn(
        "equity_on", F.first("equity").over(so_far) + F.sum("_c").over(so_far)
    ).drop("_c")


def loss_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Consecutive losses so far: a win resets, a zero keeps.

    Losses so far minus losses so far at the last win; both are running values,
    so a long island of losses is never one task.
    """
    pnl = F.col("pnl")
    losses = {"_lost": Run("count", F.when(pnl < 0, 1))}
    at_win = {"_base": Run("last", F.when(pnl > 0, F.col("_lost")))}
    done = running(df, keys, order, losses, at_win)
    return done.withColumn("streak", F.col("_lost") - F.coalesce("_base", F.lit(0))).drop("_lost", "_base")


def trading_day_ordinals(days: DataFrame) -> DataFrame:
    month, quarter = F.date_trunc("month", "ts"), F.date_trunc("quarter", "ts")
    wm = Window.partitionBy("symbol", month)
    wq = Window.partitionBy("symbol", quarter)
    return days.select(
        "*",
        F.row_number().over(wm.orderBy("ts")).alias("day_no"),
        (F.count(F.lit(1)).over(wm) - F.row_number().over(wm.orderBy("ts"))).alias("days_left"),
        F.row_number().over(wq.orderBy("ts")).alias("q_day"),
        (F.count(F.lit(1)).over(wq) - F.row_number().over(wq.orderBy("ts"))).alias("q_left"),
    )


def defer_blackout(df: DataFrame, keys: Sequence[str], blackout: Column) -> DataFrame:
    """Entries inside a blackout wait for its end; the latest one wins.

    Flatten codes (+-2) pass at once and cancel a waiting entry.
    """
    w = by(keys)
    work = df.withColumn("_b", blackout)
    clear = F.count_if(~F.col("_b")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    work = work.withColumn("_seg", clear)
    inside = Window.partitionBy(*keys, "_seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    waiting = F.last(F.when(F.col("_b") & (F.col("signal") != 0), F.col("signal")), ignorenulls=True).over(inside)
    work = work.withColumn("_wait", waiting)
    out = (
        F.when(F.col("_b"), F.when(F.abs("signal") == 2, F.col("signal")).otherwise(0))
        .when(F.col("signal") != 0, F.col("signal"))
        .when(F.abs("_wait") == 1, F.col("_wait"))
        .otherwise(0)
    )
    return work.withColumn("signal", out.cast("int")).drop("_b", "_seg", "_wait")


def hold_bars(entry: Column, n: int, w: WindowSpec) -> Column:
    """1 on the ``n`` bars from an entry on; a later entry extends the hold."""
    return F.coalesce(F.max(F.when(entry, 1)).over(w.rowsBetween(-(n - 1), 0)), F.lit(0))


def stress_clusters(
    daily_level: DataFrame, window: int = 20, quantile: float = 0.99, gap_days: int = 5, top: int = 3
) -> DataFrame:
    """Runs of high rolling volatility, merged over gaps of up to ``gap_days``.

    Input is one row per day, so its ordered passes are small.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("ts")
    f = w.rowsBetween(-(window - 1), 0)
    vol = daily_level.withColumn("rvol", F.when(F.count("level").over(f) == window, F.stddev_samp("level").over(f)))
    vol = vol.filter("rvol IS NOT NULL")
    flagged = vol.filter(F.col("rvol") >= vol.agg(F.percentile("rvol", F.lit(quantile))).scalar())
    fresh = F.coalesce(F.datediff("ts", F.lag("ts").over(w)) > gap_days, F.lit(True))
    islands = flagged.withColumn("_new", fresh.cast("int")).withColumn(
        "_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    spans = islands.groupBy("_g").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("rvol").alias("peak_vol"), F.count(F.lit(1)).alias("n_bars")
    )
    best = spans.orderBy(F.desc("n_bars"), "start").limit(top)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_bars"), "start")) - 1
    return best.withColumn("cluster_id", rank).drop("_g")


def adjacent_correlation(df: DataFrame, axis: str, match: Sequence[str], value: str) -> DataFrame:
    """Correlation of each axis value with the next one over matching rows,
    and the median of those correlations.  The axis has few distinct values."""
    w = Window.partitionBy(F.lit(1)).orderBy(axis)
    nxt = df.select(axis).distinct().select(F.col(axis).alias("_a"), F.lead(axis).over(w).alias("_b")).filter("_b IS NOT NULL")
    left = df.select(*match, F.col(axis).alias("_a"), F.col(value).alias("_x")).join(nxt, "_a")
    right = df.select(*match, F.col(axis).alias("_b"), F.col(value).alias("_y"))
    pairs = left.join(right, [*match, "_b"]).groupBy("_a", "_b").agg(correlation("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))
    mid = pairs.agg(F.median("r")).scalar()
    return pairs.select(F.col("_a").alias(f"{axis}_a"), F.col("_b").alias(f"{axis}_b"), "r", "n", mid.alias("rho_bar"))

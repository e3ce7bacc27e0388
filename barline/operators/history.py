"""History splits and fold evaluation, parameter sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.draws import mix_value, uniform
from barline.operators.accounting import account, performance
from barline.operators.indicators import by
from barline.operators.lookup import rows_by_grid
from barline.operators.rules import ordered_pass, position_to_signal

DAYS_PER_MONTH = 30.44


def indexed_bars(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """0-based bar index and bar count per key."""
    return bars.withColumn("idx", F.row_number().over(by(keys)) - 1).withColumn(
        "n_bars", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )


def anchored_walks(bars: DataFrame, is_months: int, oos_months: int, num_walks: int) -> DataFrame:
    """``symbol, fold, is_end, oos_end`` in bar indices; the in-sample part starts at 0."""
    span = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000).alias("days"),
    )
    per_month = F.col("n_bars") / (F.col("days") / DAYS_PER_MONTH)
    walks = span.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
    months = is_months + F.col("fold") * oos_months
    cut = walks.withColumn("is_end", F.floor(months * per_month)).withColumn(
        "oos_end", F.floor((months + oos_months) * per_month)
    )
    return cut.filter("oos_end <= n_bars").select("symbol", "fold", "is_end", "oos_end")



def purged_folds(bars: DataFrame, k: int, embargo: int) -> DataFrame:
    """Each bar once per fold it belongs to: ``oos`` in the fold, ``is`` outside
    the fold and its embargo.  Keys too short for ``k`` folds give no rows."""
    b = indexed_bars(bars).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("n_bars") / k)
    start = F.col("fold") * size
    end = F.when(F.col("fold") == k - 1, F.col("n_bars")).otherwise((F.col("fold") + 1) * size)
    role = F.when((F.col("idx") >= start) & (F.col("idx") < end), "oos").when(
        (F.col("idx") < start - embargo) | (F.col("idx") >= end + embargo), "is"
    )
    return b.filter(size >= 2 * max(embargo, 1)).withColumn("role", role).filter("role IS NOT NULL")


def evaluate(
    df: DataFrame, keys: Sequence[str], signal: Callable[[DataFrame, list[str]], DataFrame], fee: float, ppy: float
) -> DataFrame:
    """Signal, accounting and metrics per key; the series restarts in each key."""
    return performance(account(signal(df, list(keys)), list(keys), fee), list(keys), ppy)


def walk_results(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """In-sample and out-of-sample metrics side by side; efficiency = OOS PF / IS PF."""
    wanted = ["profit_factor", "sharpe", "max_drawdown", "trades", "gross_profit", "gross_loss", "bars"]
    wide = metrics.groupBy(*keys).pivot("role", ["is", "oos"]).agg(*[F.first(c).alias(c) for c in wanted])
    ipf = F.col("is_profit_factor")
    opf = F.coalesce("oos_profit_factor", F.lit(float("inf")))
    return wide.withColumn("wfe", F.when(ipf > 0, opf / ipf).otherwise(0.0))


def aggregate_walks(walks: DataFrame, keys: Sequence[str], ppy: float, gates: dict[str, float]) -> DataFrame:
    """Combined metrics over a key's walks and the pass flag."""
    gp, gl = F.sum("oos_gross_profit"), F.sum("oos_gross_loss")
    out = walks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("walks"),
        F.when(gl > 0, gp / gl).when(gp > 0, float("inf")).otherwise(0.0).alias("combined_pf"),
        F.sum("oos_trades").alias("trades"),
        F.avg("oos_sharpe").alias("mean_sharpe"),
        F.avg(F.coalesce("wfe", F.lit(0.0))).alias("mean_wfe"),
        F.avg((F.coalesce("oos_profit_factor", F.lit(float("inf"))) > 1.0).cast("int")).alias("win_rate"),
        F.least(F.min("oos_max_drawdown"), F.lit(0.0)).alias("max_drawdown"),
        (F.sum("oos_trades") / F.sum("oos_bars") * ppy).alias("annual_trades"),
    )
    ok = (
        (F.col("combined_pf") >= gates["pf"])
        & (F.col("win_rate") >= gates["win_rate"])
        & (F.col("mean_wfe") >= gates["wfe"])
        & (F.col("annual_trades") >= gates["annual_trades"])
        & (F.col("max_drawdown") >= gates["max_drawdown"])
    )
    return out.withColumn("passed", ok)


def sweep(df: DataFrame, keys: Sequence[str], grid: Sequence[tuple[int, int]], fee: float, ppy: float) -> DataFrame:
    """Moving-average cross metrics per key and parameter pair, all in one job.

    Each distinct period is averaged once per bar, before the rows are repeated
    per pair.  The repeated rows are spread by (key, pair): with few symbols and
    many pairs, a partitioning by symbol alone would leave most tasks idle.
    """
    keys = list(keys)
    w = by(keys)

    def mean(n: int) -> Column:
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(f) == n, F.avg("close").over(f))

    periods = sorted({n for pair in grid for n in pair})
    averaged = df.select(*keys, "ts", "close", *[mean(n).alias(f"_m{n}") for n in periods])
    wide = rows_by_grid(averaged, [("short_n", "long_n")], grid)
    pick = lambda c: F.coalesce(*[F.when(F.col(c) == n, F.col(f"_m{n}")) for n in periods])
    side = F.when(pick("short_n") > pick("long_n"), 1).when(pick("short_n") < pick("long_n"), -1).otherwise(0)
    full = [*keys, "param_id", "short_n", "long_n"]
    work = wide.select(*full, "ts", "close", side.alias("position")).repartition(*[F.col(k) for k in full])
    return performance(account(position_to_signal(work, full), full, fee), full, ppy)


def jittered(base: tuple[int, int], n: int, pct: float, seed: int) -> list[tuple[int, int]]:
    """``n`` parameter pairs within +-pct (at least +-1) of ``base``."""
    out = []
    for rep in range(n):
        pair = []
        for i, v in enumerate(base):
            d = max(1, round(v * pct))
            pair.append(max(1, v - d + mix_value(i, rep, seed) % (2 * d + 1)))
        out.append((pair[0], pair[1]))
    return out


def robustness(pf_rows: DataFrame, keys: Sequence[str], pf: str = "profit_factor") -> DataFrame:
    """Spread of a profit factor over perturbed runs (population sd)."""
    agg = pf_rows.filter(F.col(pf).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(pf).alias("mean_pf"),
        F.stddev_pop(pf).alias("std_pf"),
        nearest_rank(pf, 5.0).alias("p5_pf"),
        nearest_rank(pf, 95.0).alias("p95_pf"),
    )
    return agg.withColumn("cliff", F.coalesce(F.try_divide("std_pf", "mean_pf") > 0.5, F.lit(False)))


def nearest_rank(value: str, pct: float) -> Column:
    """Element round(pct/100 * (n-1)) of a small group's sorted values."""
    values = F.array_sort(F.collect_list(value))
    at = F.round(F.lit(pct / 100.0) * (F.count(value) - 1)).cast("int")
    return F.element_at(values, at + 1)


def random_signals(bars: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` random signal series: 20 % +1, 20 % -1, 60 % 0."""
    reps = bars.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    row = F.floor(F.unix_micros("ts") / 1_000_000)
    u = uniform(row, F.col("rep"), seed)
    return reps.withColumn("signal", F.when(u < 0.2, -1).when(u >= 0.8, 1).otherwise(0))


def composite_score(pf: Column, sharpe: Column, drawdown: Column) -> Column:
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return 0.5 * clamp(pf / 3) + 0.3 * clamp((sharpe + 1) / 4) + 0.2 * clamp(1 - F.abs(drawdown))


def stopped_accounting(df: DataFrame, keys: Sequence[str], fee: float, mode: int = 0, sl_atr=None, tp_atr=None, sl_pct=None, tp_pct=None) -> DataFrame:
    """Bar-by-bar accounting with stop and target levels set at entry.

    Needs ``signal``, ``atr`` and OHLC.  A stop counts before a target in the
    same bar; no re-entry on the bar of an exit, nor on the bar after a flatten.
    One ordered pass per key over bars.
    """
    def distance(mult, pct, atr, price):
        if mult is not None and not np.isnan(atr):
            return atr * mult
        return math.nan if pct is None else price * pct

    def step(p: pd.DataFrame) -> pd.DataFrame:
        n = len(p)
        close, high, low, atr = (p[c].to_numpy(float) for c in ("close", "high", "low", "atr"))
        sig = p["signal"].to_numpy(int)
        ret, closed = np.zeros(n), np.zeros(n, np.int32)
        side, stop, target, rest = 0, math.nan, math.nan, False
        for i in range(1, n):
            was_resting, rest = rest, False
            exited = False
            if side:
                adverse, kind = (low[i], high[i]) if side > 0 else (high[i], low[i])
                if abs(sig[i]) == 2:
                    leave, rest, exited = close[i], True, True
                elif side * adverse <= side * stop:
                    leave, exited = stop, True
                elif side * kind >= side * target:
                    leave, exited = target, True
                else:
                    leave = close[i]
                ret[i] = side * (leave - close[i - 1]) / close[i - 1]
                if exited:
                    ret[i] -= fee
                    closed[i], side = 1, 0
            if not side and not exited and not was_resting:
                wish = sig[i] if abs(sig[i]) == 1 else 0
                if (wish > 0 and mode != 2) or (wish < 0 and mode != 1):
                    side = int(wish)
                    stop = close[i] - side * distance(sl_atr, sl_pct, atr[i], close[i])
                    target = close[i] + side * distance(tp_atr, tp_pct, atr[i], close[i])
                    ret[i] -= fee
        return p.assign(ret=ret, closed=closed)

    return ordered_pass(df, keys, step, "ret double, closed int")

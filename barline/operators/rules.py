"""Signal rules: bars in, a ``signal`` column out (0 hold, +-1 enter, +-2 flatten).

Every rule takes ``(bars, keys, **params)``.  Rules that are windows stay in the
JVM; the few whose state feeds on itself run as one ordered pass per key over
bars, which are bounded per key by time span / timeframe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions import calendar as cal
from barline.operators import indicators as ind
from barline.operators.indicators import by
from barline.operators.states import hold_bars

# Hold horizons in minutes by index (0 unused).
HOLD_MINUTES = (0, 1, 3, 5, 10, 15, 20, 30, 45, 60)
LONG_CLUSTERS = ("london_burst", "london_open", "ny_post_close")
SHORT_CLUSTERS = ("london_continuation", "ny_close_sell", "tokyo_fix")
# Daily edges (hour, minute, direction) and the groups of them.
DAY_EDGES = ((7, 55, 1), (8, 30, -1), (9, 55, 1), (10, 0, -1), (20, 55, -1), (21, 5, 1), (0, 55, -1))
EDGE_GROUPS = {"london_open": DAY_EDGES[0:4], "ny_close": DAY_EDGES[4:6], "tokyo_fix": DAY_EDGES[6:7], "all": DAY_EDGES}

Rule = Callable[..., DataFrame]
RULES: dict[str, Rule] = {}


def rule(fn: Rule) -> Rule:
    RULES[fn.__name__] = fn
    return fn


def apply_rule(name: str, bars: DataFrame, keys: Sequence[str], **params) -> DataFrame:
    """Rule by name."""
    return RULES[name](bars, list(keys), **params)


def position_to_signal(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clamped change of ``position``; the first bar has none."""
    # Without the inner default the first bar's missing step would count as the bound: least() skips nulls.
    step = F.coalesce(F.col("position") - F.lag("position").over(by(keys)), F.lit(0))
    return df.withColumn("signal", F.greatest(F.lit(-1), F.least(F.lit(1), step)).cast("int"))


def _side(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def _positioned(df: DataFrame, keys: Sequence[str], bars: DataFrame, position: Column) -> DataFrame:
    out = position_to_signal(df.withColumn("position", position), keys)
    return out.select(*bars.columns, "position", "signal")


@rule
def sma_cross(bars, keys, short_window=5, long_window=20):
    w = by(keys)
    work = bars.withColumn("_s", ind.sma(F.col("close"), short_window, w)).withColumn(
        "_l", ind.sma(F.col("close"), long_window, w)
    )
    return _positioned(work, keys, bars, _side(F.col("_s") > F.col("_l"), F.col("_s") < F.col("_l")))


@rule
def ema_atr(bars, keys, short_ema=8, long_ema=21, atr_period=10, atr_multiplier=1.0):
    work = ind.with_ema(bars, keys, F.col("close"), short_ema, "_s")
    work = ind.with_ema(work, keys, F.col("close"), long_ema, "_l")
    work = ind.with_atr(work, keys, atr_period, "_a")
    work = work.withColumn("_m", ind.rolling_median(F.col("_a"), atr_period * 5, by(keys)))
    on = F.col("_a") > F.col("_m") * atr_multiplier
    return _positioned(work, keys, bars, _side(on & (F.col("_s") > F.col("_l")), on & (F.col("_s") < F.col("_l"))))


@rule
def keltner(bars, keys, ema_period=20, atr_period=10, atr_multiplier=1.5):
    work = ind.with_atr(ind.with_ema(bars, keys, F.col("close"), ema_period, "_m"), keys, atr_period, "_a")
    band = atr_multiplier * F.col("_a")
    return _positioned(
        work, keys, bars, _side(F.col("close") > F.col("_m") + band, F.col("close") < F.col("_m") - band)
    )


@rule
def rsi_reversal(bars, keys, period=14, oversold=40.0, overbought=60.0):
    work = ind.with_rsi(bars, keys, period, name="_r")
    return _positioned(work, keys, bars, _side(F.col("_r") < oversold, F.col("_r") > overbought))


@rule
def donchian_breakout(bars, keys, entry_period=20, exit_period=10):
    w = by(keys)
    # The channel excludes the current bar and needs no full history of highs
    # beyond the frame, except the bar before the first.
    work = bars.withColumn("_u", F.lag("high").over(w)).withColumn("_d", F.lag("low").over(w))
    work = work.withColumn("_u", ind.rolling_max(F.col("_u"), entry_period, w)).withColumn(
        "_d", ind.rolling_min(F.col("_d"), exit_period, w)
    )
    both = F.col("_u").isNotNull() & F.col("_d").isNotNull()
    return _positioned(
        work, keys, bars, _side(both & (F.col("close") > F.col("_u")), both & (F.col("close") < F.col("_d")))
    )


def _bands(bars: DataFrame, keys: Sequence[str], period: int, k: float) -> DataFrame:
    w = by(keys)
    work = bars.withColumn("_m", ind.sma(F.col("close"), period, w)).withColumn(
        "_sd", ind.rolling_std(F.col("close"), period, w)
    )
    return work.withColumn("_up", F.col("_m") + k * F.col("_sd")).withColumn("_dn", F.col("_m") - k * F.col("_sd"))


@rule
def bb_pctb(bars, keys, period=20, std_dev=2.0, oversold=0.05, overbought=0.95):
    work = _bands(bars, keys, period, std_dev)
    pct = F.try_divide(F.col("close") - F.col("_dn"), F.col("_up") - F.col("_dn"))
    return _positioned(work, keys, bars, _side(pct < oversold, pct > overbought))


@rule
def bb_squeeze(bars, keys, period=20, std_dev=1.5, squeeze_lookback=30, squeeze_percentile=30.0):
    w = by(keys)
    work = _bands(bars, keys, period, std_dev)
    work = work.withColumn("_w", F.try_divide(F.col("_up") - F.col("_dn"), "_m"))
    work = work.withColumn("_q", ind.rolling_quantile(F.col("_w"), squeeze_lookback, squeeze_percentile / 100, w))
    work = work.withColumn("_tight", F.lag(F.col("_w") <= F.col("_q")).over(w))
    tight = F.coalesce("_tight", F.lit(False))
    return _positioned(
        work, keys, bars, _side(tight & (F.col("close") > F.col("_up")), tight & (F.col("close") < F.col("_dn")))
    )


@rule
def macd_hist(bars, keys, fast_period=12, slow_period=26, signal_period=9):
    work = ind.with_ema(bars, keys, F.col("close"), fast_period, "_f")
    work = ind.with_ema(work, keys, F.col("close"), slow_period, "_s").withColumn("_line", F.col("_f") - F.col("_s"))
    work = ind.with_ema(work, keys, F.col("_line"), signal_period, "_sig")
    # The first bar is exactly zero; block sums leave noise at 1e-13.
    hist = F.round(F.col("_line") - F.col("_sig"), 9)
    return _positioned(work, keys, bars, _side(hist > 0, hist < 0))


@rule
def dual_momentum(bars, keys, roc_period=10, threshold=0.3):
    r = ind.roc(F.col("close"), roc_period, by(keys)) * 100
    return _positioned(bars, keys, bars, _side(r > threshold, r < -threshold))


@rule
def momentum_roc(bars, keys, roc_period=6, threshold=0.004):
    r = ind.roc(F.col("close"), roc_period, by(keys))
    return _positioned(bars, keys, bars, _side(r > threshold, r < -threshold))


@rule
def seasonal_filter(bars, keys, active_months=(3, 4, 9), entry_offset=-2):
    season = F.month("ts").isin(*active_months)
    shifted = F.lag(season, -entry_offset).over(by(keys)) if entry_offset <= 0 else F.lead(season, entry_offset).over(by(keys))
    return _positioned(bars, keys, bars, F.when(shifted, 1).otherwise(0))


@rule
def vol_breakout(bars, keys, channel_period=20, multiplier=1.0, vol_type="atr"):
    w = by(keys)
    work = bars.withColumn("_m", ind.sma(F.col("close"), channel_period, w))
    if vol_type == "atr":
        work = ind.with_atr(work, keys, channel_period, "_v")
    elif vol_type == "std":
        work = work.withColumn("_v", ind.rolling_std(F.col("close"), channel_period, w))
    elif vol_type == "parkinson":
        work = work.withColumn("_v", ind.parkinson(channel_period, w))
    else:
        raise ValueError(f"unknown vol_type {vol_type}")
    band = multiplier * F.col("_v")
    return _positioned(
        work, keys, bars, _side(F.col("close") > F.col("_m") + band, F.col("close") < F.col("_m") - band)
    )


@rule
def session_momentum(bars, keys, trend_ema=20, entry_hour_start=8, entry_hour_end=13, use_trend_filter=True, avoid_nfp_week=True):
    inside = (F.hour("ts") >= entry_hour_start) & (F.hour("ts") < entry_hour_end)
    if avoid_nfp_week:
        inside = inside & ~cal.is_first_friday(F.col("ts"))
    if not use_trend_filter:
        return _positioned(bars, keys, bars, F.when(inside, 1).otherwise(0))
    work = ind.with_ema(bars, keys, F.col("close"), trend_ema, "_e")
    up, down = F.round(F.col("close") - F.col("_e"), 9) > 0, F.round(F.col("close") - F.col("_e"), 9) < 0
    return _positioned(work, keys, bars, _side(inside & up, inside & down))


@rule
def month_end_jpy(bars, keys, trend_ema=20, month_end_window=3, month_start_window=3, use_dow_filter=True, best_dow=1, use_trend_filter=True):
    day = F.dayofmonth("ts")
    turn = (cal.days_in_month(F.col("ts")) - day < month_end_window) | (day <= month_start_window)
    on = ~turn
    if use_dow_filter:
        on = on & (F.weekday("ts") == best_dow)
    if not use_trend_filter:
        return _positioned(bars, keys, bars, F.when(on, 1).otherwise(0))
    work = ind.with_ema(bars, keys, F.col("close"), trend_ema, "_e")
    return _positioned(work, keys, bars, F.when(on & (F.round(F.col("close") - F.col("_e"), 9) > 0), 1).otherwise(0))


@rule
def tod_edge(bars, keys, entry_minute=540, direction="long", hold_h=9, bar_minutes=60):
    if not 1 <= hold_h <= 9 or direction not in ("long", "short"):
        raise ValueError("hold_h must be 1..9, direction long or short")
    n = max(-(-HOLD_MINUTES[hold_h] // bar_minutes), 1)
    held = hold_bars(cal.minute_of_day(F.col("ts")) == entry_minute, n, by(keys))
    return _positioned(bars, keys, bars, held * (1 if direction == "long" else -1))


@rule
def time_of_day_drift(bars, keys, cluster="all", hold_bars=3, bar_seconds=900):
    """Entry two bars before the bar that holds the edge, flatten after the hold.

    Two bars of lag lie between a signal and its return.  Where an entry and a
    flatten fall on one bar, the entry stands.
    """
    w = by(keys)
    sod = cal.second_of_day(F.col("ts"))
    edge = F.lit(0)
    for h, m, d in EDGE_GROUPS.get(cluster, DAY_EDGES):
        at = h * 3600 + m * 60
        edge = F.when((sod <= at) & (at < sod + bar_seconds), d).otherwise(edge)
    work = bars.withColumn("_edge", edge)
    work = work.withColumn("_entry", F.coalesce(F.lead("_edge", 2).over(w), F.lit(0)))
    work = work.withColumn("_flat", F.coalesce(F.lag("_entry", max(hold_bars, 1)).over(w), F.lit(0)))
    return work.withColumn("signal", F.when(F.col("_entry") != 0, F.col("_entry")).otherwise(2 * F.col("_flat")).cast("int")).select(
        *bars.columns, "signal"
    )


@rule
def calendar_anomaly(bars, keys, edges=((2, "early", 1), (4, "mid", -1), (1, "late", 1))):
    """Position by (weekday 1 = Monday, part of the month)."""
    dow, part = F.weekday("ts") + 1, cal.month_position(F.col("ts"))
    position = F.lit(0)
    for d, p, x in edges:
        position = F.when((dow == d) & (part == p), x).otherwise(position)
    return _positioned(bars, keys, bars, position)


# ---- rules whose state feeds on itself -------------------------------------------


def ordered_pass(df: DataFrame, keys: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], new: str) -> DataFrame:
    """One ordered pass per key over bars; ``step`` adds the ``new`` columns."""
    added = T._parse_datatype_string(new)
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values("ts", kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def hysteresis(z: np.ndarray, enter: float, leave: float, forced_flat: np.ndarray, long_ok: np.ndarray, short_ok: np.ndarray):
    """Enter beyond +-``enter`` against the move, leave inside +-``leave``.

    NaN leaves the state as it is.  Returns (signal, position) per row.
    """
    n = len(z)
    signal, position = np.zeros(n, np.int32), np.zeros(n, np.int32)
    held = 0
    for i in range(n):
        if not np.isnan(z[i]):
            target = held
            if forced_flat[i]:
                target = 0
            elif held == 0:
                target = int(z[i] < -enter and long_ok[i]) - int(z[i] > enter and short_ok[i])
            elif (held > 0 and z[i] > -leave) or (held < 0 and z[i] < leave):
                target = 0
            signal[i], held = target - held, target
        position[i] = held
    return signal, position


@rule
def dxy_mean_reversion(bars, keys, lookback=20, z_entry=1.5, z_exit=0.3, use_rsi_filter=False, rsi_period=14, rsi_threshold=70.0, invert_aux=False, ref="close"):
    w = by(keys)
    sd = ind.rolling_std(F.col(ref), lookback, w)
    z = F.try_divide(F.col(ref) - ind.sma(F.col(ref), lookback, w), sd) * (-1.0 if invert_aux else 1.0)
    work = bars.withColumn("_z", F.round(z, 9))
    if use_rsi_filter:
        work = ind.with_rsi(work, keys, rsi_period, F.col(ref), "_r")
    else:
        work = work.withColumn("_r", F.lit(None).cast("double"))

    def step(p: pd.DataFrame) -> pd.DataFrame:
        r = p["_r"].to_numpy(float)
        free = np.isnan(r)
        s, _ = hysteresis(p["_z"].to_numpy(float), z_entry, z_exit, np.zeros(len(p), bool), free | (r <= rsi_threshold), free | (r >= 100 - rsi_threshold))
        return p.assign(signal=s)

    return ordered_pass(work, keys, step, "signal int").drop("_z", "_r")


@rule
def cross_asset_fx(bars, keys, fast_lookback=5, slow_lookback=20, z_entry=0.8, z_exit=0.2, vol_lookback=10, vol_regime_mult=1.2, trade_in_high_vol=False, invert_aux=False, ref="close", undefined_sticks=True):
    """z of fast minus slow mean with hysteresis and a volatility filter.

    ``undefined_sticks`` keeps the mean of the ATR undefined from its warm-up
    on, so the filter never fires (the default behaviour); off, it fires.
    """
    w = by(keys)
    sd = ind.rolling_std(F.col(ref), slow_lookback, w)
    gap = ind.sma(F.col(ref), fast_lookback, w) - ind.sma(F.col(ref), slow_lookback, w)
    work = bars.withColumn("_z", F.round(F.try_divide(gap, sd) * (-1.0 if invert_aux else 1.0), 9))
    work = ind.with_atr(work, keys, vol_lookback, "_a")
    work = work.withColumn("_am", ind.sma(F.col("_a"), vol_lookback * 2, w, nulls_stick=undefined_sticks))
    high = F.lit(False) if trade_in_high_vol else F.coalesce(F.col("_a") > F.col("_am") * vol_regime_mult, F.lit(False))
    work = work.withColumn("_hv", high)

    def step(p: pd.DataFrame) -> pd.DataFrame:
        yes = np.ones(len(p), bool)
        s, _ = hysteresis(p["_z"].to_numpy(float), z_entry, z_exit, p["_hv"].to_numpy(bool), yes, yes)
        return p.assign(signal=s)

    return ordered_pass(work, keys, step, "signal int").drop("_z", "_a", "_am", "_hv")


@rule
def cluster_pair_drift(bars, keys, long_cluster="london_burst", short_cluster="tokyo_fix", hold_bars=5, exit_type="none", tp=None, sl=None):
    """Long in one clock window, short in another, out after a hold or at limits.

    ``tp`` and ``sl`` are multiples of ATR(14) for ``atr_based`` exits and
    fractions of the entry price for ``fixed_pct``.
    """
    if long_cluster not in LONG_CLUSTERS or short_cluster not in SHORT_CLUSTERS:
        return bars.withColumn("position", F.lit(0)).withColumn("signal", F.lit(0))
    work = bars.withColumn("_lw", cal.in_cluster(F.col("ts"), long_cluster)).withColumn("_sw", cal.in_cluster(F.col("ts"), short_cluster))
    if exit_type == "atr_based":
        work = ind.with_atr(work, keys, 14, "_unit")
    elif exit_type == "fixed_pct":
        work = work.withColumn("_unit", F.lit(1.0))
    else:
        work = work.withColumn("_unit", F.lit(None).cast("double"))
    up = float("inf") if tp is None else tp
    down = float("inf") if sl is None else sl

    def step(p: pd.DataFrame) -> pd.DataFrame:
        close, unit = p["close"].to_numpy(float), p["_unit"].to_numpy(float)
        lw, sw = p["_lw"].to_numpy(bool), p["_sw"].to_numpy(bool)
        pos = np.zeros(len(p), np.int32)
        held, since, price = 0, 0, 0.0
        for i in range(len(p)):
            want = -1 if sw[i] and (held != -1 or lw[i]) else (1 if lw[i] and held != 1 else 0)
            if want:
                held, since, price = want, i, close[i]
            if held:
                gain = held * (close[i] - price) / (price if exit_type == "fixed_pct" else 1.0)
                beyond = not np.isnan(unit[i]) and (gain >= up * unit[i] or gain <= -down * unit[i])
                if i - since >= max(hold_bars, 1) or beyond:
                    held = 0
            pos[i] = held
        return p.assign(position=pos)

    out = ordered_pass(work, keys, step, "position int")
    return position_to_signal(out, keys).select(*bars.columns, "position", "signal")


@rule
def macro_event_drift(bars, keys, windows=None, window_offset=2, hold_bars=4, tp_pct=None, sl_pct=None, flip=False, min_offset=1):
    """Enter ``window_offset`` bars after a macro window's end, in its direction.

    ``windows`` are ``(end, direction)`` pairs in time order (a calendar of a few
    dozen).  A window that ends while a position is open is passed over.  An
    offset below ``min_offset`` would look ahead and gives no signal.
    """
    if window_offset < min_offset:
        return bars.withColumn("position", F.lit(0)).withColumn("signal", F.lit(0))
    ends = np.array([np.datetime64(e) for e, _ in windows], dtype="datetime64[us]")
    dirs = [(-d if flip else d) for _, d in windows]
    tp, sl = (np.inf if tp_pct is None else tp_pct), (np.inf if sl_pct is None else sl_pct)

    def step(p: pd.DataFrame) -> pd.DataFrame:
        n = len(p)
        ts = p["ts"].to_numpy(dtype="datetime64[us]")
        high, low, close = (p[c].to_numpy(float) for c in ("high", "low", "close"))
        reached = np.searchsorted(ts, ends, side="left")
        pos = np.zeros(n, np.int32)
        free = 0  # first bar at which a window can be noticed while flat
        busy_from = busy_to = 0  # bars on which windows are passed over
        for k in range(len(ends)):
            seen = max(int(reached[k]), busy_from)
            if seen < busy_to:
                busy_from = seen + 1
                continue
            entry = max(int(reached[k]), free) + window_offset
            if entry >= n:
                break
            d = dirs[k]
            free = busy_from = entry + 1
            busy_to = busy_from
            if d == 0:
                continue
            best, worst = (high, low) if d > 0 else (low, high)
            path = slice(entry + 1, entry + hold_bars)
            target, stop = close[entry] * (1 + d * tp), close[entry] * (1 - d * sl)
            hit = np.flatnonzero((d * best[path] >= d * target) | (d * worst[path] <= d * stop))
            leave = min(entry + (1 + int(hit[0]) if len(hit) else hold_bars), n)
            pos[entry:leave] = d
            free, busy_to = leave, leave
        return p.assign(position=pos)

    out = ordered_pass(bars, keys, step, "position int")
    return position_to_signal(out, keys)

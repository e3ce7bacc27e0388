"""Exit replay, sizing, drawdown gates and the de-risk overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.indicators import by, sma, true_range
from barline.operators.states import rolling_z

# Limits of the gate and of the sizing.
DD_HARD_CAP = 0.20
DAILY_LOSS_LIMIT = 0.03
LOSS_STREAK_LIMIT = 5
KELLY_MAX, KELLY_MIN = 0.5, 0.25


def bar_trades(bars: DataFrame, every_hours: int, length: int, atr_window: int = 14) -> DataFrame:
    """Trades entered at every n-th hour with their next ``length`` bars nested."""
    w = by(["symbol"])
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    work = bars.withColumn("_tr", true_range(w))
    work = work.withColumn("atr", sma(F.col("_tr"), atr_window, w)).withColumn("entry_bar", F.row_number().over(w))
    path = F.collect_list(F.struct("high", "low", "close", "atr")).over(w.rowsBetween(1, length))
    work = work.withColumn("bars", path)
    picked = work.filter((hour % every_hours == 0) & F.col("atr").isNotNull() & (F.size("bars") == length))
    return picked.select(
        "symbol",
        "entry_bar",
        hour.alias("trade_id"),
        F.when(hour % (2 * every_hours) == 0, 1).otherwise(-1).alias("direction"),
        F.col("close").alias("entry_price"),
        F.col("atr").alias("atr_at_entry"),
        "bars",
    )


def replay_exits(trades: DataFrame, atr_k: float = 2.0, max_hold: int | None = None, lookback: int = 3) -> DataFrame:
    """First exit rule to fire per trade, with its bar and pnl.

    Order within a bar: ATR stop, technical stop, trailing stop, time stop; with
    none, the trade closes at its last bar.  Works inside each nested array, so
    there is no shuffle.
    """
    d = F.col("direction")

    def at(b: Column, i: Column) -> Column:
        long = d == 1
        adverse = F.when(long, b["low"]).otherwise(b["high"])
        seen = F.slice("bars", 1, i + 1)
        recent = F.slice("bars", F.greatest(i - lookback, F.lit(0)) + 1, lookback)
        swing = F.when(long, F.array_min(F.transform(recent, lambda x: x["low"]))).otherwise(
            F.array_max(F.transform(recent, lambda x: x["high"]))
        )
        best = F.when(
            long, F.greatest(F.col("entry_price"), F.array_max(F.transform(seen, lambda x: x["close"])))
        ).otherwise(F.least(F.col("entry_price"), F.array_min(F.transform(seen, lambda x: x["close"]))))
        beyond = lambda level: d * adverse <= d * level
        rule = (
            F.when(beyond(F.col("entry_price") - d * atr_k * F.col("atr_at_entry")), "atr_stop")
            .when((i >= lookback) & beyond(swing), "technical_stop")
            .when(beyond(best - d * atr_k * b["atr"]), "trailing_stop")
        )
        if max_hold is not None:
            rule = rule.when(i >= max_hold - 1, "time_stop")
        return F.struct(rule.alias("rule"), i.alias("i"), b["close"].alias("close"))

    fired = F.filter(F.transform("bars", at), lambda x: x["rule"].isNotNull())
    last = F.struct(
        F.lit("fold_end").alias("rule"),
        (F.size("bars") - 1).alias("i"),
        F.element_at("bars", -1)["close"].alias("close"),
    )
    hit = trades.withColumn("_x", F.coalesce(F.get(fired, F.lit(0)), last))
    return hit.select(
        *[c for c in trades.columns if c != "bars"],
        F.col("_x.rule").alias("exit_rule"),
        (F.col("entry_bar") + F.col("_x.i")).alias("exit_bar"),
        (d * (F.col("_x.close") - F.col("entry_price"))).alias("pnl"),
    )


def kelly_fraction(p: Column, b: Column) -> Column:
    f = p - F.try_divide(1 - p, b)
    return F.greatest(F.lit(0.0), F.least(f, F.lit(KELLY_MAX)))


def sized(trades: DataFrame, fraction: Column, atr: Column, equity: float, dd_cap: float, risk_pct: float = 0.01, k_atr: float = 2.0) -> DataFrame:
    """Smallest of the Kelly, ATR-normalised and capped size, with the reason."""
    ok = (atr > 0) & F.lit(equity > 0)
    out = (
        trades.withColumn("kelly_size", equity * fraction)
        .withColumn("atr_size", F.when(ok, F.try_divide(F.lit(equity * risk_pct), k_atr * atr)).otherwise(0.0))
        .withColumn("cap_size", F.lit(equity * dd_cap))
    )
    low = F.least("kelly_size", "atr_size", "cap_size")
    reason = (
        F.when(~ok | (low <= 0), "zero")
        .when(F.col("kelly_size") == low, "kelly")
        .when(F.col("atr_size") == low, "atr_norm")
        .otherwise("fixed_cap")
    )
    return out.withColumn("size", F.when(ok & (low > 0), low).otherwise(0.0)).withColumn("binding_reason", reason)


def kelly_sensitivity(inputs: DataFrame, delta: float = 0.10) -> DataFrame:
    """Kelly fraction at the centre and four corners of (p, b)."""
    corners = {"center": (1, 1), "ne": (1 + delta, 1 + delta), "se": (1 + delta, 1 - delta), "nw": (1 - delta, 1 + delta), "sw": (1 - delta, 1 - delta)}
    points = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, (x, y) in corners.items()])
    long = inputs.withColumn("_c", F.explode(points)).select(*inputs.columns, "_c.*")
    p, b = F.col("p") * F.col("x"), F.col("b") * F.col("y")
    f = F.when((b <= 0) | (p <= 0) | (p >= 1), None).otherwise(kelly_fraction(p, b))
    return long.withColumn("f", f).drop("x", "y")


def expand_to_bars(trades: DataFrame, last_bar: Column) -> DataFrame:
    """One row per bar of a trade; pnl sits on the exit bar."""
    start, end = F.least("entry_bar", last_bar), F.least("exit_bar", last_bar)
    rows = trades.withColumn("_end", end).withColumn("bar", F.explode(F.sequence(start, end)))
    return rows.withColumn("bar_pnl", F.when(F.col("bar") == F.col("_end"), F.coalesce("pnl", F.lit(0.0))).otherwise(0.0)).drop("_end")


def drawdown_gate(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State and risk multiplier per row of ``ts, equity, pnl``.

    Precedence: hard drawdown cap, daily loss limit, losing streak, step-down.
    """
    w = by(keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    work = days.withColumn("_peak", F.max("equity").over(so_far))
    work = work.withColumn("dd_value", F.greatest(F.lit(0.0), (F.col("_peak") - F.col("equity")) / F.col("_peak")))
    in_day = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("daily_loss_sum", F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))).over(in_day))
    work = work.withColumn("_isl", F.count_if(F.col("pnl") > 0).over(so_far))
    island = Window.partitionBy(*keys, "_isl").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("consecutive_loss_count", F.count_if(F.col("pnl") < 0).over(island))
    state = (
        F.when(F.col("dd_value") >= DD_HARD_CAP, "gate_closed:hard_cap_20pct")
        .when(F.col("daily_loss_sum") >= DAILY_LOSS_LIMIT, "gate_closed:daily_loss_3pct")
        .when(F.col("consecutive_loss_count") >= LOSS_STREAK_LIMIT, "gate_closed:step_down_consecutive")
        .otherwise("ok")
    )
    dd = F.col("dd_value")
    mult = F.when(dd < 0.05, 1.0).when(dd < 0.10, 0.75).when(dd < 0.15, 0.50).otherwise(0.25)
    return (
        work.withColumn("dd_state", state)
        .withColumn("risk_multiplier", F.when(F.col("dd_state") == "ok", mult).otherwise(0.0))
        .withColumn("rest_flag", F.col("dd_state") == "gate_closed:step_down_consecutive")
        .drop("_peak", "_isl")
    )


def derisk(gated: DataFrame, keys: Sequence[str], window: int = 20, n_losses: float = 5.0) -> DataFrame:
    """``z_t`` of the drawdown and ``p_shift`` of the losing streak."""
    z = rolling_z(F.col("dd_value"), window, by(keys))
    shift = F.least(F.greatest(F.col("consecutive_loss_count") / n_losses, F.lit(0.0)), F.lit(1.0))
    return gated.withColumn("z_t", z).withColumn("p_shift", shift)


def overlay_multiplier(alpha: Column | float, beta: Column | float, cap: float) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    b = beta if isinstance(beta, Column) else F.lit(beta)
    return F.least(F.lit(cap), F.exp(-a * F.col("z_t") - b * F.col("p_shift")))


def equity_metrics(df: DataFrame, keys: Sequence[str], equity: str) -> DataFrame:
    """Profit factor of equity changes and maximum drawdown per key."""
    w = by(keys)
    peak = F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))
    work = df.withColumn("_d", F.col(equity) - F.lag(equity).over(w)).withColumn("_pk", peak)
    gain, loss = F.sum(F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0)), F.sum(F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0))
    return work.groupBy(*keys).agg(
        F.when(loss > 0, gain / loss).alias("pf"), F.min((F.col(equity) - F.col("_pk")) / F.col("_pk")).alias("max_dd")
    )

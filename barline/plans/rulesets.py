"""Signal rules over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.events import MIN_OFFSET, WINDOW_HOURS, calendar_rows
from barline.operators import imbalance, lookup
from barline.operators.accounting import account, performance
from barline.operators.bars import ticks_to_bars
from barline.operators.rules import apply_rule
from barline.plans.aggs import _SLOT30, STUDY_SCORES, study_events
from barline.plans.checks import (
    BARS, DAILY, FAST, QUOTES, account_ctes, bars_sql, ema_sql, performance_select, signal_sql, sql,
)
from barline.plans.registry import query
from barline.plans.shapes import hourly, rows_as
from barline.plans.windows import _RSI, TR
from barline.sources import tables as T

K = ["symbol"]
WIN = "(PARTITION BY symbol ORDER BY ts ROWS {} PRECEDING)"


def avg_full(x: str, n: int) -> str:
    w = WIN.format(n - 1)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN avg({x}) OVER {w} END"


def sd_full(x: str, n: int) -> str:
    w = WIN.format(n - 1)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN stddev_samp({x}) OVER {w} END"


def rule_sql(*ctes: str, src: str, position: str) -> str:
    p = f"pos AS (SELECT symbol, ts, close, (CASE {position} ELSE 0 END) AS position FROM {src})"
    return sql(*ctes, p, body=f"SELECT symbol, ts, position::INTEGER AS position, {signal_sql()} AS signal FROM pos")


def _rule(name: str, rule: str, check: str | None, shape=hourly, cols=("symbol", "ts", "position", "signal"), **params):
    @query(name, check)
    def _(spark, sf):
        return apply_rule(rule, shape(spark, sf), K, **params).select(*cols)


QB = (QUOTES, BARS)


@query("H00_position_to_signal", rule_sql(*QB, src="bars", position="WHEN hour(ts) BETWEEN 6 AND 9 THEN 1 WHEN hour(ts) BETWEEN 10 AND 12 THEN -1"))
def _(spark, sf):
    from barline.operators.rules import position_to_signal

    h = F.hour("ts")
    p = hourly(spark, sf).withColumn("position", F.when(h.between(6, 9), 1).when(h.between(10, 12), -1).otherwise(0))
    return position_to_signal(p, K).select("symbol", "ts", "position", "signal")


SMA_X = f"x AS (SELECT *, {avg_full('close', 5)} AS s, {avg_full('close', 20)} AS l FROM bars)"
SMA_P = "WHEN s > l THEN 1 WHEN s < l THEN -1"
_rule("H01_sma_cross", "sma_cross", rule_sql(*QB, SMA_X, src="x", position=SMA_P))

_rule(
    "H02_ema_atr",
    "ema_atr",
    rule_sql(
        *QB, TR,
        f"a0 AS (SELECT *, {avg_full('tr', 10)} AS a, {ema_sql('close', 2 / 9)} AS s, {ema_sql('close', 2 / 22)} AS l FROM tr)",
        f"x AS (SELECT *, CASE WHEN count(a) OVER {WIN.format(49)} = 50 THEN median(a) OVER {WIN.format(49)} END AS m FROM a0)",
        src="x", position="WHEN a > m AND s > l THEN 1 WHEN a > m AND s < l THEN -1",
    ),
)
_rule(
    "H03_keltner",
    "keltner",
    rule_sql(
        *QB, TR, f"x AS (SELECT *, {avg_full('tr', 10)} AS a, {ema_sql('close', 2 / 21)} AS m FROM tr)",
        src="x", position="WHEN close > m + 1.5::DOUBLE * a THEN 1 WHEN close < m - 1.5::DOUBLE * a THEN -1",
    ),
)
_rule("H04_rsi_reversal", "rsi_reversal", rule_sql(*QB, _RSI, src="rsi", position="WHEN rsi < 40 THEN 1 WHEN rsi > 60 THEN -1"))
_rule(
    "H05_donchian_breakout",
    "donchian_breakout",
    rule_sql(
        *QB,
        """x AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 20 THEN max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS u,
 CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 10 THEN min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS d FROM bars)""",
        src="x", position="WHEN u IS NULL OR d IS NULL THEN 0 WHEN close > u THEN 1 WHEN close < d THEN -1",
    ),
)


def bands_sql(k: float) -> str:
    return f"b0 AS (SELECT *, {avg_full('close', 20)} AS m, {sd_full('close', 20)} AS sd FROM bars), x0 AS (SELECT *, m + {k}::DOUBLE * sd AS up, m - {k}::DOUBLE * sd AS dn FROM b0)"


_rule(
    "H06_bb_pctb", "bb_pctb",
    rule_sql(*QB, bands_sql(2.0), "x AS (SELECT *, (close - dn) / nullif(up - dn, 0) AS pct FROM x0)", src="x", position="WHEN pct < 0.05::DOUBLE THEN 1 WHEN pct > 0.95::DOUBLE THEN -1"),
)
_rule(
    "H07_bb_squeeze", "bb_squeeze",
    rule_sql(
        *QB, bands_sql(1.5), "x1 AS (SELECT *, (up - dn) / nullif(m, 0) AS bw FROM x0)",
        f"x2 AS (SELECT *, CASE WHEN count(bw) OVER {WIN.format(29)} = 30 THEN quantile_cont(bw, 0.3) OVER {WIN.format(29)} END AS q FROM x1)",
        "x AS (SELECT *, lag(bw <= q) OVER (PARTITION BY symbol ORDER BY ts) AS tight FROM x2)",
        src="x", position="WHEN tight AND close > up THEN 1 WHEN tight AND close < dn THEN -1",
    ),
)
_rule(
    "H08_macd_hist", "macd_hist",
    rule_sql(
        *QB, f"x0 AS (SELECT *, {ema_sql('close', 2 / 13)} - {ema_sql('close', 2 / 27)} AS line FROM bars)",
        f"x AS (SELECT *, round(line - {ema_sql('line', 2 / 10)}, 9) AS hist FROM x0)", src="x", position="WHEN hist > 0 THEN 1 WHEN hist < 0 THEN -1",
    ),
)
_rule(
    "H09_dual_momentum", "dual_momentum",
    rule_sql(*QB, "x AS (SELECT *, (close / nullif(lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1) * 100 AS r FROM bars)", src="x", position="WHEN r > 0.3::DOUBLE THEN 1 WHEN r < -0.3::DOUBLE THEN -1"),
)
_rule(
    "H10_momentum_roc", "momentum_roc",
    rule_sql(*QB, "x AS (SELECT *, close / nullif(lag(close, 6) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r FROM bars)", src="x", position="WHEN r > 0.004::DOUBLE THEN 1 WHEN r < -0.004::DOUBLE THEN -1"),
)
_rule(
    "H11_seasonal_filter", "seasonal_filter",
    rule_sql(DAILY, "x AS (SELECT *, lag(month(ts) IN (3, 4, 9), 2) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM daily)", src="x", position="WHEN s THEN 1"),
    shape=T.daily_prices,
)
_rule(
    "H12_vol_breakout_atr", "vol_breakout",
    rule_sql(*QB, TR, f"x AS (SELECT *, {avg_full('close', 20)} AS m, {avg_full('tr', 20)} AS v FROM tr)", src="x", position="WHEN close > m + v THEN 1 WHEN close < m - v THEN -1"),
)
_rule(
    "H12_vol_breakout_std", "vol_breakout",
    rule_sql(*QB, f"x AS (SELECT *, {avg_full('close', 20)} AS m, {sd_full('close', 20)} AS v FROM bars)", src="x", position="WHEN close > m + v THEN 1 WHEN close < m - v THEN -1"),
    vol_type="std",
)
_rule(
    "H12_vol_breakout_parkinson", "vol_breakout",
    rule_sql(*QB, f"x AS (SELECT *, {avg_full('close', 20)} AS m, sqrt({avg_full('pow(ln(high / low), 2) / (4 * ln(2))', 20)}) AS v FROM bars)", src="x", position="WHEN close > m + 200 * v THEN 1 WHEN close < m - 200 * v THEN -1"),
    vol_type="parkinson", multiplier=200.0,
)

_Z = f"z0 AS (SELECT *, round((close - {avg_full('close', 20)}) / nullif({sd_full('close', 20)}, 0), 9) AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"
_HYST = """st AS (SELECT symbol, rn, ts, 0 AS held, 0 AS signal FROM z0 WHERE rn = 1
 UNION ALL SELECT b.symbol, b.rn, b.ts, {t} AS held, {t} - st.held AS signal FROM st JOIN z0 b ON b.symbol = st.symbol AND b.rn = st.rn + 1)"""


def hyst(enter, leave, flat="false", lo="true", so="true"):
    return _HYST.format(t=f"""(CASE WHEN b.z IS NULL THEN st.held WHEN {flat} THEN 0 WHEN st.held = 0 THEN CASE WHEN b.z < -{enter} AND {lo} THEN 1 WHEN b.z > {enter} AND {so} THEN -1 ELSE 0 END
  WHEN st.held = 1 AND b.z > -{leave} THEN 0 WHEN st.held = -1 AND b.z < {leave} THEN 0 ELSE st.held END)""")


def recursive(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + body


_SIGNAL_ONLY = ("symbol", "ts", "signal")
_rule("H13_reference_reversion", "dxy_mean_reversion", recursive(*QB, _Z, hyst(1.5, 0.3), body="SELECT symbol, ts, signal FROM st"), cols=_SIGNAL_ONLY)
_rule(
    "H13_reference_reversion_rsi", "dxy_mean_reversion",
    recursive(*QB, _RSI, f"z0 AS (SELECT *, round((close - {avg_full('close', 20)}) / nullif({sd_full('close', 20)}, 0), 9) AS z FROM rsi)",
              hyst(1.5, 0.3, lo="(b.rsi IS NULL OR b.rsi <= 45)", so="(b.rsi IS NULL OR b.rsi >= 55)"), body="SELECT symbol, ts, signal FROM st"),
    cols=_SIGNAL_ONLY, use_rsi_filter=True, rsi_threshold=45.0,
)
_rule(
    "H14_session_momentum", "session_momentum",
    rule_sql(*QB, f"x AS (SELECT *, round(close - {ema_sql('close', 2 / 21)}, 9) AS g, hour(ts) >= 8 AND hour(ts) < 13 AND NOT (day(ts) <= 7 AND isodow(ts) = 5) AS ok FROM bars)", src="x", position="WHEN ok AND g > 0 THEN 1 WHEN ok AND g < 0 THEN -1"),
)
_ZX = f"z0 AS (SELECT *, round(({avg_full('close', 5)} - {avg_full('close', 20)}) / nullif({sd_full('close', 20)}, 0), 9) AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"
_rule("H15_cross_asset", "cross_asset_fx", recursive(*QB, _ZX, hyst(0.8, 0.2), body="SELECT symbol, ts, signal FROM st"), cols=_SIGNAL_ONLY)
_rule(
    "H15_cross_asset_vol_filter", "cross_asset_fx",
    recursive(
        *QB, TR, f"a0 AS (SELECT *, {avg_full('tr', 10)} AS a FROM tr)",
        f"a1 AS (SELECT *, {avg_full('a', 20)} AS am FROM a0)",
        f"z0 AS (SELECT *, round(({avg_full('close', 5)} - {avg_full('close', 20)}) / nullif({sd_full('close', 20)}, 0), 9) AS z, coalesce(a > am * 1.2::DOUBLE, false) AS hv, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM a1)",
        hyst(0.8, 0.2, flat="b.hv"), body="SELECT symbol, ts, signal FROM st",
    ),
    cols=_SIGNAL_ONLY, undefined_sticks=False,
)
_rule(
    "H16_month_end", "month_end_jpy",
    rule_sql(*QB, f"x AS (SELECT *, round(close - {ema_sql('close', 2 / 21)}, 9) AS g, NOT (day(last_day(ts)) - day(ts) < 3 OR day(ts) <= 3) AND isodow(ts) = 2 AS ok FROM bars)", src="x", position="WHEN ok AND g > 0 THEN 1"),
)

M15 = bars_sql("bars", 900)


def quarter_hourly(spark, sf):
    return ticks_to_bars(T.quotes(spark, sf), "15m")


def minute_bars(spark, sf):
    return ticks_to_bars(T.fast_quotes(spark, sf), "1m")


_rule(
    "H18_tod_edge", "tod_edge",
    rule_sql(QUOTES, M15, "x AS (SELECT *, max(CASE WHEN hour(ts) * 60 + minute(ts) = 540 THEN 1 END) OVER (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING) AS h FROM bars)", src="x", position="WHEN h = 1 THEN -1"),
    shape=quarter_hourly, direction="short", bar_minutes=15,
)
_EDGES = ", ".join(f"({i}, {h * 3600 + m * 60}, {d})" for i, (h, m, d) in enumerate(((7, 55, 1), (8, 30, -1), (9, 55, 1), (10, 0, -1), (20, 55, -1), (21, 5, 1), (0, 55, -1))))
_rule(
    "H19_time_of_day_drift", "time_of_day_drift",
    sql(
        QUOTES, M15, f"ed(i, sod, d) AS (VALUES {_EDGES})",
        "e AS (SELECT b.symbol, b.ts, coalesce(arg_max(ed.d, ed.i), 0) AS edge FROM bars b LEFT JOIN ed ON ed.sod >= hour(b.ts) * 3600 + minute(b.ts) * 60 AND ed.sod < hour(b.ts) * 3600 + minute(b.ts) * 60 + 900 GROUP BY ALL)",
        "n AS (SELECT *, coalesce(lead(edge, 2) OVER (PARTITION BY symbol ORDER BY ts), 0) AS entry FROM e)",
        body="SELECT symbol, ts, (CASE WHEN entry <> 0 THEN entry ELSE 2 * coalesce(lag(entry, 3) OVER (PARTITION BY symbol ORDER BY ts), 0) END)::INTEGER AS signal FROM n",
    ),
    shape=quarter_hourly, cols=_SIGNAL_ONLY,
)

_M1 = """bars AS (SELECT symbol, make_timestamp(us // 60000000 * 60000000) AS ts, arg_min((bid + ask) / 2, (us, event_id)) AS open, max((bid + ask) / 2) AS high, min((bid + ask) / 2) AS low, arg_max((bid + ask) / 2, (us, event_id)) AS close FROM fast GROUP BY symbol, us // 60000000)"""


def cluster_check(*ctes: str, src: str, beyond: str) -> str:
    """The bar-by-bar state as a recursive query."""
    st = f"""st AS (SELECT symbol, rn, ts, close, 0 AS held, 0::BIGINT AS since, 0.0::DOUBLE AS price FROM cb WHERE rn = 0
 UNION ALL SELECT symbol, rn, ts, close, CASE WHEN held <> 0 AND (rn - since >= 5 OR {beyond}) THEN 0 ELSE held END, since, price FROM (
  SELECT b.*, CASE WHEN b.sw AND st.held <> -1 THEN -1 WHEN b.lw AND st.held <> 1 THEN 1 ELSE st.held END AS held,
   CASE WHEN (b.sw AND st.held <> -1) OR (b.lw AND st.held <> 1) THEN b.rn ELSE st.since END AS since,
   CASE WHEN (b.sw AND st.held <> -1) OR (b.lw AND st.held <> 1) THEN b.close ELSE st.price END AS price
  FROM st JOIN cb b ON b.symbol = st.symbol AND b.rn = st.rn + 1) q)"""
    cb = f"""cb AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, ts, close, a, hour(ts) * 60 + minute(ts) >= 595 AND hour(ts) * 60 + minute(ts) < 600 AS lw,
 hour(ts) * 60 + minute(ts) >= 55 AND hour(ts) * 60 + minute(ts) < 60 AS sw FROM {src} UNION ALL SELECT DISTINCT symbol, 0, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, false, false FROM {src})"""
    pos = "pos AS (SELECT symbol, ts, held AS position FROM st WHERE rn > 0)"
    return recursive(FAST, _M1, *ctes, cb, st, pos, body=f"SELECT symbol, ts, position::INTEGER AS position, {signal_sql()} AS signal FROM pos")


_rule("H17_cluster_drift", "cluster_pair_drift", cluster_check("y AS (SELECT *, NULL::DOUBLE AS a FROM bars)", src="y", beyond="false"), shape=minute_bars)
_rule(
    "H17_cluster_drift_pct", "cluster_pair_drift",
    cluster_check("y AS (SELECT *, 1.0::DOUBLE AS a FROM bars)", src="y", beyond="held * (close - price) / price >= 0.004::DOUBLE OR held * (close - price) / price <= -0.003::DOUBLE"),
    shape=minute_bars, exit_type="fixed_pct", tp=0.004, sl=0.003,
)
_rule(
    "H17_cluster_drift_atr", "cluster_pair_drift",
    cluster_check(TR, f"y AS (SELECT *, {avg_full('tr', 14)} AS a FROM tr)", src="y", beyond="(a IS NOT NULL AND (held * (close - price) >= 0.5::DOUBLE * a OR held * (close - price) <= -0.4::DOUBLE * a))"),
    shape=minute_bars, exit_type="atr_based", tp=0.5, sl=0.4,
)


def macro_windows(source: str) -> list[tuple[str, int]]:
    hours = WINDOW_HOURS[source]
    return [(f"{d}T{h + hours:02d}:00:00", x) for _, d, h, x in calendar_rows(source)]


def macro_check(source: str, offset: int, hold: int, tp: float | None = None, sl: float | None = None) -> str:
    """Bar-by-bar state: direction, hold end, entry price, next window, noticed bar."""
    rows = ", ".join(f"({i}, TIMESTAMP '{e.replace('T', ' ')}', {x})" for i, (e, x) in enumerate(macro_windows(source)))
    lim = "false"
    if tp is not None:
        lim = f"(dir > 0 AND (high >= price * (1 + {tp}::DOUBLE) OR low <= price * (1 - {sl}::DOUBLE)) OR dir < 0 AND (low <= price * (1 - {tp}::DOUBLE) OR high >= price * (1 + {sl}::DOUBLE)))"
    st = f"""st AS (SELECT symbol, rn, ts, 0 AS dir, 0::BIGINT AS hold_until, 0.0::DOUBLE AS price, 0 AS nxt, NULL::BIGINT AS seen FROM cb WHERE rn = -1
 UNION ALL SELECT symbol, rn, ts, CASE WHEN fire THEN wdir ELSE d1 END, CASE WHEN fire THEN rn + {hold} ELSE hold_until END, CASE WHEN fire THEN close ELSE price END,
   CASE WHEN fire OR (d1 <> 0 AND seen IS NULL AND ts >= wend) THEN nxt + 1 ELSE nxt END, CASE WHEN fire THEN NULL ELSE seen1 END
 FROM (SELECT *, coalesce(d1 = 0 AND seen1 IS NOT NULL AND rn = seen1 + {offset}, false) AS fire FROM (
  SELECT *, CASE WHEN d1 = 0 AND seen IS NULL AND ts >= wend THEN rn ELSE seen END AS seen1 FROM (
   SELECT b.symbol, b.rn, b.ts, b.close, st.hold_until, st.price, st.nxt, st.seen, w.wend, w.wdir,
    CASE WHEN st.dir <> 0 AND (b.rn >= st.hold_until OR {lim.replace('dir ', 'st.dir ').replace('high', 'b.high').replace('low ', 'b.low ').replace('price', 'st.price')}) THEN 0 ELSE st.dir END AS d1
   FROM st JOIN cb b ON b.symbol = st.symbol AND b.rn = st.rn + 1 LEFT JOIN win w ON w.i = st.nxt))))"""
    cb = "cb AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, ts, high, low, close FROM bars UNION ALL SELECT DISTINCT symbol, -1, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM bars)"
    pos = "pos AS (SELECT symbol, ts, dir AS position FROM st WHERE rn >= 0)"
    return recursive(*QB, f"win(i, wend, wdir) AS (VALUES {rows})", cb, st, pos, body=f"SELECT symbol, ts, position::INTEGER AS position, {signal_sql()} AS signal FROM pos")


_rule("H20_boj_drift", "macro_event_drift", macro_check("boj", 1, 6), windows=macro_windows("boj"), min_offset=MIN_OFFSET["boj"], window_offset=1, hold_bars=6)
_rule("H20_boj_drift_limits", "macro_event_drift", macro_check("boj", 3, 24, 0.004, 0.02), windows=macro_windows("boj"), min_offset=MIN_OFFSET["boj"], window_offset=3, hold_bars=24, tp_pct=0.004, sl_pct=0.02)
_rule("H21_nfp_drift", "macro_event_drift", macro_check("nfp", 2, 8), windows=macro_windows("nfp"), min_offset=MIN_OFFSET["nfp"], window_offset=2, hold_bars=8)
_rule("H21_nfp_drift_limits", "macro_event_drift", macro_check("nfp", 2, 40, 0.015, 0.015), windows=macro_windows("nfp"), min_offset=MIN_OFFSET["nfp"], window_offset=2, hold_bars=40, tp_pct=0.015, sl_pct=0.015)
_rule("H21_ecb_drift", "macro_event_drift", macro_check("ecb", 2, 8), windows=macro_windows("ecb"), min_offset=MIN_OFFSET["ecb"], window_offset=2, hold_bars=8)
_rule("H21_fomc_drift", "macro_event_drift", macro_check("fomc", 2, 8), windows=macro_windows("fomc"), min_offset=MIN_OFFSET["fomc"], window_offset=2, hold_bars=8)
_rule(
    "H22_calendar_anomaly", "calendar_anomaly",
    rule_sql(*QB, src="bars", position="WHEN isodow(ts) = 2 AND day(ts) <= 10 THEN 1 WHEN isodow(ts) = 4 AND day(ts) > 10 AND day(ts) <= 20 THEN -1 WHEN isodow(ts) = 1 AND day(ts) > 20 THEN 1"),
)


_H23 = """mv AS (SELECT b.symbol, b.ts, b.close AS entry, r.close AS ref, (b.close / r.close - 1) * 10000 AS move, lead(b.close, 3) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS x FROM bars b LEFT JOIN bars r ON r.symbol = b.symbol AND r.ts = b.ts - INTERVAL 4 HOUR),
h23 AS (SELECT symbol, ts, CASE WHEN move >= 20 THEN -1 ELSE 1 END AS direction, entry, x, round((CASE WHEN move >= 20 THEN -1 ELSE 1 END) * (x / entry - 1) * 10000 - 4, 6) AS pnl_bps FROM mv WHERE hour(ts) = 21 AND abs(move) >= 20 AND x IS NOT NULL)"""


def reversal_trades(spark, sf):
    """21:00 moves against the close four hours earlier, faded for three bars."""
    bars = hourly(spark, sf)
    ref = bars.select("symbol", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("ts"), F.col("close").alias("ref"))
    moved = lookup.exits_ahead(bars, 3, "INTERVAL 3 HOURS").join(ref, ["symbol", "ts"]).filter("hour(ts) = 21")
    move = (F.col("close") / F.col("ref") - 1) * 10_000
    direction = F.when(move >= 20, -1).otherwise(1)
    t = moved.filter((F.abs(move) >= 20) & F.col("ahead").isNotNull()).withColumn("direction", direction)
    pnl = F.col("direction") * (F.col("ahead") / F.col("close") - 1) * 10_000 - 4
    return t.select("symbol", "ts", "direction", F.col("close").alias("entry"), F.col("ahead").alias("x"), F.round(pnl, 6).alias("pnl_bps"))


@query("H23_reference_move_reversal", sql(*QB, _H23, body="SELECT symbol, ts, direction, pnl_bps FROM h23"))
def _(spark, sf):
    return reversal_trades(spark, sf).select("symbol", "ts", "direction", "pnl_bps")


@query("H24_stance_mapping", sql(FAST, _SLOT30, STUDY_SCORES, body="SELECT direction, signal_side, stance, count(*) AS n FROM ev GROUP BY ALL"))
def _(spark, sf):
    return study_events(spark, sf).groupBy("direction", "signal_side", "stance").agg(rows_as("n"))


@query("H25_imbalance_events", sql(FAST, _SLOT30, STUDY_SCORES, body="""SELECT symbol, entry_us, score_family, lookback_seconds, threshold, direction, horizon_seconds, round(imbalance_score, 6) + 0.0 AS imbalance_score, round(threshold_value, 6) AS threshold_value, signal_side, exit_us FROM ev"""))
def _(spark, sf):
    ev = study_events(spark, sf)
    return ev.select(*imbalance.KEY, "entry_us", "imbalance_score", "threshold_value", "signal_side", "exit_us")


@query("flagship_sma_cross", sql(*QB, SMA_X, f"pos AS (SELECT symbol, ts, close, (CASE {SMA_P} ELSE 0 END) AS position FROM x)", f"sg AS (SELECT *, {signal_sql()} AS signal FROM pos)", account_ctes("sg", "0.0004"), body=performance_select("acc", 8760.0)))
def _(spark, sf):
    signals = apply_rule("sma_cross", hourly(spark, sf), K)
    return performance(account(signals, K, 0.0004), K, 8760.0)

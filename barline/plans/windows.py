"""Ordered-series (window) queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import calendar as cal
from barline.functions.stats import correlation
from barline.operators import imbalance, states
from barline.operators import indicators as ind
from barline.operators.accounting import sticky_position
from barline.operators.asof import asof_forward_grid
from barline.operators.indicators import by
from barline.operators.series import Run, rolling, running
from barline.plans.aggs import _CLIFF, _SLOT30, STUDY_SCORES, alpha_cliffs, study_scores
from barline.plans.checks import BARS, DAILY, FAST, QUOTES, REFERENCE, SLOTS, TORD, TRADES, ema_sql, sql
from barline.plans.joins import _GRID, _GRID_JOIN, grid_anchors
from barline.plans.registry import query
from barline.plans.shapes import hourly, rows_as
from barline.sources import tables as T

W = "PARTITION BY symbol ORDER BY ts"
K = ["symbol"]


def bars_sql(expr: str, name: str) -> str:
    """Check for one indicator column over hourly bars."""
    return sql(QUOTES, BARS, body=f"SELECT symbol, ts, round({expr}, 6) + 0.0 AS {name} FROM bars")


def full(expr: str, n: int, count_of: str = "close") -> str:
    f = f"({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({count_of}) OVER {f} = {n} THEN {expr.format(f=f)} END"


TR = """tr0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars),
tr AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr FROM tr0)"""


@query("E01_lag_in_bucket", sql(FAST, _SLOT30, body="SELECT symbol, us, event_id, round(mid, 6) AS mid, round(pm, 6) AS prev_mid FROM prev"))
def _(spark, sf):
    return imbalance.with_previous_mid(T.fast_quotes(spark, sf)).select("symbol", "us", "event_id", "mid", "prev_mid")


@query("E02_row_number_first", sql(FAST, _GRID, body=f"SELECT symbol, anchor_us, quote_us FROM ({_GRID_JOIN}) WHERE quote_us IS NOT NULL"))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    return asof_forward_grid(grid_anchors(q), q, ["symbol"], "anchor_us").filter("quote_us IS NOT NULL").select("symbol", "anchor_us", "quote_us")


def _family(name):
    return sql(FAST, _SLOT30, STUDY_SCORES, body=f"SELECT symbol, entry_us, lookback_seconds, round(imbalance_score, 6) + 0.0 AS imbalance_score FROM feat WHERE score_family = '{name}'")


@query("E03_rolling_volume_imbalance", _family(imbalance.FAMILIES[0]))
def _(spark, sf):
    t = imbalance.bucket_totals(T.fast_quotes(spark, sf))
    return imbalance.features(t, families=imbalance.FAMILIES[:1]).select("symbol", "entry_us", "lookback_seconds", "imbalance_score")


@query("E04_rolling_direction_imbalance", _family(imbalance.FAMILIES[1]))
def _(spark, sf):
    t = imbalance.bucket_totals(T.fast_quotes(spark, sf))
    return imbalance.features(t, families=imbalance.FAMILIES[1:]).select("symbol", "entry_us", "lookback_seconds", "imbalance_score")


@query("G01_union_of_families", sql(FAST, _SLOT30, STUDY_SCORES, body="SELECT score_family, lookback_seconds, count(*) AS n, count(imbalance_score) AS scored, round(sum(coalesce(imbalance_score, 0)), 4) AS total FROM feat GROUP BY ALL"))
def _(spark, sf):
    return study_scores(spark, sf).groupBy("score_family", "lookback_seconds").agg(
        rows_as("n"), F.count("imbalance_score").alias("scored"), F.round(F.sum(F.coalesce("imbalance_score", F.lit(0.0))), 4).alias("total")
    )


def _indicator(name, check, build):
    @query(name, check)
    def _(spark, sf):
        return build(hourly(spark, sf))


def _column(name, expr_sql, make):
    """Registers one indicator column; ``make(window)`` builds it."""
    label = name.split("_", 1)[1]

    @query(name, bars_sql(expr_sql, label))
    def _(spark, sf):
        return hourly(spark, sf).select("symbol", "ts", make(by(K)).alias(label))


_column("E05_sma", full("avg(close) OVER {f}", 10), lambda w: ind.sma(F.col("close"), 10, w))


@query("E05_sma_ticks", sql(QUOTES, body="SELECT symbol, event_id, round(CASE WHEN row_number() OVER w >= 20 THEN avg(bid) OVER (PARTITION BY symbol ORDER BY us, event_id ROWS 19 PRECEDING) END, 6) AS sma FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY us, event_id)"))
def _(spark, sf):
    q = T.quotes(spark, sf).select("symbol", "us", "event_id", "bid")
    out = rolling(q, ["symbol"], ["us", "event_id"], lambda w: {"m": F.avg("bid").over(w.rowsBetween(-19, 0))}, back=19, index="rn")
    return out.select("symbol", "event_id", F.when(F.col("rn") >= 20, F.col("m")).alias("sma"))


@query("E06_ema", bars_sql(ema_sql("close", 2 / 13), "ema"))
def _(spark, sf):
    return ind.with_ema(hourly(spark, sf), K, F.col("close"), 12, "ema").select("symbol", "ts", "ema")


@query("E07_true_range", sql(QUOTES, BARS, TR, body="SELECT symbol, ts, round(tr, 6) AS true_range FROM tr"))
def _(spark, sf):
    return hourly(spark, sf).select("symbol", "ts", ind.true_range(by(K)).alias("true_range"))


@query("E08_atr", sql(QUOTES, BARS, TR, body=f"SELECT symbol, ts, round({full('avg(tr) OVER {f}', 14, 'tr')}, 6) AS atr FROM tr"))
def _(spark, sf):
    return ind.with_atr(hourly(spark, sf), K, 14).select("symbol", "ts", "atr")


_WILDER = """w0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS m FROM tr),
w1 AS (SELECT *, CASE WHEN rn >= 14 THEN list_reduce(list(CASE WHEN rn = 14 THEN m ELSE tr END) FILTER (rn >= 14) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda y, x: y + (x - y) / 14.0::DOUBLE) END AS watr FROM w0)"""


@query("E09_wilder_atr", sql(QUOTES, BARS, TR, _WILDER, body="SELECT symbol, ts, round(watr, 6) AS watr FROM w1"))
def _(spark, sf):
    return ind.with_wilder_atr(hourly(spark, sf), K).select("symbol", "ts", "watr")


_column("E10_rolling_std", full("stddev_samp(close) OVER {f}", 20), lambda w: ind.rolling_std(F.col("close"), 20, w))
_column("E11_rolling_max", full("max(high) OVER {f}", 15), lambda w: ind.rolling_max(F.col("high"), 15, w))
_column("E11_rolling_min", full("min(low) OVER {f}", 15), lambda w: ind.rolling_min(F.col("low"), 15, w))
_column("E12_rolling_median", full("median(close) OVER {f}", 21), lambda w: ind.rolling_median(F.col("close"), 21, w))
_column("E13_rolling_quantile", full("quantile_cont(close, 0.2) OVER {f}", 25), lambda w: ind.rolling_quantile(F.col("close"), 25, 0.2, w))

_DTR = """dtr0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM daily),
tr AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr FROM dtr0)"""


@query("E14_pooled_quantiles", sql(DAILY, _DTR, _WILDER, body="""SELECT symbol, ts, round(watr, 6) AS watr, round(lo, 6) AS q33, round(hi, 6) AS q67,
 CASE WHEN watr IS NULL THEN 'VOL_NA' WHEN watr < lo THEN 'VOL_LOW' WHEN watr < hi THEN 'VOL_MID' ELSE 'VOL_HIGH' END AS bucket FROM (
 SELECT *, quantile_cont(watr, 0.33) OVER p AS lo, quantile_cont(watr, 0.67) OVER p AS hi FROM w1 WINDOW p AS (ORDER BY ts, symbol ROWS 89 PRECEDING))"""))
def _(spark, sf):
    vol = ind.with_wilder_atr(T.daily_prices(spark, sf), K)
    pooled = states.pooled_quantiles(vol, "watr", 30 * 3, {"q33": 0.33, "q67": 0.67}, ["ts", "symbol"])
    labelled = pooled.withColumn("bucket", states.vol_bucket(F.col("watr"), F.col("q33"), F.col("q67")))
    return labelled.select("symbol", "ts", "bucket", "watr", "q33", "q67")


_RSI = """dl AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
gl AS (SELECT *, list_reduce(list(greatest(d, 0)) FILTER (rn >= 2) OVER f, lambda y, x: y + (x - y) / 14.0::DOUBLE) AS g, list_reduce(list(greatest(-d, 0)) FILTER (rn >= 2) OVER f, lambda y, x: y + (x - y) / 14.0::DOUBLE) AS l
 FROM (SELECT *, coalesce(d, 0) AS d0 FROM dl) WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rsi AS (SELECT *, CASE WHEN rn >= 15 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END END AS rsi FROM gl)"""


@query("E15_rsi", sql(QUOTES, BARS, _RSI, body="SELECT symbol, ts, round(rsi, 6) AS rsi FROM rsi"))
def _(spark, sf):
    return ind.with_rsi(hourly(spark, sf), K, 14).select("symbol", "ts", "rsi")


_column("E16_roc", f"close / nullif(lag(close, 6) OVER ({W}), 0) - 1", lambda w: ind.roc(F.col("close"), 6, w))
_column("E17_parkinson", full("sqrt(avg(pow(ln(high / low), 2) / (4 * ln(2))) OVER {f})", 12), lambda w: ind.parkinson(12, w))
_column("E18_shift_back", f"lag(close, 3) OVER ({W})", lambda w: F.lag("close", 3).over(w))
_column("E18_shift_ahead", f"lead(close, 3) OVER ({W})", lambda w: F.lead("close", 3).over(w))
_column("E19_log_return", f"ln(close / lag(close) OVER ({W}))", lambda w: ind.log_return(w))
_column(
    "E20_rolling_zscore",
    f"coalesce((close - avg(close) OVER f) / nullif(CASE WHEN count(*) OVER f = 20 THEN stddev_samp(close) OVER f END, 0), 0)".replace("OVER f", f"OVER ({W} ROWS 19 PRECEDING)"),
    lambda w: states.rolling_z(F.col("close"), 20, w),
)


@query("E21_lagged_return_sum", sql(QUOTES, BARS, "lr AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars)", body="SELECT symbol, ts, round(sum(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS momentum FROM lr"))
def _(spark, sf):
    lr = hourly(spark, sf).withColumn("r", ind.log_return(by(K)))
    return lr.select("symbol", "ts", F.sum("r").over(by(K).rowsBetween(-10, -1)).alias("momentum"))


@query("E22_rolling_correlation", sql(DAILY, REFERENCE, """j AS (SELECT symbol, ts, close, value FROM daily JOIN reference USING (ts))""", body="""SELECT symbol, ts, round(CASE WHEN count(*) OVER f >= 60 THEN corr(close, value) OVER f END, 5) AS corr60 FROM j WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)"""))
def _(spark, sf):
    j = T.daily_prices(spark, sf).select("symbol", "ts", "close").join(T.reference_series(spark, sf), "ts")
    f = by(K).rowsBetween(-59, 0)
    return j.select("symbol", "ts", F.round(F.when(F.count(F.lit(1)).over(f) >= 60, correlation("close", "value", f)), 5).alias("corr60"))


CF = "PARTITION BY cell_id, fold ORDER BY " + TORD
KEYS = ["cell_id", "fold"]
ORD = list(T.TRADE_ORDER)


def trade_series(spark, sf):
    """The columns a scan over trades needs; a scan writes what it is given."""
    return T.trades(spark, sf).select(*KEYS, *ORD, "pnl")


@query("E23_cumulative_equity", sql(TRADES, f"c AS (SELECT *, 1 + sum(pnl / 10000) OVER ({CF}) AS e FROM trades)", body="SELECT cell_id, fold, count(*) AS n, round(min(e), 6) AS low, round(max(e), 6) AS high, round(avg(e), 6) AS mean FROM c GROUP BY ALL"))
def _(spark, sf):
    c = running(trade_series(spark, sf), KEYS, ORD, {"cum": Run("sum", F.col("pnl"))}).withColumn("e", 1 + F.col("cum") / 10_000)
    return c.groupBy(*KEYS).agg(rows_as("n"), F.min("e").alias("low"), F.max("e").alias("high"), F.avg("e").alias("mean"))


@query("E24_product_equity", sql(TRADES, f"c AS (SELECT *, product(1 + pnl / 100000) OVER ({CF}) AS e FROM trades)", body="SELECT cell_id, fold, count(*) AS n, round(min(e), 6) AS low, round(max(e), 6) AS high FROM c GROUP BY ALL"))
def _(spark, sf):
    c = running(trade_series(spark, sf), KEYS, ORD, {"e": Run("product", 1 + F.col("pnl") / 100_000)})
    return c.groupBy(*KEYS).agg(rows_as("n"), F.min("e").alias("low"), F.max("e").alias("high"))


@query("E25_drawdown", sql(TRADES, f"c AS (SELECT *, product(1 + pnl / 100000) OVER ({CF}) AS e FROM trades)", f"d AS (SELECT *, max(e) OVER ({CF}) AS p FROM c)", body="SELECT cell_id, fold, round(min((e - p) / p), 6) + 0.0 AS max_drawdown, round(avg((e - p) / p), 6) + 0.0 AS mean_drawdown FROM d GROUP BY ALL"))
def _(spark, sf):
    growth, peak = {"e": Run("product", 1 + F.col("pnl") / 100_000)}, {"p": Run("max", F.col("e"))}
    dd = running(trade_series(spark, sf), KEYS, ORD, growth, peak).withColumn("dd", (F.col("e") - F.col("p")) / F.col("p"))
    return dd.groupBy(*KEYS).agg(F.min("dd").alias("max_drawdown"), F.avg("dd").alias("mean_drawdown"))


@query("E26_drawdown_bps", sql(TRADES, f"c AS (SELECT *, sum(pnl) OVER ({CF}) AS e FROM trades)", f"d AS (SELECT *, greatest(max(e) OVER ({CF}), 0) AS p FROM c)", body="SELECT cell_id, fold, min(e - p) AS max_drawdown FROM d GROUP BY ALL"))
def _(spark, sf):
    dd = running(trade_series(spark, sf), KEYS, ORD, {"e": Run("sum", F.col("pnl"))}, {"p": Run("max", F.col("e"))})
    return dd.groupBy(*KEYS).agg(F.min(F.col("e") - F.greatest(F.col("p"), F.lit(0.0))).alias("max_drawdown"))


_DAYEQ = """dp AS (SELECT cell_id, ts, sum(pnl) / 10000 AS p FROM trades GROUP BY ALL), eq AS (SELECT *, 1 + sum(p) OVER (PARTITION BY cell_id ORDER BY ts) AS equity FROM dp)"""


@query("E27_overlay_equity", sql(TRADES, _DAYEQ, """o AS (SELECT *, coalesce(equity - lag(equity) OVER (PARTITION BY cell_id ORDER BY ts), 0) * (CASE WHEN day(ts) % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END) AS d, first_value(equity) OVER (PARTITION BY cell_id ORDER BY ts) AS e0 FROM eq)""",
 body="SELECT cell_id, ts, round(e0 + sum(d) OVER (PARTITION BY cell_id ORDER BY ts), 6) AS equity_on FROM o"))
def _(spark, sf):
    eq = states.daily_equity(T.trades(spark, sf)).withColumn("m_t", F.when(F.dayofmonth("ts") % 2 == 0, 0.5).otherwise(1.0))
    return states.overlay_equity(eq, ["cell_id"]).select("cell_id", "ts", "equity_on")


@query("E28_first_difference", sql(TRADES, _DAYEQ, body="SELECT cell_id, ts, round(equity - lag(equity) OVER (PARTITION BY cell_id ORDER BY ts), 6) + 0.0 AS diff FROM eq"))
def _(spark, sf):
    eq = states.daily_equity(T.trades(spark, sf))
    return eq.select("cell_id", "ts", (F.col("equity") - F.lag("equity").over(by(["cell_id"]))).alias("diff"))


@query("E29_loss_streak", sql(TRADES, f"i AS (SELECT *, count(*) FILTER (pnl > 0) OVER ({CF}) AS isl FROM trades)", f"s AS (SELECT *, count(*) FILTER (pnl < 0) OVER (PARTITION BY cell_id, fold, isl ORDER BY {TORD}) AS streak FROM i)",
 body="SELECT cell_id, fold, max(streak) AS longest, sum(streak)::BIGINT AS total, count(*) FILTER (streak >= 5) AS closed FROM s GROUP BY ALL"))
def _(spark, sf):
    s = states.loss_streak(trade_series(spark, sf), KEYS, ORD)
    return s.groupBy(*KEYS).agg(F.max("streak").alias("longest"), F.sum("streak").alias("total"), F.count_if(F.col("streak") >= 5).alias("closed"))


@query("E29_role_streak", """SELECT role, max(streak) AS longest, count(*) AS n FROM (SELECT *, count(*) FILTER (length(text) < 200) OVER (PARTITION BY conv_id, isl ORDER BY turn) AS streak FROM (
 SELECT *, count(*) FILTER (length(text) >= 200) OVER (PARTITION BY conv_id ORDER BY turn) AS isl FROM conversations)) GROUP BY 1""")
def _(spark, sf):
    c = T.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(F.length("text") < 200, -1.0).otherwise(1.0).alias("pnl"))
    return states.loss_streak(c, ["conv_id"], ["turn"]).groupBy("role").agg(F.max("streak").alias("longest"), rows_as("n"))


@query("E30_daily_loss_sum", sql(TRADES, f"l AS (SELECT *, sum(greatest(-pnl, 0)) OVER (PARTITION BY cell_id, ts::DATE ORDER BY {TORD}) AS day_loss FROM trades)", body="SELECT cell_id, max(day_loss) AS worst, count(*) FILTER (day_loss >= 60) AS over_limit FROM l GROUP BY 1"))
def _(spark, sf):
    t = trade_series(spark, sf).withColumn("day", F.to_date("ts"))
    losses = Run("sum", F.greatest(-F.col("pnl"), F.lit(0.0)))
    out = running(t, ["cell_id", "day"], ORD, {"day_loss": losses})
    return out.groupBy("cell_id").agg(F.max("day_loss").alias("worst"), F.count_if(F.col("day_loss") >= 60).alias("over_limit"))


@query("E31_trading_day_ordinal", sql(DAILY, body="""SELECT symbol, ts, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS day_no, count(*) OVER (PARTITION BY symbol, date_trunc('month', ts)) - row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS days_left,
 row_number() OVER (PARTITION BY symbol, date_trunc('quarter', ts) ORDER BY ts) AS q_day FROM daily"""))
def _(spark, sf):
    return states.trading_day_ordinals(T.daily_prices(spark, sf)).select("symbol", "ts", "day_no", "days_left", "q_day")


@query("E32_dedup_null_last", sql(TRADES, body="SELECT pair, fold, x, qty FROM (SELECT pair, fold, CASE WHEN qty > 10 THEN qty END AS x, qty, row_number() OVER (PARTITION BY pair, fold ORDER BY CASE WHEN qty > 10 THEN qty END NULLS LAST, qty) AS rn FROM trades) WHERE rn = 1"))
def _(spark, sf):
    t = T.trades(spark, sf).withColumn("x", F.when(F.col("qty") > 10, F.col("qty")))
    # One aggregate instead of numbering a whole group in one task.
    best = F.min_by(F.struct("x", "qty"), F.struct(F.col("x").isNull(), "x", "qty"))
    return t.groupBy("pair", "fold").agg(best.alias("b")).select("pair", "fold", "b.*")


_SIG = "sg AS (SELECT *, CASE (epoch(ts)::BIGINT // 3600) % 7 WHEN 1 THEN 1 WHEN 3 THEN -1 WHEN 5 THEN 2 ELSE 0 END AS signal FROM bars)"


def toy_signal(df):
    h = F.floor(F.unix_micros("ts") / 3_600_000_000) % 7
    return df.withColumn("signal", F.when(h == 1, 1).when(h == 3, -1).when(h == 5, 2).otherwise(0))


@query("E33_sticky_position", sql(QUOTES, BARS, _SIG, body=f"""SELECT symbol, ts, CASE WHEN abs(p) = 2 THEN 0 ELSE p END AS position, greatest(CASE WHEN abs(p) = 2 THEN 0 ELSE p END, 0) AS long_only FROM (
 SELECT symbol, ts, coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM sg)"""))
def _(spark, sf):
    s = toy_signal(hourly(spark, sf))
    return s.select("symbol", "ts", sticky_position(K).alias("position"), sticky_position(K, mode=1).alias("long_only"))


_MIN = """m1 AS (SELECT symbol, us // 60000000 AS m, make_timestamp(us // 60000000 * 60000000) AS ts, arg_max(bid, (us, event_id)) AS close FROM fast GROUP BY 1, 2, 3),
sgn AS (SELECT *, CASE m % 9 WHEN 0 THEN 1 WHEN 4 THEN -1 WHEN 7 THEN 2 ELSE 0 END AS signal, hour(ts) * 60 + minute(ts) AS mod FROM m1),
bl AS (SELECT *, mod BETWEEN 745 AND 755 OR mod BETWEEN 805 AND 815 OR mod BETWEEN 835 AND 850 OR mod BETWEEN 895 AND 910 OR mod BETWEEN 1320 AND 1330 OR mod BETWEEN 0 AND 10 OR mod BETWEEN 50 AND 59 AS blk FROM sgn)"""


def minute_signals(spark, sf):
    from barline.operators.bars import ticks_to_bars

    m = ticks_to_bars(T.fast_quotes(spark, sf), "1m")
    k = F.floor(F.unix_micros("ts") / 60_000_000) % 9
    return m.withColumn("signal", F.when(k == 0, 1).when(k == 4, -1).when(k == 7, 2).otherwise(0))


@query("E34_deferred_signal", sql(FAST, _MIN, """is1 AS (SELECT *, count(*) FILTER (NOT blk) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM bl)""",
 """pn AS (SELECT *, last_value(CASE WHEN blk AND signal <> 0 THEN signal END IGNORE NULLS) OVER (PARTITION BY symbol, seg ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pend FROM is1)""",
 body="""SELECT symbol, ts, (CASE WHEN blk THEN CASE WHEN abs(signal) = 2 THEN signal ELSE 0 END WHEN signal <> 0 THEN signal WHEN abs(pend) = 1 THEN pend ELSE 0 END)::INTEGER AS signal FROM pn"""))
def _(spark, sf):
    return states.defer_blackout(minute_signals(spark, sf), K, cal.is_blackout(F.col("ts"))).select("symbol", "ts", "signal")


@query("E35_hold_n_bars", sql(QUOTES, BARS, body=f"SELECT symbol, ts, coalesce(max(CASE WHEN hour(ts) = 9 THEN 1 END) OVER ({W} ROWS 3 PRECEDING), 0) AS held FROM bars"))
def _(spark, sf):
    return hourly(spark, sf).select("symbol", "ts", states.hold_bars(F.hour("ts") == 9, 4, by(K)).alias("held"))


_CLUSTERS = """ab AS (SELECT ts, avg(abs(p)) AS a FROM (SELECT cell_id, ts, sum(pnl) AS p FROM trades GROUP BY ALL) GROUP BY 1),
rv AS (SELECT * FROM (SELECT ts, CASE WHEN count(*) OVER f = 20 THEN stddev_samp(a) OVER f END AS rvol FROM ab WINDOW f AS (ORDER BY ts ROWS 19 PRECEDING)) WHERE rvol IS NOT NULL),
fl AS (SELECT * FROM rv WHERE rvol >= (SELECT quantile_cont(rvol, 0.95) FROM rv)),
gp AS (SELECT *, sum(CASE WHEN date_diff('day', prev, ts) <= 5 THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS g FROM (SELECT *, lag(ts) OVER (ORDER BY ts) AS prev FROM fl))"""


@query("E36_proximity_clusters", sql(TRADES, _CLUSTERS, body="SELECT (row_number() OVER (ORDER BY count(*) DESC, min(ts)) - 1)::INTEGER AS cluster_id, min(ts) AS start, max(ts) AS \"end\", round(max(rvol), 6) AS peak_vol, count(*) AS n_bars FROM gp GROUP BY g ORDER BY n_bars DESC, min(ts) LIMIT 3"))
def _(spark, sf):
    return states.stress_clusters(stress_base(spark, sf), quantile=0.95)


def stress_base(spark, sf):
    """Mean absolute daily pnl over cells: one row per day."""
    per = T.trades(spark, sf).groupBy("cell_id", "ts").agg(F.sum("pnl").alias("p"))
    return per.groupBy("ts").agg(F.avg(F.abs("p")).alias("level"))


@query("E37_flag_transitions", sql(TRADES, "dp AS (SELECT cell_id, ts, (max(qty) > 40)::INTEGER AS flag FROM trades GROUP BY ALL)", body="SELECT cell_id, sum(d)::BIGINT AS transitions FROM (SELECT cell_id, abs(flag - lag(flag) OVER (PARTITION BY cell_id ORDER BY ts)) AS d FROM dp) GROUP BY 1"))
def _(spark, sf):
    flags = T.trades(spark, sf).groupBy("cell_id", "ts").agg((F.max("qty") > 40).cast("int").alias("flag"))
    step = F.abs(F.col("flag") - F.lag("flag").over(by(["cell_id"])))
    return flags.withColumn("d", step).groupBy("cell_id").agg(F.sum("d").alias("transitions"))


@query("E38_fee_flip", sql(SLOTS, "ps AS (SELECT event, wo, hb, et, fee, sign(sum(sign))::INTEGER AS dir FROM slots GROUP BY ALL)", "pv AS (SELECT *, lag(dir) OVER (PARTITION BY event, wo, hb, et ORDER BY fee) AS pd, lag(fee) OVER (PARTITION BY event, wo, hb, et ORDER BY fee) AS pf FROM ps)",
 body="SELECT event, wo, hb, et, pf AS fee_low, fee AS fee_high, pd AS dir_low, dir AS dir_high FROM pv WHERE pd * dir = -1"))
def _(spark, sf):
    pooled = T.slot_reports(spark, sf).groupBy("event", "wo", "hb", "et", "fee").agg(F.signum(F.sum("sign")).cast("int").alias("dir_high"))
    w = Window.partitionBy("event", "wo", "hb", "et").orderBy("fee")
    steps = pooled.withColumn("dir_low", F.lag("dir_high").over(w)).withColumn("fee_low", F.lag("fee").over(w))
    return steps.filter("dir_low * dir_high = -1").withColumnRenamed("fee", "fee_high")


@query("E39_alpha_cliff", sql(SLOTS, _CLIFF, body="SELECT * FROM cliff"))
def _(spark, sf):
    return alpha_cliffs(spark, sf)


@query("E40_adjacent_offsets", sql(SLOTS, "b AS (SELECT wo, hb, et, fee, sum(net_sum) / sum(trades) AS s FROM slots GROUP BY ALL)", "pr AS (SELECT a.wo AS wo_a, c.wo AS wo_b, corr(a.s, c.s) AS r, count(*) AS n FROM b a JOIN b c USING (hb, et, fee) WHERE c.wo = (SELECT min(wo) FROM b x WHERE x.wo > a.wo) GROUP BY ALL)",
 body="SELECT wo_a, wo_b, n, round(r, 6) AS r, round((SELECT median(r) FROM pr), 6) AS rho_bar FROM pr"))
def _(spark, sf):
    b = T.slot_reports(spark, sf).groupBy("wo", "hb", "et", "fee").agg((F.sum("net_sum") / F.sum("trades")).alias("s"))
    return states.adjacent_correlation(b, "wo", ["hb", "et", "fee"], "s")

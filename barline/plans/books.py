"""Accounting, folds, sweeps, portfolio, trades and selection."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions.draws import uniform_sql
from barline.operators import folds, history, portfolio, selection, states
from barline.operators import trades as tr
from barline.operators.accounting import LONG_ONLY, account, performance
from barline.operators.bars import PERIODS_PER_YEAR
from barline.operators.indicators import by, with_atr
from barline.operators.lookup import first_overlap, neighbour_sums
from barline.operators.rules import apply_rule
from barline.operators.series import fan_out
from barline.plans.aggs import _SCEN, _SLOT30, STUDY_PRICED, STUDY_SCORES, alpha_cliffs, study_priced, _CLIFF
from barline.plans.checks import (
    BARS, BARS4, DAILY, FAST, QUOTES, SLOTS, TRADES, account_ctes, performance_select, signal_sql, sql,
)
from barline.plans.joins import _TRIALS, trials
from barline.plans.registry import query
from barline.plans.rulesets import K, SMA_P, SMA_X, avg_full, recursive
from barline.plans.shapes import four_hourly, hourly, rows_as
from barline.plans.windows import _CLUSTERS, _SIG, TR, stress_base, toy_signal
from barline.sources import tables as T

QB = (QUOTES, BARS)
ACC = "SELECT symbol, ts, position_::INTEGER AS position, round(ret_, 6) + 0.0 AS ret, round(equity_, 6) AS equity FROM acc"


def accounted(df):
    return df.select("symbol", "ts", "position", "ret", "equity")


@query("I01_position_accounting", sql(*QB, _SIG, account_ctes("sg", "0.0004"), body=ACC))
def _(spark, sf):
    return accounted(account(toy_signal(hourly(spark, sf)), K, 0.0004))


@query("I01_long_only", sql(*QB, _SIG, account_ctes("sg", "0.0004", mode=1), body=ACC))
def _(spark, sf):
    return accounted(account(toy_signal(hourly(spark, sf)), K, 0.0004, mode=LONG_ONLY))


@query("I02_sized_accounting", sql(*QB, _SIG, account_ctes("sg", "0.0004", size="0.4"), body=ACC))
def _(spark, sf):
    return accounted(account(toy_signal(hourly(spark, sf)), K, 0.0004, size=0.4))


@query("I03_hourly_fee", sql(*QB, _SIG, account_ctes("sg", "0.0004::DOUBLE * (CASE WHEN hour(ts) IN (0, 1) THEN 0.8 WHEN hour(ts) = 21 THEN 2.0 ELSE 1.0 END)::DOUBLE", flatten=False), body=ACC))
def _(spark, sf):
    return accounted(account(toy_signal(hourly(spark, sf)), K, 0.0004, hourly_fee=True))


_STOP = """sb AS (SELECT symbol, ts, high, low, close, signal, a, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM sg),
st AS (SELECT symbol, rn, ts, close AS pc, 0 AS side, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS target, false AS rest, 0.0::DOUBLE AS ret, 0 AS closed FROM sb WHERE rn = 1
 UNION ALL SELECT symbol, rn, ts, close, CASE WHEN enter <> 0 THEN enter WHEN exit_kind > 0 THEN 0 ELSE side END,
  CASE WHEN enter <> 0 THEN close - enter * (CASE WHEN a IS NOT NULL THEN a * 1.5::DOUBLE ELSE close * 0.004::DOUBLE END) ELSE stop END,
  CASE WHEN enter <> 0 THEN close + enter * (CASE WHEN a IS NOT NULL THEN a * 2.0::DOUBLE ELSE close * 0.006::DOUBLE END) ELSE target END,
  exit_kind = 3, CASE WHEN side <> 0 THEN side * ((CASE exit_kind WHEN 1 THEN stop WHEN 2 THEN target ELSE close END) - pc) / pc ELSE 0 END - (CASE WHEN exit_kind > 0 THEN 0.0004::DOUBLE ELSE 0 END) - (CASE WHEN enter <> 0 THEN 0.0004::DOUBLE ELSE 0 END),
  (exit_kind > 0)::INTEGER
 FROM (SELECT *, CASE WHEN side = 0 AND NOT rest AND abs(signal) = 1 THEN signal ELSE 0 END AS enter FROM (
  SELECT b.symbol, b.rn, b.ts, b.close, b.signal, b.a, st.pc, st.side, st.stop, st.target, st.rest,
   CASE WHEN st.side = 0 THEN 0 WHEN abs(b.signal) = 2 THEN 3 WHEN (st.side = 1 AND b.low <= st.stop) OR (st.side = -1 AND b.high >= st.stop) THEN 1
    WHEN (st.side = 1 AND b.high >= st.target) OR (st.side = -1 AND b.low <= st.target) THEN 2 ELSE 0 END AS exit_kind
  FROM st JOIN sb b ON b.symbol = st.symbol AND b.rn = st.rn + 1)))"""


@query("I04_stop_target_accounting", recursive(*QB, TR, f"tb AS (SELECT *, {avg_full('tr', 14)} AS a FROM tr)", _SIG.replace("FROM bars", "FROM tb"), _STOP, body="SELECT symbol, ts, round(ret, 6) + 0.0 AS ret, closed FROM st"))
def _(spark, sf):
    b = with_atr(toy_signal(hourly(spark, sf)), K, 14)
    out = history.stopped_accounting(b, K, 0.0004, sl_atr=1.5, tp_atr=2.0, sl_pct=0.004, tp_pct=0.006)
    return out.select("symbol", "ts", "ret", "closed")


@query("I05_performance_metrics", sql(*QB, _SIG, account_ctes("sg", "0.0004"), body=performance_select("acc", 8760.0)))
def _(spark, sf):
    return performance(account(toy_signal(hourly(spark, sf)), K, 0.0004), K, 8760.0)


@query("I06_periods_per_year", sql(QUOTES, BARS, BARS4, body="""SELECT tf, symbol, bars, ppy, round(bars / ppy, 6) AS years FROM (SELECT '1h' AS tf, symbol, count(*) AS bars, 8760.0::DOUBLE AS ppy FROM bars GROUP BY symbol UNION ALL SELECT '4h', symbol, count(*), 2190.0 FROM bars4 GROUP BY symbol)"""))
def _(spark, sf):
    one = hourly(spark, sf).withColumn("tf", F.lit("1h"))
    n = one.unionByName(four_hourly(spark, sf).withColumn("tf", F.lit("4h"))).groupBy("tf", "symbol").agg(rows_as("bars"))
    ppy = F.create_map(*[F.lit(x) for kv in PERIODS_PER_YEAR.items() for x in kv])[F.col("tf")]
    return n.withColumn("ppy", ppy).withColumn("years", F.col("bars") / F.col("ppy"))


_WALKS = """sp AS (SELECT symbol, count(*) AS n_bars, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000::DOUBLE AS days FROM {b} GROUP BY 1),
walks AS (SELECT symbol, fold, floor(({i} + fold * {o}) * (n_bars / (days / 30.44::DOUBLE)))::BIGINT AS is_end, floor(({i} + (fold + 1) * {o}) * (n_bars / (days / 30.44::DOUBLE)))::BIGINT AS oos_end, n_bars FROM sp, (SELECT unnest(range({n}))::INTEGER AS fold))"""


@query("I07_anchored_walks", sql(DAILY, _WALKS.format(b="daily", i=24, o=6, n=12), body="SELECT symbol, fold, is_end, oos_end FROM walks WHERE oos_end <= n_bars"))
def _(spark, sf):
    return history.anchored_walks(T.daily_prices(spark, sf), 24, 6, 12)


_KFOLD = """ix AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
kf AS (SELECT * FROM (SELECT ix.*, fold, CASE WHEN idx >= fold * (n // 5) AND idx < CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END THEN 'oos'
 WHEN idx < fold * (n // 5) - 10 OR idx >= CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END + 10 THEN 'is' END AS role FROM ix, (SELECT unnest(range(5))::INTEGER AS fold)) WHERE role IS NOT NULL)"""


@query("I08_purged_folds", sql(*QB, _KFOLD, body="SELECT symbol, fold, role, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM kf GROUP BY ALL"))
def _(spark, sf):
    f = history.purged_folds(hourly(spark, sf), 5, 10)
    return f.groupBy("symbol", "fold", "role").agg(rows_as("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def keyed_sma(src: str, keys: str, s: str, l: str, out: str = "acc") -> str:
    """SMA cross restarted per key, accounted."""
    w = lambda n: f"(PARTITION BY {keys} ORDER BY ts ROWS {n} - 1 PRECEDING)"
    m = lambda n: f"CASE WHEN count(*) OVER {w(n)} = {n} THEN avg(close) OVER {w(n)} END"
    return f"ks AS (SELECT *, {m(s)} AS s, {m(l)} AS l FROM {src}), kp AS (SELECT *, (CASE {SMA_P} ELSE 0 END) AS position FROM ks), kg AS (SELECT *, {signal_sql(keys)} AS signal FROM kp), " + account_ctes("kg", "0.0004", keys=keys, out=out)


_FOLD_KEYS = "symbol, fold, role"


@query("I09_fold_evaluation", sql(*QB, _KFOLD, keyed_sma("kf", _FOLD_KEYS, "5", "20"), f"pm AS ({performance_select('acc', 8760.0, _FOLD_KEYS)})", """pw AS (SELECT i.symbol, i.fold, i.profit_factor AS is_pf, o.profit_factor AS oos_pf, o.trades AS oos_trades, o.sharpe AS oos_sharpe FROM (SELECT * FROM pm WHERE role = 'is') i JOIN (SELECT * FROM pm WHERE role = 'oos') o USING (symbol, fold))""",
 body="SELECT symbol, fold, is_pf, oos_pf, oos_trades, oos_sharpe, round(oos_pf / is_pf, 4) AS wfe FROM pw"))
def _(spark, sf):
    kf = history.purged_folds(hourly(spark, sf), 5, 10)
    m = history.evaluate(kf, ["symbol", "fold", "role"], lambda d, k: apply_rule("sma_cross", d, k), 0.0004, 8760.0)
    w = history.walk_results(m, ["symbol", "fold"])
    wfe = F.round(F.round("oos_profit_factor", 6) / F.round("is_profit_factor", 6), 4)
    return w.select("symbol", "fold", F.col("is_profit_factor").alias("is_pf"), F.col("oos_profit_factor").alias("oos_pf"), "oos_trades", "oos_sharpe", wfe.alias("wfe"))


GRID = [(3, 10), (5, 20), (8, 20), (5, 40), (8, 40), (13, 40)]
_GRIDSQL = "gr(param_id, short_n, long_n) AS (VALUES " + ", ".join(f"({i}, {s}, {l})" for i, (s, l) in enumerate(GRID)) + ")"


def grid_sma_sql(src: str, keys: str, grid: list[tuple[int, int]]) -> str:
    """One branch per parameter pair, then accounting over all of them."""
    parts = []
    for i, (s, l) in enumerate(grid):
        m = lambda n: f"CASE WHEN count(*) OVER (PARTITION BY {keys} ORDER BY ts ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER (PARTITION BY {keys} ORDER BY ts ROWS {n - 1} PRECEDING) END"
        parts.append(f"SELECT *, {i} AS param_id, {s} AS short_n, {l} AS long_n, {m(s)} AS s, {m(l)} AS l FROM {src}")
    k = keys + ", param_id, short_n, long_n"
    return "ks AS (" + " UNION ALL ".join(parts) + f"), kp AS (SELECT *, (CASE {SMA_P} ELSE 0 END) AS position FROM ks), kg AS (SELECT *, {signal_sql(k)} AS signal FROM kp), " + account_ctes("kg", "0.0004", keys=k)


_SWEEP_KEYS = "symbol, param_id, short_n, long_n"


@query("I10_batch_sweep", sql(*QB, grid_sma_sql("bars", "symbol", GRID), body=performance_select("acc", 8760.0, _SWEEP_KEYS)))
def _(spark, sf):
    return history.sweep(hourly(spark, sf), ["symbol"], GRID, 0.0004, 8760.0)


_WF = """w AS (SELECT i.symbol, i.fold, i.param_id, i.pf AS ipf, o.* FROM (SELECT symbol, fold, param_id, gp / nullif(gl, 0) AS pf FROM m WHERE role = 'is') i JOIN (SELECT symbol, fold, param_id, trades, gp, gl, gp / nullif(gl, 0) AS opf, sharpe, dd, bars FROM m WHERE role = 'oos') o USING (symbol, fold, param_id))"""
_M = """m AS (SELECT symbol, fold, role, param_id, count(*) AS bars, count(*) FILTER (traded_ > 0) AS trades, sum(greatest(ret_, 0)) AS gp, sum(greatest(-ret_, 0)) AS gl, least(min((equity_ - peak_) / peak_), 0) AS dd,
 CASE WHEN stddev_samp(ret_) > 0 THEN avg(ret_) / stddev_samp(ret_) * sqrt(8760) ELSE 0 END AS sharpe FROM acc GROUP BY ALL)"""
_D54 = sql(*QB, _KFOLD, grid_sma_sql("kf", _FOLD_KEYS, GRID[:3]), _M, _WF.replace("i.symbol, i.fold, i.param_id, i.pf AS ipf, o.*", "i.pf AS ipf, o.*"), body="""SELECT *, combined_pf >= 1.0 AND win_rate >= 0.5 AND mean_wfe >= 0.4 AND annual_trades >= 100 AND max_drawdown >= -0.3 AS passed FROM (
 SELECT symbol, param_id, count(*) AS walks, round(sum(gp) / sum(gl), 5) AS combined_pf, sum(trades)::BIGINT AS trades, round(avg(sharpe), 4) AS mean_sharpe, round(avg(CASE WHEN ipf > 0 THEN opf / ipf ELSE 0 END), 5) AS mean_wfe,
 round(avg((opf > 1)::INTEGER), 6) AS win_rate, round(min(dd), 6) AS max_drawdown, round(sum(trades) / sum(bars)::DOUBLE * 8760, 5) AS annual_trades FROM w GROUP BY symbol, param_id)""")


@query("D54_walk_summary", _D54)
def _(spark, sf):
    kf = history.purged_folds(hourly(spark, sf), 5, 10)
    m = history.sweep(kf, ["symbol", "fold", "role"], GRID[:3], 0.0004, 8760.0)
    w = history.walk_results(m, ["symbol", "param_id", "fold"])
    gates = {"pf": 1.0, "win_rate": 0.5, "wfe": 0.4, "annual_trades": 100.0, "max_drawdown": -0.3}
    out = history.aggregate_walks(w, ["symbol", "param_id"], 8760.0, gates)
    return out.withColumns({"combined_pf": F.round("combined_pf", 5), "mean_sharpe": F.round("mean_sharpe", 4), "mean_wfe": F.round("mean_wfe", 5), "annual_trades": F.round("annual_trades", 5)})


@query("I11_slot_grid", sql(SLOTS, body="""SELECT g.*, coalesce(s.trades, 0) AS trades, round(s.pf, 6) AS pf FROM (SELECT * FROM (SELECT unnest(['BOJ', 'ECB', 'FOMC', 'NFP']) AS event), (SELECT unnest(['P0', 'P1', 'P2', 'P3']) AS pair), (SELECT unnest(range(16))::INTEGER AS wo), (SELECT unnest(range(1, 7))::INTEGER AS hb),
 (SELECT unnest(['none', 'fixed_pct']) AS et), (SELECT unnest([0.0, 1.0, 2.0, 3.0, 5.0])::DOUBLE AS fee)) g LEFT JOIN slots s USING (event, pair, wo, hb, et, fee)"""))
def _(spark, sf):
    grid = spark.range(1)
    for name, values in (("event", T.SLOT_EVENTS), ("pair", T.SLOT_PAIRS), ("wo", range(16)), ("hb", range(1, 7)), ("et", ("none", "fixed_pct")), ("fee", T.FEE_LEVELS_BPS)):
        grid = fan_out(grid, name, values)
    s = T.slot_reports(spark, sf).select("event", "pair", "wo", "hb", "et", "fee", "trades", "pf")
    return grid.drop("id").join(s, ["event", "pair", "wo", "hb", "et", "fee"], "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


@query("I12_parameter_grid", """SELECT p_brand, session, a AS short_n, b AS long_n, (a * 100 + b) % 12 + 1 AS month FROM (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1), (SELECT unnest(range(1, 60, 6))::INTEGER AS a), (SELECT unnest(range(1, 60, 6))::INTEGER AS b), (SELECT unnest(['asia', 'london']) AS session)
 WHERE a >= lo AND a <= hi AND b <= hi AND a < b""")
def _(spark, sf):
    # Each brand spans its own parameter range; the constraint is short < long.
    space = T.table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    steps = [int(x) for x in range(1, 60, 6)]
    g = fan_out(fan_out(fan_out(space, "short_n", steps), "long_n", steps), "session", ("asia", "london"))
    g = g.filter("short_n >= lo AND short_n <= hi AND long_n <= hi AND short_n < long_n")
    return g.select("p_brand", "session", "short_n", "long_n", ((F.col("short_n") * 100 + F.col("long_n")) % 12 + 1).alias("month"))


JITTER = history.jittered((5, 20), 50, 0.2, 42)


@query("I13_parameter_robustness", sql(*QB, grid_sma_sql("bars", "symbol", JITTER), "pf AS (SELECT symbol, param_id, sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0) AS pf FROM acc GROUP BY ALL)",
 body="SELECT symbol, count(pf) AS runs, round(avg(pf), 6) AS mean_pf, round(stddev_pop(pf), 6) AS std_pf, round(list_sort(list(pf))[round(0.05 * (count(pf) - 1))::INTEGER + 1], 6) AS p5_pf, round(list_sort(list(pf))[round(0.95 * (count(pf) - 1))::INTEGER + 1], 6) AS p95_pf, stddev_pop(pf) / avg(pf) > 0.5 AS cliff FROM pf GROUP BY 1"))
def _(spark, sf):
    return history.robustness(history.sweep(hourly(spark, sf), ["symbol"], JITTER, 0.0004, 8760.0), ["symbol"])


@query("I14_random_benchmark", sql(*QB, f"rs AS (SELECT symbol, ts, close, rep, (CASE WHEN u < 0.2::DOUBLE THEN -1 WHEN u >= 0.8::DOUBLE THEN 1 ELSE 0 END) AS signal FROM (SELECT *, {uniform_sql('epoch(ts)::BIGINT', 'rep', 7)} AS u FROM bars, (SELECT unnest(range(200))::INTEGER AS rep)))",
 account_ctes("rs", "0.0004", keys="symbol, rep"), "rp AS (SELECT symbol, rep, sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0) AS pf FROM acc GROUP BY ALL)",
 SMA_X, f"pos AS (SELECT symbol, ts, close, (CASE {SMA_P} ELSE 0 END) AS position FROM x)", f"sg AS (SELECT *, {signal_sql()} AS signal FROM pos)", account_ctes("sg", "0.0004", out="own"), "op AS (SELECT symbol, sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0) AS own_pf FROM own GROUP BY ALL)",
 body="SELECT symbol, round(any_value(own_pf), 6) AS own_pf, round(avg(pf), 6) AS random_mean_pf, round(count(*) FILTER (pf <= own_pf) * 100.0 / count(*), 6)::DOUBLE AS percentile_rank FROM rp JOIN op USING (symbol) WHERE pf IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    bars = hourly(spark, sf)
    noise = performance(account(history.random_signals(bars, 200, 7), ["symbol", "rep"], 0.0004), ["symbol", "rep"], 8760.0)
    own = performance(account(apply_rule("sma_cross", bars, K), K, 0.0004), K, 8760.0).select("symbol", F.col("profit_factor").alias("own_pf"))
    j = noise.filter("profit_factor IS NOT NULL").join(own, "symbol")
    rank = F.count_if(F.col("profit_factor") <= F.col("own_pf")) / F.count(F.lit(1)) * 100
    return j.groupBy("symbol").agg(F.max("own_pf").alias("own_pf"), F.avg("profit_factor").alias("random_mean_pf"), rank.alias("percentile_rank"))


@query("I15_plateau_score", sql(_TRIALS, body="""SELECT trial_id, neighbours, round(CASE WHEN neighbours > 0 THEN least(pf_sum / neighbours / pf, 1) ELSE 0 END, 6) AS score FROM (SELECT c.trial_id, any_value(c.pf) AS pf, count(t.trial_id) AS neighbours, sum(t.pf) AS pf_sum FROM trials c LEFT JOIN trials t ON t.trial_id <> c.trial_id
 AND abs((t.a - c.a) / c.a::DOUBLE) <= 0.2::DOUBLE AND abs((t.b - c.b) / c.b::DOUBLE) <= 0.2::DOUBLE GROUP BY 1)"""))
def _(spark, sf):
    near = neighbour_sums(trials(spark, sf), ["a", "b"], "pf", 0.2)
    ratio = F.least(F.try_divide("pf_sum", "neighbours") / F.col("pf"), F.lit(1.0))
    return near.select("trial_id", "neighbours", F.when(F.col("neighbours") > 0, ratio).otherwise(0.0).alias("score"))


_CP = """dq AS (SELECT cell_id, fold, ts, sum(pnl) AS p, count(*) AS n FROM trades GROUP BY ALL), dqe AS (SELECT *, 1 + sum(p / 10000) OVER (PARTITION BY cell_id, fold ORDER BY ts) AS e FROM dq), dqp AS (SELECT *, max(e) OVER (PARTITION BY cell_id, fold ORDER BY ts) AS m FROM dqe),
cp AS (SELECT cell_id, fold, sum(n)::BIGINT AS trades, sum(greatest(p, 0)) / nullif(sum(greatest(-p, 0)), 0) AS pf, avg(p) / nullif(stddev_samp(p), 0) * sqrt(252) AS sharpe, min((e - m) / m) AS max_dd FROM dqp GROUP BY ALL)"""


def cell_performance(spark, sf):
    """Daily profit factor, Sharpe and drawdown per cell and fold (<= 126 rows)."""
    d = T.trades(spark, sf).groupBy("cell_id", "fold", "ts").agg(F.sum("pnl").alias("p"), rows_as("n"))
    so_far = by(["cell_id", "fold"]).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("e", 1 + F.sum(F.col("p") / 10_000).over(so_far)).withColumn("m", F.max("e").over(so_far))
    p = F.col("p")
    return d.groupBy("cell_id", "fold").agg(
        F.sum("n").alias("trades"),
        F.try_divide(F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))).alias("pf"),
        (F.try_divide(F.avg(p), F.stddev_samp(p)) * math.sqrt(252)).alias("sharpe"),
        F.min((F.col("e") - F.col("m")) / F.col("m")).alias("max_dd"),
    )


_SCORE = "0.5 * least(greatest(pf / 3, 0), 1) + 0.3 * least(greatest((sharpe + 1) / 4, 0), 1) + 0.2 * least(greatest(1 - abs(max_dd), 0), 1)"


@query("I16_composite_score", sql(TRADES, _CP, body=f"SELECT cell_id, count(*) AS folds, sum(trades)::BIGINT AS trades, round(avg({_SCORE}), 6) AS score FROM cp GROUP BY 1 HAVING sum(trades) >= 5 AND avg({_SCORE}) >= 0.1"))
def _(spark, sf):
    c = cell_performance(spark, sf).withColumn("s", history.composite_score(F.col("pf"), F.col("sharpe"), F.col("max_dd")))
    return c.groupBy("cell_id").agg(rows_as("folds"), F.sum("trades").alias("trades"), F.avg("s").alias("score")).filter("trades >= 5 AND score >= 0.1")


@query("I17_nearest_rank", sql(SLOTS, body="SELECT event, round(list_sort(list(pf))[round(0.05 * (count(pf) - 1))::INTEGER + 1], 6) AS p5, round(list_sort(list(pf))[round(0.95 * (count(pf) - 1))::INTEGER + 1], 6) AS p95 FROM slots WHERE fee = 0 AND pf IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    s = T.slot_reports(spark, sf).filter("fee = 0 AND pf IS NOT NULL")
    return s.groupBy("event").agg(history.nearest_rank("pf", 5.0).alias("p5"), history.nearest_rank("pf", 95.0).alias("p95"))


_SLOTEQ = (SMA_X, f"pos AS (SELECT symbol, ts, close, (CASE {SMA_P} ELSE 0 END) AS position FROM x)", f"sg AS (SELECT *, {signal_sql()} AS signal FROM pos)", account_ctes("sg", "0.0004"),
 "cm AS (SELECT ts FROM acc GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM acc))", "rt AS (SELECT * FROM (SELECT symbol AS slot, ts, equity_ / lag(equity_) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM acc WHERE ts IN (SELECT ts FROM cm)) WHERE r IS NOT NULL)",
 "wt AS (SELECT slot, stddev_pop(r) AS vol, 1.0::DOUBLE / count(*) OVER () AS equal, (1 / stddev_pop(r)) / sum(1 / stddev_pop(r)) OVER () AS inverse_vol FROM rt GROUP BY 1)",
 "pr AS (SELECT ts, sum(r * inverse_vol) AS r FROM rt JOIN wt USING (slot) GROUP BY 1)", "pe AS (SELECT *, product(1 + r) OVER (ORDER BY ts) AS equity FROM pr)")
def slot_returns(spark, sf):
    acc = account(apply_rule("sma_cross", hourly(spark, sf), K), K, 0.0004)
    return portfolio.slot_returns(acc.select(F.col("symbol").alias("slot"), "ts", "equity"))


@query("I18_slot_weights", sql(*QB, *_SLOTEQ, body="SELECT slot, round(vol, 6) AS vol, round(equal, 6) AS equal, round(inverse_vol, 6) AS inverse_vol FROM wt"))
def _(spark, sf):
    return portfolio.weights(slot_returns(spark, sf))


@query("I19_combined_equity", sql(*QB, *_SLOTEQ, body="SELECT ts, round(r, 6) + 0.0 AS r, round(equity, 6) AS equity FROM pe"))
def _(spark, sf):
    r = slot_returns(spark, sf)
    return portfolio.combined_equity(portfolio.combined_returns(r, portfolio.weights(r), "inverse_vol"))


@query("I20_portfolio_metrics", sql(*QB, *_SLOTEQ, "pk AS (SELECT *, greatest(max(equity) OVER (ORDER BY ts), 1) AS peak FROM pe)", body="""SELECT bars, round(sharpe, 5) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(last_equity, 6) AS last_equity, round(pow(last_equity, 8760.0 / (bars + 1)) - 1, 5) AS cagr, CASE WHEN abs(max_drawdown) < 1e-12 THEN 0 ELSE round((pow(last_equity, 8760.0 / (bars + 1)) - 1) / abs(max_drawdown), 4) END AS calmar FROM (
 SELECT count(*) AS bars, avg(r) / stddev_pop(r) * sqrt(8760) AS sharpe, least(min((equity - peak) / peak), 0) AS max_drawdown, arg_max(equity, ts) AS last_equity FROM pk)"""))
def _(spark, sf):
    r = slot_returns(spark, sf)
    m = portfolio.portfolio_metrics(portfolio.combined_returns(r, portfolio.weights(r), "inverse_vol"), 8760.0)
    return m.withColumns({"sharpe": F.round("sharpe", 5), "cagr": F.round("cagr", 5), "calmar": F.round("calmar", 4)})


@query("I21_mean_pairwise_correlation", sql(*QB, *_SLOTEQ, body="SELECT round(avg(c), 6) AS mean_correlation, count(c) AS pairs FROM (SELECT a.slot, b.slot AS s2, corr(a.r, b.r) AS c FROM rt a JOIN rt b ON a.ts = b.ts AND a.slot < b.slot GROUP BY ALL)"))
def _(spark, sf):
    return portfolio.mean_pairwise_correlation(slot_returns(spark, sf))


@query("I22_quote_side_pnl", sql(FAST, _SLOT30, STUDY_SCORES, STUDY_PRICED, body="SELECT symbol, stance, count(pnl_net) AS trades, round(sum(pnl_net), 3) AS total, round(min(pnl_net), 5) AS worst, round(max(pnl_net), 5) AS best FROM priced GROUP BY ALL"))
def _(spark, sf):
    p = study_priced(spark, sf)
    return p.groupBy("symbol", "stance").agg(F.count("pnl_net").alias("trades"), F.round(F.sum("pnl_net"), 3).alias("total"), F.round(F.min("pnl_net"), 5).alias("worst"), F.round(F.max("pnl_net"), 5).alias("best"))


_FEES = "fees AS (SELECT unnest([0.0, 1.0, 2.0, 3.0, 5.0])::DOUBLE AS fee_bps)"


def fee_curve_sql(src: str, keys: str) -> str:
    return account_ctes(f"(SELECT s.*, fee_bps FROM {src} s, fees)", "fee_bps / 10000", keys=keys + ", fee_bps", out="fc")


@query("I23_fee_curve", sql(*QB, SMA_X, f"pos AS (SELECT symbol, ts, close, (CASE {SMA_P} ELSE 0 END) AS position FROM x)", f"sg AS (SELECT *, {signal_sql()} AS signal FROM pos)", _FEES, fee_curve_sql("sg", "symbol"),
 body="SELECT symbol, fee_bps, count(*) FILTER (traded_ > 0) AS trades, round(sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0), 6) AS pf, round(sum(ret_) / nullif(count(*) FILTER (traded_ > 0), 0) * 10000, 5) AS mean_bps FROM fc GROUP BY ALL"))
def _(spark, sf):
    s = fan_out(apply_rule("sma_cross", hourly(spark, sf), K), "fee_bps", T.FEE_LEVELS_BPS)
    return fee_curve(s, ["symbol", "fee_bps"])


def fee_curve(signals, keys):
    a = account(signals, keys, F.col("fee_bps") / 10_000)
    r, n = F.col("ret"), F.count_if(F.col("traded") > 0)
    return a.groupBy(*keys).agg(
        n.alias("trades"), F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))).alias("pf"),
        F.round(F.try_divide(F.sum(r), n) * 10_000, 5).alias("mean_bps"),
    )


def replay_sql(n: int, name: str = "rx") -> str:
    """Exit replay with windows over unnested bars."""
    return f"""ta{n} AS (SELECT *, CASE WHEN count(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING) = {n} THEN avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING) END AS atr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS nn, epoch(ts)::BIGINT // 3600 AS h FROM tr),
tt{n} AS (SELECT symbol, rn AS entry_bar, h AS trade_id, CASE WHEN h % 12 = 0 THEN 1 ELSE -1 END AS d, close AS ep, atr AS ea FROM ta{n} WHERE h % 6 = 0 AND atr IS NOT NULL AND rn + 12 <= nn),
tp{n} AS (SELECT t.*, b.rn - t.entry_bar - 1 AS i, b.high, b.low, b.close, b.atr FROM tt{n} t JOIN ta{n} b ON b.symbol = t.symbol AND b.rn > t.entry_bar AND b.rn <= t.entry_bar + 12),
tw{n} AS (SELECT *, greatest(ep, max(close) OVER w) AS hi, least(ep, min(close) OVER w) AS lo, min(low) OVER w3 AS swl, max(high) OVER w3 AS swh FROM tp{n} WINDOW w AS (PARTITION BY symbol, entry_bar ORDER BY i ROWS UNBOUNDED PRECEDING), w3 AS (PARTITION BY symbol, entry_bar ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
tf{n} AS (SELECT *, CASE WHEN d * (CASE WHEN d = 1 THEN low ELSE high END) <= d * (ep - d * 2.0 * ea) THEN 'atr_stop' WHEN i >= 3 AND d * (CASE WHEN d = 1 THEN low ELSE high END) <= d * (CASE WHEN d = 1 THEN swl ELSE swh END) THEN 'technical_stop'
  WHEN d * (CASE WHEN d = 1 THEN low ELSE high END) <= d * ((CASE WHEN d = 1 THEN hi ELSE lo END) - d * 2.0 * atr) THEN 'trailing_stop' WHEN i >= 9 THEN 'time_stop' END AS rule FROM tw{n}),
{name} AS (SELECT symbol, trade_id, any_value(entry_bar) AS entry_bar, any_value(d) AS direction, any_value(ea) AS atr_at_entry, coalesce(arg_min(rule, i) FILTER (rule IS NOT NULL), 'fold_end') AS exit_rule, coalesce(min(i) FILTER (rule IS NOT NULL), 11) + any_value(entry_bar) AS exit_bar,
  any_value(d) * (coalesce(arg_min(close, i) FILTER (rule IS NOT NULL), arg_max(close, i)) - any_value(ep)) AS pnl FROM tf{n} GROUP BY ALL)"""


def replayed(spark, sf, atr_window=14):
    return tr.replay_exits(tr.bar_trades(hourly(spark, sf), 6, 12, atr_window), max_hold=10)


@query("I24_exit_replay", sql(*QB, TR, replay_sql(14), body="SELECT symbol, trade_id, entry_bar, direction, exit_rule, exit_bar, round(pnl, 6) + 0.0 AS pnl FROM rx"))
def _(spark, sf):
    return replayed(spark, sf).select("symbol", "trade_id", "entry_bar", "direction", "exit_rule", "exit_bar", "pnl")


ATR_WINDOWS = (7, 10, 14, 20, 28)


@query("I25_atr_fragility", sql(*QB, TR, *[replay_sql(n, f"rx{n}") for n in ATR_WINDOWS], body=" UNION ALL ".join(f"SELECT {n} AS atr_window, exit_rule, count(*) AS n, round(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 5) AS pf, round(avg(pnl), 6) + 0.0 AS mean_pnl FROM rx{n} GROUP BY exit_rule" for n in ATR_WINDOWS)))
def _(spark, sf):
    bars = hourly(spark, sf)
    runs = None
    for n in ATR_WINDOWS:
        one = tr.replay_exits(tr.bar_trades(bars, 6, 12, n), max_hold=10).withColumn("atr_window", F.lit(n))
        runs = one if runs is None else runs.unionByName(one)
    p = F.col("pnl")
    return runs.groupBy("atr_window", "exit_rule").agg(
        rows_as("n"), F.round(F.try_divide(F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))), 5).alias("pf"), F.avg(p).alias("mean_pnl")
    )


_KI = """ki AS (SELECT cell_id, fold, count(*) FILTER (pnl > 0) / count(*)::DOUBLE - 0.05::DOUBLE AS p, 3 * sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) AS b FROM trades GROUP BY ALL)"""


def kelly_inputs(spark, sf):
    p = F.col("pnl")
    return T.trades(spark, sf).groupBy("cell_id", "fold").agg(
        (F.count_if(p > 0) / F.count(F.lit(1)) - 0.05).alias("p"),
        F.try_divide(3 * F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))).alias("b"),
    )


@query("I27_position_size", sql(TRADES, _KI, "sz AS (SELECT t.cell_id, t.fold, t.qty / 10 - 0.5::DOUBLE AS atr, least(greatest(p - (1 - p) / b, 0), 0.5::DOUBLE) AS f FROM trades t JOIN ki USING (cell_id, fold))", "s2 AS (SELECT *, 10000 * f AS kelly_size, CASE WHEN atr > 0 THEN 100 / (2 * atr) ELSE 0 END AS atr_size, 2000.0::DOUBLE AS cap_size FROM sz)",
 body="""SELECT cell_id, binding_reason, count(*) AS n, round(sum(size), 3) AS total FROM (SELECT *, CASE WHEN atr > 0 THEN greatest(least(kelly_size, atr_size, cap_size), 0) ELSE 0 END AS size, CASE WHEN atr <= 0 OR least(kelly_size, atr_size, cap_size) <= 0 THEN 'zero' WHEN kelly_size = least(kelly_size, atr_size, cap_size) THEN 'kelly' WHEN atr_size = least(kelly_size, atr_size, cap_size) THEN 'atr_norm' ELSE 'fixed_cap' END AS binding_reason FROM s2) GROUP BY ALL"""))
def _(spark, sf):
    t = T.trades(spark, sf).select("cell_id", "fold", (F.col("qty") / 10 - 0.5).alias("atr")).join(kelly_inputs(spark, sf), ["cell_id", "fold"])
    s = tr.sized(t, tr.kelly_fraction(F.col("p"), F.col("b")), F.col("atr"), 10_000.0, 0.2)
    return s.groupBy("cell_id", "binding_reason").agg(rows_as("n"), F.round(F.sum("size"), 3).alias("total"))


@query("I28_kelly_sensitivity", sql(TRADES, _KI, "c5(point, x, y) AS (VALUES ('center', 1.0::DOUBLE, 1.0::DOUBLE), ('ne', 1.1, 1.1), ('se', 1.1, 0.9), ('nw', 0.9, 1.1), ('sw', 0.9, 0.9))", "f5 AS (SELECT cell_id, fold, point, CASE WHEN b * y <= 0 OR p * x <= 0 OR p * x >= 1 THEN NULL ELSE least(greatest(p * x - (1 - p * x) / (b * y), 0), 0.5) END AS f FROM ki, c5)",
 body="SELECT cell_id, round(min(f), 6) AS lowest, round(max(f), 6) AS highest, bool_and(coalesce(f >= 0.25, false)) AS robust FROM f5 GROUP BY 1"))
def _(spark, sf):
    g = tr.kelly_sensitivity(kelly_inputs(spark, sf))
    return g.groupBy("cell_id").agg(F.min("f").alias("lowest"), F.max("f").alias("highest"), F.bool_and(F.coalesce(F.col("f") >= tr.KELLY_MIN, F.lit(False))).alias("robust"))


@query("I29_trade_to_bars", sql(*QB, TR, replay_sql(14), "lb AS (SELECT symbol, count(*) AS lb FROM tr GROUP BY 1)", "ex AS (SELECT symbol, unnest(range(least(entry_bar, lb), least(exit_bar, lb) + 1)) AS bar, least(exit_bar, lb) AS xe, pnl FROM rx JOIN lb USING (symbol))",
 body="SELECT symbol, bar, count(*) AS open_trades, round(sum(CASE WHEN bar = xe THEN pnl ELSE 0 END), 6) + 0.0 AS bar_pnl FROM ex GROUP BY ALL"))
def _(spark, sf):
    last = hourly(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("last_bar"))
    e = tr.expand_to_bars(replayed(spark, sf).join(last, "symbol"), F.col("last_bar"))
    return e.groupBy("symbol", F.col("bar").cast("bigint").alias("bar")).agg(rows_as("open_trades"), F.sum("bar_pnl").alias("bar_pnl"))


_DD = """de AS (SELECT cell_id, ts, sum(pnl) AS whole, sum(pnl) / 3000 AS p FROM trades GROUP BY ALL), dq AS (SELECT *, (3000 + sum(whole) OVER (PARTITION BY cell_id ORDER BY ts)) / 3000 AS equity FROM de), dp AS (SELECT *, max(equity) OVER (PARTITION BY cell_id ORDER BY ts) AS pk, count(*) FILTER (p > 0) OVER (PARTITION BY cell_id ORDER BY ts) AS isl FROM dq),
dv AS (SELECT *, greatest(0, (pk - equity) / pk) AS dd_value, greatest(-p, 0) AS dls, count(*) FILTER (p < 0) OVER (PARTITION BY cell_id, isl ORDER BY ts) AS clc FROM dp),
gate AS (SELECT *, CASE WHEN dd_value >= 0.2 THEN 'gate_closed:hard_cap_20pct' WHEN dls >= 0.03 THEN 'gate_closed:daily_loss_3pct' WHEN clc >= 5 THEN 'gate_closed:step_down_consecutive' ELSE 'ok' END AS dd_state FROM dv)"""


def gated(spark, sf):
    """Drawdown gate over the daily equity of each cell."""
    d = T.trades(spark, sf).groupBy("cell_id", "ts").agg(F.sum("pnl").alias("whole"))
    so_far = by(["cell_id"]).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", (3000 + F.sum("whole").over(so_far)) / 3000).withColumn("pnl", F.col("whole") / 3000).drop("whole")
    return tr.drawdown_gate(d, ["cell_id"])


@query("I30_drawdown_gate", sql(TRADES, _DD, body="""SELECT cell_id, ts, round(dd_value, 6) + 0.0 AS dd_value, dd_state, (CASE WHEN dd_state <> 'ok' THEN 0 WHEN dd_value < 0.05 THEN 1 WHEN dd_value < 0.1 THEN 0.75 WHEN dd_value < 0.15 THEN 0.5 ELSE 0.25 END)::DOUBLE AS risk_multiplier, clc AS consecutive_loss_count, round(dls, 6) + 0.0 AS daily_loss_sum FROM gate"""))
def _(spark, sf):
    return gated(spark, sf).select("cell_id", "ts", "dd_value", "dd_state", "risk_multiplier", "consecutive_loss_count", "daily_loss_sum")


_ZT = """zt AS (SELECT *, coalesce((dd_value - avg(dd_value) OVER f) / nullif(CASE WHEN count(*) OVER f = 20 THEN stddev_samp(dd_value) OVER f END, 0), 0) AS z_t, least(clc / 5.0::DOUBLE, 1) AS p_shift FROM gate WINDOW f AS (PARTITION BY cell_id ORDER BY ts ROWS 19 PRECEDING))"""


@query("I31_derisk_multiplier", sql(TRADES, _DD, _ZT, body="SELECT cell_id, ts, round(z_t, 5) + 0.0 AS z_t, p_shift, round(least(1, exp(-0.5 * z_t - p_shift)), 5) AS m_t FROM zt"))
def _(spark, sf):
    d = tr.derisk(gated(spark, sf), ["cell_id"])
    return d.select("cell_id", "ts", F.round("z_t", 5).alias("z_t"), "p_shift", F.round(tr.overlay_multiplier(0.5, 1.0, 1.0), 5).alias("m_t"))


def overlay(df, keys, cap=1.0):
    """Overlay equity for the alpha, beta columns of each key."""
    w = df.withColumn("m_t", tr.overlay_multiplier(F.col("alpha"), F.col("beta"), cap))
    return states.overlay_equity(w, keys)


_OV = """ov AS (SELECT cell_id, ts, alpha, beta, equity, first_value(equity) OVER k + sum(d * m) OVER k AS equity_on FROM (SELECT *, least(1, exp(-alpha * z_t - beta * p_shift)) AS m, coalesce(equity - lag(equity) OVER (PARTITION BY cell_id, alpha, beta ORDER BY ts), 0) AS d FROM zt, abg) WINDOW k AS (PARTITION BY cell_id, alpha, beta ORDER BY ts))"""


@query("I32_overlay_grid", sql(TRADES, _DD, _ZT, "abg AS (SELECT * FROM (SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS alpha), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS beta))", _OV, "om AS (SELECT *, equity_on - lag(equity_on) OVER (PARTITION BY cell_id, alpha, beta ORDER BY ts) AS dlt, max(equity_on) OVER (PARTITION BY cell_id, alpha, beta ORDER BY ts) AS pk FROM ov)",
 "oc AS (SELECT cell_id, alpha, beta, sum(greatest(dlt, 0)) / nullif(sum(greatest(-dlt, 0)), 0) AS pf, min((equity_on - pk) / pk) AS dd FROM om GROUP BY ALL)", body="SELECT alpha, beta, round(median(pf), 5) AS pf_median, round(median(dd), 5) AS max_dd_median FROM oc GROUP BY ALL"))
def _(spark, sf):
    d = tr.derisk(gated(spark, sf), ["cell_id"])
    grid = fan_out(fan_out(d, "alpha", (0.25, 0.5, 1.0)), "beta", (0.5, 1.0, 2.0))
    keys = ["cell_id", "alpha", "beta"]
    m = tr.equity_metrics(overlay(grid, keys), keys, "equity_on")
    return m.groupBy("alpha", "beta").agg(F.round(F.median("pf"), 5).alias("pf_median"), F.round(F.median("max_dd"), 5).alias("max_dd_median"))


_TOP = """top AS (SELECT min(ts) AS s, max(ts) AS e, count(*) AS nb, row_number() OVER (ORDER BY count(*) DESC, min(ts)) - 1 AS cid FROM gp GROUP BY g ORDER BY nb DESC, s LIMIT 3)"""


@query("I33_stress_replay", sql(TRADES, _DD, _ZT, "abg AS (SELECT 0.5::DOUBLE AS alpha, 1.0::DOUBLE AS beta)", _OV, _CLUSTERS, _TOP, """sr AS (SELECT cid, cell_id, o.ts, equity, equity_on FROM ov o JOIN top ON o.ts::DATE >= s::DATE AND o.ts::DATE <= e::DATE)""",
 """sd AS (SELECT *, equity - lag(equity) OVER k AS d0, equity_on - lag(equity_on) OVER k AS d1, max(equity) OVER k AS p0, max(equity_on) OVER k AS p1 FROM sr WINDOW k AS (PARTITION BY cid, cell_id ORDER BY ts))""",
 """sc AS (SELECT cid, cell_id, sum(greatest(d0, 0)) / nullif(sum(greatest(-d0, 0)), 0) AS f0, sum(greatest(d1, 0)) / nullif(sum(greatest(-d1, 0)), 0) AS f1, min((equity - p0) / p0) AS m0, min((equity_on - p1) / p1) AS m1 FROM sd GROUP BY ALL)""",
 body="SELECT cid::INTEGER AS cluster_id, round(median(f0), 5) AS pf_off, round(median(f1), 5) AS pf_on, round(median(m0), 5) + 0.0 AS dd_off, round(median(m1), 5) + 0.0 AS dd_on, count(*) AS cells FROM sc GROUP BY 1"))
def _(spark, sf):
    d = tr.derisk(gated(spark, sf), ["cell_id"]).withColumn("alpha", F.lit(0.5)).withColumn("beta", F.lit(1.0))
    eq = overlay(d, ["cell_id"])
    top = states.stress_clusters(stress_base(spark, sf), quantile=0.95)
    # At most three clusters: their days become an equi key.
    days = top.select("cluster_id", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("day"))
    hit = eq.withColumn("day", F.to_date("ts")).join(days, "day")
    k = ["cluster_id", "cell_id"]
    off = tr.equity_metrics(hit, k, "equity").withColumnsRenamed({"pf": "f0", "max_dd": "m0"})
    both = off.join(tr.equity_metrics(hit, k, "equity_on"), k)
    med = lambda c, n: F.round(F.median(c), 5).alias(n)
    return both.groupBy("cluster_id").agg(med("f0", "pf_off"), med("pf", "pf_on"), med("m0", "dd_off"), med("max_dd", "dd_on"), rows_as("cells"))


EXPECTED = [("first half", "1995-01-01", "1996-06-30"), ("middle", "1996-07-01", "1999-06-30"), ("never", "2010-01-01", "2010-02-01"), ("late", "1999-07-01", "2001-12-31")]


@query("I34_absent_event_padding", sql(TRADES, _CLUSTERS, _TOP, "xe(i, label, xs, xe) AS (VALUES " + ", ".join(f"({i}, '{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (n, a, b) in enumerate(EXPECTED)) + ")",
 "an AS (SELECT cid, coalesce((SELECT label FROM xe WHERE NOT (e < xe.xs OR s > xe.xe) ORDER BY i LIMIT 1), 'unannotated') AS label, nb FROM top WHERE cid < 2)", body="""SELECT label, nb::BIGINT AS n_bars, false AS absent FROM an UNION ALL SELECT label, 0, true FROM (SELECT label, row_number() OVER (ORDER BY i) AS k FROM xe WHERE label NOT IN (SELECT label FROM an)) WHERE k <= 3 - (SELECT count(*) FROM an)"""))
def _(spark, sf):
    top = states.stress_clusters(stress_base(spark, sf), quantile=0.95).filter("cluster_id < 2")
    found = top.select(first_overlap("start", "end", EXPECTED).alias("label"), "n_bars", F.lit(False).alias("absent"))
    expected = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(EXPECTED)], "i INT, label STRING")
    gone = expected.join(found.select("label"), "label", "left_anti")
    gone = gone.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("i")))
    room = 3 - found.agg(F.count(F.lit(1))).scalar()
    pads = gone.filter(F.col("k") <= room).select("label", F.lit(0).cast("bigint").alias("n_bars"), F.lit(True).alias("absent"))
    return found.unionByName(pads)


@query("I35_base_vs_adverse", sql(TRADES, _SCEN, body="""SELECT pair, round(sum(CASE WHEN scenario = 'base' THEN pnl - cost * turn END) / count(*) FILTER (scenario = 'base'), 6)::DOUBLE AS base_expectancy, round(sum(CASE WHEN scenario = 'adverse' THEN pnl - cost * turn END) / count(*) FILTER (scenario = 'adverse'), 6)::DOUBLE AS adverse_expectancy FROM trades, scen GROUP BY 1"""))
def _(spark, sf):
    m = folds.costed_metrics(T.trades(spark, sf), ["pair"], {"base": (4.0, 1.0), "adverse": (9.5, 1.5)})
    p = m.groupBy("pair").pivot("scenario", ["base", "adverse"]).agg(F.first("expectancy"))
    return p.withColumnsRenamed({"base": "base_expectancy", "adverse": "adverse_expectancy"})


@query("I36_ledger_cost", sql(TRADES, body="SELECT cell_id, round(sum(notional * (2.0 + fold) / 10000), 2) AS cost, round(sum(notional * pnl / 10000 - notional * (2.0 + fold) / 10000), 2) AS net FROM trades GROUP BY 1"))
def _(spark, sf):
    cost = F.col("notional") * (2.0 + F.col("fold")) / 10_000
    return T.trades(spark, sf).groupBy("cell_id").agg(F.round(F.sum(cost), 2).alias("cost"), F.round(F.sum(F.col("notional") * F.col("pnl") / 10_000 - cost), 2).alias("net"))


@query("I37_margin_ratio", sql(TRADES, body="SELECT pair, count(*) FILTER (ratio <= 0.005) AS liquidated, count(*) AS positions, round(min(ratio), 6) AS lowest FROM (SELECT pair, (notional + notional * pnl * 300 / 10000) / notional AS ratio FROM trades) GROUP BY 1"))
def _(spark, sf):
    ratio = (F.col("notional") + F.col("notional") * F.col("pnl") * 300 / 10_000) / F.col("notional")
    return T.trades(spark, sf).withColumn("ratio", ratio).groupBy("pair").agg(F.count_if(F.col("ratio") <= 0.005).alias("liquidated"), rows_as("positions"), F.min("ratio").alias("lowest"))


@query("I38_edge_expansion", sql(QUOTES, BARS, "eg AS (SELECT event_type AS symbol, (min(event_id) % 24)::INTEGER AS entry_hour, (CASE WHEN min(event_id) % 2 = 0 THEN 1 ELSE -1 END) AS d FROM events GROUP BY 1)", _FEES,
 "sl AS (SELECT eg.*, h FROM eg, (SELECT unnest([1, 2, 4]) AS h))", "hp AS (SELECT b.symbol, b.ts, b.close, sl.h, sl.d * coalesce(max(CASE WHEN hour(b.ts) = entry_hour THEN 1 END) OVER (PARTITION BY b.symbol, sl.h ORDER BY b.ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS p4, sl.d * coalesce(max(CASE WHEN hour(b.ts) = entry_hour THEN 1 END) OVER (PARTITION BY b.symbol, sl.h ORDER BY b.ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 0) AS p2, sl.d * (hour(b.ts) = entry_hour)::INTEGER AS p1 FROM bars b JOIN sl USING (symbol))",
 "hq AS (SELECT symbol, ts, close, h, CASE h WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p4 END AS position FROM hp)", f"hs AS (SELECT *, {signal_sql('symbol, h')} AS signal FROM hq)", fee_curve_sql("hs", "symbol, h"),
 body="SELECT symbol, h AS hold_bars, fee_bps, count(*) FILTER (traded_ > 0) AS trades, round(sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0), 6) AS pf, round(sum(ret_) / nullif(count(*) FILTER (traded_ > 0), 0) * 10000, 5) AS mean_bps, coalesce(sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0) >= 1, false) AS passed FROM fc GROUP BY ALL"))
def _(spark, sf):
    from barline.operators.rules import position_to_signal

    first = F.min("event_id")
    edges = T.table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(
        (first % 24).cast("int").alias("entry_hour"), F.when(first % 2 == 0, 1).otherwise(-1).alias("d")
    )
    # One edge per symbol, unfolded over its hold candidates.
    slots = fan_out(edges, "hold_bars", (1, 2, 4))
    rows = hourly(spark, sf).join(slots, "symbol")
    w = by(["symbol", "hold_bars"])
    entry = F.hour("ts") == F.col("entry_hour")
    held = {n: states.hold_bars(entry, n, w) for n in (1, 2, 4)}
    pick = F.coalesce(*[F.when(F.col("hold_bars") == n, h) for n, h in held.items()])
    rows = rows.withColumn("position", pick * F.col("d"))
    s = fan_out(position_to_signal(rows, ["symbol", "hold_bars"]), "fee_bps", T.FEE_LEVELS_BPS)
    out = fee_curve(s, ["symbol", "hold_bars", "fee_bps"])
    return out.withColumn("passed", F.coalesce(F.col("pf") >= 1, F.lit(False)))


# ---- F: sorts, top-k, ranking ----------------------------------------------------


@query("F01_total_order", sql(SLOTS, body="SELECT event, pair, wo, hb, et, fee, trades FROM slots ORDER BY 1, 2, 3, 4, 5, 6"))
def _(spark, sf):
    keys = ["event", "pair", "wo", "hb", "et", "fee"]
    return T.slot_reports(spark, sf).select(*keys, "trades").orderBy(*keys)


@query("F02_top_n", sql(SLOTS, _CLIFF, body="SELECT * FROM cliff ORDER BY alpha_cliff DESC NULLS LAST, event, pair, wo, hb, et LIMIT 20"))
def _(spark, sf):
    return alpha_cliffs(spark, sf).orderBy(F.desc_nulls_last("alpha_cliff"), "event", "pair", "wo", "hb", "et").limit(20)


@query("F03_pareto_front", """SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size >= a.p_size AND -(b.p_partkey % 17) >= -(a.p_partkey % 17)
 AND (b.p_retailprice > a.p_retailprice OR b.p_size > a.p_size OR -(b.p_partkey % 17) > -(a.p_partkey % 17)))""")
def _(spark, sf):
    p = T.table(spark, sf, "part").withColumn("neg_mod", -(F.col("p_partkey") % 17))
    return selection.pareto_front(p, ["p_retailprice", "p_size", "neg_mod"]).select("p_partkey", "p_size", "p_retailprice")


@query("F04_candidates", """SELECT p_brand, p_type, p_size, p_retailprice, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part WHERE p_size >= 10) WHERE rn = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 15""")
def _(spark, sf):
    p = T.table(spark, sf, "part").filter("p_size >= 10").select("p_brand", "p_type", "p_size", "p_retailprice", "p_partkey")
    return selection.best_distinct(p, ["p_brand", "p_type"], "p_retailprice", "p_partkey", 15)


@query("F05_best_per_key", sql(TRADES, _CP, body="SELECT cell_id, fold, round(pf, 6) AS pf FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY pf DESC, fold) AS rn FROM cp) WHERE rn = 1"))
def _(spark, sf):
    return selection.one_per_group(cell_performance(spark, sf).select("cell_id", "fold", "pf"), "cell_id", F.col("pf"), "fold")


@query("F06_weighted_ranking", sql(TRADES, _CP, "sc AS (SELECT substr(cell_id, 1, 3) AS asset, cell_id, fold, round(pf * greatest(sharpe, 0.1) * 0.9 / nullif(abs(max_dd), 0), 4) AS score FROM cp)", body="SELECT asset, cell_id, fold, score, row_number() OVER (ORDER BY score DESC, asset)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, cell_id, fold) AS rn FROM sc) WHERE rn = 1"))
def _(spark, sf):
    c = cell_performance(spark, sf)
    score = F.round(F.try_divide(F.col("pf") * F.greatest(F.col("sharpe"), F.lit(0.1)) * 0.9, F.abs("max_dd")), 4)
    c = c.select(F.substring("cell_id", 1, 3).alias("asset"), "cell_id", "fold", score.alias("score"))
    return selection.ranked(selection.one_per_group(c, "asset", F.col("score"), "fold"), "score", "asset")


@query("F07_best_worst_category", sql(DAILY, "r AS (SELECT symbol, isodow(ts) - 1 AS dow, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM daily)", "m AS (SELECT symbol, dow, avg(r) AS m FROM r GROUP BY ALL)", body="SELECT symbol, arg_max(dow, m) AS best_dow, arg_min(dow, m) AS worst_dow, round((max(m) - min(m)) * 252 * 10000, 3) AS spread_bps FROM m GROUP BY 1"))
def _(spark, sf):
    from barline.operators.indicators import log_return

    r = T.daily_prices(spark, sf).withColumn("r", log_return(by(K)))
    m = r.groupBy("symbol", F.weekday("ts").alias("dow")).agg(F.avg("r").alias("m"))
    return m.groupBy("symbol").agg(F.max_by("dow", "m").alias("best_dow"), F.min_by("dow", "m").alias("worst_dow"), F.round((F.max("m") - F.min("m")) * 252 * 10_000, 3).alias("spread_bps"))


@query("F09_stratified_split", """WITH d AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY u, doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM (SELECT *, {u} AS u FROM labels))
 SELECT doc_id, quality, CASE WHEN n >= 4 AND rn <= round(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM d""".replace("{u}", uniform_sql("doc_id", "0", 11)))
def _(spark, sf):
    lab = T.table(spark, sf, "labels").select("doc_id", "quality")
    return selection.stratified_split(lab, "doc_id", "quality", 11)


@query("F10_idempotent_order")
def _(spark, sf):
    s = alpha_cliffs(spark, sf)
    return s.orderBy(F.asc_nulls_last("alpha_cliff"), *[F.asc_nulls_last(c) for c in ("event", "pair", "wo", "hb", "et")])


@query("F11_entry_ordinals", sql(*QB, _SIG, account_ctes("sg", "0.0004"), "tn AS (SELECT symbol, ts, position_, lag(position_) OVER (PARTITION BY symbol ORDER BY ts) AS pv FROM acc WHERE ts >= TIMESTAMP '2024-01-15')", body="SELECT symbol, ts, position_::INTEGER AS position, row_number() OVER (PARTITION BY symbol ORDER BY ts)::INTEGER AS trade_no FROM tn WHERE pv = 0 AND position_ <> 0"))
def _(spark, sf):
    a = account(toy_signal(hourly(spark, sf)), K, 0.0004).filter("ts >= TIMESTAMP '2024-01-15'")
    entries = a.withColumn("pv", F.lag("position").over(by(K))).filter("pv = 0 AND position <> 0")
    return entries.select("symbol", "ts", "position", F.row_number().over(by(K)).alias("trade_no"))

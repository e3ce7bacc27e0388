"""Scans over several rules, two timeframes, exits and modes, and their anchored walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.draws import uniform_sql
from barline.functions.stats import expected_max_sharpe
from barline.operators import history, scan, verdicts
from barline.operators.accounting import account, performance
from barline.operators.rules import apply_rule
from barline.plans.books import JITTER, grid_sma_sql
from barline.plans.checks import BARS, BARS4, QUOTES, account_ctes, normal_cdf_sql, signal_sql, sql
from barline.plans.registry import query
from barline.plans.rulesets import SMA_P, SMA_X, K
from barline.plans.shapes import four_hourly, hourly

RULES = scan.standard_rules(
    crosses=[(5, 20), (10, 50), (20, 100)], momenta=[(3, 0.2), (12, 0.4)], reversions=[(20, 1.5), (50, 2.0)], breakouts=[20, 55]
)
EXITS = (scan.Exit("none"), scan.Exit("tight", 0.004, 0.006), scan.Exit("wide", 0.01, 0.02))
SCAN = scan.Scan(RULES, EXITS)
YEAR = {"1h": 8760.0, "4h": 2190.0}
MONTHS, WALKS = (0.25, 0.08), 8
GATES = scan.Gates(pf=1.0, win_rate=0.5, wfe=0.4, annual_trades=100.0, max_drawdown=-0.3)


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly and four-hourly bars of all symbols."""
    of = lambda bars, tf: bars.select("symbol", F.lit(tf).alias("tf"), "ts", "high", "low", "close")
    return of(hourly(spark, sf_dir), "1h").unionByName(of(four_hourly(spark, sf_dir), "4h"))


_BARS = (QUOTES, BARS, BARS4)
_FRAMED = """tfb AS (SELECT symbol, '1h' AS tf, ts, high, low, close FROM bars UNION ALL SELECT symbol, '4h', ts, high, low, close FROM bars4),
sp AS (SELECT symbol, tf, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000::DOUBLE AS days FROM tfb GROUP BY ALL),
bd AS (SELECT symbol, tf, list(e ORDER BY e) AS borders FROM (SELECT symbol, tf, n, floor(({i} + k * {o}) * (n / (days / 30.44::DOUBLE)))::BIGINT AS e FROM sp, (SELECT unnest(range({w} + 1)) AS k)) WHERE e <= n GROUP BY ALL),
blk AS (SELECT tfb.*, len(list_filter(borders, lambda e: e <= i)) AS block, len(borders) AS nb FROM (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts) - 1 AS i FROM tfb) tfb JOIN bd USING (symbol, tf))""".format(
    i=MONTHS[0], o=MONTHS[1], w=WALKS
)


def _branch(number: int, rule: scan.ScanRule, p: dict[str, float]) -> str:
    over = lambda frame: f"(PARTITION BY symbol, tf ORDER BY ts {frame})"
    full = lambda f, n, frame: f"(CASE WHEN count(close) OVER {over(frame)} = {n} THEN {f} OVER {over(frame)} END)"
    a, b = p["a"], p.get("b")
    last = f"ROWS {a - 1} PRECEDING"
    before = f"ROWS BETWEEN {a} PRECEDING AND 1 PRECEDING"
    if rule.name == "cross":
        x, y = full("avg(close)", a, last), full("avg(close)", b, f"ROWS {b - 1} PRECEDING")
        up, down = f"{x} > {y}", f"{x} < {y}"
    elif rule.name == "momentum":
        x = f"(close / lag(close, {a}) OVER {over('')} - 1)"
        up, down = f"{x} > {b}::DOUBLE / 100", f"{x} < -({b}::DOUBLE) / 100"
    elif rule.name == "reversion":
        m, s = full("avg(close)", a, last), full("stddev_pop(close)", a, last)
        up, down = f"close < {m} - {b}::DOUBLE * {s}", f"close > {m} + {b}::DOUBLE * {s}"
    else:
        up, down = f"close > {full('max(high)', a, before)}", f"close < {full('min(low)', a, before)}"
    second = "NULL" if b is None else b
    return f"SELECT *, {number} AS param_id, '{rule.name}' AS rule, {a}::DOUBLE AS a, {second}::DOUBLE AS b, CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END AS position FROM {{src}}"


_PARAM, _UNIT = "symbol, tf, param_id", "symbol, tf, param_id, exit, mode"


def units_sql(src: str) -> str:
    """Per-bar returns of every unit over ``src``, as ``u7``."""
    branches = " UNION ALL ".join(_branch(i, r, p) for i, (r, p) in enumerate(SCAN.rows)).format(src=src)
    value = lambda v: "NULL" if v is None else v
    exits = ", ".join(f"('{e.name}', {value(e.stop)}::DOUBLE, {value(e.target)}::DOUBLE)" for e in EXITS)
    w, r = f"(PARTITION BY {_UNIT} ORDER BY ts)", f"(PARTITION BY {_UNIT}, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND "
    return f"""s0 AS ({branches}), s1 AS (SELECT *, {signal_sql(_PARAM)} AS signal FROM s0),
s2 AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER (PARTITION BY {_PARAM} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM s1),
u0 AS (SELECT * EXCLUDE (h), CASE mode WHEN 1 THEN greatest(h, 0) WHEN 2 THEN least(h, 0) ELSE h END AS held FROM s2, (VALUES {exits}) AS x(exit, stop, target), (SELECT unnest([0, 1, 2]) AS mode)),
u1 AS (SELECT *, lag(held) OVER {w} AS prev, lag(close) OVER {w} AS pc FROM u0),
u2 AS (SELECT *, sum(coalesce((held <> prev)::INTEGER, 1)) OVER {w} AS own_run FROM u1),
u3 AS (SELECT *, first_value(close) OVER (PARTITION BY {_UNIT}, own_run ORDER BY ts) AS own_entry FROM u2),
u4 AS (SELECT *, lag(own_run) OVER {w} AS run, lag(own_entry) OVER {w} AS entry, coalesce(prev, 0) AS side FROM u3),
u5 AS (SELECT *, coalesce(CASE WHEN side > 0 THEN low <= entry * (1 - stop) WHEN side < 0 THEN high >= entry * (1 + stop) END, false) AS stopped,
  coalesce(CASE WHEN side > 0 THEN high >= entry * (1 + target) WHEN side < 0 THEN low <= entry * (1 - target) END, false) AS reached FROM u4),
u6 AS (SELECT *, CASE WHEN coalesce(max((stopped OR reached)::INTEGER) OVER {r}1 PRECEDING), 0) = 1 THEN 0 ELSE side END AS o,
  CASE WHEN stopped THEN entry * (1 - side * stop) WHEN reached THEN entry * (1 + side * target) ELSE close END AS leave FROM u5),
u7 AS (SELECT *, greatest(gross - traded * {SCAN.fee}::DOUBLE, -1) AS ret FROM (SELECT *, coalesce(o * (leave - pc) / pc, 0) AS gross,
  CASE WHEN stopped OR reached THEN abs(o) ELSE 0 END + CASE WHEN held <> prev THEN abs(held - CASE WHEN stopped OR reached THEN 0 ELSE o END) ELSE 0 END AS traded FROM u6))"""


_NAMES = f"{_UNIT}, rule, a, b"
_PF = "CASE WHEN {gl} > 0 THEN {gp} / {gl} WHEN {gp} > 0 THEN 'inf'::DOUBLE ELSE 0 END"


def _sums(keys: str, src: str, order: str) -> str:
    """Measures straight from the bars of each key."""
    gp, gl = "sum(greatest(ret, 0))", "sum(greatest(-ret, 0))"
    return f"""SELECT {keys}, count(*) AS bars, count(*) FILTER (traded > 0) AS trades, {gp} AS gp, {gl} AS gl, sum(greatest(gross, 0)) AS gross_gp, sum(greatest(-gross, 0)) AS gross_gl,
 {_PF.format(gp=gp, gl=gl)} AS pf, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(CASE tf WHEN '1h' THEN 8760 ELSE 2190 END) ELSE 0 END AS sharpe,
 arg_max(e, ts) AS growth, least(min(e / greatest(m, 1) - 1), 0) AS drawdown FROM (SELECT *, max(e) OVER (PARTITION BY {order} ORDER BY ts) AS m FROM (SELECT *, product(1 + ret) OVER (PARTITION BY {order} ORDER BY ts) AS e FROM {src})) GROUP BY {keys}"""


_INF = "CASE WHEN isinf({x}) THEN {x} ELSE round({x}, 6) END"


@query("I10_rule_scan", sql(*_BARS, _FRAMED, units_sql("tfb"), f"pm AS ({_sums(_NAMES, 'u7', _UNIT)})",
 body=f"SELECT {_NAMES}, bars, trades, {_INF.format(x='pf')} AS pf, round(sharpe, 6) + 0.0 AS sharpe, round(growth - 1, 6) + 0.0 AS total_return, round(drawdown, 6) + 0.0 AS max_drawdown FROM pm"))
def _(spark, sf):
    """Every rule, parameter row, exit and mode over whole hourly and four-hourly series."""
    keys = [*scan.UNIT, "rule", *SCAN.parameters]
    s = scan.summaries(scan.units(framed(spark, sf), SCAN), keys).withColumns(scan.measures("", "", scan.periods_per_year(YEAR)))
    return s.select(*keys, "bars", "trades", "pf", "sharpe", (F.col("growth") - 1).alias("total_return"), F.col("drawdown").alias("max_drawdown"))


_ROLES = f"""fr AS (SELECT u7.*, fold, CASE WHEN block <= fold THEN 'is' ELSE 'oos' END AS role FROM u7 JOIN (SELECT unnest(range({WALKS})) AS fold) f ON block <= fold + 1 AND fold + 1 < nb),
pm AS ({_sums(_NAMES + ", fold, role", "fr", _UNIT + ", fold, role")}),
wm AS (SELECT o.*, i.bars AS is_bars, i.trades AS is_trades, i.pf AS is_pf, i.sharpe AS is_sharpe, i.drawdown AS is_drawdown, CASE WHEN i.pf > 0 AND NOT isinf(i.pf) THEN o.pf / i.pf ELSE 0 END AS wfe
 FROM (SELECT * FROM pm WHERE role = 'oos') o JOIN (SELECT * FROM pm WHERE role = 'is') i USING ({_UNIT}, fold))"""
_WALKED = (*_BARS, _FRAMED, "inb AS (SELECT * FROM blk WHERE block < nb)", units_sql("inb"), _ROLES)


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.walk_metrics(framed(spark, sf_dir), SCAN, MONTHS, WALKS, scan.periods_per_year(YEAR))


@query("I09_anchored_walk_metrics", sql(*_WALKED, body=f"SELECT {_NAMES}, fold::INTEGER AS fold, is_bars, is_trades, {_INF.format(x='is_pf')} AS is_pf, round(is_sharpe, 6) + 0.0 AS is_sharpe, round(is_drawdown, 6) + 0.0 AS is_drawdown, bars AS oos_bars, trades AS oos_trades, {_INF.format(x='pf')} AS oos_pf, round(sharpe, 6) + 0.0 AS oos_sharpe, round(drawdown, 6) + 0.0 AS oos_drawdown, {_INF.format(x='wfe')} AS wfe FROM wm"))
def _(spark, sf):
    """Every walk of every unit, in-sample parts from merged block summaries."""
    return walks(spark, sf).select(
        *scan.UNIT, "rule", *SCAN.parameters, "fold", "is_bars", "is_trades", "is_pf", "is_sharpe", "is_drawdown",
        F.col("bars").alias("oos_bars"), F.col("trades").alias("oos_trades"), "oos_pf", "oos_sharpe", F.col("drawdown").alias("oos_drawdown"), "wfe",
    )


_Z = f"(mean_sharpe - {expected_max_sharpe(SCAN.trials)}::DOUBLE) / sqrt((1 + 0.5::DOUBLE * mean_sharpe * mean_sharpe) / (greatest(trades, 2) - 1))"
SUMMARY_CTES = (*_WALKED, f"""ws AS (SELECT {_NAMES}, count(*) AS walks, {_PF.format(gp="sum(gp)", gl="sum(gl)")} AS combined_pf, {_PF.format(gp="sum(gross_gp)", gl="sum(gross_gl)")} AS gross_pf,
 sum(trades)::BIGINT AS trades, avg(sharpe) AS mean_sharpe, avg(wfe) AS mean_wfe, avg((pf > 1)::INTEGER) AS win_rate, least(min(drawdown), 0) AS max_drawdown, sum(trades) / sum(bars)::DOUBLE * CASE tf WHEN '1h' THEN 8760 ELSE 2190 END AS annual_trades FROM wm GROUP BY {_NAMES})""",
 f"wz AS (SELECT *, {_Z} AS z FROM ws)", f"wd AS (SELECT *, greatest(0, least(1, 1 - {normal_cdf_sql('z')})) AS dsr_pvalue, combined_pf >= {GATES.pf} AND win_rate >= {GATES.win_rate} AND mean_wfe >= {GATES.wfe} AND annual_trades >= {GATES.annual_trades} AND max_drawdown >= {GATES.max_drawdown} AS passed FROM wz)")


@query("D54_scan_summary", sql(*SUMMARY_CTES, body=f"SELECT {_NAMES}, walks, {_INF.format(x='combined_pf')} AS combined_pf, {_INF.format(x='gross_pf')} AS gross_pf, trades, round(mean_sharpe, 6) + 0.0 AS mean_sharpe, {_INF.format(x='mean_wfe')} AS mean_wfe, round(win_rate, 6) AS win_rate, round(max_drawdown, 6) + 0.0 AS max_drawdown, round(annual_trades, 6) AS annual_trades, round(dsr_pvalue, 6) AS dsr_pvalue, passed, passed AND dsr_pvalue < {GATES.alpha} AS strict_pass, gross_pf >= {GATES.pf} AS relaxed_pass FROM wd"))
def summary(spark, sf):
    """Combined walks of every unit, deflated by the trials of its series, with the strict and the relaxed pass."""
    return scan.walk_summary(walks(spark, sf), SCAN, scan.periods_per_year(YEAR), GATES)


_GROSS = "sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0)"


@query("J27_commit_gate", sql(*SUMMARY_CTES, "wf AS (SELECT * FROM wd WHERE tf = '1h' AND rule = 'cross' AND a = 5 AND b = 20 AND exit = 'none' AND mode = 0)",
 grid_sma_sql("bars", "symbol", JITTER), f"jp AS (SELECT symbol, param_id, short_n, long_n, {_GROSS} AS pf FROM acc GROUP BY ALL)",
 f"rs AS (SELECT symbol, ts, close, rep, (CASE WHEN u < 0.2::DOUBLE THEN -1 WHEN u >= 0.8::DOUBLE THEN 1 ELSE 0 END) AS signal FROM (SELECT *, {uniform_sql('epoch(ts)::BIGINT', 'rep', 7)} AS u FROM bars, (SELECT unnest(range(200))::INTEGER AS rep)))",
 account_ctes("rs", "0.0004", keys="symbol, rep", out="racc"), f"rp AS (SELECT symbol, rep, {_GROSS} AS pf FROM racc GROUP BY ALL)",
 SMA_X, f"pos AS (SELECT symbol, ts, close, (CASE {SMA_P} ELSE 0 END) AS position FROM x)", f"sg AS (SELECT *, {signal_sql()} AS signal FROM pos)", account_ctes("sg", "0.0004", out="own"), f"op AS (SELECT symbol, {_GROSS} AS own_pf FROM own GROUP BY ALL)",
 "ev AS (SELECT symbol, (SELECT coalesce(stddev_pop(pf) / avg(pf) > 0.5, false) FROM jp WHERE jp.symbol = op.symbol) AS cliff, (SELECT count(*) FILTER (pf <= own_pf) * 100.0 / count(*) FROM rp WHERE rp.symbol = op.symbol AND pf IS NOT NULL)::DOUBLE AS pr, (SELECT least(avg(pf) / own_pf, 1) FROM jp WHERE jp.symbol = op.symbol AND NOT (short_n = 5 AND long_n = 20)) AS plateau FROM op)",
 "ck AS (SELECT symbol, passed, dsr_pvalue < 0.05 AS dsr_significant, NOT cliff AS mc_robust, coalesce(pr >= 95, false) AS random_beats, coalesce(plateau >= 0.5, false) AS plateau_ok, max_drawdown < -0.4 OR combined_pf < 1 AS veto FROM wf JOIN ev USING (symbol))",
 body="SELECT symbol, passed AS wfd_pass, dsr_significant, mc_robust, random_beats, plateau_ok, n >= 3 AS majority, veto, n >= 3 AND NOT veto AS approved FROM (SELECT *, passed::INTEGER + dsr_significant::INTEGER + mc_robust::INTEGER + random_beats::INTEGER + plateau_ok::INTEGER AS n FROM ck)"))
def _(spark, sf):
    """Approval on joined evidence: walks, deflated p-value, perturbed parameters, random entries and the plateau around the parameters."""
    unit = (F.col("tf") == "1h") & (F.col("rule") == "cross") & (F.col("a") == 5) & (F.col("b") == 20) & (F.col("exit") == "none") & (F.col("mode") == 0)
    walked = summary(spark, sf).filter(unit).select("symbol", "passed", "dsr_pvalue", "max_drawdown", "combined_pf")
    bars = hourly(spark, sf)
    near = history.sweep(bars, ["symbol"], JITTER, 0.0004, 8760.0)
    cliff = history.robustness(near, ["symbol"]).select("symbol", "cliff")
    own = performance(account(apply_rule("sma_cross", bars, K), K, 0.0004), K, 8760.0).select("symbol", F.col("profit_factor").alias("own_pf"))
    around = near.filter("NOT (short_n = 5 AND long_n = 20)").groupBy("symbol").agg(F.avg("profit_factor").alias("near_pf"))
    noise = performance(account(history.random_signals(bars, 200, 7), ["symbol", "rep"], 0.0004), ["symbol", "rep"], 8760.0)
    rank = noise.filter("profit_factor IS NOT NULL").join(own, "symbol").groupBy("symbol")
    rank = rank.agg((F.count_if(F.col("profit_factor") <= F.col("own_pf")) / F.count(F.lit(1)) * 100).alias("pr"))
    e = walked.join(cliff, "symbol").join(own, "symbol").join(around, "symbol", "left").join(rank, "symbol", "left")
    plateau = F.least(F.try_divide("near_pf", "own_pf"), F.lit(1.0)) >= 0.5
    found = {"wfd_pass": F.col("passed"), "dsr_significant": F.col("dsr_pvalue") < 0.05, "mc_robust": ~F.col("cliff"), "random_beats": F.col("pr") >= 95, "plateau_ok": plateau}
    e = e.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in found.items()})
    majority, veto, approved = verdicts.commit_gate([F.col(k) for k in found], F.col("max_drawdown"), F.col("combined_pf"))
    return e.select("symbol", *found, majority.alias("majority"), veto.alias("veto"), approved.alias("approved"))

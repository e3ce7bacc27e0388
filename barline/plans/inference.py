"""Resampling, corrections, agreement, verdicts, policies and drift."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import calendar as cal
from barline.functions import stats as st
from barline.functions.draws import uniform_sql
from barline.functions.text import fingerprint, fixed6
from barline.operators import agreement as ag
from barline.operators import imbalance, lookup, policies, resampling, states, verdicts
from barline.operators import multiple as mt
from barline.operators.indicators import by, log_return
from barline.operators.policies import PolicyRule
from barline.operators.series import Run, fan_out, running
from barline.plans.aggs import (
    _GRID216, _SLOT30, _TALLY, STUDY_CELLS, STUDY_PRICED, STUDY_SCORES, family_grid, study_priced, tally,
)
from barline.plans.books import _CP, QB, cell_performance
from barline.plans.checks import DAILY, FAST, REFERENCE, SLOTS, TORD, TRADES, normal_cdf_sql, sql
from barline.plans.registry import query
from barline.plans.rulesets import _H23, reversal_trades
from barline.plans.shapes import rows_as
from barline.sources import tables as T

K = ["symbol"]
ROW = "(ok * 8 + ln) * 1048576 + (pk * 7919 + sk) % 1048576"
ORD = list(T.TRADE_ORDER)

# ---- J: statistics ---------------------------------------------------------------

_SR0 = st.expected_max_sharpe(96)
_DSR = """mo AS (SELECT cell_id, count(*) AS n, CASE WHEN stddev_samp(pnl) > 1e-12 THEN avg(pnl) / stddev_samp(pnl) END AS sr, skewness(pnl) AS sk, kurtosis(pnl) + 3 AS ku FROM trades GROUP BY 1)"""

# Tail probabilities of the checks: Simpson's rule over the density.
_SIMPSON = "list_sum([(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f}) for i in range(0, 401)]) * ({x}) / 1200"


def student_p_sql(t: str, df: str) -> str:
    x = f"(abs({t}) * i / 400)"
    f = f"pow(1 + {x} * {x} / ({df}), -(({df}) + 1) / 2.0)"
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) * " + _SIMPSON.format(f=f, x=f"abs({t})") + ")"


def chi_square_p_sql(h: str, df: str) -> str:
    x = f"(({h}) * i / 400)"
    f = f"(CASE WHEN i = 0 THEN (CASE WHEN ({df}) = 2 THEN 1 ELSE 0 END) ELSE pow({x}, ({df}) / 2.0 - 1) * exp(-{x} / 2) END)"
    return f"(1 - exp(-lgamma(({df}) / 2.0)) / pow(2, ({df}) / 2.0) * " + _SIMPSON.format(f=f, x=h) + ")"


def moments(df, keys, value):
    """Sharpe per trade and bias-corrected skew and kurtosis (normal = 3)."""
    n = F.count(value).cast("double")
    g1, g2 = F.skewness(value), F.kurtosis(value)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.when(F.stddev_samp(value) > 1e-12, F.avg(value) / F.stddev_samp(value)).alias("sr"),
        F.when(n > 2, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)).otherwise(0.0).alias("sk"),
        F.when(n > 3, F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3)) + 3).otherwise(3.0).alias("ku"),
    )


def dsr_reason(n, sr, dsr):
    """Why the gate is shut; 'passed' if it is open."""
    shut = F.when(dsr > 0.95, "passed").otherwise("dsr_probability_not_above_threshold")
    return F.when(n < 2, "insufficient_trades").when(sr.isNull(), "zero_variance").when(dsr.isNull() | F.isnan(dsr), "non_finite_returns").otherwise(shut)


_DSRZ = f"dz AS (SELECT *, (sr - {_SR0}::DOUBLE) / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1)) AS z FROM mo)"


def deflated(spark, sf):
    """Per-trade Sharpe of every cell and the probability that it is genuine after 96 trials."""
    m = moments(T.trades(spark, sf), ["cell_id"], "pnl")
    return m.withColumn("dsr", st.deflated_sharpe(F.col("sr"), 96, F.col("sk"), F.col("ku"), F.col("n")))


@query("J01_deflated_sharpe", sql(TRADES, _DSR, _DSRZ, body=f"SELECT cell_id, n, round(sr, 6) + 0.0 AS sr, round({normal_cdf_sql('z')}, 6) AS dsr, coalesce({normal_cdf_sql('z')} > 0.95, false) AS passed, CASE WHEN n < 2 THEN 'insufficient_trades' WHEN sr IS NULL THEN 'zero_variance' WHEN {normal_cdf_sql('z')} > 0.95 THEN 'passed' ELSE 'dsr_probability_not_above_threshold' END AS reason FROM dz"))
def _(spark, sf):
    d = deflated(spark, sf)
    passed = F.coalesce(F.col("dsr") > 0.95, F.lit(False))
    return d.select("cell_id", "n", "sr", "dsr", passed.alias("passed"), dsr_reason(F.col("n"), F.col("sr"), F.col("dsr")).alias("reason"))


# Replicates of the bootstraps and label permutations, of the sign flips, of the direction shuffle and the payoff bound.
REPS, FLIPS, SHUFFLES = 1000, 999, 2000


def block_means_sql(reps: int, seed: int, keys: str = "cell_id") -> str:
    u = lambda salt: uniform_sql("k", "rep", seed + salt)
    p = "least(greatest(1 / greatest(sqrt(n), 1), 1e-6), 1 - 1e-6)"
    same = lambda t: " AND ".join(f"{t}.{k} = b3.{k}" for k in keys.split(", "))
    return f"""px AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {TORD}) AS i, sum(pnl) OVER (PARTITION BY {keys} ORDER BY {TORD}) AS s FROM trades),
sz AS (SELECT {keys}, max(i) AS n, arg_max(s, i) AS total FROM px GROUP BY ALL),
b0 AS (SELECT *, unnest(range(1, (ceil(n / sqrt(n)) * 2 + 51)::BIGINT)) AS k FROM sz, (SELECT unnest(range({reps}))::INTEGER AS rep)),
b1 AS (SELECT *, (floor(ln(1 - greatest({u(0)}, 1e-12)) / ln(1 - {p})) + 1)::BIGINT AS len, floor({u(1)} * n)::BIGINT AS start FROM b0),
b2 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY {keys}, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM b1),
b3 AS (SELECT *, least(len, n - done) AS l FROM b2 WHERE done < n),
b4 AS (SELECT b3.*, coalesce(e.s, 0) AS es, coalesce(a.s, 0) AS s0 FROM b3 LEFT JOIN px e ON {same("e")} AND e.i = CASE WHEN start + l > n THEN start + l - n ELSE start + l END LEFT JOIN px a ON {same("a")} AND a.i = start),
bm AS (SELECT {keys}, rep, sum(es - s0 + CASE WHEN start + l > n THEN total ELSE 0 END) / any_value(n) AS mean FROM b4 GROUP BY ALL)"""


@query("J02_block_bootstrap_interval", sql(TRADES, block_means_sql(REPS, 42), body=f"SELECT cell_id, round(list_sort(list(mean))[{math.floor(0.025 * REPS) + 1}], 6) + 0.0 AS ci_low, round(list_sort(list(mean))[{math.ceil(0.975 * REPS) + 1}], 6) + 0.0 AS ci_high FROM bm GROUP BY 1"))
def _(spark, sf):
    m = resampling.block_bootstrap_means(T.trades(spark, sf), ["cell_id"], ORD, F.col("pnl"), REPS, 42)
    return resampling.interval(m, ["cell_id"], REPS)


@query("J03_block_bootstrap_pvalue", sql(TRADES, block_means_sql(REPS, 43), "ob AS (SELECT cell_id, avg(pnl) AS m0, count(*) AS n FROM trades GROUP BY 1)", body="SELECT cell_id, any_value(n) AS n, round(any_value(m0), 6) + 0.0 AS mean, CASE WHEN any_value(n) < 4 OR abs(any_value(m0)) <= 1e-12 THEN 1 ELSE round(avg((abs(mean - m0) >= abs(m0))::INTEGER), 6) END AS p_raw FROM bm JOIN ob USING (cell_id) GROUP BY 1"))
def _(spark, sf):
    t = T.trades(spark, sf)
    m = resampling.block_bootstrap_means(t, ["cell_id"], ORD, F.col("pnl"), REPS, 43).withColumnRenamed("mean", "star")
    obs = t.groupBy("cell_id").agg(F.avg("pnl").alias("mean"), rows_as("n"))
    p = m.join(obs, "cell_id").groupBy("cell_id").agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.avg((F.abs(F.col("star") - F.col("mean")) >= F.abs("mean")).cast("int")).alias("p_raw")
    )
    return p.withColumn("p_raw", F.when((F.col("n") < 4) | (F.abs("mean") <= 1e-12), 1.0).otherwise(F.col("p_raw")))


def pool_sql(kind: str, reps: int, seed: int, src: str = "trades", row: str = ROW) -> str:
    """Pools of equal values, the cumulative probabilities of their counts, and a count for each pool and replicate."""
    mean, spread = ("c", "sqrt(c)") if kind == "poisson" else ("c / 2", "sqrt(c) / 2")
    last = f"ceil({mean} + 8 * {spread} + 20)"
    log = "k * ln(c) - c - lgamma(k + 1)" if kind == "poisson" else "lgamma(c + 1) - c * ln(2) - lgamma(k + 1) - lgamma(c - k + 1)"
    last = last if kind == "poisson" else f"least(c, {last})"
    return f"""pool AS (SELECT cell_id, pnl::DOUBLE AS x, count(*) AS c, min({row}) AS row FROM {src} WHERE pnl IS NOT NULL GROUP BY ALL),
cw AS (SELECT c, greatest(0, floor({mean} - 8 * {spread} - 20))::BIGINT AS lo, {last}::BIGINT AS hi FROM (SELECT DISTINCT c FROM pool)),
ck AS (SELECT c, lo, unnest(range(lo, hi + 1)) AS k FROM cw),
cc AS (SELECT c, lo, k, round(sum(exp({log})) OVER (PARTITION BY c ORDER BY k), 9) AS cum FROM ck),
ct AS (SELECT c, any_value(lo) AS lo, list(cum ORDER BY k) AS cdf FROM cc GROUP BY c),
du AS (SELECT pool.*, lo, cdf, rep, {uniform_sql("row", "rep", seed)} AS u FROM pool JOIN ct USING (c), (SELECT unnest(range({reps}))::INTEGER AS rep)),
dr AS (SELECT cell_id, rep, x, c, lo + len(list_filter(cdf, lambda v: v <= u)) AS w FROM du)"""


# Each row's own Poisson(1) count.
_POIS = "(" + " + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in resampling.POISSON_CDF.tolist()) + ")"


@query("J04_iid_bootstrap_pvalue", sql(TRADES, "ob AS (SELECT cell_id, sum(pnl)::DOUBLE AS t, count(pnl) AS n FROM trades GROUP BY 1)", f"dr AS (SELECT cell_id, rep, pnl::DOUBLE AS x, {uniform_sql(ROW, 'rep', 5)} AS u FROM trades, (SELECT unnest(range({REPS}))::INTEGER AS rep) WHERE pnl IS NOT NULL)",
 f"ms AS (SELECT cell_id, rep, sum({_POIS} * x) AS s, sum({_POIS})::DOUBLE AS w FROM dr GROUP BY ALL)", body="SELECT cell_id, any_value(n)::BIGINT AS n, round(any_value(t / n), 6) + 0.0 AS mean, CASE WHEN any_value(n) < 4 OR abs(any_value(t / n)) <= 1e-12 THEN 1 ELSE round(avg((abs(n * s - t * w) >= abs(t) * w)::INTEGER) FILTER (w > 0), 6) END AS p_raw FROM ms JOIN ob USING (cell_id) GROUP BY 1"))
def _(spark, sf):
    return resampling.bootstrap_pvalues(T.trades(spark, sf), ["cell_id"], F.expr(ROW), F.col("pnl"), REPS, 5, pooled=False)


@query("J05_sign_flip", sql(TRADES, f"sf AS (SELECT cell_id, rep, sum(CASE WHEN {uniform_sql(ROW, 'rep', 9)} < 0.5 THEN -pnl ELSE pnl END) AS s FROM trades, (SELECT unnest(range({FLIPS}))::INTEGER AS rep) GROUP BY ALL)", "ob AS (SELECT cell_id, count(*) AS n, sum(pnl) AS observed_sum FROM trades GROUP BY 1)",
 body=f"SELECT cell_id, any_value(n) AS n, any_value(observed_sum) AS observed_sum, count(*) FILTER (s >= observed_sum) AS extreme, round((count(*) FILTER (s >= observed_sum) + 1) / {FLIPS + 1}.0::DOUBLE, 6) AS p_raw FROM sf JOIN ob USING (cell_id) GROUP BY 1"))
def _(spark, sf):
    return resampling.sign_flip_pvalues(T.trades(spark, sf), ["cell_id"], F.expr(ROW), F.col("pnl"), FLIPS, 9)


_PC = """pt AS (SELECT cell_id, count(*) AS n, avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))) AS t FROM trades GROUP BY 1),
pc AS (SELECT *, round(least(1, exp(-0.5 * t * t)), 9) AS p_raw, row_number() OVER (ORDER BY cell_id) - 1 AS cell_no, ['LOW', 'MID', 'HIGH'][((row_number() OVER (ORDER BY cell_id) - 1) % 3 + 1)::INTEGER] AS bucket, CASE WHEN (row_number() OVER (ORDER BY cell_id) - 1) % 2 = 0 THEN 'HAWK' ELSE 'DOV' END AS stance FROM pt)"""


def tested_cells(spark, sf):
    """One row per cell (at most 42): tail p-value, number and labels."""
    t = F.try_divide(F.avg("pnl"), F.stddev_samp("pnl") / F.sqrt(F.count("pnl")))
    c = T.trades(spark, sf).groupBy("cell_id").agg(rows_as("n"), t.alias("t"))
    c = c.withColumn("p_raw", F.round(F.least(F.lit(1.0), F.exp(-0.5 * F.col("t") * F.col("t"))), 9))
    no = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("cell_id")) - 1
    c = c.withColumn("cell_no", no)
    bucket = F.element_at(F.array(F.lit("LOW"), F.lit("MID"), F.lit("HIGH")), F.col("cell_no") % 3 + 1)
    return c.withColumn("bucket", bucket).withColumn("stance", F.when(F.col("cell_no") % 2 == 0, "HAWK").otherwise("DOV"))


def holm_sql(src: str, family: str, m: str, tie: str = "cell_no") -> str:
    part = f"PARTITION BY {family} " if family else ""
    return f"(SELECT *, least(1, max(({m} - rk + 1) * p_raw) OVER ({part}ORDER BY p_raw, {tie} ROWS UNBOUNDED PRECEDING)) AS p_adj FROM (SELECT *, row_number() OVER ({part}ORDER BY p_raw, {tie}) AS rk FROM {src}))"


def shuffle_sql(src: str, group: str, row: str, label: str, reps: int, seed: int) -> str:
    g = (group + ", ") if group else ""
    return f"""sa AS (SELECT *, row_number() OVER (PARTITION BY {g}rep ORDER BY {row}) AS r FROM {src}, (SELECT unnest(range({reps}))::INTEGER AS rep)),
sb AS (SELECT {g}rep, {label} AS shuffled, row_number() OVER (PARTITION BY {g}rep ORDER BY {uniform_sql(row, 'rep', seed)}, {row}) AS r FROM {src}, (SELECT unnest(range({reps}))::INTEGER AS rep)),
sh AS (SELECT * FROM sa JOIN sb USING ({g}rep, r))"""


@query("J06_bucket_permutation", sql(TRADES, _PC, shuffle_sql("pc", "", "cell_no", "bucket", REPS, 21), "kept AS (SELECT * FROM sh WHERE shuffled IN ('LOW', 'MID'))", body=f"SELECT r.rep, count(*) FILTER (p_adj < 0.05) AS edges FROM (SELECT unnest(range({REPS}))::INTEGER AS rep) r LEFT JOIN {holm_sql('kept', 'rep', '64')} h ON h.rep = r.rep GROUP BY 1"))
def _(spark, sf):
    return resampling.permuted_edge_counts(tested_cells(spark, sf), "bucket", ("LOW", "MID"), 64, 0.05, REPS, 21)


@query("J07_stance_permutation", sql(TRADES, _PC, f"ha AS {holm_sql('pc', '', '64')}", shuffle_sql("ha", "", "cell_no", "stance", REPS, 22), body="SELECT rep, count(*) FILTER (p_adj < 0.05 AND shuffled = 'HAWK') AS edges FROM sh GROUP BY 1"))
def _(spark, sf):
    return resampling.stance_edge_counts(tested_cells(spark, sf), "stance", "HAWK", 64, 0.05, REPS, 22)


_PFD = "sum(greatest({x}, 0)) / nullif(sum(greatest(-({x}), 0)), 0)"


@query("J08_direction_shuffle", sql(*QB, _H23, "hx AS (SELECT symbol, direction, entry, x, epoch(ts)::BIGINT // 3600 AS h FROM h23)", shuffle_sql("hx", "symbol", "h", "direction", SHUFFLES, 23), f"nl AS (SELECT symbol, rep, coalesce({_PFD.format(x='shuffled * (x / entry - 1) * 10000 - 4')}, 1e12) AS pf FROM sh GROUP BY ALL)", f"ob AS (SELECT symbol, coalesce({_PFD.format(x='direction * (x / entry - 1) * 10000 - 4')}, 1e12) AS observed FROM hx GROUP BY 1)",
 body="SELECT symbol, round(any_value(observed), 6) AS observed, round(quantile_cont(pf, 0.95), 6) AS null_p95, any_value(observed) > quantile_cont(pf, 0.95) AS passed FROM nl JOIN ob USING (symbol) GROUP BY 1"))
def _(spark, sf):
    t = reversal_trades(spark, sf).withColumn("h", F.floor(F.unix_micros("ts") / 3_600_000_000))
    # One trade per symbol and day.
    perm = resampling.shuffled(t, ["symbol"], F.col("h"), "direction", SHUFFLES, 23)

    def pf(direction):
        pnl = F.col(direction) * (F.col("x") / F.col("entry") - 1) * 10_000 - 4
        return F.coalesce(F.try_divide(F.sum(F.greatest(pnl, F.lit(0.0))), F.sum(F.greatest(-pnl, F.lit(0.0)))), F.lit(1e12))

    null = perm.groupBy("symbol", "rep").agg(pf("shuffled").alias("pf")).groupBy("symbol").agg(F.percentile("pf", F.lit(0.95)).alias("null_p95"))
    out = null.join(t.groupBy("symbol").agg(pf("direction").alias("observed")), "symbol")
    return out.withColumn("passed", resampling.exceeds_null(F.col("observed"), F.col("null_p95")))


_PF2 = """pt AS (SELECT cell_id, fold, count(*) AS n, avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))) AS t FROM trades GROUP BY ALL), pf2 AS (SELECT *, round(least(1, exp(-0.5 * t * t)), 9) AS p_raw FROM pt)"""


def tested_folds(spark, sf):
    t = F.try_divide(F.avg("pnl"), F.stddev_samp("pnl") / F.sqrt(F.count("pnl")))
    c = T.trades(spark, sf).groupBy("cell_id", "fold").agg(rows_as("n"), t.alias("t"))
    return c.withColumn("p_raw", F.round(F.least(F.lit(1.0), F.exp(-0.5 * F.col("t") * F.col("t"))), 9))


@query("J09_holm_padded", sql(TRADES, _PF2, body=f"SELECT fold, cell_id, round(p_raw, 6) AS p_raw, round(p_adj, 6) AS p_adj, p_adj < 0.05 AS pass_fwer FROM {holm_sql('pf2', 'fold', '72', 'cell_id')}"))
def _(spark, sf):
    h = mt.holm(tested_folds(spark, sf), ["fold"], "p_raw", ["cell_id"], 72)
    return h.select("fold", "cell_id", "p_raw", "p_adj", (F.col("p_adj") < 0.05).alias("pass_fwer"))


@query("G08_padded_family", sql(TRADES, _PF2, "gr AS (SELECT cell_id, fold FROM (SELECT DISTINCT cell_id FROM trades), (SELECT unnest(range(4))::INTEGER AS fold))", body="SELECT cell_id, fold, CASE WHEN p_raw IS NULL THEN 'padded' ELSE 'tested' END AS status, round(coalesce(p_raw, 1), 6) AS p_raw FROM gr LEFT JOIN pf2 USING (cell_id, fold)"))
def _(spark, sf):
    tested = tested_folds(spark, sf).select("cell_id", "fold", "p_raw")
    grid = fan_out(tested.select("cell_id").distinct(), "fold", (0, 1, 2, 3))
    return mt.padded_family(grid, tested, ["cell_id", "fold"], "p_raw").select("cell_id", "fold", "status", "p_raw")


@query("D49_edge_count", sql(TRADES, _PF2, body=f"SELECT fold, count(*) FILTER (p_adj < 0.05) AS edges, count(*) AS tested FROM {holm_sql('pf2', 'fold', '72', 'cell_id')} GROUP BY 1"))
def _(spark, sf):
    h = mt.holm(tested_folds(spark, sf), ["fold"], "p_raw", ["cell_id"], 72)
    return h.groupBy("fold").agg(F.count_if(F.col("p_adj") < 0.05).alias("edges"), rows_as("tested"))


@query("J10_bonferroni_bh", sql(TRADES, _PF2, body="SELECT fold, count(*) FILTER (p_raw < 0.05 / 192) AS pass_bonferroni, coalesce(max(CASE WHEN p_raw <= i / m::DOUBLE * 0.1 THEN i END), 0) AS pass_bh FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p_raw) AS i, count(*) OVER (PARTITION BY fold) AS m FROM pf2) GROUP BY 1"))
def _(spark, sf):
    return mt.pass_counts(tested_folds(spark, sf), ["fold"], "p_raw", 192)


_TL = "tl AS (" + _TALLY.format(where="") + ")"


def vif_tally(spark, sf):
    return ag.vif(tally(T.slot_reports(spark, sf)), ["event", "hb"], ["long", "neutral", "short"])


# The inverse of a 3 x 3 correlation matrix in closed form.
_VIF = """v0 AS (SELECT event, hb, count(*) AS n, sum(long * long)::DOUBLE AS aa, sum(neutral * neutral)::DOUBLE AS bb, sum(short * short)::DOUBLE AS cc, sum(long * neutral)::DOUBLE AS ab, sum(long * short)::DOUBLE AS ac, sum(neutral * short)::DOUBLE AS bc FROM tl GROUP BY ALL),
v1 AS (SELECT *, ab / sqrt(nullif(aa * bb, 0)) AS r, ac / sqrt(nullif(aa * cc, 0)) AS s, bc / sqrt(nullif(bb * cc, 0)) AS t FROM v0), v2 AS (SELECT *, 1 + 2 * r * s * t - r * r - s * s - t * t AS det FROM v1),
vf AS (SELECT event, hb, n, CASE WHEN n < 3 OR det IS NULL OR det < 1e-10 THEN 'inf'::DOUBLE ELSE (3 - r * r - s * s - t * t) / det / 3 END AS vif FROM v2)"""


@query("J12_variance_inflation", sql(SLOTS, _TL, _VIF, body="SELECT event, hb, n, CASE WHEN isinf(vif) THEN vif ELSE round(vif, 6) END AS vif FROM vf"))
def _(spark, sf):
    return vif_tally(spark, sf)


@query("J11_effective_family", sql(SLOTS, _TL, _VIF, body="SELECT round(bar, 6) AS vif_bar, round(greatest(1, least(24, 24 / bar)), 6) AS m_eff FROM (SELECT coalesce(avg(vif), 24) AS bar FROM vf WHERE NOT isinf(vif))"))
def _(spark, sf):
    v = vif_tally(spark, sf).filter(F.col("vif") < float("inf"))
    bar = F.coalesce(F.avg("vif"), F.lit(24.0))
    return v.agg(bar.alias("vif_bar"), F.greatest(F.lit(1.0), F.least(F.lit(24.0), 24.0 / bar)).alias("m_eff"))


_SGN = """sgw AS (SELECT event, hb, wo, et, max(CASE WHEN pair = 'P0' THEN s END) AS p0, max(CASE WHEN pair = 'P1' THEN s END) AS p1, max(CASE WHEN pair = 'P2' THEN s END) AS p2, max(CASE WHEN pair = 'P3' THEN s END) AS p3 FROM (SELECT event, pair, wo, hb, et, sign(long - short)::INTEGER AS s FROM tl) GROUP BY ALL)"""
_LONGP = "lp AS (" + " UNION ALL ".join(f"SELECT event, hb, wo, et, 'p{i}' AS a, 'p{j}' AS b, p{i} AS x, p{j} AS y FROM sgw WHERE p0 + p1 + p2 + p3 IS NOT NULL" for i in range(4) for j in range(i + 1, 4)) + ")"


def sign_wide(spark, sf):
    t = tally(T.slot_reports(spark, sf)).withColumn("s", F.signum(F.col("long") - F.col("short")).cast("int"))
    return lookup.slots_wide(t, "s").na.drop(subset=["p0", "p1", "p2", "p3"])


PAIRS = ["p0", "p1", "p2", "p3"]
_SPEAR = """rk AS (SELECT *, rank() OVER (PARTITION BY event, hb, a, b ORDER BY x) + (count(*) OVER (PARTITION BY event, hb, a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY event, hb, a, b ORDER BY y) + (count(*) OVER (PARTITION BY event, hb, a, b, y) - 1) / 2 AS ry FROM lp),
sp AS (SELECT event, hb, a, b, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY ALL),
rb AS (SELECT event, hb, max(n) AS n, least(greatest(coalesce(median(rho), 0), 0), 1) AS rho_bar FROM sp GROUP BY ALL)"""


def rho_bar(spark, sf):
    long = ag.pair_table(sign_wide(spark, sf), ["event", "hb"], PAIRS)
    per = ag.spearman(long, ["event", "hb", "a", "b"])
    return per.groupBy("event", "hb").agg(F.max("n").alias("n"), F.least(F.greatest(F.coalesce(F.median("rho"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("rho_bar"))


@query("J13_median_rank_correlation", sql(SLOTS, _TL, _SGN, _LONGP, _SPEAR, body="SELECT event, hb, n, round(rho_bar, 6) AS rho_bar FROM rb"))
def _(spark, sf):
    return rho_bar(spark, sf)


@query("J14_effective_sample", sql(SLOTS, _TL, _SGN, _LONGP, _SPEAR, body="SELECT event, hb, n, round((1 - rho_bar) * n / 1.5, 6) AS n_eff, round(4 / (1 + 3 * rho_bar), 6) AS k_eff FROM rb"))
def _(spark, sf):
    r = rho_bar(spark, sf)
    return r.select("event", "hb", "n", ag.n_effective(F.col("n"), F.col("rho_bar"), F.lit(1.5)).alias("n_eff"), (4 / (1 + 3 * F.col("rho_bar"))).alias("k_eff"))


@query("J34_any_sufficient", sql(SLOTS, _TL, _SGN, _LONGP, _SPEAR, body="SELECT event, CASE WHEN bool_or((1 - rho_bar) * n / 1.5 >= 4) THEN 'proceed' ELSE 'null-ship' END AS decision FROM rb GROUP BY 1"))
def _(spark, sf):
    r = rho_bar(spark, sf).withColumn("n_eff", ag.n_effective(F.col("n"), F.col("rho_bar"), F.lit(1.5)))
    return r.groupBy("event").agg(F.when(F.bool_or(F.col("n_eff") >= 4), "proceed").otherwise("null-ship").alias("decision"))


_L0 = """lv AS (SELECT event, CASE WHEN hb <= 3 THEN '0-60m' ELSE '60-120m' END AS dur, et, trades FROM slots WHERE fee = 0),
ls AS (SELECT 0 AS level, event, dur || '_x_' || et AS cell_id, sum(trades)::BIGINT AS n FROM lv GROUP BY ALL UNION ALL SELECT 1, event, dur, sum(trades)::BIGINT FROM lv GROUP BY ALL UNION ALL SELECT 2, event, et, sum(trades)::BIGINT FROM lv GROUP BY ALL)"""


@query("J15_hierarchical_fallback", sql(SLOTS, _L0, body="SELECT ls.* FROM ls JOIN (SELECT event, coalesce(min(CASE WHEN mn >= 1000 THEN level END), 2) AS level FROM (SELECT event, level, min(n) AS mn FROM ls GROUP BY ALL) GROUP BY 1) USING (event, level)"))
def _(spark, sf):
    s = T.slot_reports(spark, sf).filter("fee = 0").withColumn("dur", cal.duration_bucket(F.col("hb"), F.lit(20)))
    dims = ["event", "dur", "et"]
    sets = [[F.col(c) for c in dims], [F.col("event"), F.col("dur")], [F.col("event"), F.col("et")]]
    g = s.groupingSets(sets, *[F.col(c) for c in dims]).agg(F.grouping_id().alias("gid"), F.sum("trades").alias("n"))
    g = g.withColumn("level", F.when(F.col("gid") == 0, 0).when(F.col("gid") == 1, 1).otherwise(2))
    g = g.withColumn("cell_id", F.concat_ws("_x_", "dur", "et"))
    smallest = F.min("n").over(Window.partitionBy("event", "level"))
    g = g.withColumn("_ok", smallest >= 1000)
    chosen = F.coalesce(F.min(F.when(F.col("_ok"), F.col("level"))).over(Window.partitionBy("event")), F.lit(2))
    return g.withColumn("_c", chosen).filter("level = _c").select("event", "level", "cell_id", "n")


def votes(spark, sf):
    w = sign_wide(spark, sf)
    longs = sum((F.when(F.col(p) == 1, 1).otherwise(0) for p in PAIRS), F.lit(0))
    shorts = sum((F.when(F.col(p) == -1, 1).otherwise(0) for p in PAIRS), F.lit(0))
    return w.select("event", "hb", longs.alias("longs"), shorts.alias("shorts"))


_FK = """vt AS (SELECT event, (p0 = 1)::INTEGER + (p1 = 1)::INTEGER + (p2 = 1)::INTEGER + (p3 = 1)::INTEGER AS l, (p0 = -1)::INTEGER + (p1 = -1)::INTEGER + (p2 = -1)::INTEGER + (p3 = -1)::INTEGER AS s FROM sgw WHERE p0 + p1 + p2 + p3 IS NOT NULL),
fk0 AS (SELECT event, count(*) AS subjects, avg((l * (l - 1) + s * (s - 1)) / 12.0::DOUBLE) AS po, sum(l) / (count(*) * 4.0::DOUBLE) AS pl FROM vt WHERE l + s = 4 GROUP BY 1),
fk AS (SELECT event, subjects, (po - (pl * pl + (1 - pl) * (1 - pl))) / nullif(1 - (pl * pl + (1 - pl) * (1 - pl)), 0) AS kappa FROM fk0)"""


@query("J16_fleiss_kappa", sql(SLOTS, _TL, _SGN, _FK, body="SELECT event, subjects, round(kappa, 6) + 0.0 AS kappa FROM fk"))
def _(spark, sf):
    return ag.fleiss_kappa(votes(spark, sf), ["event"], 4)


_CK = """ck0 AS (SELECT event, a, b, count(*) AS n, avg((x = y)::INTEGER) AS po, avg((x = 1)::INTEGER) AS px, avg((y = 1)::INTEGER) AS py FROM lp WHERE x <> 0 AND y <> 0 GROUP BY ALL),
ck AS (SELECT event, a, b, n, (po - (px * py + (1 - px) * (1 - py))) / nullif(1 - (px * py + (1 - px) * (1 - py)), 0) AS kappa FROM ck0)"""


@query("J17_cohen_kappa", sql(SLOTS, _TL, _SGN, _LONGP, _CK, body="SELECT event, a, b, n, round(kappa, 6) + 0.0 AS kappa FROM ck"))
def _(spark, sf):
    return ag.cohen_kappa(ag.pair_table(sign_wide(spark, sf), ["event"], PAIRS), ["event", "a", "b"])


@query("J18_kappa_label", sql(SLOTS, _TL, _SGN, _LONGP, _CK, body="SELECT event, CASE WHEN kappa IS NULL THEN 'undefined' WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost_perfect' END AS label, count(*) AS n FROM ck GROUP BY ALL"))
def _(spark, sf):
    k = ag.cohen_kappa(ag.pair_table(sign_wide(spark, sf), ["event"], PAIRS), ["event", "a", "b"])
    return k.groupBy("event", st.landis_koch(F.col("kappa")).alias("label")).agg(rows_as("n"))


_AG = """agr AS (SELECT event, hb, a, b, count(*) AS n, count(*) FILTER (x = y) AS k FROM lp WHERE x <> 0 AND y <> 0 GROUP BY ALL)"""


def agreements(spark, sf):
    p = ag.pair_table(sign_wide(spark, sf), ["event", "hb"], PAIRS).filter("x <> 0 AND y <> 0")
    return p.groupBy("event", "hb", "a", "b").agg(rows_as("n"), F.count_if(F.col("x") == F.col("y")).alias("k"))


@query("J19_exact_binomial", sql(SLOTS, _TL, _SGN, _LONGP, _AG, body="SELECT event, hb, a, b, n, k, round(least(1, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p FROM agr"))
def _(spark, sf):
    return agreements(spark, sf).withColumn("p", ag.binomial_two_sided(F.col("k"), F.col("n")))


@query("J19_exact_interval")
def _(spark, sf):
    return ag.proportion_interval(agreements(spark, sf), "k", "n")


@query("J20_simpson_check", sql(SLOTS, "st0 AS (SELECT event, hb, count(*) FILTER (sign = 1) AS l, count(*) FILTER (sign = -1) AS s FROM slots GROUP BY ALL)", body="""SELECT event, round(sum(l) / sum(l + s)::DOUBLE, 6) AS pooled, round(max(l / (l + s)::DOUBLE), 6) AS top, abs(sum(l) / sum(l + s)::DOUBLE - max(l / (l + s)::DOUBLE)) > 0.3 AS divergent,
 (count(*) FILTER (l / (l + s)::DOUBLE > 0.5) > count(*) / 2.0) <> (sum(l) / sum(l + s)::DOUBLE > 0.5) AS reversed FROM st0 GROUP BY 1"""))
def _(spark, sf):
    s = T.slot_reports(spark, sf).groupBy("event", "hb").agg(F.count_if(F.col("sign") == 1).alias("l"), F.count_if(F.col("sign") == -1).alias("s"))
    r = F.col("l") / (F.col("l") + F.col("s"))
    out = s.groupBy("event").agg(
        (F.sum("l") / F.sum(F.col("l") + F.col("s"))).alias("pooled"), F.max(r).alias("top"), F.count_if(r > 0.5).alias("_up"), F.count(F.lit(1)).alias("_n")
    )
    return out.select("event", "pooled", "top", (F.abs(F.col("pooled") - F.col("top")) > 0.3).alias("divergent"), ((F.col("_up") > F.col("_n") / 2) != (F.col("pooled") > 0.5)).alias("reversed"))


_RET = """rr AS (SELECT *, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 9) AS r FROM daily), rt AS (SELECT * FROM rr WHERE r IS NOT NULL)"""


def daily_returns(spark, sf):
    r = T.daily_prices(spark, sf).withColumn("r", F.round(log_return(by(K)), 9))
    return r.filter("r IS NOT NULL")


def kw_sql(group: str) -> str:
    return f"""av AS (SELECT symbol, {group} AS g, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY symbol, r) AS t, r FROM rt),
ti AS (SELECT symbol, sum(t * t * t - t) AS ties, sum(t)::BIGINT AS n FROM (SELECT DISTINCT symbol, r, t FROM av) GROUP BY 1), gs AS (SELECT symbol, g, sum(rk) AS s, count(*) AS c FROM av GROUP BY ALL)
SELECT symbol, count(*) AS groups, any_value(n) AS n, round((12.0 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (pow(any_value(n), 3) - any_value(n))), 6) AS h FROM gs JOIN ti USING (symbol) GROUP BY 1"""


def kw_p_sql(group: str) -> str:
    body = kw_sql(group)
    at = body.rindex("SELECT symbol, count(*) AS groups")
    return body[:at] + "SELECT *, round(" + chi_square_p_sql("h", "groups - 1") + ", 6) + 0.0 AS p FROM (" + body[at:] + ")"


def _kw(name, group_sql, group):
    @query(name, "WITH " + DAILY + ", " + _RET + ", " + kw_p_sql(group_sql))
    def _(spark, sf):
        return ag.kruskal_wallis(daily_returns(spark, sf).withColumn("g", group()), K, "g", "r")


_kw("J21_kruskal_weekday", "isodow(ts)", lambda: F.weekday("ts"))
_kw("J21_kruskal_month", "month(ts)", lambda: F.month("ts"))


@query("J22_two_sample_t", sql(DAILY, _RET, body="""SELECT symbol, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS welch_t, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, round(""" + student_p_sql("((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)))", "n1 + n2 - 2") + """, 6) + 0.0 AS p, round(sqrt(v1 / v2), 6) AS vol_ratio FROM (
 SELECT symbol, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(r) FILTER (f) AS m1, avg(r) FILTER (NOT f) AS m2, var_samp(r) FILTER (f) AS v1, var_samp(r) FILTER (NOT f) AS v2 FROM (SELECT *, day(ts) <= 3 AS f FROM rt) GROUP BY 1)"""))
def _(spark, sf):
    x = daily_returns(spark, sf).withColumn("f", F.dayofmonth("ts") <= 3)
    t = ag.two_sample(x, K, "f", "r")
    return t.select("symbol", "n1", "n2", "welch_t", "t", "p", "vol_ratio")


@query("J22_mann_whitney", sql(DAILY, _RET, "mr AS (SELECT symbol, day(ts) <= 3 AS f, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY symbol, r) AS t FROM rt)",
 "mu AS (SELECT symbol, sum(rk) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, count(*) AS n, sum(t * t - 1)::DOUBLE AS ties FROM mr GROUP BY 1)",
 "mz AS (SELECT *, greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1)::DOUBLE))) AS z FROM mu)",
 body="SELECT symbol, round(u, 3)::DOUBLE AS u, round(2 * (1 - " + normal_cdf_sql("z") + "), 6) + 0.0 AS p FROM mz"))
def _(spark, sf):
    return ag.mann_whitney(daily_returns(spark, sf).withColumn("f", F.dayofmonth("ts") <= 3), K, "f", "r")


@query("J22_levene", sql(DAILY, _RET, "z AS (SELECT symbol, f, abs(r - median(r) OVER (PARTITION BY symbol, f)) AS z FROM (SELECT *, day(ts) <= 3 AS f FROM rt))", "zz AS (SELECT *, avg(z) OVER (PARTITION BY symbol) AS zm, avg(z) OVER (PARTITION BY symbol, f) AS zg FROM z)", "lv AS (SELECT symbol, count(*) AS n, (count(*) - 2) * sum(pow(zg - zm, 2)) / sum(pow(z - zg, 2)) AS w FROM zz GROUP BY 1)",
 body="SELECT symbol, round(w, 5) AS levene, round(" + student_p_sql("sqrt(w)", "n - 2") + ", 5) + 0.0 AS p FROM lv"))
def _(spark, sf):
    out = ag.levene(daily_returns(spark, sf).withColumn("f", F.dayofmonth("ts") <= 3), K, "f", "r")
    return out.withColumn("levene", F.round("levene", 5)).withColumn("p", F.round("p", 5))


def _season(name, group_sql, group):
    @query(name, sql(DAILY, _RET, body=f"SELECT symbol, {group_sql} AS bucket, count(*) AS n, round(avg(r), 6) + 0.0 AS mean_ret, round(stddev_samp(r), 6) AS sd, round(avg(r) * 252 * 10000, 3) + 0.0 AS annual_bps FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS dn, count(*) OVER (PARTITION BY symbol, date_trunc('month', ts)) - row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS dl, count(*) OVER (PARTITION BY symbol, date_trunc('quarter', ts)) - row_number() OVER (PARTITION BY symbol, date_trunc('quarter', ts) ORDER BY ts) AS ql, (year(ts), week(ts)) IN (SELECT (year(ts), week(ts)) FROM daily WHERE day(ts) <= 7 AND isodow(ts) = 5) AS nfp FROM rt) GROUP BY ALL"))
    def _(spark, sf):
        r = lookup.flag_release_weeks(states.trading_day_ordinals(daily_returns(spark, sf)))
        return r.groupBy("symbol", group().alias("bucket")).agg(
            rows_as("n"), F.avg("r").alias("mean_ret"), F.stddev_samp("r").alias("sd"), F.round(F.avg("r") * 252 * 10_000, 3).alias("annual_bps")
        )


_season("J23_weekday_table", "(isodow(ts) - 1)::INTEGER", lambda: F.weekday("ts"))
_season("J23_month_table", "month(ts)::INTEGER", lambda: F.month("ts"))
_season("J23_turn_of_month", "(dn <= 3 OR dl < 3)", lambda: (F.col("day_no") <= 3) | (F.col("days_left") < 3))
_season("J23_quarter_end", "(ql < 5)", lambda: F.col("q_left") < 5)
_season("J23_release_week", "nfp", lambda: F.col("in_week"))

_LL = """xr AS (SELECT ts, ln(value / lag(value) OVER (ORDER BY ts)) AS xr, value FROM reference), jn AS (SELECT rt.symbol, rt.ts, rt.r, xr.xr, xr.value, lag(xr.xr) OVER (PARTITION BY rt.symbol ORDER BY rt.ts) AS xlag FROM rt JOIN xr USING (ts) WHERE xr.xr IS NOT NULL)"""


@query("J24_lead_lag", sql(DAILY, _RET, REFERENCE, _LL, body="""SELECT symbol, count(*) AS n, round(corr(r, xr), 6) AS same_day, round(corr(r, xlag), 6) AS lag_one, round(avg(r) FILTER (value > med), 6) + 0.0 AS high_mean, round(avg(r) FILTER (value <= med), 6) + 0.0 AS low_mean FROM (SELECT *, median(value) OVER (PARTITION BY symbol) AS med FROM jn) GROUP BY 1"""))
def _(spark, sf):
    w = Window.partitionBy(F.lit(1)).orderBy("ts")
    ref = T.reference_series(spark, sf).withColumn("xr", F.log(F.col("value") / F.lag("value").over(w))).filter("xr IS NOT NULL")
    j = daily_returns(spark, sf).select("symbol", "ts", "r").join(ref, "ts").withColumn("xlag", F.lag("xr").over(by(K)))
    j = j.join(j.groupBy("symbol").agg(F.median("value").alias("med")), "symbol")
    return j.groupBy("symbol").agg(
        rows_as("n"), st.correlation("r", "xr").alias("same_day"), st.correlation("r", "xlag").alias("lag_one"),
        F.avg(F.when(F.col("value") > F.col("med"), F.col("r"))).alias("high_mean"), F.avg(F.when(F.col("value") <= F.col("med"), F.col("r"))).alias("low_mean"),
    )


def _momentum(lb):
    return f"SELECT symbol, {lb} AS lookback, count(*) AS n, round(corr(m, r), 6) AS predictive FROM (SELECT symbol, r, sum(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {lb} PRECEDING AND 1 PRECEDING) AS m FROM rt) WHERE m IS NOT NULL GROUP BY 1"


@query("J24_momentum_lookbacks", sql(DAILY, _RET, body=" UNION ALL ".join(_momentum(n) for n in (5, 10, 20))))
def _(spark, sf):
    r = daily_returns(spark, sf)
    w = by(K)
    r = r.withColumns({f"m{n}": F.sum("r").over(w.rowsBetween(-n, -1)) for n in (5, 10, 20)})
    long = r.select("symbol", "r", F.explode(F.array(*[F.struct(F.lit(n).alias("lookback"), F.col(f"m{n}").alias("m")) for n in (5, 10, 20)])).alias("x"))
    return long.filter("x.m IS NOT NULL").groupBy("symbol", "x.lookback").agg(rows_as("n"), st.correlation("x.m", "r").alias("predictive"))


_GI = f"""{block_means_sql(REPS, 42, "cell_id, fold")},
gn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY {TORD}) AS i, count(*) OVER (PARTITION BY cell_id) AS nn FROM trades),
gh AS (SELECT cell_id, any_value(nn) AS n, avg(pnl) FILTER (i <= nn // 2) AS h1, avg(pnl) FILTER (i > nn // 2) AS h2, abs(avg(pnl) / (stddev_samp(pnl) / sqrt(count(*)))) AS abs_t, avg(pnl) AS m, 0.01 * avg(qty) AS cost FROM gn GROUP BY 1),
gc AS (SELECT cell_id, fold, list_sort(list(mean))[{math.floor(0.025 * REPS) + 1}] AS lo, list_sort(list(mean))[{math.ceil(0.975 * REPS) + 1}] AS hi FROM bm GROUP BY ALL),
gf AS (SELECT cell_id, fold, count(*) AS trades, CASE WHEN sum(greatest(-pnl, 0)) > 0 THEN sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) ELSE 1e300 END AS pf FROM trades GROUP BY ALL),
gm AS (SELECT cell_id, count(*) FILTER (pf >= 2.0 AND trades >= 1) AS folds_passing, arg_min(lo, abs(k - (c // 2 + 1))) AS lo, arg_min(hi, abs(k - (c // 2 + 1))) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY lo, fold) AS k, count(*) OVER (PARTITION BY cell_id) AS c FROM gf JOIN gc USING (cell_id, fold)) GROUP BY 1),
gi AS (SELECT * FROM gh JOIN gm USING (cell_id))"""

# A fold passes from this profit factor and number of trades on.
FOLD_PF, FOLD_TRADES = 2.0, 1


def gate_inputs(spark, sf):
    """Halves by trade order, folds whose profit factor passes, the block-bootstrap interval of the middle fold, the cost of a trade."""
    base = T.trades(spark, sf)
    t = running(base.select("cell_id", *ORD, "pnl", "qty"), ["cell_id"], ORD, {"i": Run("count", F.lit(1))})
    size = t.groupBy("cell_id").agg(F.max("i").alias("nn"))
    p = F.col("pnl")
    first = F.col("i") <= F.floor(F.col("nn") / 2)
    halves = t.join(size, "cell_id").groupBy("cell_id").agg(
        F.max("nn").alias("n"), F.avg(F.when(first, p)).alias("h1_mean"), F.avg(F.when(~first, p)).alias("h2_mean"),
        F.abs(F.avg(p) / (F.stddev_samp(p) / F.sqrt(F.count(p)))).alias("abs_t"), F.avg(p).alias("mean_pnl"), (0.01 * F.avg("qty")).alias("round_trip_cost"),
    )
    lost = F.sum(F.greatest(-p, F.lit(0.0)))
    per = base.groupBy("cell_id", "fold").agg(rows_as("trades"), F.when(lost > 0, F.sum(F.greatest(p, F.lit(0.0))) / lost).otherwise(float("inf")).alias("pf"))
    means = resampling.block_bootstrap_means(base, ["cell_id", "fold"], ORD, p, REPS, 42)
    per = per.join(resampling.interval(means, ["cell_id", "fold"], REPS), ["cell_id", "fold"])
    w = Window.partitionBy("cell_id")
    mid = per.withColumn("k", F.row_number().over(w.orderBy("ci_low", "fold"))).withColumn("c", F.count(F.lit(1)).over(w))
    at = F.col("k") == F.floor(F.col("c") / 2) + 1
    passing = F.count_if((F.col("pf") >= FOLD_PF) & (F.col("trades") >= FOLD_TRADES))
    folded = mid.groupBy("cell_id").agg(passing.alias("folds_passing"), F.max(F.when(at, F.col("ci_low"))).alias("ci_low"), F.max(F.when(at, F.col("ci_high"))).alias("ci_high"))
    return halves.join(folded, "cell_id")


@query("J26_gate_inputs", sql(TRADES, _GI, body="SELECT cell_id, n, folds_passing, round(h1, 6) + 0.0 AS h1_mean, round(h2, 6) + 0.0 AS h2_mean, round(lo, 6) + 0.0 AS ci_low, round(hi, 6) + 0.0 AS ci_high FROM gi"))
def _(spark, sf):
    return gate_inputs(spark, sf).select("cell_id", "n", "folds_passing", "h1_mean", "h2_mean", "ci_low", "ci_high")


@query("J25_six_gates", sql(TRADES, _GI, _DSR, _DSRZ, body=f"""SELECT cell_id, concat_ws(',', CASE WHEN NOT abs_t > 4.4 THEN 'abs_t_stat' END, CASE WHEN NOT coalesce(1 - {normal_cdf_sql('z')} < 0.05, false) THEN 'dsr_pvalue' END, CASE WHEN NOT m > 2 * cost THEN 'mean_pip_vs_cost' END, CASE WHEN folds_passing < 4 THEN 'fold_pf_4of5' END, CASE WHEN NOT sign(h1) * sign(h2) = 1 THEN 'h1_h2_sign_agree' END, CASE WHEN NOT (lo > 0 OR hi < 0) THEN 'bootstrap_ci_excludes_zero' END) AS failed FROM gi JOIN dz USING (cell_id)"""))
def _(spark, sf):
    d = deflated(spark, sf).select("cell_id", (1 - F.col("dsr")).alias("dsr_pvalue"))
    g = gate_inputs(spark, sf).join(d, "cell_id")
    return g.withColumn("gates", verdicts.six_gates()).select("cell_id", verdicts.failed_gates("gates").alias("failed"))


@query("J28_verdict_cascade", sql(SLOTS, _TL, _SGN, _LONGP, _SPEAR, _FK, _VIF, body="""SELECT event, CASE WHEN max_vif >= 10 OR n_eff < 4 THEN 'noise' WHEN kappa >= 0.61 THEN 'signal' WHEN kappa >= 0.41 THEN 'drift' ELSE 'noise' END AS verdict
 FROM (SELECT event, any_value(kappa) AS kappa, max(vif) AS max_vif, min(CASE WHEN vif IS NULL OR vif <= 0 OR isinf(vif) THEN 0 ELSE greatest((1 - rho_bar) * rb.n / vif, 0) END) AS n_eff FROM rb JOIN vf USING (event, hb) JOIN fk USING (event) GROUP BY event)"""))
def _(spark, sf):
    """Kappa of the event, the largest variance inflation and the smallest effective sample of its horizons."""
    kappa = ag.fleiss_kappa(votes(spark, sf), ["event"], 4).select("event", "kappa")
    sample = rho_bar(spark, sf).join(vif_tally(spark, sf).select("event", "hb", "vif"), ["event", "hb"])
    sample = sample.withColumn("n_eff", ag.n_effective(F.col("n"), F.col("rho_bar"), F.col("vif")))
    per = sample.groupBy("event").agg(F.max("vif").alias("max_vif"), F.min("n_eff").alias("n_eff")).join(kappa, "event")
    return per.select("event", verdicts.cascade(F.col("kappa"), F.col("max_vif"), F.col("n_eff")).alias("verdict"))


# A pool cell is an event and a range of holding times; pnl are whole numbers, which number the pools of equal values.
_CELL = "CASE WHEN hb <= 3 THEN '0-60m' ELSE '60-120m' END"
_POOLED = f"pooled AS (SELECT event || '|' || {_CELL} AS cell_id, pnl, (pnl + 4096)::BIGINT AS vid FROM slot_trades)"


def pooled_cells(spark, sf):
    """Effective sample (the least of the cell's horizons), interval of the mean by bootstrap, and sign ratio of every pool cell."""
    cell = F.when(F.col("hb") <= 3, "0-60m").otherwise("60-120m").alias("pool_cell")
    keys = ["event", "pool_cell"]
    sample = rho_bar(spark, sf).select("event", cell, ag.n_effective(F.col("n"), F.col("rho_bar"), F.lit(1.5)).alias("n_eff"))
    sample = sample.groupBy(*keys).agg(F.min("n_eff").alias("n_eff"))
    held = T.slot_trades(spark, sf).select("event", cell, "pnl")
    pool = resampling.pools(held, keys, F.col("pnl"), F.col("pnl") + 4096)
    sums = resampling.replicate_sums(pool, keys, F.col("_row"), {"_s": F.col("_x"), "_w": F.lit(1.0)}, resampling.pool_counts("poisson"), REPS, 31, F.col("_n"))
    ci = resampling.interval(sums.select(*keys, F.try_divide("_s", "_w").alias("mean")), keys, REPS)
    s = T.slot_reports(spark, sf)
    long, short = F.count_if(F.col("sign") == 1), F.count_if(F.col("sign") == -1)
    ratio = s.groupBy("event", cell).agg(F.coalesce(F.try_divide(long, long + short), F.lit(0.5)).alias("sign_ratio"))
    return sample.join(ci, keys).join(ratio, keys)


@query("J29_cell_verdict", sql(SLOTS, _TL, _SGN, _LONGP, _SPEAR, _POOLED, pool_sql("poisson", REPS, 31, "pooled", "vid"),
 f"ne AS (SELECT event, {_CELL} AS pool_cell, min(greatest((1 - rho_bar) * n / 1.5, 0)) AS n_eff FROM rb GROUP BY ALL)",
 "mr AS (SELECT cell_id, rep, sum(w * x) / sum(w) AS mean FROM dr GROUP BY ALL)",
 f"ci AS (SELECT split_part(cell_id, '|', 1) AS event, split_part(cell_id, '|', 2) AS pool_cell, list_sort(list(mean))[{math.floor(0.025 * REPS) + 1}] AS lo, list_sort(list(mean))[{math.ceil(0.975 * REPS) + 1}] AS hi FROM mr GROUP BY cell_id)",
 f"sr AS (SELECT event, {_CELL} AS pool_cell, coalesce(count(*) FILTER (sign = 1) / nullif(count(*) FILTER (sign <> 0), 0)::DOUBLE, 0.5) AS sr FROM slots GROUP BY ALL)",
 body="""SELECT event, pool_cell, round(n_eff, 6) AS n_eff, round(lo, 6) + 0.0 AS ci_low, round(hi, 6) + 0.0 AS ci_high, round(sr, 6) AS sign_ratio, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict,
 CASE WHEN ok THEN NULL WHEN n_eff < 4 THEN 'sampling_noise' WHEN (lo <= 0 AND hi >= 0) OR sr <= 0 THEN 'structural' ELSE 'bug' END AS failure
 FROM (SELECT *, n_eff >= 4 AND lo > 0 AND sr > 0 AS ok FROM ne JOIN ci USING (event, pool_cell) JOIN sr USING (event, pool_cell))"""))
def _(spark, sf):
    c = pooled_cells(spark, sf)
    v, kind = verdicts.cell_verdict(F.col("n_eff"), F.col("ci_low"), F.col("ci_high"), F.col("sign_ratio"))
    return c.select("event", "pool_cell", "n_eff", "ci_low", "ci_high", "sign_ratio", v.alias("verdict"), kind.alias("failure"))


@query("J30_pair_gate_summary", sql(TRADES, _CP, body="""SELECT pair, bool_or(ok) AS any_pass, bool_and(ok) AS all_pass, CASE WHEN bool_or(ok) THEN 'ship' ELSE 'hold' END AS verdict, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM (
 SELECT substr(cell_id, 1, 1) AS pair, pf >= 1.05 AND max_dd >= -0.6 AS ok, CASE WHEN pf < 1.05 THEN 'pf_below_limit' WHEN max_dd < -0.6 THEN 'drawdown_limit' END AS reason FROM cp) GROUP BY 1"""))
def _(spark, sf):
    ok = (F.col("pf") >= 1.05) & (F.col("max_dd") >= -0.6)
    reason = F.when(F.col("pf") < 1.05, "pf_below_limit").when(F.col("max_dd") < -0.6, "drawdown_limit")
    g = cell_performance(spark, sf).groupBy(F.substring("cell_id", 1, 1).alias("pair")).agg(
        F.bool_or(ok).alias("any_pass"), F.bool_and(ok).alias("all_pass"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons")
    )
    return g.withColumn("verdict", F.when(F.col("any_pass"), "ship").otherwise("hold"))


@query("J31_regime_matrix", sql(SLOTS, _TL, _SGN, """fl AS (SELECT event, CASE WHEN pair IN ('P0', 'P1') THEN 'major' WHEN pair = 'P2' THEN 'cross' ELSE 'carry' END AS flow, long, short FROM tl)""", """cr AS (SELECT event, CASE WHEN stddev_pop(p0) > 0 AND stddev_pop(p1) > 0 THEN abs(corr(p0, p1)) ELSE 0 END AS c FROM sgw WHERE p0 + p1 + p2 + p3 IS NOT NULL GROUP BY 1)""", body="SELECT flow, event, round(sum(long) / sum(long + short)::DOUBLE, 6) AS agreement, any_value(CASE WHEN flow = 'major' THEN c > 0.7 ELSE false END) AS independence_broken FROM fl JOIN cr USING (event) GROUP BY ALL"))
def _(spark, sf):
    flow = F.when(F.col("pair").isin("P0", "P1"), "major").when(F.col("pair") == "P2", "cross").otherwise("carry")
    t = tally(T.slot_reports(spark, sf)).withColumn("flow", flow)
    cell = t.groupBy("flow", "event").agg((F.sum("long") / F.sum(F.col("long") + F.col("short"))).alias("agreement"))
    # Only the first row joins several pairs, so only it can lose independence.
    tie = sign_wide(spark, sf).groupBy("event").agg(F.coalesce(F.abs(st.correlation("p0", "p1")), F.lit(0.0)).alias("c"))
    broken = F.when(F.col("flow") == "major", F.col("c") > 0.7).otherwise(False)
    return cell.join(tie, "event").select("flow", "event", "agreement", broken.alias("independence_broken"))


@query("J32_label_scores", """WITH p AS (SELECT quality AS t, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)), l AS (SELECT unnest([0, 1]) AS label),
 s AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn FROM p, l GROUP BY 1) SELECT label, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((SELECT avg(2 * tp / (2 * tp + fp + fn)::DOUBLE) FROM s), 6) AS macro_f1 FROM s""")
def _(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("predicted"))
    j = T.table(spark, sf, "labels").select("doc_id", "quality").join(d, "doc_id")
    return verdicts.label_scores(j, "quality", "predicted")


@query("J33_edge_validation", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size % 9 = 8 THEN 'direction' WHEN p_size % 11 < 1 OR p_size % 11 > 9 THEN 'hold_index' WHEN p_size * 31 > 1439 THEN 'entry_minute' ELSE 'ok' END AS reason FROM part) GROUP BY 1""")
def _(spark, sf):
    e = T.table(spark, sf, "part").select(
        F.when(F.col("p_size") % 9 == 8, "sideways").when(F.col("p_size") % 2 == 0, "long").otherwise("short").alias("direction"),
        (F.col("p_size") % 11).alias("hold_h"), (F.col("p_size") * 31).alias("entry_minute"),
    )
    reason = F.when(~F.col("direction").isin("long", "short"), "direction").when(~F.col("hold_h").between(1, 9), "hold_index").when(~F.col("entry_minute").between(0, 1439), "entry_minute").otherwise("ok")
    return e.groupBy(reason.alias("reason")).agg(rows_as("n"))


@query("I26_kelly_inputs")
def _(spark, sf):
    from barline.operators.kelly import kelly_lower_bounds

    return kelly_lower_bounds(T.trades(spark, sf), ["cell_id", "fold"], F.expr(ROW), SHUFFLES, 42)


@query("flagship_tick_study", sql(FAST, _SLOT30, STUDY_SCORES, STUDY_PRICED, STUDY_CELLS, _GRID216, "fam AS (SELECT g.*, coalesce(num_trades, 0) AS num_trades, profit_factor, coalesce(p_raw, 1)::DOUBLE AS p_raw, coalesce(num_trades >= min_trades, false) AS dense FROM famgrid g LEFT JOIN cellp USING (symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds))",
 body="SELECT symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds, num_trades, round(profit_factor, 5) AS profit_factor, round(p_raw, 5) AS p_raw, round(p_adj, 5) AS p_adj, p_adj < 0.05 AND dense AS pass_fwer FROM " + holm_sql("fam", "symbol", "108", "score_family, lookback_seconds, threshold, direction, horizon_seconds")))
def _(spark, sf):
    cells = imbalance.cell_summary(study_priced(spark, sf))
    fam = mt.padded_family(family_grid(spark, sf), cells, imbalance.KEY, "p_raw")
    adj = mt.holm(fam, ["symbol"], "p_raw", imbalance.KEY[1:], 108)
    ok = (F.col("p_adj") < 0.05) & ~F.coalesce("sparse", F.lit(True))
    return adj.select(*imbalance.KEY, F.coalesce("num_trades", F.lit(0)).alias("num_trades"), *[F.round(c, 5).alias(c) for c in ("profit_factor", "p_raw", "p_adj")], ok.alias("pass_fwer"))


# ---- L, C27, F08: policies, drift ------------------------------------------------

RULES = [
    PolicyRule("r0", "c_acctbal", "lte", "block", 0.0),
    PolicyRule("r1", "c_mktsegment", "eq", "cap", "BUILDING", 1500.0),
    PolicyRule("r2", "c_acctbal", "gte", "size", 2000.0),
    PolicyRule("r3", "c_missing", "exists", "block"),
    PolicyRule("r4", "c_nationkey", "lte", "rest", 3),
    PolicyRule("r5", "c_acctbal", "gte", "cap", 8000.0, 5000.0),
]
_RC = """rc AS (SELECT c.*, r.id, r.prec, r.idx, r.decision, r.cap FROM customer c LEFT JOIN (VALUES ('r0', 0, 0, 'block', NULL::DOUBLE), ('r1', 2, 1, 'cap', 1500), ('r2', 3, 2, 'size', NULL), ('r4', 1, 4, 'rest', NULL), ('r5', 2, 5, 'cap', 5000)) r(id, prec, idx, decision, cap)
 ON (r.id = 'r0' AND c_acctbal <= 0) OR (r.id = 'r1' AND c_mktsegment = 'BUILDING') OR (r.id = 'r2' AND c_acctbal >= 2000) OR (r.id = 'r4' AND c_nationkey <= 3) OR (r.id = 'r5' AND c_acctbal >= 8000)),
dc AS (SELECT c_custkey, any_value(c_acctbal) AS bal, arg_min(id, prec * 10 + idx) AS id, arg_min(decision, prec * 10 + idx) AS decision, first(cap ORDER BY prec, idx) AS cap, coalesce(string_agg(id, ',' ORDER BY prec, idx), '') AS sup FROM rc GROUP BY 1)"""


def decided(spark, sf):
    c = T.table(spark, sf, "customer").withColumn("requested", F.round(F.col("c_acctbal") + 500))
    return policies.evaluate(c, RULES, "requested")


@query("L05_policy_evaluation", sql(_RC, body="""SELECT c_custkey, CASE WHEN round(bal + 500) <= 0 THEN 'block' ELSE coalesce(decision, 'block') END AS decision_class, CASE WHEN round(bal + 500) <= 0 THEN 'invalid.requested_size' ELSE coalesce(id, 'malformed_policy.no_match') END AS binding_rule, CASE WHEN round(bal + 500) <= 0 THEN '' ELSE sup END AS supporting_rules,
 (CASE WHEN round(bal + 500) <= 0 THEN 0 WHEN decision = 'size' THEN round(bal + 500) WHEN decision = 'cap' THEN least(round(bal + 500), cap) ELSE 0 END)::DOUBLE AS allowed_size FROM dc"""))
def _(spark, sf):
    return decided(spark, sf).select("c_custkey", "decision_class", "binding_rule", "supporting_rules", "allowed_size")


@query("C27_rules_by_candidate", sql(_RC, body="SELECT id AS rule, count(*) AS matches FROM rc WHERE id IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    c = T.table(spark, sf, "customer")
    hits = F.array(*[F.when(policies.condition(r, c.columns), F.lit(r.id)) for r in RULES])
    return c.select(F.explode(hits).alias("rule")).filter("rule IS NOT NULL").groupBy("rule").agg(rows_as("matches"))


@query("F08_first_matching_rule", sql(_RC, body="SELECT coalesce(id, 'malformed_policy.no_match') AS winner, sup AS supporting, count(*) AS n FROM dc WHERE round(bal + 500) > 0 GROUP BY ALL"))
def _(spark, sf):
    d = decided(spark, sf).filter("requested > 0")
    return d.groupBy(F.col("binding_rule").alias("winner"), F.col("supporting_rules").alias("supporting")).agg(rows_as("n"))


_DOC = """dj AS (SELECT o_orderkey, o_orderkey % 7 AS k, CASE o_orderkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'size' WHEN 2 THEN 'cap' WHEN 3 THEN 'rest' ELSE 'maybe' END AS cls, CASE o_orderkey % 4 WHEN 3 THEN 'desk' ELSE 'paper' END AS surface FROM orders)"""


@query("L06_contract_check", sql(_DOC, body="""SELECT fault, count(*) AS n FROM (SELECT CASE WHEN k = 0 THEN 'required_fields:decision' WHEN k = 1 THEN 'required_fields:trace.class' WHEN surface = 'desk' THEN 'surface_scope:surface' WHEN cls = 'maybe' THEN 'decision_enum:decision.class' WHEN k = 2 THEN 'reason_enum:decision.fail_close_reason' WHEN k = 3 AND cls <> 'size' THEN 'class_mismatch:trace.class' END AS fault FROM dj) GROUP BY 1"""))
def _(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey") % 7
    cls = F.element_at(F.array(*[F.lit(x) for x in ("block", "size", "cap", "rest", "maybe")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    decision = F.struct(cls.alias("class"), F.when(k == 2, "other").otherwise("none").alias("fail_close_reason"))
    doc = F.to_json(F.struct(
        F.when(F.col("o_orderkey") % 4 == 3, "desk").otherwise("paper").alias("surface"),
        F.when(k != 0, decision).alias("decision"),
        F.struct(F.when(k == 1, None).when(k == 3, "size").otherwise(cls).alias("class")).alias("trace"),
    ))
    return policies.contract_faults(o.withColumn("doc", doc), "doc").groupBy("fault").agg(rows_as("n"))


@query("L07_cap_sizing", "SELECT p_brand, count(*) FILTER (p_retailprice > 950) AS bound, round(sum(least(p_retailprice, 950)), 2) AS total FROM part GROUP BY 1")
def _(spark, sf):
    p = T.table(spark, sf, "part")
    return p.groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") > 950).alias("bound"), F.round(F.sum(F.least(F.col("p_retailprice"), F.lit(950.0))), 2).alias("total"))


@query("L08_family_precheck", sql(TRADES, _PF2, "ix AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cell_id) - 1 - (CASE WHEN fold = 1 THEN 1 ELSE 0 END) * (CASE WHEN cell_id > 'N' THEN 1 ELSE 0 END) AS i FROM pf2)", body="SELECT fold, count(*) AS n, CASE WHEN count(*) <> 42 THEN 'count_mismatch' WHEN count(DISTINCT i) <> count(*) THEN 'duplicate_index' WHEN count(*) FILTER (p_raw IS NULL OR p_raw < 0 OR p_raw > 1) > 0 THEN 'p_out_of_range' WHEN min(i) <> 0 OR max(i) <> count(*) - 1 THEN 'index_not_contiguous' ELSE 'ok' END AS reason FROM ix GROUP BY 1"))
def _(spark, sf):
    w = Window.partitionBy("fold").orderBy("cell_id")
    slip = F.when((F.col("fold") == 1) & (F.col("cell_id") > "N"), 1).otherwise(0)
    t = tested_folds(spark, sf).withColumn("i", F.row_number().over(w) - 1 - slip)
    return mt.precheck(t, ["fold"], "p_raw", "i", 42)


_HS = """hs AS (SELECT event, pair, CASE WHEN wo < 8 THEN 'early' ELSE 'late' END AS epoch, sha256(string_agg(DISTINCT (hb || '/' || et), '|' ORDER BY (hb || '/' || et)) || '|' || max(CASE WHEN trades > 38 THEN 1 ELSE 0 END)) AS digest FROM slots WHERE fee = 0 GROUP BY ALL)"""


def epoch_hashes(spark, sf):
    """Fingerprint of the slot set of each (event, pair, epoch)."""
    s = T.slot_reports(spark, sf).filter("fee = 0").withColumn("epoch", F.when(F.col("wo") < 8, "early").otherwise("late"))
    key = F.concat_ws("/", F.col("hb").cast("string"), "et")
    g = s.groupBy("event", "pair", "epoch").agg(
        F.array_join(F.array_sort(F.collect_set(key)), "|").alias("slots"), F.max(F.when(F.col("trades") > 38, 1).otherwise(0)).alias("busy")
    )
    return g.select("event", "pair", "epoch", fingerprint([F.col("slots"), F.col("busy")]).alias("digest"))


@query("L01_group_drift", sql(SLOTS, _HS, body="SELECT event, epoch, count(DISTINCT digest) AS variants, string_agg(DISTINCT pair, ',' ORDER BY pair) AS members FROM hs GROUP BY ALL HAVING count(DISTINCT digest) > 1"))
def _(spark, sf):
    return policies.group_drift(epoch_hashes(spark, sf), ["event", "epoch"], "digest", "pair")


@query("L02_structural_drift", sql(SLOTS, _HS, body="SELECT event, epoch, CASE WHEN event IN ('BOJ', 'NFP') THEN 'expected_asymmetry' ELSE 'genuine' END AS kind FROM hs GROUP BY event, epoch HAVING count(DISTINCT digest) > 1"))
def _(spark, sf):
    d = policies.group_drift(epoch_hashes(spark, sf), ["event", "epoch"], "digest", "pair")
    expected = fan_out(spark.range(1), "event", ("BOJ", "NFP")).select("event", F.lit(True).alias("_e"))
    kind = F.when(F.col("_e"), "expected_asymmetry").otherwise("genuine")
    return d.join(expected, "event", "left").select("event", "epoch", kind.alias("kind"))


@query("L03_dimension_sets", sql(SLOTS, body="SELECT event, pair, string_agg(DISTINCT hb::VARCHAR, ',' ORDER BY hb::VARCHAR) AS holds, string_agg(DISTINCT et, ',' ORDER BY et) AS exits, count(DISTINCT wo) AS offsets FROM slots WHERE passed GROUP BY ALL"))
def _(spark, sf):
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return T.slot_reports(spark, sf).filter("passed").groupBy("event", "pair").agg(
        listed(F.col("hb").cast("string")).alias("holds"), listed("et").alias("exits"), F.countDistinct("wo").alias("offsets")
    )


@query("L04_regression_compare", sql(SLOTS, "a AS (SELECT event, wo, hb, et, fee, trades || '|' || printf('%.6f', gp) AS h FROM slots WHERE pair = 'P0')", "b AS (SELECT event, wo, hb, et, fee, trades || '|' || printf('%.6f', gp) AS h FROM slots WHERE pair = 'P1')", body="SELECT event, CASE WHEN b.h IS NULL THEN 'only_left' WHEN a.h IS NULL THEN 'only_right' WHEN a.h = b.h THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM a FULL JOIN b USING (event, wo, hb, et, fee) GROUP BY ALL"))
def _(spark, sf):
    key = ["event", "wo", "hb", "et", "fee"]
    s = T.slot_reports(spark, sf).select("pair", *key, fingerprint([F.col("trades"), fixed6(F.col("gp"))]).alias("digest"))
    c = policies.compare_tables(s.filter("pair = 'P0'"), s.filter("pair = 'P1'"), key, "digest")
    return c.groupBy("event", "status").agg(rows_as("n"))

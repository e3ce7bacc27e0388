"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import calendar as cal
from barline.operators import audits, folds, imbalance, quality
from barline.operators.bars import coarsen_bars, floor_micros
from barline.operators.quantiles import exact_percentiles
from barline.operators.series import fan_out
from barline.plans.checks import BARS, BARS4, FAST, QUOTES, SLOTS, SLOT_TRADES, TRADES, sql
from barline.plans.joins import _WIDE
from barline.plans.registry import query
from barline.plans.rows import _CELLS, _VOL, cells, vol_labels
from barline.plans.shapes import hourly, rows_as
from barline.session import settle
from barline.sources import tables as T

_ROUND_BARS = "SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM "


@query("D01_tick_to_bars", sql(QUOTES, BARS, body=_ROUND_BARS + "bars"))
def _(spark, sf):
    return hourly(spark, sf)


@query("D02_bars_to_coarser", sql(QUOTES, BARS4, body=_ROUND_BARS + "bars4"))
def _(spark, sf):
    return coarsen_bars(hourly(spark, sf), "4h")


_SLOT30 = """prev AS (SELECT *, (bid + ask) / 2 AS mid, lag((bid + ask) / 2) OVER (PARTITION BY symbol, us // 30000000 ORDER BY us, event_id) AS pm, us // 30000000 * 30000000 AS slot_us FROM fast),
tot AS (SELECT symbol, slot_us, slot_us + 30000000 AS entry_us, sum(bid_vol) AS bid_vol, sum(ask_vol) AS ask_vol, count(*) FILTER (mid > pm) AS ups, count(*) FILTER (mid < pm) AS downs, count(*) AS ticks FROM prev GROUP BY ALL)"""


@query("D03_bucket_totals", sql(FAST, _SLOT30, body="SELECT * FROM tot"))
def _(spark, sf):
    return imbalance.bucket_totals(T.fast_quotes(spark, sf))


@query("D04_conditional_counts", sql(QUOTES, body="""SELECT symbol, count(*) FILTER (bid IS NULL) AS nulls, count(*) FILTER (bid_vol = 0) AS zeros, count(*) FILTER (ask - bid < 0) AS negatives FROM quotes GROUP BY 1"""))
def _(spark, sf):
    return T.quotes(spark, sf).groupBy("symbol").agg(
        F.count_if(F.col("bid").isNull()).alias("nulls"), F.count_if(F.col("bid_vol") == 0).alias("zeros"), F.count_if(F.col("ask") < F.col("bid")).alias("negatives")
    )


@query("D05_source_audit", sql(QUOTES, body="""SELECT symbol, count(*) AS row_count, min(ts) AS min_ts, max(ts) AS max_ts, count(*) FILTER (ts IS NULL) AS null_ts, count(*) FILTER (bid IS NULL) AS null_bid,
 count(*) FILTER (ask IS NULL) AS null_ask, count(*) FILTER (bid_vol IS NULL) AS null_bid_vol, count(*) FILTER (ask_vol IS NULL) AS null_ask_vol, count(*) FILTER (bid_vol = 0) AS zero_bid_vol,
 count(*) FILTER (ask_vol = 0) AS zero_ask_vol, count(*) FILTER (ask < bid) AS negative_spread, min(round(ask - bid, 6)) AS min_spread, median(round(ask - bid, 6)) AS median_spread, max(round(ask - bid, 6)) AS max_spread FROM quotes GROUP BY 1"""))
def _(spark, sf):
    return audits.source_audit(T.quotes(spark, sf))


@query("D06_monthly_rollup", """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS row_count, min(l_shipdate) AS min_ts, max(l_shipdate) AS max_ts FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        rows_as("row_count"), F.min("l_shipdate").alias("min_ts"), F.max("l_shipdate").alias("max_ts")
    )


_JAN, _FEB = 1_704_067_200_000_000, 1_706_745_600_000_000


@query("D07_bucket_completeness", sql(QUOTES, f"""b AS (SELECT symbol, us // 900000000 AS b, count(*) AS ticks FROM quotes WHERE us >= {_JAN} AND us < {_FEB} GROUP BY ALL)""",
 body="""SELECT symbol, 900 AS bucket_seconds, count(*) AS observed, 2976 AS expected, 2976 - count(*) AS missing, min(ticks) AS min_ticks, median(ticks)::DOUBLE AS median_ticks, max(ticks) AS max_ticks FROM b GROUP BY 1"""))
def _(spark, sf):
    return audits.bucket_completeness(T.quotes(spark, sf), 900, _JAN, _FEB)


_STUDY_END = _JAN + 8 * 3_600_000_000
STUDY_SCORES = """feat AS (
 SELECT symbol, entry_us, 'volume_ratio_imbalance' AS score_family, 30 AS lookback_seconds, (bid_vol - ask_vol) / nullif(bid_vol + ask_vol, 0) AS imbalance_score FROM tot
 UNION ALL SELECT symbol, entry_us, 'volume_ratio_imbalance', 60, (sum(bid_vol) OVER w1 - sum(ask_vol) OVER w1) / nullif(sum(bid_vol) OVER w1 + sum(ask_vol) OVER w1, 0) FROM tot WINDOW w1 AS (PARTITION BY symbol ORDER BY entry_us ROWS 1 PRECEDING)
 UNION ALL SELECT symbol, entry_us, 'volume_ratio_imbalance', 300, (sum(bid_vol) OVER w9 - sum(ask_vol) OVER w9) / nullif(sum(bid_vol) OVER w9 + sum(ask_vol) OVER w9, 0) FROM tot WINDOW w9 AS (PARTITION BY symbol ORDER BY entry_us ROWS 9 PRECEDING)
 UNION ALL SELECT symbol, entry_us, 'mid_price_tick_direction_imbalance', 30, (ups - downs)::DOUBLE / nullif(ups + downs, 0) FROM tot
 UNION ALL SELECT symbol, entry_us, 'mid_price_tick_direction_imbalance', 60, (sum(ups) OVER w1 - sum(downs) OVER w1)::DOUBLE / nullif(sum(ups) OVER w1 + sum(downs) OVER w1, 0) FROM tot WINDOW w1 AS (PARTITION BY symbol ORDER BY entry_us ROWS 1 PRECEDING)
 UNION ALL SELECT symbol, entry_us, 'mid_price_tick_direction_imbalance', 300, (sum(ups) OVER w9 - sum(downs) OVER w9)::DOUBLE / nullif(sum(ups) OVER w9 + sum(downs) OVER w9, 0) FROM tot WINDOW w9 AS (PARTITION BY symbol ORDER BY entry_us ROWS 9 PRECEDING)),
"""
STUDY_SCORES += f"""lim AS (
 SELECT symbol, score_family, lookback_seconds, 'p80' AS threshold, quantile_cont(abs(imbalance_score), 0.8) AS threshold_value FROM feat WHERE imbalance_score IS NOT NULL AND entry_us < {_STUDY_END} GROUP BY ALL
 UNION ALL SELECT symbol, score_family, lookback_seconds, 'p90', quantile_cont(abs(imbalance_score), 0.9) FROM feat WHERE imbalance_score IS NOT NULL AND entry_us < {_STUDY_END} GROUP BY ALL
 UNION ALL SELECT symbol, score_family, lookback_seconds, 'p95', quantile_cont(abs(imbalance_score), 0.95) FROM feat WHERE imbalance_score IS NOT NULL AND entry_us < {_STUDY_END} GROUP BY ALL),
ev AS (SELECT f.*, threshold, threshold_value, direction, horizon_seconds, CASE WHEN imbalance_score >= threshold_value THEN 'positive_extreme' ELSE 'negative_extreme' END AS signal_side,
  entry_us + horizon_seconds * 1000000 AS exit_us,
  (CASE WHEN imbalance_score >= threshold_value THEN 1 ELSE -1 END) * (CASE WHEN direction = 'momentum' THEN 1 ELSE -1 END) AS stance
 FROM feat f JOIN lim USING (symbol, score_family, lookback_seconds), (SELECT unnest(['mean_reversion', 'momentum']) AS direction), (SELECT unnest([60, 180, 300]) AS horizon_seconds)
 WHERE abs(imbalance_score) >= threshold_value)"""
STUDY_PRICED = """anch AS (SELECT DISTINCT symbol, entry_us AS a FROM ev UNION SELECT DISTINCT symbol, exit_us FROM ev),
qa AS (SELECT symbol, a, arg_min(bid, (us, bid, ask)) AS bid, arg_min(ask, (us, bid, ask)) AS ask FROM (
  SELECT anch.symbol, anch.a, q.us, q.bid, q.ask FROM anch JOIN (SELECT *, us // 30000000 * 30000000 AS g FROM fast) q ON q.symbol = anch.symbol AND (q.g = anch.a OR q.g = anch.a + 30000000)) GROUP BY ALL),
priced AS (SELECT ev.*, e.bid AS entry_bid, x.bid AS exit_bid,
  stance * ((CASE WHEN stance = 1 THEN x.bid ELSE x.ask END) - (CASE WHEN stance = 1 THEN e.ask ELSE e.bid END)) / (CASE WHEN stance = 1 THEN e.ask ELSE e.bid END) * 10000 - 42 AS pnl_net
 FROM ev LEFT JOIN qa e ON e.symbol = ev.symbol AND e.a = entry_us LEFT JOIN qa x ON x.symbol = ev.symbol AND x.a = exit_us)"""
STUDY_CELLS = """cellsum AS (SELECT symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds, count(*) AS event_count, count(*) FILTER (entry_bid IS NULL) AS missing_entry,
  count(*) FILTER (exit_bid IS NULL) AS missing_exit, count(pnl_net) AS num_trades, sum(greatest(coalesce(pnl_net, 0), 0)) AS gross_profit, abs(sum(least(coalesce(pnl_net, 0), 0))) AS gross_loss,
  avg(pnl_net) AS mean_net, stddev_samp(pnl_net) AS std_net FROM priced GROUP BY ALL),
cellp AS (SELECT *, gross_profit / nullif(gross_loss, 0) AS profit_factor, gross_loss <= 0 AND gross_profit > 0 AS pf_infinite,
  CASE WHEN num_trades < 4 OR std_net IS NULL OR std_net <= 0 THEN 1.0 ELSE least(1.0, exp(-0.5 * pow(abs(mean_net / (std_net / sqrt(num_trades))), 2))) END AS p_raw,
  greatest(30, 10 * (horizon_seconds // 60)) AS min_trades FROM cellsum)"""


def study_scores(spark, sf):
    # The bucket table is read by the thresholds and by the events.
    return imbalance.features(settle(imbalance.bucket_totals(T.fast_quotes(spark, sf)), "buckets"))


def study_events(spark, sf):
    scores = study_scores(spark, sf)
    return imbalance.events(scores, imbalance.thresholds(scores, _STUDY_END, exact=True))


def study_priced(spark, sf):
    """Priced events: quotes join at bucket size, before the family unfolds."""
    q = T.fast_quotes(spark, sf)
    buckets = settle(imbalance.with_quote_paths(imbalance.bucket_totals(q), q), "buckets")
    paths = ["entry", *[f"exit_{h}" for h in imbalance.HORIZON_SECONDS]]
    scores = imbalance.features(buckets, carry=paths)
    limits = imbalance.thresholds(scores, _STUDY_END, exact=True)
    return imbalance.priced(imbalance.events(scores, limits))


@query("D08_event_counts", sql(FAST, _SLOT30, STUDY_SCORES, body="SELECT symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds, count(*) AS n FROM ev GROUP BY ALL"))
def _(spark, sf):
    return study_events(spark, sf).groupBy(*imbalance.KEY).agg(rows_as("n"))


_GRID216 = """famgrid AS (SELECT symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds FROM (SELECT DISTINCT event_type AS symbol FROM events), (SELECT unnest(['volume_ratio_imbalance', 'mid_price_tick_direction_imbalance']) AS score_family),
 (SELECT unnest([30, 60, 300]) AS lookback_seconds), (SELECT unnest(['p80', 'p90', 'p95']) AS threshold), (SELECT unnest(['mean_reversion', 'momentum']) AS direction), (SELECT unnest([60, 180, 300]) AS horizon_seconds))"""


def family_grid(spark, sf):
    """Symbols x 108 family members."""
    out = T.table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct()
    for name, values in (
        ("score_family", imbalance.FAMILIES), ("lookback_seconds", imbalance.LOOKBACK_SECONDS), ("threshold", tuple(imbalance.THRESHOLDS)),
        ("direction", imbalance.DIRECTIONS), ("horizon_seconds", imbalance.HORIZON_SECONDS),
    ):
        out = fan_out(out, name, values)
    return out


@query("D09_dense_family_counts", sql(FAST, _SLOT30, STUDY_SCORES, _GRID216, body="""SELECT g.*, coalesce(n, 0) AS n FROM famgrid g LEFT JOIN (SELECT symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds, count(*) AS n FROM ev GROUP BY ALL) c
 USING (symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds)"""))
def _(spark, sf):
    counts = study_events(spark, sf).groupBy(*imbalance.KEY).agg(rows_as("n"))
    return family_grid(spark, sf).join(counts, imbalance.KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("D10_missing_value_audit", sql(FAST, _SLOT30, STUDY_SCORES, body="""SELECT symbol, count(*) AS n, count(*) FILTER (imbalance_score IS NULL) AS null_score, count(*) FILTER (entry_us IS NULL) AS null_entry,
 count(*) FILTER (imbalance_score IS NULL AND score_family = 'volume_ratio_imbalance') AS no_volume, count(*) FILTER (imbalance_score IS NULL AND score_family <> 'volume_ratio_imbalance') AS no_moves FROM feat GROUP BY 1"""))
def _(spark, sf):
    return study_scores(spark, sf).groupBy("symbol").agg(
        rows_as("n"), F.count_if(F.col("imbalance_score").isNull()).alias("null_score"), F.count_if(F.col("entry_us").isNull()).alias("null_entry"),
        F.count_if(F.col("missing_reason") == "zero_volume_denominator").alias("no_volume"), F.count_if(F.col("missing_reason") == "zero_mid_tick_denominator").alias("no_moves"),
    )


@query("D11_cell_pnl_summary", sql(FAST, _SLOT30, STUDY_SCORES, STUDY_PRICED, STUDY_CELLS, body="""SELECT symbol, score_family, lookback_seconds, threshold, direction, horizon_seconds, event_count, missing_entry, missing_exit, num_trades, round(gross_profit, 4) AS gross_profit,
 round(gross_loss, 4) AS gross_loss, round(mean_net, 5) AS mean_net, round(std_net, 5) AS std_net, round(profit_factor, 5) AS profit_factor, pf_infinite, round(p_raw, 5) AS p_raw, min_trades, num_trades < min_trades AS sparse FROM cellp"""))
def _(spark, sf):
    out = imbalance.cell_summary(study_priced(spark, sf))
    places = {"gross_profit": 4, "gross_loss": 4, "mean_net": 5, "std_net": 5, "profit_factor": 5, "p_raw": 5}
    return out.withColumns({c: F.round(c, d) for c, d in places.items()})


_PF = """round(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 6)"""


@query("D12_profit_factor", sql(TRADES, body=f"""SELECT cell_id, fold, sum(greatest(pnl, 0)) AS gross_profit, sum(greatest(-pnl, 0)) AS gross_loss,
 CASE WHEN sum(greatest(-pnl, 0)) > 0 THEN {_PF} WHEN sum(greatest(pnl, 0)) > 0 THEN NULL ELSE 0 END AS pf, sum(greatest(-pnl, 0)) <= 1e-12 AND sum(greatest(pnl, 0)) > 0 AS pf_infinite FROM trades GROUP BY ALL"""))
def _(spark, sf):
    return folds.profit_factor(T.trades(spark, sf), ["cell_id", "fold"], F.col("pnl"))


@query("D13_sparse_gate", sql(FAST, _SLOT30, STUDY_SCORES, STUDY_PRICED, STUDY_CELLS, body="""SELECT symbol, horizon_seconds, count(*) FILTER (num_trades < min_trades) AS sparse_cells, count(*) FILTER (num_trades >= min_trades) AS dense_cells, max(min_trades) AS min_trades FROM cellp GROUP BY ALL"""))
def _(spark, sf):
    c = imbalance.cell_summary(study_priced(spark, sf))
    return c.groupBy("symbol", "horizon_seconds").agg(F.count_if("sparse").alias("sparse_cells"), F.count_if(~F.col("sparse")).alias("dense_cells"), F.max("min_trades").alias("min_trades"))


@query("D14_distinct_anchors", sql(FAST, _SLOT30, STUDY_SCORES, body="""SELECT symbol, count(*) AS anchors, count(*) FILTER (a % 30000000 <> 0) AS off_grid FROM (SELECT symbol, entry_us AS a FROM ev UNION SELECT symbol, exit_us FROM ev) GROUP BY 1"""))
def _(spark, sf):
    a = imbalance.anchors(study_events(spark, sf))
    return a.groupBy("symbol").agg(rows_as("anchors"), F.count_if(F.pmod("anchor_us", F.lit(30_000_000)) != 0).alias("off_grid"))


@query("D15_duplicate_keys", """SELECT count(*) AS duplicate_groups, coalesce(sum(n), 0)::BIGINT AS duplicate_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)""")
def _(spark, sf):
    dup = T.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(rows_as("n")).filter("n > 1")
    return dup.agg(rows_as("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


@query("D16_exact_thresholds", sql(FAST, _SLOT30, STUDY_SCORES, body="SELECT symbol, score_family, lookback_seconds, threshold, round(threshold_value, 6) AS threshold_value FROM lim"))
def _(spark, sf):
    return imbalance.thresholds(study_scores(spark, sf), _STUDY_END, exact=True)


@query("D16_approx_thresholds")
def _(spark, sf):
    return imbalance.thresholds(study_scores(spark, sf), _STUDY_END)


@query("D17_first_row_struct", sql(QUOTES, body="""SELECT symbol, us // 86400000000 AS day_no, min(us) AS us, round(arg_min(bid, (us, event_id)), 6) AS bid, round(arg_min(ask, (us, event_id)), 6) AS ask FROM quotes GROUP BY ALL"""))
def _(spark, sf):
    q = T.quotes(spark, sf)
    first = F.min_by(F.struct("us", "bid", "ask"), F.struct("us", "event_id"))
    return q.groupBy("symbol", F.floor(F.col("us") / 86_400_000_000).alias("day_no")).agg(first.alias("q")).select("symbol", "day_no", "q.*")


@query("D18_any_value", """SELECT n_regionkey, any_value(r_name) AS region, count(*) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def _(spark, sf):
    n = T.table(spark, sf, "nation").join(F.broadcast(T.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("n_regionkey").agg(F.any_value("r_name").alias("region"), rows_as("nations"))


@query("D19_tick_density", sql(QUOTES, body="""SELECT symbol, count(*) AS hours, sum(n)::BIGINT AS ticks, median(n)::DOUBLE AS p50, round(quantile_cont(n, 0.05), 6) AS p5, round(quantile_cont(n, 0.95), 6) AS p95 FROM (
 SELECT symbol, us // 3600000000 AS h, count(*) AS n FROM quotes GROUP BY ALL) GROUP BY 1"""))
def _(spark, sf):
    # Hours per symbol are bounded by the time span.
    return audits.hourly_density(T.quotes(spark, sf)).groupBy("symbol").agg(
        rows_as("hours"), F.sum("ticks").alias("ticks"), *[F.percentile("ticks", F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p5", 0.05), ("p95", 0.95))]
    )


@query("D20_spread_distribution", sql(QUOTES, """sp AS (SELECT symbol, round((ask - bid) / ((bid + ask) / 2) * 10000, 6) AS s FROM quotes)""", body="""SELECT symbol, count(*) AS n, round(quantile_cont(s, 0.25), 5) AS p25, round(quantile_cont(s, 0.5), 5) AS p50, round(quantile_cont(s, 0.75), 5) AS p75,
 round(quantile_cont(s, 0.95), 5) AS p95, round(avg(s), 5) AS mean_bps, round(quantile_cont(s, 0.5) + 40, 5) AS p50_after_fee, round(avg(s) + 40, 5) AS mean_after_fee FROM sp GROUP BY 1"""))
def _(spark, sf):
    q = T.quotes(spark, sf).select("symbol", F.round(audits.spread_bps(), 6).alias("s"))
    pct = exact_percentiles(q, ["symbol"], F.col("s"), {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    both = pct.join(q.groupBy("symbol").agg(F.avg("s").alias("mean_bps")), "symbol")
    both = both.withColumn("p50_after_fee", F.col("p50") + 40).withColumn("mean_after_fee", F.col("mean_bps") + 40)
    return both.withColumns({c: F.round(c, 5) for c in ("p25", "p50", "p75", "p95", "mean_bps", "p50_after_fee", "mean_after_fee")})


@query("D21_missing_hours", sql(QUOTES, body="""SELECT symbol, observed, round(expected, 6) AS expected, round(greatest(0, expected - observed) / expected * 100, 6) AS missing_pct FROM (
 SELECT symbol, count(DISTINCT us // 3600000000) AS observed, (max(us) - min(us)) / 3.6e9::DOUBLE AS expected FROM quotes GROUP BY 1)"""))
def _(spark, sf):
    return audits.missing_hours(T.quotes(spark, sf))


@query("D22_spike_reversion", sql(QUOTES, """sp AS (SELECT symbol, us, event_id, round((ask - bid) / ((bid + ask) / 2) * 10000, 6) + (CASE WHEN event_id % 97 < 3 THEN 5 ELSE 0 END) AS s FROM quotes)""",
 """lim2 AS (SELECT symbol, median(round(s, 6)) AS m, stddev_samp(round(s, 6)) AS sd FROM sp GROUP BY 1)""", """lab AS (SELECT sp.symbol, us, event_id, CASE WHEN round(s, 6) > m + 2 * sd THEN 1 WHEN round(s, 6) < m + sd THEN 0 END AS label FROM sp JOIN lim2 USING (symbol))""",
 """st AS (SELECT *, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lab)""",
 """ed AS (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY us, event_id) AS spike_us FROM st WHERE (label = 1 AND before = 0) OR (label = 0 AND before = 1))""",
 body="""SELECT symbol, count(*) AS pairs, round(median((us - spike_us) / 1e6), 6) AS median_seconds FROM ed WHERE label = 0 AND us - spike_us < 7200000000 GROUP BY 1"""))
def _(spark, sf):
    # A wider quote every so often gives the synthetic ticks spikes to find.
    wide = (F.col("event_id") % 97 < 3).cast("int") * 5.0 / 10_000 * (F.col("bid") + F.col("ask")) / 2
    q = T.quotes(spark, sf).withColumn("bump", wide)
    spiky = q.withColumn("bid", F.col("bid") - F.col("bump") / 2).withColumn("ask", F.col("ask") + F.col("bump") / 2)
    runs = audits.spike_reversions(spiky)
    seconds = (F.col("revert_us") - F.col("spike_us")) / 1e6
    counted = exact_percentiles(runs, ["symbol"], seconds, {"median_seconds": 0.5})
    return counted.select("symbol", F.col("n").alias("pairs"), "median_seconds")


@query("D23_event_metrics", sql(SLOTS, body="""SELECT event, pair, count(*) FILTER (passed) AS pass_count, round(avg(pf), 6) AS mean_pf FROM slots WHERE fee = 2 GROUP BY ALL"""))
def _(spark, sf):
    return T.slot_reports(spark, sf).filter("fee = 2").groupBy("event", "pair").agg(F.count_if("passed").alias("pass_count"), F.avg("pf").alias("mean_pf"))


@query("D24_retro_pass_table", sql(SLOTS, body="""SELECT event, count(*) AS total_slots, count(*) FILTER (passed) AS pass_count, min(trades) AS trades_min, max(trades) AS trades_max,
 list_sort(list(trades))[count(*) // 2 + 1] AS trades_median, count(*) FILTER (trades = 0) AS zero_trades FROM slots WHERE fee = 3 GROUP BY 1"""))
def _(spark, sf):
    # At most 3,072 slots per event.
    s = T.slot_reports(spark, sf).filter("abs(fee - 3) < 0.01")
    upper = F.element_at(F.array_sort(F.collect_list("trades")), F.floor(F.count(F.lit(1)) / 2).cast("int") + 1)
    return s.groupBy("event").agg(
        rows_as("total_slots"), F.count_if("passed").alias("pass_count"), F.min("trades").alias("trades_min"), F.max("trades").alias("trades_max"),
        upper.alias("trades_median"), F.count_if(F.col("trades") == 0).alias("zero_trades"),
    )


_CLIFF = """cliff AS (SELECT event, pair, wo, hb, et, min(CASE WHEN coalesce(pf, 0) < 2 THEN fee END) AS alpha_cliff FROM slots GROUP BY ALL)"""


def alpha_cliffs(spark, sf, level=2.0):
    """Smallest fee at which a slot's profit factor is below the level; no trades count as 0."""
    s = T.slot_reports(spark, sf)
    return s.groupBy("event", "pair", "wo", "hb", "et").agg(F.min(F.when(F.coalesce("pf", F.lit(0.0)) < level, F.col("fee"))).alias("alpha_cliff"))


@query("D25_cliff_histogram", sql(SLOTS, _CLIFF, body="""SELECT label, count(alpha_cliff) AS slots FROM (VALUES ('1', 0.0, 1.0), ('2', 1.0, 2.0), ('3', 2.0, 3.0), ('5', 3.0, 5.0), ('>5', 5.0, 1e300)) b(label, lo, hi)
 LEFT JOIN cliff ON alpha_cliff >= lo AND alpha_cliff < hi GROUP BY 1"""))
def _(spark, sf):
    c = F.col("alpha_cliff")
    label = F.when(c < 1, "1").when(c < 2, "2").when(c < 3, "3").when(c < 5, "5").otherwise(">5")
    got = alpha_cliffs(spark, sf).filter("alpha_cliff >= 0").groupBy(label.alias("label")).agg(rows_as("slots"))
    bins = fan_out(spark.range(1), "label", ["1", "2", "3", "5", ">5"]).drop("id")
    return bins.join(got, "label", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))


_TALLY = """SELECT event, pair, wo, hb, et, count(*) FILTER (sign = 1) AS long, count(*) FILTER (sign = 0) AS neutral, count(*) FILTER (sign = -1) AS short FROM slots {where} GROUP BY ALL"""


def tally(s):
    """Long, neutral and short fee levels per slot."""
    return s.groupBy("event", "pair", "wo", "hb", "et").agg(
        F.count_if(F.col("sign") == 1).alias("long"), F.count_if(F.col("sign") == 0).alias("neutral"), F.count_if(F.col("sign") == -1).alias("short")
    )


@query("D26_sign_tally", sql(SLOTS, body=_TALLY.format(where="")))
def _(spark, sf):
    return tally(T.slot_reports(spark, sf))


@query("D27_pass_tally", sql(SLOTS, body=_TALLY.format(where="WHERE passed")))
def _(spark, sf):
    return tally(T.slot_reports(spark, sf).filter("passed"))


@query("D28_stratified_agreement", sql(SLOTS, body="""SELECT event, hb, fee, pair, count(*) FILTER (sign = 1) AS longs, round(count(*) FILTER (sign = 1) / nullif(count(*) FILTER (sign <> 0), 0)::DOUBLE, 6) AS agreement FROM slots GROUP BY ALL"""))
def _(spark, sf):
    longs = F.count_if(F.col("sign") == 1)
    return T.slot_reports(spark, sf).groupBy("event", "hb", "fee", "pair").agg(longs.alias("longs"), F.try_divide(longs, F.count_if(F.col("sign") != 0)).alias("agreement"))


@query("D29_pairwise_agreement", sql(SLOTS, """sg AS (SELECT * FROM slots WHERE fee = 2 AND sign <> 0)""", body="""SELECT a.pair AS left_pair, b.pair AS right_pair, count(*) AS common, round(count(*) FILTER (a.sign = b.sign) / count(*)::DOUBLE, 6) AS agreement
 FROM sg a JOIN sg b USING (event, wo, hb, et) GROUP BY ALL"""))
def _(spark, sf):
    wide = T.slot_reports(spark, sf).filter("fee = 2 AND sign <> 0").groupBy("event", "wo", "hb", "et").pivot("pair", list(T.SLOT_PAIRS)).agg(F.first("sign"))
    # Four pairs, so the matrix is sixteen aggregates over one wide row.
    combos = F.array(*[F.struct(F.lit(a).alias("left_pair"), F.lit(b).alias("right_pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a in T.SLOT_PAIRS for b in T.SLOT_PAIRS])
    long = wide.select(F.explode(combos).alias("c")).select("c.*").filter("x IS NOT NULL AND y IS NOT NULL")
    return long.groupBy("left_pair", "right_pair").agg(rows_as("common"), (F.count_if(F.col("x") == F.col("y")) / F.count(F.lit(1))).alias("agreement"))


@query("D30_pooled_sign_ratio", sql(SLOTS, body="""SELECT event, split_part(cell, '_x_', 1) AS pool_cell, round(coalesce(sum(l) / nullif(sum(l + s), 0)::DOUBLE, 0.5), 6) AS sign_ratio FROM (
 SELECT event, (CASE WHEN hb <= 3 THEN '0-60m' ELSE '60-120m' END) || '_x_' || et AS cell, (sign = 1)::INTEGER AS l, (sign = -1)::INTEGER AS s FROM slots) GROUP BY ALL"""))
def _(spark, sf):
    s = T.slot_reports(spark, sf).withColumn("cell", F.concat_ws("_x_", cal.duration_bucket(F.col("hb"), F.lit(20)), "et"))
    long, short = F.sum(F.when(F.col("sign") == 1, 1).otherwise(0)), F.sum(F.when(F.col("sign") == -1, 1).otherwise(0))
    return s.groupBy("event", F.split_part("cell", F.lit("_x_"), F.lit(1)).alias("pool_cell")).agg(F.coalesce(F.try_divide(long, long + short), F.lit(0.5)).alias("sign_ratio"))


@query("D31_cell_audit", sql(SLOT_TRADES, body="""SELECT g.pair, g.event, g.hb, g.et, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS empty, coalesce(n, 0) < 50 AS below_min, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.pair, g.event)::DOUBLE, 6) AS share FROM
 (SELECT * FROM (SELECT unnest(['P0', 'P1', 'P2', 'P3']) AS pair), (SELECT unnest(['BOJ', 'ECB', 'FOMC', 'NFP']) AS event), (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS hb), (SELECT unnest(['none', 'fixed_pct']) AS et)) g LEFT JOIN (SELECT pair, event, hb, et, count(*) AS n FROM slot_trades GROUP BY ALL) c USING (pair, event, hb, et)"""))
def _(spark, sf):
    grid = fan_out(fan_out(fan_out(spark.range(1), "event", T.SLOT_EVENTS), "hb", range(1, 8)), "et", ("none", "fixed_pct")).drop("id")
    grid = fan_out(grid, "pair", T.SLOT_PAIRS)
    counts = T.slot_trades(spark, sf).groupBy("pair", "event", "hb", "et").agg(rows_as("n"))
    full = grid.join(counts, ["pair", "event", "hb", "et"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("pair", "event"))
    return full.select("*", (F.col("n") == 0).alias("empty"), (F.col("n") < 50).alias("below_min"), share.alias("share"))


@query("D32_cells_and_marginals", sql(SLOT_TRADES, body="""SELECT pair, event, et, hb, grouping(pair, event, et, hb)::INTEGER AS level, count(*) AS n FROM slot_trades GROUP BY GROUPING SETS ((pair, event, et, hb), (pair), (event), (et), (hb))"""))
def _(spark, sf):
    dims = ["pair", "event", "et", "hb"]
    sets = [[F.col(d) for d in dims]] + [[F.col(d)] for d in dims]
    # Counts per full cell first (768 rows), then the marginals of those.
    cells_ = T.slot_trades(spark, sf).groupBy(*dims).agg(rows_as("c"))
    return cells_.groupingSets(sets, *dims).agg(F.grouping_id().cast("int").alias("level"), F.sum("c").alias("n"))


@query("D33_bucket_sizes", sql(TRADES, body="""SELECT fold, count(DISTINCT cell_id) AS n_min, count(*) AS n_eff FROM trades GROUP BY 1"""))
def _(spark, sf):
    per_cell = T.trades(spark, sf).groupBy("fold", "cell_id").agg(rows_as("c"))
    return per_cell.groupBy("fold").agg(rows_as("n_min"), F.sum("c").alias("n_eff"))


@query("D34_compound_cells", sql(SLOTS, _CELLS, _VOL, body="""SELECT bucket, stance, count(*) AS n, count(*) >= 30 AS sufficient FROM vol JOIN cells USING (cell_id) WHERE stance IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    j = vol_labels(spark, sf).join(cells(spark, sf), "cell_id").filter("stance IS NOT NULL")
    return j.groupBy("bucket", "stance").agg(rows_as("n")).withColumn("sufficient", F.col("n") >= 30)


@query("D35_kill_switch", sql(SLOTS, _CELLS, body="""SELECT event, min(n) AS min_stratum, min(n) < 21 AS kill FROM (SELECT event, pair, stance, count(*) AS n FROM cells GROUP BY ALL) GROUP BY 1"""))
def _(spark, sf):
    strata = cells(spark, sf).groupBy("event", "pair", "stance").agg(rows_as("n"))
    return strata.groupBy("event").agg(F.min("n").alias("min_stratum")).withColumn("kill", F.col("min_stratum") < 21)


@query("D36_modal_value", sql(TRADES, body="""SELECT cell_id, arg_min(fold, (-n, fold)) AS mode_fold FROM (SELECT cell_id, fold, count(*) AS n FROM trades GROUP BY ALL) GROUP BY 1"""))
def _(spark, sf):
    return T.trades(spark, sf).groupBy("cell_id").agg(F.mode("fold", deterministic=True).alias("mode_fold"))


@query("D37_median_over_folds", sql(TRADES, body="""SELECT cell_id, round(median(CASE WHEN fold <> 1 OR cell_id <> 'A_F_1' THEN m END), 6) AS median_mean FROM (SELECT cell_id, fold, avg(pnl) AS m FROM trades GROUP BY ALL) GROUP BY 1"""))
def _(spark, sf):
    per = T.trades(spark, sf).groupBy("cell_id", "fold").agg(F.avg("pnl").alias("m"))
    noisy = F.when((F.col("fold") == 1) & (F.col("cell_id") == "A_F_1"), F.lit(float("nan"))).otherwise(F.col("m"))
    return per.withColumn("m", noisy).groupBy("cell_id").agg(F.median(quality.finite_or(F.col("m"), None)).alias("median_mean"))


_DIMS = ("event", "pair", "wo", "hb", "et")


@query("D38_failure_histogram", sql(SLOTS, body=" UNION ALL ".join(f"SELECT '{d}' AS dim, {d}::VARCHAR AS value, count(*) AS n, count(*) FILTER (NOT passed) AS failures FROM slots GROUP BY 2" for d in _DIMS)))
def _(spark, sf):
    s = T.slot_reports(spark, sf)
    long = s.select("passed", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in _DIMS])).alias("d"))
    return long.groupBy("d.dim", "d.value").agg(rows_as("n"), F.count_if(~F.col("passed")).alias("failures"))


def ablation(s):
    """Per fee and dimension: passing rows, and distinct combinations without it."""
    ok = s.filter("passed")
    counts = [F.countDistinct(F.struct(*[d for d in _DIMS if d != drop])).alias(drop) for drop in _DIMS]
    wide = ok.groupBy("fee").agg(F.countDistinct(F.struct(*_DIMS)).alias("baseline"), *counts)
    long = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("ablated")) for d in _DIMS]))
    return wide.select("fee", "baseline", long.alias("a")).select("fee", "baseline", "a.*")


_ABL = "abl AS (" + " UNION ALL ".join(f"SELECT fee, '{d}' AS dim, count(*) AS baseline, count(DISTINCT ({', '.join(x for x in _DIMS if x != d)})) AS ablated FROM slots WHERE passed GROUP BY fee" for d in _DIMS) + ")"


@query("D39_ablation", sql(SLOTS, _ABL, body="SELECT fee, dim, baseline, ablated, baseline - ablated AS delta FROM abl"))
def _(spark, sf):
    return ablation(T.slot_reports(spark, sf)).withColumn("delta", F.col("baseline") - F.col("ablated"))


@query("D40_axis_cardinality", sql(SLOTS, body="SELECT dim, n FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dim, count(DISTINCT {d}) AS n FROM slots" for d in _DIMS) + ") ORDER BY -n, dim LIMIT 2"))
def _(spark, sf):
    wide = T.slot_reports(spark, sf).agg(*[F.countDistinct(d).alias(d) for d in _DIMS])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("n")) for d in _DIMS])).alias("a")).select("a.*")
    return long.orderBy(F.desc("n"), "dim").limit(2)


@query("D41_first_order_index", sql(SLOTS, _ABL, body="""SELECT axis, round(var_pop(m) / (SELECT nullif(var_pop(ablated), 0) FROM abl), 6) AS s1 FROM (SELECT 'dim' AS axis, avg(ablated) OVER (PARTITION BY dim) AS m FROM abl UNION ALL SELECT 'fee', avg(ablated) OVER (PARTITION BY fee) FROM abl) GROUP BY 1"""))
def _(spark, sf):
    a = ablation(T.slot_reports(spark, sf))
    a = a.withColumns({f"m_{x}": F.avg("ablated").over(Window.partitionBy(x)) for x in ("dim", "fee")})
    axes = F.array(*[F.struct(F.lit(x).alias("axis"), F.col(f"m_{x}").alias("m")) for x in ("dim", "fee")])
    long = a.select("ablated", F.explode(axes).alias("e")).select("ablated", "e.*")
    return long.groupBy("axis").agg(F.try_divide(F.var_pop("m"), F.var_pop("ablated")).alias("s1"))


_SCEN = "scen AS (SELECT * FROM (VALUES ('base', 4.0, 1.0), ('adverse', 9.5, 1.5)) v(scenario, cost, turn))"


@query("D42_costed_metrics", sql(TRADES, _SCEN, body="""SELECT scenario, pair, count(*) AS trades, (cost * turn)::DOUBLE AS total_cost, round(sum(greatest(pnl - cost * turn, 0)) / nullif(sum(greatest(cost * turn - pnl, 0)), 0), 6)::DOUBLE AS net_pf,
 round(avg(pnl - cost * turn), 6)::DOUBLE AS expectancy, (turn * count(*))::DOUBLE AS turnover FROM trades, scen GROUP BY scenario, pair, cost, turn"""))
def _(spark, sf):
    return folds.costed_metrics(T.trades(spark, sf), ["pair"], {"base": (4.0, 1.0), "adverse": (9.5, 1.5)})


@query("D43_pass_tiers", sql(SLOTS, body="""SELECT tier, pair, count(*) AS n, count(DISTINCT event) AS events, round(avg(pf), 6) AS mean_pf FROM (SELECT *, CASE WHEN pf >= 1.5 AND trades >= 15 THEN 'gold' WHEN pf >= 1.2 THEN 'silver' WHEN pf >= 1 THEN 'bronze' ELSE 'fail' END AS tier FROM slots) GROUP BY ALL"""))
def _(spark, sf):
    pf = F.col("pf")
    tier = F.when((pf >= 1.5) & (F.col("trades") >= 15), "gold").when(pf >= 1.2, "silver").when(pf >= 1, "bronze").otherwise("fail")
    return T.slot_reports(spark, sf).withColumn("tier", tier).groupBy("tier", "pair").agg(rows_as("n"), F.countDistinct("event").alias("events"), F.avg("pf").alias("mean_pf"))


@query("D44_threshold_count", sql(SLOTS, body="""SELECT pair, event, count(*) FILTER (pf >= 1.2 AND trades >= 10) AS qualified, count(*) FILTER (pf >= 1.2 AND trades >= 10) >= 5 AS pass FROM slots GROUP BY ALL"""))
def _(spark, sf):
    ok = F.count_if((F.col("pf") >= 1.2) & (F.col("trades") >= 10))
    return T.slot_reports(spark, sf).groupBy("pair", "event").agg(ok.alias("qualified"), (ok >= 5).alias("pass"))


@query("D45_expected_shortfall", sql(TRADES, body="""SELECT cell_id, n, CASE WHEN n >= 20 THEN round(es, 6) END AS es FROM (SELECT cell_id, any_value(n) AS n, abs(avg(pnl) FILTER (pnl <= p5)) AS es FROM
 (SELECT *, quantile_cont(pnl, 0.05) OVER (PARTITION BY cell_id) AS p5, count(*) OVER (PARTITION BY cell_id) AS n FROM trades) GROUP BY 1)"""))
def _(spark, sf):
    return folds.expected_shortfall(T.trades(spark, sf), ["cell_id"], F.col("pnl"))


@query("D46_daily_sharpe", sql(TRADES, """dp AS (SELECT cell_id, ts, sum(pnl) AS p, (max(qty) > 40)::INTEGER AS flag FROM trades GROUP BY ALL)""",
 """tr AS (SELECT *, abs(flag - lag(flag) OVER (PARTITION BY cell_id ORDER BY ts)) AS d FROM dp)""", body="""SELECT cell_id, count(*) AS days, sum(d)::BIGINT AS transitions,
 round(avg(p) / nullif(stddev_pop(p), 0) / (CASE WHEN sum(d) > 0 THEN sum(d) / count(*)::DOUBLE ELSE 1 END), 6) AS turnover_sharpe FROM tr GROUP BY 1"""))
def _(spark, sf):
    return folds.turnover_sharpe(T.trades(spark, sf), ["cell_id"])


@query("D47_calmar", sql(TRADES, """dp AS (SELECT cell_id, ts, sum(pnl) / 10000 AS p FROM trades GROUP BY ALL)""", """eq AS (SELECT *, 1 + sum(p) OVER (PARTITION BY cell_id ORDER BY ts) AS e FROM dp)""", """pk AS (SELECT *, max(e) OVER (PARTITION BY cell_id ORDER BY ts) AS m FROM eq)""",
 body="""SELECT cell_id, round(arg_max(e, ts), 6) AS last_equity, round(max((m - e) / m), 6) AS max_dd, round((pow(arg_max(e, ts) / arg_min(e, ts), 252.0 / count(*)) - 1) / nullif(max((m - e) / m), 0), 5) AS calmar FROM pk GROUP BY 1"""))
def _(spark, sf):
    return folds.calmar(T.trades(spark, sf), ["cell_id"]).withColumn("calmar", F.round("calmar", 5))


@query("D48_median_on_subset", sql(SLOTS, _CELLS, body="""SELECT event, round(median(pf), 6) AS median_pf, count(*) AS n FROM slots WHERE fee = 1 AND event || '_' || pair || '_' || wo IN (SELECT cell_id FROM cells WHERE pass_flag) GROUP BY 1"""))
def _(spark, sf):
    tested = cells(spark, sf).filter("pass_flag").select("event", "pair", "wo")
    s = T.slot_reports(spark, sf).filter("fee = 1").join(tested, ["event", "pair", "wo"], "left_semi")
    return s.groupBy("event").agg(F.median("pf").alias("median_pf"), rows_as("n"))


@query("D50_exit_rule_shares", sql(TRADES, body=f"""SELECT rule, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share, {_PF} AS pf, round(avg(pnl), 6) AS mean_pnl FROM (SELECT *, CASE ln % 4 WHEN 0 THEN 'atr_stop' WHEN 1 THEN 'technical_stop' WHEN 2 THEN 'trailing_stop' ELSE 'time_stop' END AS rule FROM trades) GROUP BY rule"""))
def _(spark, sf):
    rules = F.array(*[F.lit(r) for r in ("atr_stop", "technical_stop", "trailing_stop", "time_stop")])
    t = T.trades(spark, sf).withColumn("rule", F.element_at(rules, F.col("ln") % 4 + 1))
    return folds.rule_shares(t, "rule")


_BOOK = """book AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000000 * 1000000 - (event_id % 13) * 60000000 AS us, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
 round(100 + value / 1000 + (CASE WHEN event_id % 2 = 0 THEN 0 ELSE 0.3 END), 1) AS price FROM events)"""


@query("D51_book_disorder", sql(_BOOK, body="""SELECT * FROM (SELECT symbol, count(*) FILTER (us < p) AS disorder FROM (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM book) GROUP BY 1)
 JOIN (SELECT symbol, count(*) - count(DISTINCT (us, side, price)) AS duplicates FROM book GROUP BY 1) USING (symbol)
 JOIN (SELECT symbol, count(*) FILTER (side = 'ask' AND price < b) AS crossed, count(*) FILTER (side = 'ask' AND price = b) AS locked FROM (SELECT *, max(CASE WHEN side = 'bid' THEN price END) OVER (PARTITION BY symbol ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM book) GROUP BY 1) USING (symbol)"""))
def _(spark, sf):
    i = F.col("event_id")
    bid = i % 2 == 0
    rows = T.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), i.alias("seq"),
        (floor_micros(F.unix_micros("ts"), 1) - (i % 13) * 60_000_000).alias("us"), F.when(bid, "bid").otherwise("ask").alias("side"),
        F.round(100 + F.col("value") / 1000 + F.when(bid, 0.0).otherwise(0.3), 1).alias("price"),
    )
    return audits.book_disorder(rows)


@query("D52_realised_today", sql(TRADES, body="""SELECT cell_id, count(*) AS exits, sum(pnl) AS realised FROM trades WHERE ts::DATE = (SELECT max(ts)::DATE FROM trades) GROUP BY 1"""))
def _(spark, sf):
    t = T.trades(spark, sf)
    day = t.agg(F.to_date(F.max("ts"))).scalar()
    return t.filter(F.to_date("ts") == day).groupBy("cell_id").agg(rows_as("exits"), F.sum("pnl").alias("realised"))


@query("D53_bars_per_day", sql(QUOTES, BARS, body="""SELECT symbol, greatest(count(*) // count(DISTINCT ts::DATE), 1) AS bars_per_day FROM bars GROUP BY 1"""))
def _(spark, sf):
    per = F.floor(F.count(F.lit(1)) / F.countDistinct(F.to_date("ts")))
    return hourly(spark, sf).groupBy("symbol").agg(F.greatest(per, F.lit(1)).alias("bars_per_day"))


@query("D55_sign_agreement", sql(SLOTS, _WIDE, body="""SELECT event, count(*) AS matched, round(avg(((p0 >= 1) = (p1 >= 1))::INTEGER), 6) AS agree_01, round(avg(((p0 >= 1) = (p1 >= 1) AND (p1 >= 1) = (p2 >= 1) AND (p2 >= 1) = (p3 >= 1))::INTEGER), 6) AS agree_all FROM wide WHERE p0 + p1 + p2 + p3 IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    from barline.operators.lookup import slots_wide

    w = slots_wide(T.slot_reports(spark, sf).filter("fee = 2"), "pf").na.drop(subset=["p0", "p1", "p2", "p3"])
    up = [F.col(f"p{i}") >= 1 for i in range(4)]
    share = lambda c: F.avg(c.cast("int"))
    return w.groupBy("event").agg(
        rows_as("matched"), share(up[0] == up[1]).alias("agree_01"), share((up[0] == up[1]) & (up[1] == up[2]) & (up[2] == up[3])).alias("agree_all")
    )

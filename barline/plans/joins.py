"""Joins: as-of, range, semi/anti, multi-key; set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.events import calendar_rows, event_windows
from barline.operators import coverage, imbalance, lookup
from barline.operators.asof import asof_backward, asof_forward, asof_forward_grid
from barline.operators.bars import floor_micros
from barline.operators.series import fan_out
from barline.plans.checks import BARS, DAILY, FAST, QUOTES, REFERENCE, SLOTS, TRADES, sql
from barline.plans.registry import query
from barline.plans.rows import _CELLS, _VOL, cells, vol_labels
from barline.plans.shapes import hourly, rows_as
from barline.sources import tables as T


# ---- C: joins ------------------------------------------------------------------


@query("C01_asof_backward", sql(DAILY, REFERENCE, """src AS (SELECT * FROM reference)""",
 body="""SELECT d.symbol, d.ts, round(coalesce(s.value, (SELECT arg_min(value, ts) FROM src), 0.0), 6) AS aux
 FROM daily d ASOF LEFT JOIN src s ON d.ts >= s.ts"""))
def _(spark, sf):
    return asof_backward(T.daily_prices(spark, sf).select("symbol", "ts"), T.reference_series(spark, sf), [], "ts", "value", "aux")


@query("C01_asof_backward_ticks", sql(QUOTES, body="""SELECT t.symbol, count(*) AS n, round(sum(coalesce(s.bid, 0)), 4) AS aux_sum,
 count(*) FILTER (s.bid IS NULL) AS unmatched FROM quotes t ASOF LEFT JOIN (SELECT us, bid FROM quotes WHERE symbol = 'view') s ON t.us >= s.us
 WHERE t.symbol <> 'view' GROUP BY 1"""))
def _(spark, sf):
    q = T.quotes(spark, sf)
    src = q.filter("symbol = 'view'").select("us", "bid")
    hit = asof_backward(q.filter("symbol <> 'view'").select("symbol", "us"), src, [], "us", "bid", "aux", backfill=False)
    return hit.groupBy("symbol").agg(rows_as("n"), F.round(F.sum(F.coalesce("aux", F.lit(0.0))), 4).alias("aux_sum"), F.count_if(F.col("aux").isNull()).alias("unmatched"))


_OFFGRID = """anchors AS (SELECT symbol, event_id, us + 45000007 AS anchor_us FROM fast)"""


@query("C02_asof_forward_tolerance", sql(FAST, _OFFGRID, body="""SELECT symbol, event_id, anchor_us, quote_us, round(bid, 6) AS bid, round(ask, 6) AS ask FROM (
 SELECT a.symbol, a.event_id, a.anchor_us, q.us AS quote_us, q.bid, q.ask,
  row_number() OVER (PARTITION BY a.symbol, a.event_id ORDER BY q.us, q.bid, q.ask) AS rn
 FROM anchors a LEFT JOIN fast q ON q.symbol = a.symbol AND q.us >= a.anchor_us AND q.us < a.anchor_us + 60000000) WHERE rn = 1"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    anchors = q.select("symbol", "event_id", (F.col("us") + 45_000_007).alias("anchor_us"))
    return asof_forward(anchors, q, ["symbol"], "anchor_us", 60_000_000)


_GRID = """anchors AS (SELECT DISTINCT symbol, (us // 30000000) * 30000000 + 60000000 AS anchor_us FROM fast)"""


def grid_anchors(q):
    return q.select("symbol", (floor_micros(F.col("us"), 30) + 60_000_000).alias("anchor_us")).distinct()


_GRID_JOIN = """SELECT symbol, anchor_us, quote_us, bid, ask FROM (
 SELECT a.symbol, a.anchor_us, q.us AS quote_us, q.bid, q.ask,
  row_number() OVER (PARTITION BY a.symbol, a.anchor_us ORDER BY q.us, q.bid, q.ask) AS rn
 FROM anchors a LEFT JOIN fast q ON q.symbol = a.symbol AND q.us >= a.anchor_us AND q.us < a.anchor_us + 60000000) WHERE rn = 1"""


@query("C03_asof_forward_grid", sql(FAST, _GRID, body=_GRID_JOIN.replace("quote_us, bid, ask FROM", "quote_us, round(bid, 6) AS bid, round(ask, 6) AS ask FROM", 1)))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    return asof_forward_grid(grid_anchors(q), q, ["symbol"], "anchor_us")


@query("C04_entry_exit_pairing", sql(FAST, _GRID, f"ent AS ({_GRID_JOIN})", "surv AS (SELECT * FROM ent WHERE bid IS NOT NULL)",
 body="""SELECT symbol, count(*) AS pairs, sum(exit_us - quote_us)::BIGINT AS held_us, round(sum(exit_bid - ask), 4) AS gain FROM (
 SELECT e.*, q.us AS exit_us, q.bid AS exit_bid, row_number() OVER (PARTITION BY e.symbol, e.anchor_us ORDER BY q.us, q.bid, q.ask) AS rn
 FROM surv e JOIN fast q ON q.symbol = e.symbol AND q.us >= e.anchor_us + 180000000 AND q.us < e.anchor_us + 240000000) WHERE rn = 1 GROUP BY 1"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    entry = asof_forward_grid(grid_anchors(q), q, ["symbol"], "anchor_us").filter("bid IS NOT NULL")
    later = entry.select("symbol", "quote_us", "ask", (F.col("anchor_us") + 180_000_000).alias("exit_anchor"))
    later = later.withColumnsRenamed({"quote_us": "entry_us", "ask": "entry_ask"})
    leave = asof_forward_grid(later, q, ["symbol"], "exit_anchor").filter("bid IS NOT NULL")
    return leave.groupBy("symbol").agg(
        rows_as("pairs"), F.sum(F.col("quote_us") - F.col("entry_us")).alias("held_us"),
        F.round(F.sum(F.col("bid") - F.col("entry_ask")), 4).alias("gain"),
    )


@query("C05_double_anchor_join", sql(FAST, _GRID, f"qa AS ({_GRID_JOIN})", body="""SELECT e.symbol, count(*) AS n, count(*) FILTER (a.bid IS NULL) AS no_entry,
 count(*) FILTER (b.bid IS NULL) AS no_exit FROM anchors e LEFT JOIN qa a ON a.symbol = e.symbol AND a.anchor_us = e.anchor_us
 LEFT JOIN qa b ON b.symbol = e.symbol AND b.anchor_us = e.anchor_us + 300000000 GROUP BY 1"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    a = grid_anchors(q)
    qa = asof_forward_grid(a, q, ["symbol"], "anchor_us")
    entry = qa.select("symbol", "anchor_us", F.col("bid").alias("entry_bid"))
    leave = qa.select("symbol", (F.col("anchor_us") - 300_000_000).alias("anchor_us"), F.col("bid").alias("exit_bid"))
    both = a.join(entry, ["symbol", "anchor_us"], "left").join(leave, ["symbol", "anchor_us"], "left")
    return both.groupBy("symbol").agg(rows_as("n"), F.count_if(F.col("entry_bid").isNull()).alias("no_entry"), F.count_if(F.col("exit_bid").isNull()).alias("no_exit"))


@query("C06_using_composite_key", sql(SLOTS, """limits AS (SELECT event, pair, fee, median(pf) AS mid FROM slots GROUP BY ALL)""",
 body="SELECT event, pair, fee, count(*) AS n, round(any_value(mid), 6) AS mid FROM slots JOIN limits USING (event, pair, fee) WHERE pf >= mid GROUP BY ALL"))
def _(spark, sf):
    s = T.slot_reports(spark, sf)
    keys = ["event", "pair", "fee"]
    limits = s.groupBy(*keys).agg(F.median("pf").alias("mid"))
    return s.join(limits, keys).filter("pf >= mid").groupBy(*keys).agg(rows_as("n"), F.any_value("mid").alias("mid"))


@query("C07_unnest_product", """SELECT event_type, horizon, direction, count(*) AS n, sum(event_id + horizon)::BIGINT AS total FROM events,
 (SELECT unnest([60, 180, 300]) AS horizon), (SELECT unnest(['mean_reversion', 'momentum']) AS direction) GROUP BY ALL""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select("event_type", "event_id")
    wide = fan_out(fan_out(e, "horizon", imbalance.HORIZON_SECONDS), "direction", imbalance.DIRECTIONS)
    return wide.groupBy("event_type", "horizon", "direction").agg(rows_as("n"), F.sum(F.col("event_id") + F.col("horizon")).alias("total"))


@query("C08_statements_by_pair", """SELECT lang, pair, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents, (SELECT unnest(['P0', 'P1', 'P2', 'P3']) AS pair) GROUP BY ALL""")
def _(spark, sf):
    d = T.table(spark, sf, "documents").select("lang", "n_chars")
    return fan_out(d, "pair", T.SLOT_PAIRS).groupBy("lang", "pair").agg(rows_as("n"), F.sum("n_chars").alias("chars"))


@query("C09_label_join", sql(SLOTS, _CELLS, _VOL, body="""SELECT pair, bucket, count(*) AS n, round(sum(net), 4) AS net FROM cells JOIN vol USING (cell_id) GROUP BY ALL"""))
def _(spark, sf):
    joined = lookup.require_rows(cells(spark, sf).join(vol_labels(spark, sf), "cell_id"))
    return joined.groupBy("pair", "bucket").agg(rows_as("n"), F.round(F.sum("net"), 4).alias("net"))


@query("C10_left_join_sentinel", sql(SLOTS, _CELLS, _VOL, body="""SELECT coalesce(bucket, 'VOL_NA') AS bucket, count(*) AS n, sum(trades)::BIGINT AS trades FROM cells LEFT JOIN (SELECT * FROM vol WHERE bucket <> 'VOL_NONE') USING (cell_id) GROUP BY 1"""))
def _(spark, sf):
    known = vol_labels(spark, sf).filter("bucket <> 'VOL_NONE'")  # the others have no label, which the sentinel must fill
    joined = cells(spark, sf).join(known, "cell_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("VOL_NA")))
    return joined.groupBy("bucket").agg(rows_as("n"), F.sum("trades").alias("trades"))


@query("C11_many_to_one", """SELECT c_mktsegment, count(*) AS orders, count(*) FILTER (c_custkey IS NULL) AS unmatched FROM orders LEFT JOIN
 customer ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    people = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = lookup.many_to_one(T.table(spark, sf, "orders").select("o_custkey"), people, ["o_custkey"])
    return joined.groupBy("c_mktsegment").agg(rows_as("orders"), F.count_if(~F.col("matched")).alias("unmatched"))


@query("C12_bridge_mode", sql(SLOTS, _CELLS, body="""SELECT cell_id, stance FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, stance) AS rn FROM (SELECT cell_id, s.stance, count(*) AS n FROM
 (SELECT DISTINCT event, pair, cell_id FROM cells) b JOIN (SELECT event, pair, CASE wo % 2 WHEN 0 THEN 'HAWK' ELSE 'DOV' END AS stance FROM slots WHERE passed) s USING (event, pair) GROUP BY ALL)) WHERE rn = 1"""))
def _(spark, sf):
    bridge = cells(spark, sf).select("event", "pair", "cell_id").distinct()
    stances = T.slot_reports(spark, sf).filter("passed").select("event", "pair", F.when(F.col("wo") % 2 == 0, "HAWK").otherwise("DOV").alias("stance"))
    # Count per (event, pair, stance) first: the bridge then meets a handful of rows.
    tally = stances.groupBy("event", "pair", "stance").agg(rows_as("n"))
    votes = bridge.join(tally, ["event", "pair"]).groupBy("cell_id", "stance").agg(F.sum("n").alias("n"))
    return votes.groupBy("cell_id").agg(F.min_by("stance", F.struct(-F.col("n"), "stance")).alias("stance"))


@query("C13_three_way_trades", sql(TRADES, body="""SELECT t.cell_id, count(*) AS n, count(x.pnl) AS with_exit, count(z.qty) AS with_size, round(sum(coalesce(x.pnl, 0) * coalesce(z.qty, 1)), 4) AS sized
 FROM trades t LEFT JOIN (SELECT ok, ln, pk, sk, pnl FROM trades) x USING (ok, ln, pk, sk) LEFT JOIN (SELECT ok, ln, pk, sk, qty FROM trades) z USING (ok, ln, pk, sk) GROUP BY 1"""))
def _(spark, sf):
    t = T.trades(spark, sf)
    key = ["ok", "ln", "pk", "sk"]
    exits = t.select(*key, F.col("pnl").alias("exit_pnl"))
    sizes = t.select(*key, F.col("qty").alias("size"))
    j = t.select("cell_id", *key).join(exits, key, "left").join(sizes, key, "left")
    value = F.coalesce("exit_pnl", F.lit(0.0)) * F.coalesce("size", F.lit(1.0))
    return j.groupBy("cell_id").agg(rows_as("n"), F.count("exit_pnl").alias("with_exit"), F.count("size").alias("with_size"), F.round(F.sum(value), 4).alias("sized"))


@query("C14_common_dates", sql(DAILY, body="""SELECT symbol, ts, round(close, 6) AS close FROM daily WHERE ts IN (SELECT ts FROM daily GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM daily))"""))
def _(spark, sf):
    return coverage.present_in_all(T.daily_prices(spark, sf), "symbol", "ts").select("symbol", "ts", "close")


_RATES = """rates AS (SELECT o_orderpriority AS zone, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(round(o_totalprice)) / count(*) AS rate FROM orders GROUP BY ALL)"""


@query("C15_rate_differential", sql(_RATES, body="""SELECT ts, round(a.rate - b.rate, 6) AS diff FROM (SELECT * FROM rates WHERE zone = '1-URGENT') a JOIN (SELECT * FROM rates WHERE zone = '5-LOW') b USING (ts)"""))
def _(spark, sf):
    o = T.table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    rates = o.groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(
        F.sum(F.round("o_totalprice")) / F.count("o_totalprice")
    )
    return rates.filter("`1-URGENT` IS NOT NULL AND `5-LOW` IS NOT NULL").select("ts", (F.col("1-URGENT") - F.col("5-LOW")).alias("diff"))


_WIDE = """wide AS (SELECT event, wo, hb, et, max(CASE WHEN pair = 'P0' THEN pf END) AS p0, max(CASE WHEN pair = 'P1' THEN pf END) AS p1,
 max(CASE WHEN pair = 'P2' THEN pf END) AS p2, max(CASE WHEN pair = 'P3' THEN pf END) AS p3 FROM slots WHERE fee = 2 GROUP BY ALL)"""


@query("C16_slot_matched_pairs", sql(SLOTS, _WIDE, body="SELECT event, wo, hb, et, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM wide WHERE p0 + p1 + p2 + p3 IS NOT NULL"))
def _(spark, sf):
    return lookup.slots_wide(T.slot_reports(spark, sf).filter("fee = 2"), "pf").filter("p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL")


_WINDOWS = """windows AS (SELECT ts AS start, ts + INTERVAL 2 HOUR AS "end" FROM events WHERE event_type = 'purchase' AND value > 150)"""


def shock_windows(spark, sf):
    e = T.table(spark, sf, "events").filter("event_type = 'purchase' AND value > 150")
    return e.select(F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))


@query("B08_outside_windows", sql(QUOTES, BARS, _WINDOWS, body="""SELECT symbol, ts, round(close, 6) AS close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE b.ts >= w.start AND b.ts < w."end")"""))
def _(spark, sf):
    return coverage.outside_windows(hourly(spark, sf), shock_windows(spark, sf)).select("symbol", "ts", "close")


@query("C17_inside_windows", sql(QUOTES, _WINDOWS, body="""SELECT symbol, event_id, (SELECT count(*) FROM windows w WHERE q.ts >= w.start AND q.ts < w."end") AS open_windows
 FROM quotes q WHERE EXISTS (SELECT 1 FROM windows w WHERE q.ts >= w.start AND q.ts < w."end")"""))
def _(spark, sf):
    q = T.quotes(spark, sf).select("symbol", "ts", "event_id")
    found = coverage.with_open_windows(q, shock_windows(spark, sf)).filter("open_windows > 0")
    return found.select("symbol", "event_id", "open_windows")


_CAL_VALUES = ", ".join(f"('{s}', DATE '{d}', {h}, {x})" for src in ("boj", "ecb", "fomc", "nfp") for s, d, h, x in calendar_rows(src))
_CAL = f"cal AS (SELECT * FROM (VALUES {_CAL_VALUES}) v(source, day, hour, direction))"


@query("C18_calendar_lookup", sql(QUOTES, _CAL, body="""SELECT symbol, source, direction, count(*) AS ticks FROM quotes JOIN cal ON cal.day = quotes.ts::DATE GROUP BY ALL"""))
def _(spark, sf):
    cal = event_windows(spark).select("day", "source", "direction")
    q = T.quotes(spark, sf).select("symbol", F.to_date("ts").alias("day"))
    # 112 calendar rows; ticks are counted per symbol and day before the join.
    daily = q.groupBy("symbol", "day").agg(rows_as("n"))
    return daily.join(F.broadcast(cal), "day").groupBy("symbol", "source", "direction").agg(F.sum("n").alias("ticks"))


@query("C19_missing_anchor", sql(FAST, _GRID, body="""SELECT symbol, anchor_us FROM anchors a WHERE NOT EXISTS (SELECT 1 FROM fast q WHERE q.symbol = a.symbol AND q.us // 30000000 = a.anchor_us // 30000000)"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    present = q.select("symbol", floor_micros(F.col("us"), 30).alias("anchor_us")).distinct()
    return grid_anchors(q).join(present, ["symbol", "anchor_us"], "left_anti")


@query("C20_false_null_check", sql(FAST, _GRID, body="""SELECT symbol, count(*) AS anchors, count(*) FILTER (NOT hit) AS null_anchors, 0 AS false_nulls FROM (
 SELECT a.symbol, EXISTS (SELECT 1 FROM fast q WHERE q.symbol = a.symbol AND q.us >= a.anchor_us AND q.us < a.anchor_us + 60000000) AS hit FROM anchors a) GROUP BY 1"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    qa = asof_forward_grid(grid_anchors(q), q, ["symbol"], "anchor_us")
    checked = asof_forward(qa.select("symbol", "anchor_us", "quote_us"), q, ["symbol"], "anchor_us", 60_000_000, prefix="seen_")
    wrong = F.col("quote_us").isNull() & F.col("seen_quote_us").isNotNull()
    return checked.groupBy("symbol").agg(rows_as("anchors"), F.count_if(F.col("quote_us").isNull()).alias("null_anchors"), F.count_if(wrong).cast("int").alias("false_nulls"))


@query("C21_exit_rows_ahead", sql(QUOTES, BARS, body="""SELECT symbol, ts, round(c6 / close - 1, 6) AS move, round(exact / close - 1, 6) AS exact_move FROM (
 SELECT a.symbol, a.ts, a.close, lead(a.close, 6) OVER (PARTITION BY a.symbol ORDER BY a.ts) AS c6, b.close AS exact FROM bars a LEFT JOIN bars b ON b.symbol = a.symbol AND b.ts = a.ts + INTERVAL 6 HOUR) WHERE hour(ts) = 21 AND c6 IS NOT NULL"""))
def _(spark, sf):
    bars = hourly(spark, sf)
    return lookup.exits_ahead(bars, 6, "INTERVAL 6 HOURS").filter("hour(ts) = 21 AND ahead IS NOT NULL").select(
        "symbol", "ts", (F.col("ahead") / F.col("close") - 1).alias("move"), (F.col("exact") / F.col("close") - 1).alias("exact_move")
    )


@query("C22_release_weeks", sql(DAILY, body="""SELECT symbol, in_week, count(*) AS n FROM (SELECT symbol, (year(ts), week(ts)) IN (SELECT (year(ts), week(ts)) FROM daily WHERE day(ts) <= 7 AND isodow(ts) = 5) AS in_week FROM daily) GROUP BY ALL"""))
def _(spark, sf):
    return lookup.flag_release_weeks(T.daily_prices(spark, sf)).groupBy("symbol", "in_week").agg(rows_as("n"))


@query("C23_after_shock_days", sql(DAILY, REFERENCE, """rr AS (SELECT ts, ln(value / lag(value) OVER (ORDER BY ts)) AS r FROM reference)""", """big AS (SELECT ts FROM rr WHERE r > 2 * (SELECT stddev_samp(r) FROM rr))""",
 body="""SELECT symbol, count(*) AS n, round(avg(close), 4) AS mean_close FROM daily WHERE ts IN (SELECT ts + d * INTERVAL 1 DAY FROM big, (SELECT unnest([1, 2, 3]) AS d)) GROUP BY 1"""))
def _(spark, sf):
    days = lookup.days_after_shocks(T.reference_series(spark, sf), 2.0, (1, 2, 3))
    hit = T.daily_prices(spark, sf).join(days, "ts", "left_semi")
    return hit.groupBy("symbol").agg(rows_as("n"), F.round(F.avg("close"), 4).alias("mean_close"))


_TRIALS = """trials AS (SELECT p_partkey AS trial_id, p_size AS a, (p_partkey % 17 + 1)::INTEGER AS b, round(p_retailprice / 900, 4) AS pf FROM part)"""


def trials(spark, sf):
    return T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("trial_id"), F.col("p_size").alias("a"), (F.col("p_partkey") % 17 + 1).cast("int").alias("b"),
        F.round(F.col("p_retailprice") / 900, 4).alias("pf"),
    )


@query("C24_parameter_neighbours", sql(_TRIALS, body="""SELECT c.trial_id, count(t.trial_id) AS neighbours, round(sum(t.pf), 4) AS pf_sum FROM trials c LEFT JOIN trials t ON t.trial_id <> c.trial_id
 AND abs((t.a - c.a) / c.a::DOUBLE) <= 0.2::DOUBLE AND abs((t.b - c.b) / c.b::DOUBLE) <= 0.2::DOUBLE GROUP BY 1"""))
def _(spark, sf):
    near = lookup.neighbour_sums(trials(spark, sf), ["a", "b"], "pf", 0.2)
    return near.select("trial_id", "neighbours", F.round("pf_sum", 4).alias("pf_sum"))


_CLUST = """clusters AS (SELECT (o_custkey % 50)::INTEGER AS cluster_id, min(o_orderdate) AS s, min(o_orderdate) + INTERVAL 40 DAY AS e FROM orders GROUP BY 1)"""


@query("C25_interval_overlap", sql(_CLUST, body="""SELECT cluster_id, coalesce((SELECT label FROM (VALUES ('first', 1, TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-03'), ('second', 2, TIMESTAMP '1995-01-02', TIMESTAMP '1995-01-20'),
 ('third', 3, TIMESTAMP '1995-02-05', TIMESTAMP '1995-03-20')) x(label, i, xs, xe) WHERE NOT (e < xs OR s > xe) ORDER BY i LIMIT 1), 'unannotated') AS label FROM clusters"""))
def _(spark, sf):
    o = T.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).cast("int").alias("cluster_id")).agg(F.min("o_orderdate").alias("start"))
    spans = o.withColumn("end", F.col("start") + F.expr("INTERVAL 40 DAYS"))
    expected = [("first", "1995-01-01", "1995-01-03"), ("second", "1995-01-02", "1995-01-20"), ("third", "1995-02-05", "1995-03-20")]
    return spans.select("cluster_id", lookup.first_overlap("start", "end", expected).alias("label"))


@query("C26_bars_by_grid", sql(QUOTES, BARS, body="""SELECT symbol, short_n, long_n, count(*) AS bars, count(*) FILTER (s > l) AS above FROM (
 SELECT symbol, 3 AS short_n, 10 AS long_n, ts, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING) AS s, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS l FROM bars
 UNION ALL SELECT symbol, 5, 20, ts, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) FROM bars) GROUP BY ALL"""))
def _(spark, sf):
    grid = lookup.rows_by_grid(hourly(spark, sf), [("short_n", "long_n")], [(3, 10), (5, 20)])
    return lookup.grid_means(grid, (3, 5, 10, 20)).groupBy("symbol", "short_n", "long_n").agg(rows_as("bars"), F.count_if(F.col("short_mean") > F.col("long_mean")).alias("above"))


# ---- G: set operations ---------------------------------------------------------


@query("G02_union_distinct", sql(FAST, body="""SELECT symbol, count(*) AS anchors FROM (SELECT symbol, (us // 30000000) * 30000000 AS a FROM fast UNION SELECT symbol, (us // 30000000) * 30000000 + 180000000 FROM fast) GROUP BY 1"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf).select("symbol", floor_micros(F.col("us"), 30).alias("a"))
    both = q.union(q.select("symbol", F.col("a") + 180_000_000)).distinct()
    return both.groupBy("symbol").agg(rows_as("anchors"))


@query("G03_except_both_ways", sql(FAST, _GRID, body="""SELECT 0 AS old_minus_new, 0 AS new_minus_old, count(*) AS anchors FROM anchors"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    a = grid_anchors(q)
    cols = ["symbol", "anchor_us", "quote_us", "bid", "ask"]
    old = asof_forward(a, q, ["symbol"], "anchor_us", 60_000_000).select(*cols)
    new = asof_forward_grid(a, q, ["symbol"], "anchor_us").select(*cols)
    # One pass over both sides instead of two EXCEPTs.
    tagged = old.withColumn("o", F.lit(1)).withColumn("n", F.lit(0)).unionByName(new.withColumn("o", F.lit(0)).withColumn("n", F.lit(1)))
    per_row = tagged.groupBy(*cols).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return per_row.agg(
        F.count_if((F.col("o") == 1) & (F.col("n") == 0)).cast("int").alias("old_minus_new"),
        F.count_if((F.col("n") == 1) & (F.col("o") == 0)).cast("int").alias("new_minus_old"),
        F.count_if(F.col("n") == 1).alias("anchors"),
    )


@query("G04_shards_union_dedup", sql(FAST, _GRID, f"qa AS ({_GRID_JOIN})", body="""SELECT symbol, anchor_us, quote_us, round(bid, 6) AS bid, round(ask, 6) AS ask FROM qa"""))
def _(spark, sf):
    q = T.fast_quotes(spark, sf)
    return lookup.sharded_anchor_quotes(grid_anchors(q), q, shard_us=3_600_000_000, overlap_us=360_000_000)


@query("G05_diagonal_concat", """SELECT milestone, count(*) AS n, count(score) AS scored, count(level) AS levelled, round(sum(coalesce(score, 0)), 4) AS score FROM (
 SELECT 'a' AS milestone, p_size::DOUBLE AS score, NULL::BIGINT AS level FROM part UNION ALL SELECT 'b', NULL, s_suppkey % 5 FROM supplier UNION ALL SELECT 'c', c_acctbal, c_nationkey FROM customer) GROUP BY 1""")
def _(spark, sf):
    a = T.table(spark, sf, "part").select(F.lit("a").alias("milestone"), F.col("p_size").alias("score"))
    b = T.table(spark, sf, "supplier").select(F.lit("b").alias("milestone"), (F.col("s_suppkey") % 5).alias("level"))
    c = T.table(spark, sf, "customer").select(F.lit("c").alias("milestone"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").alias("level"))
    stacked = lookup.diagonal_concat([a, b, c], {"milestone": "string", "score": "double", "level": "bigint"})
    return stacked.groupBy("milestone").agg(rows_as("n"), F.count("score").alias("scored"), F.count("level").alias("levelled"), F.round(F.sum(F.coalesce("score", F.lit(0.0))), 4).alias("score"))


@query("G06_date_intersection", sql(DAILY, body="""SELECT year(ts) AS epoch, count(*) AS common_days FROM (SELECT ts FROM daily WHERE symbol = 'A' INTERSECT SELECT ts FROM daily WHERE symbol = 'N' INTERSECT SELECT ts FROM daily WHERE symbol = 'R') GROUP BY 1"""))
def _(spark, sf):
    days = coverage.present_in_all(T.daily_prices(spark, sf).select("symbol", "ts"), "symbol", "ts").select("ts").distinct()
    return days.groupBy(F.year("ts").alias("epoch")).agg(rows_as("common_days"))


@query("G07_calendar_completeness", """SELECT d AS missing_day FROM (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem) WHERE d NOT IN (SELECT o_orderdate::DATE FROM orders)""")
def _(spark, sf):
    seen = T.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("missing_day")).distinct()
    known = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("missing_day")).distinct()
    return seen.join(known, "missing_day", "left_anti")


@query("G09_calendar_union", sql(_CAL, body="""SELECT source, count(*) AS windows, count(*) FILTER (n > 0) AS with_ticks, coalesce(sum(n), 0)::BIGINT AS ticks FROM (
 SELECT source, day, (SELECT count(*) FROM events e WHERE e.ts::DATE = cal.day) AS n FROM cal) GROUP BY 1"""))
def _(spark, sf):
    cal = event_windows(spark, ("fomc", "ecb")).union(event_windows(spark, ("nfp", "boj")))
    days = T.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(rows_as("n"))
    return cal.join(days, "day", "left").groupBy("source").agg(rows_as("windows"), F.count_if(F.col("n") > 0).alias("with_ticks"), F.coalesce(F.sum("n"), F.lit(0)).alias("ticks"))

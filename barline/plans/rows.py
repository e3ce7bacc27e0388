"""Projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import calendar as cal
from barline.functions import text as tx
from barline.operators import quality
from barline.operators.bars import floor_micros
from barline.operators.indicators import by
from barline.plans.checks import BARS, DAILY, QUOTES, SLOT_TRADES, SLOTS, sql
from barline.plans.registry import query
from barline.plans.shapes import hourly
from barline.sources import tables as T


# ---- B: projections and filters ------------------------------------------------


@query(
    "B01_half_open_range",
    sql(QUOTES, body="""SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM quotes
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY symbol"""),
)
def _(spark, sf):
    inside = T.quotes(spark, sf).filter("ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
    return inside.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "B02_last_n_days",
    sql(QUOTES, BARS, body="""SELECT symbol, count(*) AS n, min(ts) AS first_ts FROM bars
WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 7 DAY GROUP BY symbol"""),
)
def _(spark, sf):
    bars = hourly(spark, sf)
    recent = quality.last_days(bars, 7)
    return recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query(
    "B03_study_window",
    sql(DAILY, body="""SELECT * REPLACE (round(open,6) AS open, round(high,6) AS high, round(low,6) AS low,
 round(close,6) AS close) FROM daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'"""),
)
def _(spark, sf):
    return T.daily_prices(spark, sf).filter("ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'")


@query(
    "B04_market_closed",
    sql(QUOTES, body="""SELECT symbol, count(*) AS closed_ticks FROM quotes
WHERE symbol <> 'click' AND ((isodow(ts) = 5 AND hour(ts) >= 22) OR isodow(ts) = 6 OR (isodow(ts) = 7 AND hour(ts) < 22))
GROUP BY symbol"""),
)
def _(spark, sf):
    q = T.quotes(spark, sf)
    closed = q.filter(cal.is_market_closed(F.col("symbol"), F.col("ts"), always_open=("click",)))
    return closed.groupBy("symbol").agg(F.count(F.lit(1)).alias("closed_ticks"))


@query(
    "B05_weekend",
    "SELECT event_type, count(*) FILTER (isodow(ts) >= 6) AS weekend, count(*) FILTER (isodow(ts) < 6) AS weekday "
    "FROM events GROUP BY 1",
)
def _(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy("event_type").agg(
        F.count_if(cal.is_weekend(F.col("ts"))).alias("weekend"),
        F.count_if(~cal.is_weekend(F.col("ts"))).alias("weekday"),
    )


@query(
    "B06_blackout_minutes",
    """SELECT event_type, count(*) AS n FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)
WHERE m BETWEEN 745 AND 755 OR m BETWEEN 805 AND 815 OR m BETWEEN 835 AND 850 OR m BETWEEN 895 AND 910
   OR m BETWEEN 1320 AND 1330 OR m BETWEEN 0 AND 10 OR m BETWEEN 50 AND 59 GROUP BY 1""",
)
def _(spark, sf):
    e = T.table(spark, sf, "events").filter(cal.is_blackout(F.col("ts")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B07_clock_cluster",
    """SELECT cluster, count(*) AS n, round(sum(round(value * 100)) / count(*), 6) AS mean_value
FROM events, (VALUES ('london_open', 475, 480), ('tokyo_fix', 55, 60), ('ny_close_sell', 1259, 1264),
 ('ny_post_close', 1265, 1270), ('london_burst', 595, 600), ('london_continuation', 601, 606)) c(cluster, lo, hi)
WHERE hour(ts) * 60 + minute(ts) >= lo AND hour(ts) * 60 + minute(ts) < hi GROUP BY 1""",
)
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn("cluster", cal.cluster_name(F.col("ts")))
    cents = F.sum(F.round(F.col("value") * 100))
    return e.filter("cluster IS NOT NULL").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), (cents / F.count(F.lit(1))).alias("mean_value")
    )


@query(
    "B09_session_label",
    """SELECT CASE WHEN hour(ts) < 8 THEN 'Asian' WHEN hour(ts) < 13 THEN 'London' WHEN hour(ts) < 17 THEN 'Overlap'
 WHEN hour(ts) < 22 THEN 'NY_late' ELSE 'closed' END AS session, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn("session", cal.session_name(F.col("ts")))
    return e.groupBy("session", "event_type").agg(F.count(F.lit(1)).alias("n"))


_CELLS = """cells AS (SELECT event || '_' || pair || '_' || wo AS cell_id, event, pair, wo,
  sum(net_sum) AS net, sum(trades) AS trades, bool_or(passed) AS pass_flag,
  CASE WHEN wo % 3 = 0 THEN 'HAWK' WHEN wo % 3 = 1 THEN 'DOV' END AS stance, wo % 5 = 4 AS kill
  FROM slots GROUP BY event, pair, wo)"""


def cells(spark, sf):
    """One row per (event, pair, offset): at most 256 rows."""
    s = T.slot_reports(spark, sf)
    return s.groupBy("event", "pair", "wo").agg(
        F.sum("net_sum").alias("net"), F.sum("trades").alias("trades"), F.bool_or("passed").alias("pass_flag")
    ).select(
        F.concat_ws("_", "event", "pair", F.col("wo").cast("string")).alias("cell_id"),
        "*",
        F.when(F.col("wo") % 3 == 0, "HAWK").when(F.col("wo") % 3 == 1, "DOV").alias("stance"),
        (F.col("wo") % 5 == 4).alias("kill"),
    )


@query(
    "B10_active_pool",
    sql(SLOTS, _CELLS, body="""SELECT cell_id, net FROM cells
WHERE pass_flag AND NOT kill AND stance IN ('HAWK', 'DOV')"""),
)
def _(spark, sf):
    return quality.active_pool(cells(spark, sf), ("HAWK", "DOV")).select("cell_id", "net")


@query(
    "B11_mask_with_carry",
    sql(SLOTS, _CELLS, body="""SELECT cell_id, pass_flag, pass_flag AND (stance IS NULL OR stance = 'HAWK') AS kept
FROM cells"""),
)
def _(spark, sf):
    c = cells(spark, sf)
    kept = F.col("pass_flag") & (F.col("stance").isNull() | F.col("stance").isin("HAWK"))
    return c.select("cell_id", "pass_flag", kept.alias("kept"))


@query(
    "B12_bounded_guard",
    """SELECT CASE WHEN o_totalprice / 500000 > 0 AND o_totalprice / 500000 <= 1 THEN 'ok' ELSE 'rejected' END AS verdict,
  count(*) AS n FROM orders GROUP BY 1""",
)
def _(spark, sf):
    share = F.col("o_totalprice") / 500000
    o = T.table(spark, sf, "orders").withColumn("verdict", F.when(quality.in_unit_range(share), "ok").otherwise("rejected"))
    return o.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_VOL = """vol AS (SELECT cell_id, 'VOL_' || CASE wo % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MID' WHEN 2 THEN 'HIGH' ELSE 'NONE' END AS bucket
  FROM cells)"""


def vol_labels(spark, sf):
    name = F.element_at(F.array(*[F.lit(f"VOL_{v}") for v in ("LOW", "MID", "HIGH", "NONE")]), F.col("wo") % 4 + 1)
    return cells(spark, sf).select("cell_id", name.alias("bucket"))


@query(
    "B13_strip_prefix",
    sql(SLOTS, _CELLS, _VOL, body="""SELECT regexp_replace(bucket, '^VOL_', '') AS bucket, count(*) AS n FROM vol GROUP BY 1"""),
)
def _(spark, sf):
    return vol_labels(spark, sf).groupBy(F.regexp_replace("bucket", "^VOL_", "").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "B14_bucket_filter",
    sql(SLOTS, _CELLS, _VOL, body="""SELECT mode, cell_id, regexp_replace(coalesce(bucket, 'VOL_NA'), '^VOL_', '') AS bucket,
  mode = 'neutral' OR coalesce(bucket, 'VOL_NA') IN ('VOL_LOW', 'VOL_MID') AS pass_flag
FROM cells LEFT JOIN (SELECT * FROM vol WHERE bucket <> 'VOL_NONE') USING (cell_id), (SELECT unnest(['active', 'neutral']) AS mode)"""),
)
def _(spark, sf):
    known = vol_labels(spark, sf).filter("bucket <> 'VOL_NONE'")  # the others have no label, which the filter must take
    both = [quality.bucket_filter(cells(spark, sf).select("cell_id"), known, ("LOW", "MID"), m) for m in ("active", "neutral")]
    return both[0].unionByName(both[1])


@query(
    "B15_fee_pick",
    sql(SLOTS, body="""SELECT event, pair, wo, hb, et, max(CASE WHEN abs(fee - 2) < 0.01 THEN trades END) AS trades,
  round(max(CASE WHEN abs(fee - 2) < 0.01 THEN pf END), 6) AS pf FROM slots GROUP BY ALL"""),
)
def _(spark, sf):
    nested = T.slot_reports(spark, sf).groupBy("event", "pair", "wo", "hb", "et").agg(
        F.collect_list(F.struct("fee", "trades", "pf")).alias("fee_results")
    )
    picked = F.get(F.filter("fee_results", lambda x: F.abs(x["fee"] - 2.0) < 0.01), F.lit(0))
    return nested.select("event", "pair", "wo", "hb", "et", picked["trades"].alias("trades"), picked["pf"].alias("pf"))


@query(
    "B16_missing_reason",
    sql(QUOTES, body="""SELECT symbol, CASE WHEN v <= 0 THEN 'zero_volume_denominator' END AS missing_reason, count(*) AS buckets
FROM (SELECT symbol, us // 30000000 AS b, sum(bid_vol + ask_vol) AS v FROM quotes GROUP BY ALL) GROUP BY ALL"""),
)
def _(spark, sf):
    b = T.quotes(spark, sf).groupBy("symbol", floor_micros(F.col("us"), 30).alias("b")).agg(
        F.sum(F.col("bid_vol") + F.col("ask_vol")).alias("v")
    )
    reason = F.when(F.col("v") <= 0, "zero_volume_denominator").alias("missing_reason")
    return b.groupBy("symbol", reason).agg(F.count(F.lit(1)).alias("buckets"))


_RAW_TRADES = """raw AS (SELECT event_id AS row_index,
  CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE ts::VARCHAR END AS ts_text,
  CASE WHEN event_id % 3 = 0 THEN 'buy' WHEN event_id % 3 = 1 THEN 'sell' ELSE 'unknown' END AS side,
  CASE WHEN event_id % 17 = 0 THEN 'x' ELSE value::VARCHAR END AS price,
  (event_id % 7 - 1)::VARCHAR AS amount FROM events)"""


def raw_trade_text(spark, sf):
    i = F.col("event_id")
    return T.table(spark, sf, "events").select(
        i.alias("row_index"),
        F.when(i % 11 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts_text"),
        F.when(i % 3 == 0, "buy").when(i % 3 == 1, "sell").otherwise("unknown").alias("side"),
        F.when(i % 17 == 0, "x").otherwise(F.col("value").cast("string")).alias("price"),
        (i % 7 - 1).cast("string").alias("amount"),
    )


_BAD = """CASE WHEN try_cast(ts_text AS TIMESTAMP) IS NULL THEN 'timestamp:unparsable'
  WHEN side NOT IN ('buy', 'sell') THEN 'side:not_allowed' WHEN try_cast(price AS DOUBLE) IS NULL THEN 'price:not_numeric'
  WHEN try_cast(price AS DOUBLE) <= 0 THEN 'price:not_positive' WHEN try_cast(amount AS DOUBLE) IS NULL THEN 'amount:not_numeric'
  WHEN try_cast(amount AS DOUBLE) <= 0 THEN 'amount:not_positive' END"""


@query("B17_quarantine_failures", sql(_RAW_TRADES, body=f"""SELECT * FROM (SELECT row_index, split_part({_BAD}, ':', 1) AS field,
 split_part({_BAD}, ':', 2) AS reason FROM raw) WHERE reason <> ''"""))
def _(spark, sf):
    return quality.quarantine(raw_trade_text(spark, sf))[1]


@query("B17_quarantine_typed", sql(_RAW_TRADES, body=f"""SELECT side, count(*) AS n, round(sum(price::DOUBLE * amount::DOUBLE), 4) AS notional
 FROM raw WHERE {_BAD} IS NULL GROUP BY side"""))
def _(spark, sf):
    good = quality.quarantine(raw_trade_text(spark, sf))[0]
    return good.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price") * F.col("amount")), 4).alias("notional")
    )


@query("B18_bar_contract", sql(QUOTES, BARS, body="""SELECT symbol, violation, count(*) AS n, min(ts) AS first_ts FROM (
 SELECT symbol, ts, CASE WHEN prev IS NOT NULL AND ts <= prev THEN 'not_increasing'
  WHEN prev IS NOT NULL AND ts - prev <> INTERVAL 1 HOUR THEN 'gap' WHEN close <= 0 THEN 'non_positive_close' END AS violation
 FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars)) WHERE violation IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    bad = quality.bar_violations(hourly(spark, sf), "1h")
    return bad.groupBy("symbol", "violation").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("B19_required_values", """SELECT o_orderpriority AS value, count(*) AS n FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    return quality.unexpected_values(o, ["o_orderkey", "o_orderdate"], "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM"))


@query("B20_embargo", sql(QUOTES, BARS, body="""SELECT symbol, ts, input_ts FROM (SELECT symbol, ts,
 max(ts) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS input_ts,
 lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars) WHERE input_ts >= ts - INTERVAL 1 HOUR"""))
def _(spark, sf):
    w = by(["symbol"]).rowsBetween(-14, -1)
    inputs = hourly(spark, sf).withColumn("input_ts", F.max("ts").over(w))
    return quality.embargo_violations(inputs, "input_ts", F.col("ts") - F.expr("INTERVAL 1 HOUR")).select(
        "symbol", "ts", "input_ts"
    )


# ---- K: scalar functions -------------------------------------------------------


@query("K01_floor_seconds", "SELECT to_timestamp((epoch(ts)::BIGINT // 300) * 300)::TIMESTAMP AS bucket, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 300) * 300)
    return e.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("K02_floor_micros_grid", "SELECT make_timestamp((epoch_us(ts) // 30000000) * 30000000) AS slot, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy(F.timestamp_micros(floor_micros(F.unix_micros("ts"), 30)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("K03_off_grid_count", """SELECT event_type, count(*) AS anchors, count(*) FILTER (epoch_us(ts) % 30000000 <> 0) AS off_grid
 FROM events GROUP BY 1""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("anchors"), F.count_if(F.pmod(F.unix_micros("ts"), F.lit(30_000_000)) != 0).alias("off_grid")
    )


@query("K04_ns_iso", sql(QUOTES, BARS, body="""SELECT symbol, epoch_ns(ts) AS ns, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM bars"""))
def _(spark, sf):
    ns = F.unix_micros("ts") * 1000
    back = F.timestamp_micros(F.floor(F.col("ns") / 1000))
    return hourly(spark, sf).select("symbol", ns.alias("ns")).withColumn("iso", F.date_format(back, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query("K05_calendar_fields", """SELECT hour(ts) AS h, isodow(ts) - 1 AS dow, week(ts) AS iso_week, month(ts) AS m, quarter(ts) AS q,
 day(last_day(ts)) AS month_days, count(*) AS n, sum(hour(ts) * 60 + minute(ts))::BIGINT AS minutes,
 sum(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS seconds FROM events GROUP BY ALL""")
def _(spark, sf):
    ts = F.col("ts")
    return T.table(spark, sf, "events").groupBy(
        F.hour(ts).alias("h"),
        F.weekday(ts).alias("dow"),
        F.weekofyear(ts).alias("iso_week"),
        F.month(ts).alias("m"),
        F.quarter(ts).alias("q"),
        cal.days_in_month(ts).alias("month_days"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cal.minute_of_day(ts)).alias("minutes"),
        F.sum(cal.second_of_day(ts)).alias("seconds"),
    )


@query("K06_month_position", """SELECT CASE WHEN day(l_shipdate) <= 10 THEN 'early' WHEN day(l_shipdate) <= 20 THEN 'mid' ELSE 'late' END
 AS part_of_month, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    t = T.table(spark, sf, "lineitem")
    return t.groupBy(cal.month_position(F.col("l_shipdate")).alias("part_of_month")).agg(F.count(F.lit(1)).alias("n"))


@query("K07_duration_bucket", sql(SLOT_TRADES, body="""SELECT hb, CASE WHEN hb * 20 <= 60 THEN '0-60m' ELSE '60-120m' END AS bucket, count(*) AS n
 FROM slot_trades GROUP BY ALL"""))
def _(spark, sf):
    return T.slot_trades(spark, sf).groupBy("hb", cal.duration_bucket(F.col("hb"), F.lit(20)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("K08_event_day", "SELECT strftime(ts, '%Y-%m-%d') AS event_day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return T.table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("event_day")).agg(F.count(F.lit(1)).alias("n"))


@query("K09_safe_divide", """SELECT l_linenumber, round(sum(CASE WHEN round(l_discount * 100) > 0 THEN l_quantity / (round(l_discount * 100)) END), 4) AS ratio,
 count(*) FILTER (round(l_discount * 100) = 0) AS undefined FROM lineitem GROUP BY 1""")
def _(spark, sf):
    d = F.round(F.col("l_discount") * 100)
    ratio = F.try_divide(F.col("l_quantity"), d)
    return T.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.round(F.sum(ratio), 4).alias("ratio"), F.count_if(ratio.isNull()).alias("undefined")
    )


@query("K10_tail_bound", """SELECT cell_id, round(least(1.0, exp(-0.5 * pow(abs(t), 2))), 6) AS p FROM (
 SELECT l_returnflag || '_' || l_linestatus AS cell_id, avg(l_quantity - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) AS t FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    t = F.try_divide(F.avg(F.col("l_quantity") - 25), F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1))))
    return T.table(spark, sf, "lineitem").groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("cell_id")).agg(
        F.least(F.lit(1.0), F.exp(-0.5 * F.pow(F.abs(t), F.lit(2)))).alias("p")
    )


@query("K11_clip_sign_log", sql(QUOTES, BARS, body="""SELECT symbol, ts, least(greatest(round(close - 102, 6), -1), 1) AS clipped,
 sign(round(close - 102, 6))::INTEGER AS side, round(ln(close), 6) AS log_close FROM bars"""))
def _(spark, sf):
    x = F.round(F.col("close") - 102, 6)
    return hourly(spark, sf).select(
        "symbol", "ts", F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)).alias("clipped"),
        F.signum(x).cast("int").alias("side"), F.log("close").alias("log_close"),
    )


@query("K12_finite_or_zero", """SELECT l_linenumber, count(*) FILTER (round(l_discount * 100) = 0) AS replaced,
 round(sum(CASE WHEN round(l_discount * 100) = 0 THEN 0 ELSE l_tax / round(l_discount * 100) END), 6) AS total FROM lineitem GROUP BY 1""")
def _(spark, sf):
    d = F.round(F.col("l_discount") * 100)
    raw = F.when(d == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.when(d == 0, 1.0).otherwise(d))
    return T.table(spark, sf, "lineitem").withColumn("raw", raw).groupBy("l_linenumber").agg(
        F.count_if(~quality.is_finite(F.col("raw"))).alias("replaced"), F.sum(quality.finite_or(F.col("raw"), 0.0)).alias("total")
    )


@query("K13_cell_id_parse", sql(SLOTS, _CELLS, body="""SELECT regexp_extract(cell_id, '^([A-Z]+)_(P[0-9])_([0-9]+)$', 1) AS event,
 regexp_extract(cell_id, '^([A-Z]+)_(P[0-9])_([0-9]+)$', 2) AS pair, regexp_extract(cell_id, '^([A-Z]+)_(P[0-9])_([0-9]+)$', 3)::INTEGER AS wo, cell_id FROM cells"""))
def _(spark, sf):
    pattern = "^([A-Z]+)_(P[0-9])_([0-9]+)$"
    part = lambda i: F.regexp_extract("cell_id", pattern, i)
    return cells(spark, sf).select("cell_id", part(1).alias("event"), part(2).alias("pair"), part(3).cast("int").alias("wo"))


@query("K14_slot_key", sql(SLOT_TRADES, body="""SELECT wo || '/' || hb || '/' || et AS slot_key, split_part(wo || '/' || hb || '/' || et, '/', 3) AS et, count(*) AS n
 FROM slot_trades GROUP BY ALL"""))
def _(spark, sf):
    key = F.concat_ws("/", F.col("wo").cast("string"), F.col("hb").cast("string"), "et")
    s = T.slot_trades(spark, sf).select(key.alias("slot_key")).groupBy("slot_key").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("et", F.split_part("slot_key", F.lit("/"), F.lit(3)))


@query("K15_split_prefix", """SELECT id, split_part(id, ':', 1) AS prefix, split_part(id, ':', 2) AS arg, CASE WHEN id LIKE '%:%:%' THEN regexp_replace(id, '^[^:]*:[^:]*:', '') END AS extra, n FROM (
 SELECT lower(o_orderstatus) || ':' || o_orderpriority || CASE WHEN month(o_orderdate) > 6 THEN ':h2:x' ELSE '' END AS id, count(*) AS n FROM orders GROUP BY 1)""")
def _(spark, sf):
    late = F.when(F.month("o_orderdate") > 6, ":h2:x").otherwise("")
    ids = F.concat(F.lower("o_orderstatus"), F.lit(":"), F.col("o_orderpriority"), late)
    o = T.table(spark, sf, "orders").groupBy(ids.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("id", ":", 3)
    return o.select("id", "n", F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("arg"), F.get(parts, F.lit(2)).alias("extra"))


@query("K16_normalise_identifier", """SELECT regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, count(*) AS n
 FROM orders GROUP BY 1""")
def _(spark, sf):
    return T.table(spark, sf, "orders").groupBy(tx.normalise_component(F.col("o_orderpriority")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("K17_canonical_json", """SELECT '{"balance":' || CAST(floor(c_acctbal) AS BIGINT) || ',"key":' || c_custkey || ',"place":{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}}' AS doc FROM customer""")
def _(spark, sf):
    doc = F.to_json(F.struct(
        F.floor("c_acctbal").cast("bigint").alias("balance"),
        F.col("c_custkey").alias("key"),
        F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"),
    ))
    return T.table(spark, sf, "customer").select(doc.alias("doc"))


@query("K18_row_fingerprint", """SELECT p_partkey, sha256(p_brand || '|' || p_type || '|' || printf('%.6f', p_retailprice)) AS digest,
 substr(sha256(p_brand || '|' || p_type || '|' || printf('%.6f', p_retailprice)), 1, 12) AS digest12 FROM part""")
def _(spark, sf):
    p = T.table(spark, sf, "part")
    digest = tx.fingerprint([F.col("p_brand"), F.col("p_type"), tx.fixed6(F.col("p_retailprice"))])
    return p.select("p_partkey", digest.alias("digest")).withColumn("digest12", F.substring("digest", 1, 12))


@query("K19_nested_path", """SELECT event_type, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS found,
 count(*) FILTER (json_extract_string(props, '$.k.deep') IS NULL) AS missing, sum(json_extract_string(props, '$.k')::INTEGER)::BIGINT AS total FROM events GROUP BY 1""")
def _(spark, sf):
    k, deep = F.get_json_object("props", "$.k"), F.get_json_object("props", "$.k.deep")
    return T.table(spark, sf, "events").groupBy("event_type").agg(
        F.count_if(k.isNotNull()).alias("found"), F.count_if(deep.isNull()).alias("missing"), F.sum(k.cast("int")).alias("total")
    )


@query("K20_array_predicates", """SELECT label, count(*) AS n, count(*) FILTER (len(list_filter(embedding, lambda x: x > 0.1)) > 0) AS any_high,
 count(*) FILTER (len(list_filter(embedding, lambda x: abs(x) >= 0.5)) = 0) AS all_small, sum(len(list_filter(embedding, lambda x: x > 0)))::BIGINT AS positives,
 round(sum(embedding[1]::DOUBLE), 4) AS firsts FROM embeddings GROUP BY 1""")
def _(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.exists("embedding", lambda x: x > 0.1)).alias("any_high"),
        F.count_if(F.forall("embedding", lambda x: F.abs(x) < 0.5)).alias("all_small"),
        F.sum(F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint")).alias("positives"),
        F.round(F.sum(F.element_at("embedding", 1).cast("double")), 4).alias("firsts"),
    )


@query("K21_sign_rule", sql(SLOTS, body="""SELECT fee, sum((CASE WHEN trades = 0 OR pf IS NULL THEN 0 WHEN pf >= 1 THEN 1 ELSE -1 END))::BIGINT AS net_sign,
 count(*) FILTER (pf >= 1) AS longs FROM slots GROUP BY fee"""))
def _(spark, sf):
    s = T.slot_reports(spark, sf)
    sign = quality.sign_of(F.col("trades"), F.col("pf"))
    return s.groupBy("fee").agg(F.sum(sign).alias("net_sign"), F.count_if(sign == 1).alias("longs"))


_ENT = "trim(regexp_replace(" + "replace(" * 6 + "regexp_replace(raw, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("K22_html_paragraphs", f"""SELECT page_id, url, i - 1 AS para_no, {_ENT} AS paragraph FROM (
 SELECT page_id, url, unnest(x) AS raw, generate_subscripts(x, 1) AS i FROM (
  SELECT page_id, url, regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS x FROM pages)) WHERE {_ENT} <> ''""")
def _(spark, sf):
    return tx.paragraphs(T.table(spark, sf, "pages"))


@query("K23_link_extraction", """SELECT page_id, url, i - 1 AS link_no, href, regexp_extract(href, '([a-z]+)$', 1) AS tail FROM (
 SELECT page_id, url, unnest(x) AS href, generate_subscripts(x, 1) AS i FROM (
  SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS x FROM pages)) WHERE regexp_matches(href, '^/[a-z]+$')""")
def _(spark, sf):
    found = tx.links(T.table(spark, sf, "pages"), "^/[a-z]+$")
    return found.withColumn("tail", F.regexp_extract("href", "([a-z]+)$", 1))

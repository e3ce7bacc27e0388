"""Sources, sinks and streams: each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import trades as tr
from barline.operators.bars import ticks_to_bars
from barline.operators.rules import apply_rule
from barline.plans.aggs import tally
from barline.plans.books import QB, gated
from barline.plans.checks import BARS, BARS4, QUOTES, REFERENCE, SLOTS, TRADES, sql
from barline.plans.registry import query
from barline.plans.rulesets import K
from barline.plans.shapes import four_hourly, hourly, rows_as
from barline.session import scratch_path
from barline.sources import files
from barline.sources import tables as T
from barline.streaming import jobs

ALL_BARS = """allbars AS (SELECT make_timestamp(us // 3600000000 * 3600000000) AS ts, arg_min((bid + ask) / 2, (us, event_id)) AS open, max((bid + ask) / 2) AS high, min((bid + ask) / 2) AS low, arg_max((bid + ask) / 2, (us, event_id)) AS close, sum(bid_vol + ask_vol) AS volume FROM quotes GROUP BY us // 3600000000)"""
_ALL = "SELECT epoch_ns(ts) AS datetime_ns, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM allbars"


def market_bars(spark, sf):
    """Hourly bars over the ticks of all symbols together."""
    return ticks_to_bars(T.quotes(spark, sf).withColumn("symbol", F.lit("ALL")), "1h")


@query("A01_strict_parquet", sql(QUOTES, ALL_BARS, body=_ALL))
def _(spark, sf):
    path = scratch_path(spark, "bars")
    files.bar_file(market_bars(spark, sf)).write.parquet(path)
    return files.read_bars_parquet(spark, path)


@query("A02_strict_csv", sql(QUOTES, ALL_BARS, body=_ALL))
def _(spark, sf):
    path = scratch_path(spark, "bars-csv")
    files.bar_file(market_bars(spark, sf)).write.option("header", True).csv(path)
    return files.read_bars_csv(spark, path)


def tick_text(spark, sf):
    return T.quotes(spark, sf).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), "bid", "ask", "bid_vol", "ask_vol"
    )


_TICKSUM = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum((bid + ask) / 2), 4) AS price_sum, sum({v}) AS volume FROM quotes GROUP BY 1"


def tick_sums(ticks):
    return ticks.groupBy(F.date_trunc("day", "ts").alias("day")).agg(rows_as("n"), F.round(F.sum("price"), 4).alias("price_sum"), F.sum("volume").alias("volume"))


@query("A03_tick_csv_aliases", sql(QUOTES, body=_TICKSUM.format(v="bid_vol")))
def _(spark, sf):
    path = scratch_path(spark, "ticks-csv")
    named = tick_text(spark, sf).select(F.col("time").alias("Gmt time"), F.col("bid").alias("Bid_Price"), F.col("ask").alias("AskPrice"), F.col("bid_vol").alias("BidVolume"))
    named.write.option("header", True).csv(path)
    return tick_sums(files.read_ticks_csv(spark, path))


@query("A04_glob_braces", sql(QUOTES, body=_TICKSUM.format(v="bid_vol + ask_vol")))
def _(spark, sf):
    path = scratch_path(spark, "ticks-glob")
    tick_text(spark, sf).withColumnsRenamed({"bid_vol": "bidVolume", "ask_vol": "askVolume"}).write.partitionBy("symbol").option("header", True).csv(path)
    return tick_sums(files.read_ticks_csv(spark, f"{path}/symbol=*/*.{{csv,csv.gz}}"))


@query("A05_timestamp_forms", """SELECT (event_id % 5)::INTEGER AS form, count(*) AS n, CASE WHEN event_id % 5 = 4 THEN NULL ELSE sum(epoch(date_trunc('second', ts))::BIGINT)::BIGINT END AS seconds FROM events GROUP BY event_id % 5""")
def _(spark, sf):
    ts, form = F.date_trunc("second", "ts"), (F.col("event_id") % 5).cast("int")
    text = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, F.date_format(ts, "yyyy.MM.dd HH:mm:ss"))
        .when(form == 3, (F.unix_seconds(ts) * 1000).cast("string"))
        .otherwise("not a time")
    )
    e = T.table(spark, sf, "events").select(form.alias("form"), text.alias("text"))
    return e.groupBy("form").agg(rows_as("n"), F.sum(F.unix_seconds(files.tick_time(F.col("text")))).alias("seconds"))


def stored(spark, sf):
    path = scratch_path(spark, "store")
    both = hourly(spark, sf).withColumn("tf", F.lit("1h")).unionByName(four_hourly(spark, sf).withColumn("tf", F.lit("4h")))
    files.write_bar_store(both, path)
    return path


@query("A06_filtered_bars", sql(*QB, body="SELECT symbol, ts, round(close, 6) AS close, volume FROM bars WHERE symbol = 'view' AND ts >= (SELECT max(ts) FROM bars WHERE symbol = 'view') - INTERVAL 7 DAY"))
def _(spark, sf):
    return files.read_bar_store(spark, stored(spark, sf), "view", "1h", 7).select("symbol", "ts", "close", "volume")


@query("A07_store_metadata", sql(QUOTES, BARS, BARS4, body="SELECT symbol, '1h' AS tf, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts FROM bars GROUP BY 1 UNION ALL SELECT symbol, '4h', count(*), min(ts), max(ts) FROM bars4 GROUP BY 1"))
def _(spark, sf):
    return files.store_metadata(spark, stored(spark, sf))


@query("A08_month_shards", "SELECT event_type AS symbol, strftime(ts, '%Y-%m') AS month, count(*) AS n, 0 AS second_run FROM events GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "shards")
    q = T.quotes(spark, sf)
    files.write_tick_shards(q, path)
    again = files.write_tick_shards(q, path)
    return spark.read.parquet(path).groupBy("symbol", "month").agg(rows_as("n")).withColumn("second_run", F.lit(again))


@query("A09_ohlcv_sink", sql(*QB, body="SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"))
def _(spark, sf):
    path = scratch_path(spark, "ohlcv")
    bars = hourly(spark, sf)
    bars.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.parquet(path)
    return spark.read.schema(bars.schema).parquet(path)


@query("A10_column_normalisation", sql(*QB, body="SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"))
def _(spark, sf):
    odd = hourly(spark, sf).withColumnsRenamed({"ts": "Datetime", "open": "OPEN", "high": "USDJPY_High", "low": "usdjpy_low", "close": "Close", "volume": "VOLUME"})
    return files.normalise_ohlcv(odd)


@query("A12_trace_sink", sql(TRADES, body="SELECT cell_id, count(DISTINCT ts) AS n, 'run-1' AS run_id FROM trades GROUP BY 1"))
def _(spark, sf):
    path = scratch_path(spark, "traces")
    files.write_traces(gated(spark, sf), path, {"run_id": "run-1"})
    return spark.read.parquet(path).groupBy("cell_id", "run_id").agg(rows_as("n"))


@query("A13_table_by_date", "SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "by-date")
    files.write_partitioned_by_date(T.quotes(spark, sf), "ts", path)
    return spark.read.parquet(path).groupBy("date").agg(rows_as("n"))


@query("A15_slot_report_json", sql(SLOTS, body="SELECT event, pair, wo, hb, et, fee, trades, round(pf, 6) AS pf FROM slots"))
def _(spark, sf):
    path = scratch_path(spark, "reports")
    s = T.slot_reports(spark, sf).groupBy("event", "pair", "wo", "hb", "et").agg(F.collect_list(F.struct("fee", "trades", "pf")).alias("fee_results"))
    flat = s.filter("event IN ('BOJ', 'ECB')")
    # One nested document per event, pair and offset (twelve slots each).
    nested = s.filter("event NOT IN ('BOJ', 'ECB')").groupBy("event", "pair", "wo").agg(
        F.collect_list(F.struct("event", "pair", "wo", "hb", "et", "fee_results")).alias("slots")
    ).select("slots")
    flat.write.json(path + "/flat")
    nested.write.json(path + "/nested")
    return files.read_slot_reports(spark, path + "/*")


@query("A16_tally_json", sql(SLOTS, body="SELECT event, pair, wo, hb, et, count(*) FILTER (sign = 1) AS long, count(*) FILTER (sign = 0) AS neutral, count(*) FILTER (sign = -1) AS short FROM slots GROUP BY ALL"))
def _(spark, sf):
    t = tally(T.slot_reports(spark, sf)).withColumn("slot", F.concat_ws("/", F.col("wo").cast("string"), F.col("hb").cast("string"), "et"))
    per_event = t.groupBy("pair", "event").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("long", "neutral", "short")))).alias("m"))
    docs = per_event.select("pair", F.to_json(F.create_map("event", "m")).alias("doc"))
    return files.tally_rows(docs, "doc")


@query("A17_trade_log_jsonl", sql(*QB, body="SELECT symbol, count(*) AS trades, count(*) * 12 AS bars FROM (SELECT symbol, epoch(ts)::BIGINT // 3600 AS h, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE h % 6 = 0 AND rn >= 14 AND rn + 12 <= n GROUP BY 1"))
def _(spark, sf):
    path = scratch_path(spark, "trade-log")
    tr.bar_trades(hourly(spark, sf), 6, 12).write.json(path)
    log = files.read_trade_log(spark, path)
    return log.groupBy("symbol").agg(rows_as("trades"), F.sum(F.size("bars").cast("bigint")).alias("bars"))


@query("A18_gzip_csv_scan", sql(QUOTES, body="SELECT count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS min_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS max_ts, 'symbol,time,bid,ask,bid_vol,ask_vol' AS columns FROM quotes"))
def _(spark, sf):
    path = scratch_path(spark, "gzip")
    tick_text(spark, sf).write.option("header", True).option("compression", "gzip").csv(path)
    return files.scan_gzip_csv(spark, path, "time")


@query("A19_observations_json", sql(REFERENCE, body="SELECT ts::DATE AS date, round(value, 6) AS value FROM reference WHERE day(ts) <> 13"))
def _(spark, sf):
    r = T.reference_series(spark, sf)
    value = F.when(F.dayofmonth("ts") == 13, ".").otherwise(F.col("value").cast("string"))
    one = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value"))
    docs = r.groupBy(F.date_trunc("month", "ts").alias("m")).agg(F.to_json(F.struct(F.collect_list(one).alias("observations"))).alias("doc"))
    return files.observations(docs.select("doc"), "doc")


@query("A20_metric_sinks", sql(SLOTS, body="SELECT event, fee, count(*) AS n, count(*) FILTER (passed) AS passes FROM slots GROUP BY ALL"))
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    m = T.slot_reports(spark, sf).groupBy("event", "fee").agg(rows_as("n"), F.count_if("passed").alias("passes"))
    m.write.option("header", True).csv(path + "/csv")
    m.write.json(path + "/json")
    a = spark.read.schema(m.schema).option("header", True).csv(path + "/csv")
    b = spark.read.schema(m.schema).json(path + "/json")
    # Both forms hold the same rows.
    return a.join(b, ["event", "fee", "n", "passes"], "left_semi").select("event", "fee", "n", "passes")


@query("A21_ledger_append", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "ledger")
    jobs.append_ledger(jobs.tick_stream(spark, sf), path)
    return spark.read.parquet(path).groupBy("symbol").agg(rows_as("n"))


# ---- M: streaming ----------------------------------------------------------------


@query("M01_stream_bars", sql(*QB, body="SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM quotes) - INTERVAL 1 HOUR"))
def _(spark, sf):
    return jobs.drain(jobs.stream_bars(jobs.tick_stream(spark, sf), "1h"))


def position_ledger(spark, sf, **limits):
    """Positions of the moving-average signal, streamed over hourly bars."""
    path = scratch_path(spark, "signals")
    s = apply_rule("sma_cross", hourly(spark, sf), K)
    rows = s.select(F.col("symbol").alias("slot"), "ts", F.col("close").alias("price"), F.col("position").alias("signal"))
    rows.write.parquet(path)
    stream = spark.readStream.schema("slot STRING, ts TIMESTAMP, price DOUBLE, signal INT").parquet(path)
    return jobs.drain(jobs.stream_positions(stream, **limits))


_LED = """ps AS (SELECT symbol, ts, close, CASE WHEN s > l THEN 1 WHEN s < l THEN -1 ELSE 0 END AS signal, rn FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) END AS s,
 CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END AS l, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)),
pq AS (SELECT *, signal = 1 AND rn >= 50 AS on_, coalesce(lag(signal = 1 AND rn >= 50) OVER (PARTITION BY symbol ORDER BY ts), false) AS was FROM ps),
led AS (SELECT *, CASE WHEN on_ AND NOT was THEN 'entry' WHEN on_ THEN 'hold' WHEN was THEN 'exit' END AS action FROM pq),
lx AS (SELECT *, last_value(CASE WHEN action = 'entry' THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS ep FROM led WHERE action IS NOT NULL),
ly AS (SELECT *, CASE WHEN action = 'exit' THEN (close - ep) / ep * 2 * 1000 END AS gross, CASE WHEN action = 'exit' THEN 1000 * 2 * 4 / 10000.0::DOUBLE END AS cost FROM lx),
lz AS (SELECT *, 1000 + sum(coalesce(gross - cost, 0)) OVER (PARTITION BY symbol ORDER BY ts) AS equity FROM ly)"""


@query("M02_position_states", sql(*QB, _LED, body="SELECT symbol AS slot, ts, action, rn AS bars_seen FROM lz"))
def _(spark, sf):
    return position_ledger(spark, sf).select("slot", "ts", "action", "bars_seen")


@query("M03_margin_check")
def _(spark, sf):
    led = position_ledger(spark, sf, leverage=10.0, maintenance=0.85)
    return led.groupBy("slot", "action").agg(rows_as("n"), F.min("signal").alias("lowest_signal"))


@query("M04_net_ledger_rows", sql(*QB, _LED, body="SELECT symbol AS slot, ts, round(gross, 5) + 0.0 AS gross, cost, round(gross - cost, 5) + 0.0 AS net FROM lz WHERE action = 'exit'"))
def _(spark, sf):
    led = position_ledger(spark, sf).filter("action = 'exit'")
    return led.select("slot", "ts", F.round("gross", 5).alias("gross"), "cost", F.round("net", 5).alias("net"))


@query("M05_equity_snapshots", sql(*QB, _LED, body="SELECT symbol AS slot, round(arg_max(equity, ts), 4) AS equity, round(arg_max(equity, ts) / 10 - 100, 4) + 0.0 AS return_pct FROM lz GROUP BY 1"))
def _(spark, sf):
    led = position_ledger(spark, sf)
    last = led.groupBy("slot").agg(F.max_by("equity", "ts").alias("equity"))
    return last.select("slot", F.round("equity", 4).alias("equity"), F.round(F.col("equity") / 10 - 100, 4).alias("return_pct"))


@query("M06_minimum_history", sql(*QB, _LED, body="SELECT symbol AS slot, min(rn) >= 50 AS respected FROM lz GROUP BY 1"))
def _(spark, sf):
    return position_ledger(spark, sf).groupBy("slot").agg((F.min("bars_seen") >= 50).alias("respected"))


@query("M07_stream_daily_pnl", sql(TRADES, body="SELECT ts AS day, count(*) AS exits, sum(pnl) AS realised FROM trades WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM trades) - INTERVAL 1 DAY GROUP BY 1"))
def _(spark, sf):
    raw = spark.readStream.schema(T.SCHEMAS["lineitem"]).option("pathGlobFilter", "lineitem*.parquet").parquet(sf)
    pnl = (F.round(F.col("l_discount") * 100) - 5) * 10 + (F.round(F.col("l_tax") * 100) - 4) + (F.col("l_quantity") - 25)
    return jobs.drain(jobs.daily_realised(raw.select(F.col("l_shipdate").alias("ts"), pnl.alias("pnl"))))


@query("M08_ingest_once", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    twice = jobs.tick_stream(spark, sf).unionByName(jobs.tick_stream(spark, sf))
    return jobs.drain(jobs.deduplicated(twice)).groupBy("symbol").agg(rows_as("n"))


@query("M09_batch_stream_parity", sql(*QB, body="SELECT 0::BIGINT AS stream_only, 0::BIGINT AS batch_only, count(*) AS bars FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM quotes) - INTERVAL 1 HOUR"))
def _(spark, sf):
    live = jobs.drain(jobs.stream_bars(jobs.tick_stream(spark, sf), "1h"))
    q = T.quotes(spark, sf)
    batch = ticks_to_bars(q, "1h").filter(F.col("ts") + F.expr("INTERVAL 2 HOURS") <= q.agg(F.max("ts")).scalar())
    cols = ["symbol", "ts", *files.OHLCV]
    tagged = live.select(*cols, F.lit(1).alias("s"), F.lit(0).alias("b")).unionByName(batch.select(*cols, F.lit(0).alias("s"), F.lit(1).alias("b")))
    rows = tagged.groupBy(*cols).agg(F.max("s").alias("s"), F.max("b").alias("b"))
    return rows.agg(
        F.count_if((F.col("s") == 1) & (F.col("b") == 0)).alias("stream_only"),
        F.count_if((F.col("b") == 1) & (F.col("s") == 0)).alias("batch_only"),
        F.count_if(F.col("s") == 1).alias("bars"),
    )

"""The input tables, and the market-data shapes derived from them.

Every derivation is a plain expression over the given tables, so its cost grows
with them.  ``events`` become quote ticks, ``lineitem`` trades and daily
prices, ``orders`` a slower reference series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import prepare

# Fixed column types of the input tables (timestamps are read as UTC instants).
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# Fixed values of the slot grid.
SLOT_EVENTS = ("BOJ", "ECB", "FOMC", "NFP")
SLOT_PAIRS = ("P0", "P1", "P2", "P3")
FEE_LEVELS_BPS = (0.0, 1.0, 2.0, 3.0, 5.0)
WINDOW_OFFSETS = 16
HOLD_STEPS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote ticks: one row per event, ordered by ``(ts, event_id)`` per symbol."""
    mid = 100 + F.col("value") / 100
    half = 0.01 + 0.002 * (F.col("event_id") % 5).cast("double")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        micros(F.col("ts")).alias("us"),
        "event_id",
        (mid - half).alias("bid"),
        (mid + half).alias("ask"),
        (k % 7).cast("double").alias("bid_vol"),
        (F.col("event_id") % 5).cast("double").alias("ask_vol"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: integer-valued pnl in bps, a cell, a fold and a total order."""
    pnl = (
        (F.round(F.col("l_discount") * 100) - 5) * 10
        + (F.round(F.col("l_tax") * 100) - 4)
        + (F.col("l_quantity") - 25)
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("pair"),
        F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("cell_id"),
        (F.col("l_suppkey") % 3).cast("int").alias("fold"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("notional"),
        pnl.alias("pnl"),
    )


# A total order of trades inside any key.
TRADE_ORDER = ("ts", "ok", "ln", "pk", "sk")


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per return flag; at most one row per symbol and day."""
    px = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 1000
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("day", "l_shipdate").alias("ts"))
        .agg(
            F.min_by(px, seq).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, seq).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def reference_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slower daily series: order value in whole units, summed per day."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("day", "o_orderdate").alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("o_totalprice")).alias("total"))
        .select("ts", (F.col("total") / F.col("n")).alias("value"))
    )


def slot_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades keyed by event study slot (event, pair, offset, hold, exit type)."""
    return table(spark, sf_dir, "lineitem").select(
        F.element_at(F.array(*[F.lit(e) for e in SLOT_EVENTS]), (F.col("l_orderkey") % 4 + 1).cast("int")).alias(
            "event"
        ),
        F.concat(F.lit("P"), (F.col("l_suppkey") % 4).cast("string")).alias("pair"),
        (F.col("l_partkey") % WINDOW_OFFSETS).cast("int").alias("wo"),
        (F.col("l_linenumber") % HOLD_STEPS + 1).cast("int").alias("hb"),
        F.when(F.col("l_quantity") % 2 == 0, "none").otherwise("fixed_pct").alias("et"),
        (
            (F.round(F.col("l_discount") * 100) - 5) * 10
            + (F.round(F.col("l_tax") * 100) - 4)
            + (F.col("l_quantity") - 25)
        ).alias("pnl"),
    )


def slot_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot x fee results.

    At most events x pairs x offsets x holds x exits x fees = 15,360 rows,
    whatever the size of ``lineitem``.
    """
    fees = F.explode(F.array(*[F.lit(f) for f in FEE_LEVELS_BPS]))
    net = F.col("pnl") - 10 * F.col("fee")
    gross_profit = F.sum(F.when(net > 0, net).otherwise(0.0))
    gross_loss = F.sum(F.when(net < 0, -net).otherwise(0.0))
    return (
        slot_trades(spark, sf_dir)
        .withColumn("fee", fees)
        .groupBy("event", "pair", "wo", "hb", "et", "fee")
        .agg(
            F.count(F.lit(1)).alias("trades"),
            gross_profit.alias("gp"),
            gross_loss.alias("gl"),
            F.sum(net).alias("net_sum"),
        )
        .withColumn("pf", F.try_divide("gp", "gl"))
        .withColumn("passed", F.coalesce(F.col("pf") >= 1.1, F.lit(False)) & (F.col("trades") >= 5))
        .withColumn("sign", F.when(F.col("pf").isNull(), 0).when(F.col("pf") >= 1.0, 1).otherwise(-1))
    )


FAST_ORIGIN_US = 1_704_067_200_000_000


def fast_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote ticks with the clock run 60 times faster (dense tick series)."""
    us = F.floor((F.col("us") - FAST_ORIGIN_US) / 60) + FAST_ORIGIN_US
    return quotes(spark, sf_dir).withColumn("us", us).withColumn("ts", F.timestamp_micros("us"))

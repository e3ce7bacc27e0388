"""Structured Streaming jobs: bars, daily pnl, ingest, ledger, positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barline.operators.bars import TIMEFRAME_MINUTES
from barline.session import scratch_path
from barline.sources.tables import SCHEMAS

MIN_HISTORY = 50
LIQUIDATION = -99


#: Files of one micro-batch, so that a backlog comes in bounded batches.
MAX_FILES = 64


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote ticks from the events files as a stream (derived as in batch)."""
    mid = 100 + F.col("value") / 100
    half = 0.01 + 0.002 * (F.col("event_id") % 5).cast("double")
    raw = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", MAX_FILES).parquet(sf_dir)
    return raw.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.unix_micros("ts").alias("us"),
        "event_id",
        (mid - half).alias("bid"),
        (mid + half).alias("ask"),
        (F.get_json_object("props", "$.k").cast("int") % 7).cast("double").alias("bid_vol"),
        (F.col("event_id") % 5).cast("double").alias("ask_vol"),
    )


def stream_bars(ticks: DataFrame, timeframe: str, late: str = "1 hour") -> DataFrame:
    """Tumbling OHLCV bars; a bar is final once the watermark passes its end."""
    mid, seq = (F.col("bid") + F.col("ask")) / 2, F.struct("us", "event_id")
    span = f"{TIMEFRAME_MINUTES[timeframe]} minutes"
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", span)).agg(
        F.min_by(mid, seq).alias("open"),
        F.max(mid).alias("high"),
        F.min(mid).alias("low"),
        F.max_by(mid, seq).alias("close"),
        F.sum(F.coalesce("bid_vol", F.lit(0.0)) + F.coalesce("ask_vol", F.lit(0.0))).alias("volume"),
    )
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def deduplicated(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_realised(closes: DataFrame, late: str = "1 day") -> DataFrame:
    """Realised pnl per day of a stream of closed trades."""
    return closes.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("exits"), F.sum("pnl").alias("realised")
    ).select(F.col("window.start").alias("day"), "exits", "realised")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all input present and read what it wrote."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, "sink"), scratch_path(spark, "check")
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", check)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def append_ledger(stream: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Append what has arrived to a ledger table, each row once.

    The checkpoint lies beside the table unless another place is named, so a
    restart goes on where the last call ended.
    """
    q = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or f"{path.rstrip('/')}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


LEDGER = (
    "slot STRING, action STRING, ts TIMESTAMP, price DOUBLE, signal INT, gross DOUBLE, cost DOUBLE, net DOUBLE, "
    "equity DOUBLE, bars_seen BIGINT"
)


class PositionBook(StatefulProcessor):
    """One slot's position: entry on +1, hold on +1, exit on anything else.

    Input rows ``slot, ts, price, signal``.  A slot acts only after enough bars;
    an open position is liquidated when its margin ratio falls to the limit,
    before the signal is looked at.
    """

    def __init__(self, capital: float, leverage: float, cost_bps: float, maintenance: float, min_history: int):
        self.capital, self.leverage, self.cost_bps = capital, leverage, cost_bps
        self.maintenance, self.min_history = maintenance, min_history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", "entry DOUBLE, realised DOUBLE, bars BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entry, realised, bars = self.book.get() if self.book.exists() else (None, 0.0, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            bars += 1
            action, gross, cost = None, None, None
            signal = int(row.signal)
            if entry is not None:
                open_gain = (row.price - entry) / entry * self.leverage
                if 1.0 + open_gain <= self.maintenance:
                    action, signal = "liquidate", LIQUIDATION
                elif bars >= self.min_history:
                    action = "hold" if signal == 1 else "exit"
                if action in ("liquidate", "exit"):
                    gross = open_gain * self.capital
                    cost = self.capital * self.leverage * self.cost_bps / 1e4
                    realised += gross - cost
                    entry = None
            elif bars >= self.min_history and signal == 1:
                action, entry = "entry", row.price
            if action:
                net = None if gross is None else gross - cost
                out.append((key[0], action, row.ts, row.price, signal, gross, cost, net, self.capital + realised, bars))
        self.book.update((entry, realised, bars))
        names = [c.split()[0] for c in LEDGER.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"bars_seen": "int64", "signal": "int32"})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; a store the cluster chose stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_positions(signals: DataFrame, capital: float = 1000.0, leverage: float = 2.0, cost_bps: float = 4.0, maintenance: float = 0.5, min_history: int = MIN_HISTORY) -> DataFrame:
    """Ledger rows of every slot."""
    use_state_store(signals.sparkSession)
    return signals.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=PositionBook(capital, leverage, cost_bps, maintenance, min_history),
        outputStructType=LEDGER,
        outputMode="Append",
        timeMode="None",
    )

"""Reading and writing bars, ticks, reports and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.operators.quality import is_finite

# Fixed column order and types of the bar files.
BAR_FILE = "datetime_ns BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
OHLCV = ("open", "high", "low", "close", "volume")
# Accepted names of tick columns.
TICK_ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "gmt time", "date"),
    "bid": ("bid", "bidprice", "bid_price"),
    "ask": ("ask", "askprice", "ask_price"),
    "bid_vol": ("bidvolume", "bid_volume", "bidvol"),
    "ask_vol": ("askvolume", "ask_volume", "askvol"),
}


class ContractError(ValueError):
    """The file does not have the agreed shape."""


def _require_schema(found: T.StructType, wanted: T.StructType) -> None:
    have = [(f.name, f.dataType) for f in found.fields]
    want = [(f.name, f.dataType) for f in wanted.fields]
    if have != want:
        raise ContractError(f"columns {have} instead of {want}")


def _require_no_nulls(df: DataFrame) -> None:
    """One aggregate over the file; a single row reaches the driver."""
    bad = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    broken = {c: n for c, n in bad.items() if n}
    if broken:
        raise ContractError(f"nulls in {broken}")


def read_bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Bar file with exactly the six columns, in order, typed and non-null."""
    raw = spark.read.parquet(path)
    _require_schema(raw.schema, T._parse_datatype_string(BAR_FILE))
    _require_no_nulls(raw)
    return raw.withColumn("ts", F.timestamp_micros(F.floor(F.col("datetime_ns") / 1000)))


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bar CSV with the exact header; a malformed row fails the job."""
    raw = (
        spark.read.schema(BAR_FILE)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.withColumn("ts", F.timestamp_micros(F.floor(F.col("datetime_ns") / 1000)))


def bar_file(bars: DataFrame) -> DataFrame:
    """Bars in file form."""
    return bars.select((F.unix_micros("ts") * 1000).alias("datetime_ns"), *OHLCV)


def _alias(columns: Sequence[str], name: str) -> Column | None:
    lower = {c.strip().lower(): c for c in columns}
    found = [F.col(f"`{lower[a]}`") for a in TICK_ALIASES[name] if a in lower]
    return F.coalesce(*found) if found else None


def read_ticks_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tick CSVs with any known header spelling: ``ts, price, volume``.

    ``paths`` may be globs, braces included; no match is an error.  The price is
    the mid, missing volumes count as 0.
    """
    raw = spark.read.option("header", True).csv(paths)
    parts = {n: _alias(raw.columns, n) for n in TICK_ALIASES}
    missing = [n for n in ("timestamp", "bid", "ask") if parts[n] is None]
    if missing:
        raise ContractError(f"no column for {missing}")
    number = lambda c: F.lit(0.0) if c is None else F.coalesce(c.cast("double"), F.lit(0.0))
    return raw.select(
        tick_time(parts["timestamp"]).alias("ts"),
        ((parts["bid"].cast("double") + parts["ask"].cast("double")) / 2).alias("price"),
        (number(parts["bid_vol"]) + number(parts["ask_vol"])).alias("volume"),
    )


def tick_time(text: Column) -> Column:
    """Timestamp from several text forms; NULL when none fits."""
    forms = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSS]'Z'", "yyyy.MM.dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss[.SSS]")
    epoch = F.when(text.rlike("^[0-9]{10,13}$"), F.timestamp_millis(F.regexp_extract(text, "^([0-9]{10,13})$", 1).try_cast("bigint")))
    return F.coalesce(epoch, *[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def write_bar_store(bars: DataFrame, path: str) -> None:
    """Bars partitioned by symbol and timeframe, in time order inside files."""
    (
        bars.repartitionByRange("symbol", "tf", "ts")
        .sortWithinPartitions("symbol", "tf", "ts")
        .write.partitionBy("symbol", "tf")
        .mode("append")
        .parquet(path)
    )


def read_bar_store(spark: SparkSession, path: str, symbol: str | None, tf: str, days: int | None = None) -> DataFrame:
    """Bars of a symbol and timeframe, optionally the last days of the data.

    Only the wanted partitions are read; rows with a non-finite value are left
    out.  An unknown symbol gives no rows.
    """
    df = spark.read.parquet(path).filter(F.col("tf") == tf)
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    if days is not None:
        df = df.filter(F.col("ts") >= df.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {days} DAYS"))
    finite = F.lit(True)
    for c in OHLCV:
        finite = finite & is_finite(F.col(c))
    return df.filter(finite)


def store_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Row count and time span per symbol and timeframe."""
    df = spark.read.parquet(path)
    return df.groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def write_tick_shards(ticks: DataFrame, path: str) -> int:
    """Append month shards that are not there yet; returns the shards written.

    Present shards are skipped, so a repeated run adds nothing.  A hot symbol
    and month is spread over several files.
    """
    spark = ticks.sparkSession
    work = ticks.withColumn("month", F.date_format("ts", "yyyy-MM"))
    have = existing_shards(spark, path)
    if have is not None:
        work = work.join(have, ["symbol", "month"], "left_anti")
    fresh = work.select("symbol", "month").distinct().count()
    if fresh:
        work.repartitionByRange("symbol", "month", "ts").sortWithinPartitions("symbol", "month", "ts").write.partitionBy(
            "symbol", "month"
        ).mode("append").parquet(path)
    return fresh


def existing_shards(spark: SparkSession, path: str) -> DataFrame | None:
    """(symbol, month) pairs present: partition values only, one row per shard."""
    try:
        return spark.read.parquet(path).select("symbol", "month").distinct()
    except Exception as e:  # the path does not exist yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_partitioned_by_date(df: DataFrame, ts: str, path: str) -> None:
    """Replace a table, partitioned by date and ordered by time inside."""
    dated = df.withColumn("date", F.to_date(ts))
    dated.repartitionByRange("date", ts).sortWithinPartitions("date", ts).write.partitionBy("date").mode("overwrite").parquet(path)


def normalise_ohlcv(df: DataFrame) -> DataFrame:
    """Rename columns to ts, open..volume by exact or suffix match, any case."""
    wanted = {"ts": ("datetime", "date", "timestamp", "time", "ts"), **{c: (c,) for c in OHLCV}}
    rename = {}
    for name, options in wanted.items():
        exact = [c for c in df.columns if c.lower() in options]
        suffix = [c for c in df.columns if any(c.lower().endswith(f"_{o}") for o in options)]
        hit = exact or suffix
        if not hit:
            raise ContractError(f"no column for {name}")
        rename[hit[0]] = name
    return df.withColumnsRenamed(rename)


def write_traces(df: DataFrame, path: str, stamp: dict[str, str], files: int = 4) -> None:
    """Drawdown traces by cell, with the run's stamp as columns; a cell's rows go to a few files."""
    part = F.pmod(F.xxhash64("ts"), F.lit(files))
    placed = df.withColumns({k: F.lit(v) for k, v in stamp.items()}).repartition("cell_id", part)
    placed.write.partitionBy("cell_id").mode("overwrite").parquet(path)


SLOT_FIELDS = (
    "event STRING, pair STRING, wo INT, hb INT, et STRING, "
    "fee_results ARRAY<STRUCT<fee: DOUBLE, trades: BIGINT, pf: DOUBLE>>"
)


def read_slot_reports(spark: SparkSession, path: str) -> DataFrame:
    """Slot reports in either layout (rows, or ``{slots: [...]}``), one row per fee."""
    raw = spark.read.schema(f"{SLOT_FIELDS}, slots ARRAY<STRUCT<{SLOT_FIELDS}>>".replace("STRUCT<event STRING, pair STRING, wo INT, hb INT, et STRING, fee_results", "STRUCT<event: STRING, pair: STRING, wo: INT, hb: INT, et: STRING, fee_results:")).json(path)
    flat = raw.filter("slots IS NULL").select("event", "pair", "wo", "hb", "et", "fee_results")
    nested = raw.filter("slots IS NOT NULL").select(F.explode("slots").alias("s")).select("s.*")
    both = flat.unionByName(nested)
    return both.select("event", "pair", "wo", "hb", "et", F.explode("fee_results").alias("f")).select("event", "pair", "wo", "hb", "et", "f.*")


def tally_rows(docs: DataFrame, doc: str) -> DataFrame:
    """``{event: {"wo/hb/et": {long, neutral, short}}}`` documents to rows."""
    schema = "MAP<STRING, MAP<STRING, STRUCT<long: BIGINT, neutral: BIGINT, short: BIGINT>>>"
    events = docs.select(*[c for c in docs.columns if c != doc], F.explode(F.from_json(doc, schema)).alias("event", "slots"))
    rows = events.select(*[c for c in events.columns if c != "slots"], F.explode("slots").alias("slot", "t"))
    part = lambda i: F.split_part("slot", F.lit("/"), F.lit(i))
    return rows.select(
        *[c for c in rows.columns if c not in ("slot", "t")],
        part(1).cast("int").alias("wo"),
        part(2).cast("int").alias("hb"),
        part(3).alias("et"),
        "t.*",
    )


TRADE_LOG = (
    "symbol STRING, trade_id BIGINT, entry_bar BIGINT, entry_price DOUBLE, direction INT, atr_at_entry DOUBLE, "
    "bars ARRAY<STRUCT<high: DOUBLE, low: DOUBLE, close: DOUBLE, atr: DOUBLE>>"
)


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines trade log with nested bars."""
    return spark.read.schema(TRADE_LOG).json(path)


def scan_gzip_csv(spark: SparkSession, path: str, ts: str, max_rows: int | None = None) -> DataFrame:
    """Row count, time span and columns; of at most ``max_rows`` rows for a probe.

    A gzip file is one task, so large inputs should come as many files.
    """
    df = spark.read.option("header", True).csv(path)
    head = df if max_rows is None else df.limit(max_rows)
    return head.agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.lit(",".join(df.columns)).alias("columns")
    )


def observations(docs: DataFrame, doc: str) -> DataFrame:
    """``{observations: [{date, value}]}`` documents to dated values; "." is missing."""
    schema = "observations ARRAY<STRUCT<date: STRING, value: STRING>>"
    rows = docs.select(*[c for c in docs.columns if c != doc], F.explode(F.from_json(doc, schema)["observations"]).alias("o"))
    value = F.col("o.value").try_cast("double")
    return rows.select(*[c for c in rows.columns if c != "o"], F.to_date("o.date").alias("date"), value.alias("value")).filter("value IS NOT NULL")

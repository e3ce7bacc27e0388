"""Order-imbalance events from quote ticks, and the trades they imply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.asof import first_quote_per_slot
from barline.operators.bars import floor_micros
from barline.operators.quantiles import exact_percentiles

# Fixed values of the study family.
BUCKET_SECONDS = 30
LOOKBACK_SECONDS = (30, 60, 300)
THRESHOLDS = {"p80": 0.80, "p90": 0.90, "p95": 0.95}
HORIZON_SECONDS = (60, 180, 300)
DIRECTIONS = ("mean_reversion", "momentum")
FAMILIES = ("volume_ratio_imbalance", "mid_price_tick_direction_imbalance")
FEE_BPS_ROUNDTRIP = 40.0
SLIPPAGE_BPS_ROUNDTRIP = 2.0
KEY = ["symbol", "score_family", "lookback_seconds", "threshold", "direction", "horizon_seconds"]


def with_previous_mid(quotes: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds ``mid``, ``slot_us`` and the previous mid of the same bucket.

    The first tick of a bucket has no previous mid.  A bucket of a few seconds
    is a bounded group, so this is one shuffle and a window.
    """
    q = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn(
        "slot_us", floor_micros(F.col("us"), bucket_seconds)
    )
    bucket = Window.partitionBy("symbol", "slot_us").orderBy("us", "event_id")
    return q.withColumn("prev_mid", F.lag("mid").over(bucket))


def bucket_totals(quotes: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Per bucket: volume sums, up and down mid moves; stamped at the bucket's end."""
    q = with_previous_mid(quotes, bucket_seconds)
    return q.groupBy("symbol", "slot_us").agg(
        F.sum("bid_vol").alias("bid_vol"),
        F.sum("ask_vol").alias("ask_vol"),
        F.sum(F.when(F.col("mid") > F.col("prev_mid"), 1).otherwise(0)).alias("ups"),
        F.sum(F.when(F.col("mid") < F.col("prev_mid"), 1).otherwise(0)).alias("downs"),
        F.count(F.lit(1)).alias("ticks"),
    ).withColumn("entry_us", F.col("slot_us") + bucket_seconds * 1_000_000)


def features(
    totals: DataFrame,
    bucket_seconds: int = BUCKET_SECONDS,
    lookbacks: Sequence[int] = LOOKBACK_SECONDS,
    families: Sequence[str] = FAMILIES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Imbalance scores per family and lookback, in long form, with ``carry``.

    A lookback counts observed buckets (ROWS), not elapsed time.  All scores
    come from one pass over the window, then unfold: no union of scans.
    """
    w = Window.partitionBy("symbol").orderBy("entry_us")
    parts: list[Column] = []
    for seconds in lookbacks:
        frame = w.rowsBetween(-(seconds // bucket_seconds - 1), 0)
        sums = {c: F.sum(c).over(frame) for c in ("bid_vol", "ask_vol", "ups", "downs")}
        pairs = {
            FAMILIES[0]: (sums["bid_vol"], sums["ask_vol"], "zero_volume_denominator"),
            FAMILIES[1]: (sums["ups"], sums["downs"], "zero_mid_tick_denominator"),
        }
        for family in families:
            a, b, reason = pairs[family]
            parts.append(
                F.struct(
                    F.lit(family).alias("score_family"),
                    F.lit(seconds).alias("lookback_seconds"),
                    F.try_divide((a - b).cast("double"), (a + b).cast("double")).alias("imbalance_score"),
                    F.when(a + b <= 0, reason).alias("missing_reason"),
                )
            )
    base = ["symbol", "entry_us", *carry]
    wide = totals.select(*base, F.array(*parts).alias("f"))
    return wide.select(*base, F.explode("f").alias("f")).select(*base, "f.*")


def thresholds(scores: DataFrame, in_sample_end_us: int, exact: bool = False) -> DataFrame:
    """Quantiles of |score| per family, from in-sample rows only, long form.

    The default is the bounded-memory quantile sketch; ``exact`` ranks all
    values with a distributed count.
    """
    keys = ["symbol", "score_family", "lookback_seconds"]
    sample = scores.filter(F.col("entry_us") < in_sample_end_us).filter("imbalance_score IS NOT NULL")
    size = F.abs("imbalance_score")
    if exact:
        wide = exact_percentiles(sample, keys, size, THRESHOLDS)
    else:
        wide = sample.groupBy(*keys).agg(
            *[F.percentile_approx(size, q, 10_000).alias(n) for n, q in THRESHOLDS.items()]
        )
    pairs = F.array(*[F.struct(F.lit(n).alias("threshold"), F.col(n).alias("threshold_value")) for n in THRESHOLDS])
    return wide.select(*keys, F.explode(pairs).alias("t")).select(*keys, "t.*")


def events(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Score rows beyond their threshold, for each horizon and direction."""
    keys = ["symbol", "score_family", "lookback_seconds"]
    # At most families x lookbacks x thresholds rows per symbol.
    hit = scores.join(limits, keys).filter(F.abs("imbalance_score") >= F.col("threshold_value"))
    side = F.when(F.col("imbalance_score") >= F.col("threshold_value"), "positive_extreme").otherwise("negative_extreme")
    return (
        hit.withColumn("signal_side", side)
        .withColumn("direction", F.explode(F.array(*[F.lit(d) for d in DIRECTIONS])))
        .withColumn("horizon_seconds", F.explode(F.array(*[F.lit(h) for h in HORIZON_SECONDS])))
        .withColumn("stance", stance(F.col("direction"), F.col("signal_side")))
        .withColumn("exit_us", F.col("entry_us") + F.col("horizon_seconds") * 1_000_000)
    )


def stance(direction: Column, side: Column) -> Column:
    """momentum follows the extreme, mean reversion fades it."""
    same = F.when(side == "positive_extreme", 1).when(side == "negative_extreme", -1)
    return F.when(direction == "momentum", same).when(direction == "mean_reversion", -same)


def anchors(ev: DataFrame) -> DataFrame:
    """Distinct entry and exit times per symbol."""
    return ev.select("symbol", F.explode(F.array("entry_us", "exit_us")).alias("anchor_us")).distinct()


def pnl_bps(stance_: Column, entry_bid: Column, entry_ask: Column, exit_bid: Column, exit_ask: Column) -> Column:
    """Buy at the ask, sell at the bid; net of fee and slippage."""
    entry = F.when(stance_ == 1, entry_ask).otherwise(entry_bid)
    leave = F.when(stance_ == 1, exit_bid).otherwise(exit_ask)
    gross = F.try_divide(stance_ * (leave - entry), entry) * 10_000.0
    return gross - FEE_BPS_ROUNDTRIP - SLIPPAGE_BPS_ROUNDTRIP


def with_quote_paths(
    totals: DataFrame, quotes: DataFrame, horizons: Sequence[int] = HORIZON_SECONDS, step_us: int = 30_000_000
) -> DataFrame:
    """Adds to each bucket its ``entry`` quote and one ``exit_<h>`` per horizon.

    An anchor takes the earliest quote of its own grid step or the next one.
    Quotes shrink to one row per step first; every such row then offers itself
    to the buckets it can serve, and one aggregate collects them.  The join runs
    at bucket size, before scores, thresholds, directions and horizons multiply
    the rows.
    """
    slot = first_quote_per_slot(quotes, ["symbol"], step_us)
    delays = {"entry": 0, **{f"exit_{h}": h * 1_000_000 for h in horizons}}
    roles = F.array(
        *[
            F.struct((F.col("slot_us") - late - delay).alias("entry_us"), F.lit(role).alias("role"))
            for role, delay in delays.items()
            for late in (0, step_us)
        ]
    )
    offers = slot.select("symbol", "q", F.explode(roles).alias("r")).select("symbol", "q", "r.*")
    paths = offers.groupBy("symbol", "entry_us").agg(
        *[F.min(F.when(F.col("role") == role, F.col("q"))).alias(role) for role in delays]
    )
    return totals.join(paths, ["symbol", "entry_us"], "left")


def priced(ev: DataFrame, horizons: Sequence[int] = HORIZON_SECONDS) -> DataFrame:
    """Events with entry and exit prices; a missing quote leaves pnl NULL."""
    out = F.coalesce(*[F.when(F.col("horizon_seconds") == h, F.col(f"exit_{h}")) for h in horizons])
    both = ev.withColumn("_x", out).select(
        *[c for c in ev.columns if c != "entry" and not c.startswith("exit_") or c == "exit_us"],
        F.col("entry.bid").alias("entry_bid"),
        F.col("entry.ask").alias("entry_ask"),
        F.col("_x.bid").alias("exit_bid"),
        F.col("_x.ask").alias("exit_ask"),
    )
    cost = pnl_bps(F.col("stance"), F.col("entry_bid"), F.col("entry_ask"), F.col("exit_bid"), F.col("exit_ask"))
    return both.withColumn("pnl_net", cost)


def cell_summary(trades: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Counts, profit factor and a tail p-value per cell."""
    p = F.col("pnl_net")
    agg = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("entry_bid").isNull()).alias("missing_entry"),
        F.count_if(F.col("exit_bid").isNull()).alias("missing_exit"),
        F.count(p).alias("num_trades"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gross_profit"),
        F.abs(F.sum(F.when(p < 0, p).otherwise(0.0))).alias("gross_loss"),
        F.avg(p).alias("mean_net"),
        F.stddev_samp(p).alias("std_net"),
    )
    t = F.abs(F.col("mean_net") / (F.col("std_net") / F.sqrt("num_trades")))
    return (
        agg.withColumn("profit_factor", F.try_divide("gross_profit", "gross_loss"))
        .withColumn("pf_infinite", (F.col("gross_loss") <= 0) & (F.col("gross_profit") > 0))
        .withColumn(
            "p_raw",
            F.when((F.col("num_trades") < 4) | F.col("std_net").isNull() | (F.col("std_net") <= 0), 1.0).otherwise(
                F.least(F.lit(1.0), F.exp(-0.5 * F.pow(t, F.lit(2))))
            ),
        )
        .withColumn("min_trades", F.greatest(F.lit(30), 10 * F.floor(F.col("horizon_seconds") / 60)).cast("int"))
        .withColumn("sparse", F.col("num_trades") < F.col("min_trades"))
    )

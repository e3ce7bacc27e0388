"""Source audits over ticks: counts, completeness, spreads, book disorder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.bars import floor_micros
from barline.operators.quantiles import exact_percentiles
from barline.operators.series import Run, running


def spread_bps() -> Column:
    return (F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2) * 10_000.0


def source_audit(quotes: DataFrame) -> DataFrame:
    """One row per symbol: counts, null and zero counts, spread min/median/max."""
    spread = F.round(F.col("ask") - F.col("bid"), 6)
    counts = quotes.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("ts", "bid", "ask", "bid_vol", "ask_vol")],
        F.count_if(F.col("bid_vol") == 0).alias("zero_bid_vol"),
        F.count_if(F.col("ask_vol") == 0).alias("zero_ask_vol"),
        F.count_if(spread < 0).alias("negative_spread"),
        F.min(spread).alias("min_spread"),
        F.max(spread).alias("max_spread"),
    )
    mid = exact_percentiles(quotes, ["symbol"], spread, {"median_spread": 0.5}).drop("n")
    return counts.join(mid, "symbol")


def bucket_completeness(quotes: DataFrame, seconds: int, start_us: int, end_us: int) -> DataFrame:
    """Observed against expected buckets of a span, ticks per observed bucket."""
    inside = quotes.filter((F.col("us") >= start_us) & (F.col("us") < end_us))
    buckets = inside.groupBy("symbol", floor_micros(F.col("us"), seconds).alias("b")).agg(F.count(F.lit(1)).alias("ticks"))
    expected = (end_us - start_us) // 1_000_000 // seconds
    out = buckets.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observed"), F.min("ticks").alias("min_ticks"), F.max("ticks").alias("max_ticks")
    )
    med = exact_percentiles(buckets, ["symbol"], F.col("ticks").cast("double"), {"median_ticks": 0.5}).drop("n")
    return (
        out.join(med, "symbol")
        .withColumn("expected", F.lit(expected).cast("bigint"))
        .withColumn("missing", F.col("expected") - F.col("observed"))
        .withColumn("bucket_seconds", F.lit(seconds))
    )


def hourly_density(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("symbol", floor_micros(F.col("us"), 3600).alias("hour_us")).agg(F.count(F.lit(1)).alias("ticks"))


def missing_hours(quotes: DataFrame) -> DataFrame:
    hours = quotes.groupBy("symbol", floor_micros(F.col("us"), 3600).alias("h")).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi")
    )
    span = hours.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observed"), ((F.max("hi") - F.min("lo")) / 3.6e9).alias("expected")
    )
    gap = F.greatest(F.lit(0.0), F.col("expected") - F.col("observed"))
    return span.withColumn("missing_pct", F.coalesce(F.try_divide(gap, "expected") * 100, F.lit(0.0)))


def spike_reversions(quotes: DataFrame, max_seconds: int = 7200) -> DataFrame:
    """Spread spikes and how long they last.

    A spike starts at the first tick above median + 2 sd and ends at the first
    later tick below median + 1 sd; ticks in between belong to it.  Rows:
    ``symbol, spike_us, revert_us``.  The state is the last label that decides
    it, found by a running scan that splits hot symbols.
    """
    q = quotes.withColumn("s", F.round(spread_bps(), 6))
    mid = exact_percentiles(q, ["symbol"], F.col("s"), {"m": 0.5}).drop("n")
    limits = mid.join(q.groupBy("symbol").agg(F.stddev_samp("s").alias("sd")), "symbol")
    # One row per symbol.
    marked = q.join(limits, "symbol").withColumn(
        "label",
        F.when(F.col("s") > F.col("m") + 2 * F.col("sd"), 1).when(F.col("s") < F.col("m") + F.col("sd"), 0),
    )
    order = ["us", "event_id"]
    state = running(
        marked.select("symbol", *order, "label"),
        ["symbol"],
        order,
        {"before": Run("last", F.col("label"), inclusive=False)},
    )
    calm = F.coalesce("before", F.lit(0)) == 0
    edges = state.filter(((F.col("label") == 1) & calm) | ((F.col("label") == 0) & ~calm))
    # Starts and ends alternate, so an end's partner is the edge before it.
    paired = running(edges.select("symbol", *order, "label"), ["symbol"], order, {"spike_us": Run("last", F.col("us"), inclusive=False)})
    done = paired.filter("label = 0").select("symbol", "spike_us", F.col("us").alias("revert_us"))
    return done.filter(F.col("revert_us") - F.col("spike_us") < max_seconds * 1_000_000)


def book_disorder(rows: DataFrame) -> DataFrame:
    """Counts per symbol over rows ``seq, us, side, price``: time disorder,
    duplicates, crossed and locked books (running best bid before an ask)."""
    seen = running(
        rows,
        ["symbol"],
        ["seq"],
        {"prev_us": Run("last", F.col("us"), inclusive=False)},
    )
    order = seen.groupBy("symbol").agg(F.count_if(F.col("us") < F.col("prev_us")).alias("disorder"))
    per_row = rows.groupBy("symbol", "us", "side", "price").agg((F.count(F.lit(1)) - 1).alias("extra"))
    dup = per_row.groupBy("symbol").agg(F.sum("extra").alias("duplicates"))
    best = running(
        rows,
        ["symbol"],
        ["us", "seq"],
        {"best_bid": Run("max", F.when(F.col("side") == "bid", F.col("price")), inclusive=False)},
    ).filter("side = 'ask'")
    book = best.groupBy("symbol").agg(
        F.count_if(F.col("price") < F.col("best_bid")).alias("crossed"),
        F.count_if(F.col("price") == F.col("best_bid")).alias("locked"),
    )
    return order.join(dup, "symbol").join(book, "symbol")

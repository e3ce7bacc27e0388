"""As-of joins: backward fill, forward with a tolerance, forward on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.series import Run, running


def asof_backward(
    targets: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    out: str,
    backfill: bool = True,
) -> DataFrame:
    """Latest source value at or before each target.

    ``backfill`` (the default behaviour) gives targets before the first source
    row the first source value, and 0.0 where a source is empty.  Both sides are
    stacked and scanned once, so there is no range join and a hot key is split.
    """
    if not keys:
        one = F.lit(1)
        done = asof_backward(
            targets.withColumn("_all", one), source.withColumn("_all", one), ["_all"], at, value, out, backfill
        )
        return done.drop("_all")
    left = targets.select("*", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"))
    right = source.select(*keys, at, F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v"))
    stacked = left.unionByName(right, allowMissingColumns=True)
    runs = {out: Run("last", F.col("_v"))}
    filled = running(stacked, keys, [at, "_side"], runs).filter("_side = 1")
    if backfill:
        first = right.groupBy(*keys).agg(F.min_by("_v", at).alias("_first"))
        filled = filled.join(first, list(keys), "left")
        filled = filled.withColumn(out, F.coalesce(out, "_first", F.lit(0.0))).drop("_first")
    return filled.drop("_side", "_v")


def asof_forward(
    anchors: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str],
    anchor_us: str,
    tolerance_us: int,
    prefix: str = "",
) -> DataFrame:
    """Earliest quote in ``[anchor, anchor + tolerance)`` for any anchors.

    Ties on the time are broken by bid, then ask.  The stacked rows are scanned
    backwards once; no anchor is paired with more than one quote.
    """
    quote = F.struct(F.col("us").alias("us"), F.col("bid").alias("bid"), F.col("ask").alias("ask"))
    first = quotes.groupBy(*keys, "us").agg(F.min(quote).alias("_q"))
    right = first.select(*keys, F.col("us").alias("_at"), F.lit(0).alias("_side"), "_q")
    left = anchors.select("*", F.col(anchor_us).alias("_at"), F.lit(1).alias("_side"))
    stacked = left.unionByName(right, allowMissingColumns=True)
    order: list[Column] = [F.col("_at").desc(), F.col("_side").asc()]
    hit = running(stacked, keys, order, {"_next": Run("last", F.col("_q"))}).filter("_side = 1")
    near = F.col("_next.us") < F.col("_at") + tolerance_us
    return hit.select(
        *anchors.columns,
        F.when(near, F.col("_next.us")).alias(f"{prefix}quote_us"),
        F.when(near, F.col("_next.bid")).alias(f"{prefix}bid"),
        F.when(near, F.col("_next.ask")).alias(f"{prefix}ask"),
    )


def first_quote_per_slot(quotes: DataFrame, keys: Sequence[str], step_us: int) -> DataFrame:
    """Earliest quote (time, bid, ask) of every grid step; combined map-side."""
    slot = F.col("us") - F.pmod(F.col("us"), F.lit(step_us))
    return quotes.groupBy(*keys, slot.alias("slot_us")).agg(F.min(F.struct("us", "bid", "ask")).alias("q"))


def asof_forward_grid(
    anchors: DataFrame, quotes: DataFrame, keys: Sequence[str], anchor_us: str, step_us: int = 30_000_000
) -> DataFrame:
    """Forward as-of for anchors on a ``step_us`` grid, tolerance two steps.

    Quotes shrink to one row per step before any join; each such row answers
    the anchor at its own step and the one a step earlier.
    """
    offers = first_quote_per_slot(quotes, keys, step_us).select(
        *keys, "q", F.explode(F.array(F.col("slot_us"), F.col("slot_us") - step_us)).alias(anchor_us)
    )
    best = offers.groupBy(*keys, anchor_us).agg(F.min("q").alias("_q"))
    return anchors.join(best, [*keys, anchor_us], "left").select(
        *anchors.columns,
        F.col("_q.us").alias("quote_us"),
        F.col("_q.bid").alias("bid"),
        F.col("_q.ask").alias("ask"),
    )

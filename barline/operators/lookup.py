"""Equi, semi and bounded theta joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.asof import asof_forward_grid
from barline.operators.indicators import by


def require_rows(df: DataFrame) -> DataFrame:
    """The frame itself, or an error when a join left nothing."""
    if df.isEmpty():
        raise ValueError("join produced no rows")
    return df


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], strict: bool = False) -> DataFrame:
    """Left join onto a unique key; ``matched`` tells which rows found one.

    A duplicate key on the right is an error.  With ``strict`` an unmatched left
    row is an error too.
    """
    if not right.groupBy(*on).count().filter("count > 1").isEmpty():
        raise ValueError(f"right side is not unique on {list(on)}")
    joined = left.join(right.withColumn("_hit", F.lit(True)), list(on), "left")
    joined = joined.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")
    if strict and not joined.filter("NOT matched").isEmpty():
        raise ValueError("unmatched rows")
    return joined


def slots_wide(slots: DataFrame, value: str) -> DataFrame:
    """One row per slot with a column per pair (p0..p3)."""
    return (
        slots.withColumn("pair", F.lower("pair"))
        .groupBy("event", "wo", "hb", "et")
        .pivot("pair", ["p0", "p1", "p2", "p3"])
        .agg(F.first(value, ignorenulls=True))
    )


def exits_ahead(bars: DataFrame, n: int, exact_after: str) -> DataFrame:
    """``ahead``: close ``n`` rows later; ``exact``: close at exactly ts + delta."""
    later = bars.select("symbol", (F.col("ts") - F.expr(exact_after)).alias("ts"), F.col("close").alias("exact"))
    lead = bars.withColumn("ahead", F.lead("close", n).over(by(["symbol"])))
    return lead.join(later, ["symbol", "ts"], "left")


def flag_release_weeks(days: DataFrame) -> DataFrame:
    """``in_week``: the row's ISO week holds a first Friday of a month."""
    keyed = days.withColumn("_y", F.year("ts")).withColumn("_w", F.weekofyear("ts"))
    hits = keyed.filter((F.dayofmonth("ts") <= 7) & (F.weekday("ts") == 4)).select("_y", "_w").distinct()
    joined = keyed.join(hits.withColumn("_hit", F.lit(True)), ["_y", "_w"], "left")
    return joined.withColumn("in_week", F.coalesce("_hit", F.lit(False))).drop("_y", "_w", "_hit")


def days_after_shocks(series: DataFrame, sigmas: float, offsets: Sequence[int]) -> DataFrame:
    """Dates that lie ``offsets`` days after an up-move beyond ``sigmas``.

    The series is daily (one row per date), so its ordered pass is small.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("ts")
    moves = series.withColumn("r", F.log(F.col("value") / F.lag("value").over(w)))
    limit = moves.agg(F.stddev_samp("r")).scalar()
    big = moves.filter(F.col("r") > sigmas * limit)
    after = F.explode(F.array(*[F.col("ts") + F.expr(f"INTERVAL {d} DAYS") for d in offsets]))
    return big.select(after.alias("ts")).distinct()


def neighbour_sums(trials: DataFrame, params: Sequence[str], value: str, pct: float) -> DataFrame:
    """Count and value sum of other trials with all parameters within +-pct.

    Trials are first summed per distinct parameter vector; only vectors meet
    each other, and only those whose parameters all lie in the same or the next
    logarithmic bin, so no all-pairs join arises.
    """
    vec = trials.groupBy(*params).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    width = math.log(1.0 + pct) - math.log(1.0 - pct)
    bin_of = {p: F.floor(F.log(F.col(p).cast("double")) / width) for p in params}
    left = vec.select(*params)
    for i, p in enumerate(params):
        left = left.withColumn(f"_bin{i}", F.explode(F.array(bin_of[p] - 1, bin_of[p], bin_of[p] + 1)))
    bins = [f"_bin{i}" for i in range(len(params))]
    homes = [bin_of[p].alias(b) for p, b in zip(params, bins)]
    right = vec.select(*[F.col(p).alias(f"_near_{p}") for p in params], "_n", "_s", *homes)
    close = F.lit(True)
    for p in params:
        close = close & (F.abs((F.col(f"_near_{p}") - F.col(p)) / F.col(p).cast("double")) <= pct)
    near = left.join(right, bins).filter(close).groupBy(*params).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    out = trials.join(near, list(params))
    return out.withColumn("neighbours", F.col("_n") - 1).withColumn(
        f"{value}_sum", F.when(F.col("_n") > 1, F.col("_s") - F.col(value))
    ).drop("_n", "_s")


def first_overlap(start: str, end: str, expected: Sequence[tuple[str, str, str]]) -> Column:
    """Label of the first expected span that the row's span touches."""
    label = F.lit("unannotated")
    for name, lo, hi in reversed(expected):
        touches = ~((F.col(end) < F.lit(lo).cast("timestamp")) | (F.col(start) > F.lit(hi).cast("timestamp")))
        label = F.when(touches, name).otherwise(label)
    return label


def rows_by_grid(df: DataFrame, names: Sequence[tuple[str, ...]], grid: Sequence[tuple]) -> DataFrame:
    """Every row once per parameter tuple, with ``param_id``."""
    fields = names[0]
    structs = [
        F.struct(F.lit(i).alias("param_id"), *[F.lit(v).alias(f) for f, v in zip(fields, row)])
        for i, row in enumerate(grid)
    ]
    return df.withColumn("_p", F.explode(F.array(*structs))).select(*df.columns, "_p.*")


def grid_means(grid: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Short and long mean per row; each distinct period is computed once."""
    w = by(["symbol", "param_id"])
    means = {n: F.avg("close").over(w.rowsBetween(-(n - 1), 0)) for n in periods}
    pick = lambda col: F.coalesce(*[F.when(F.col(col) == n, m) for n, m in means.items()])
    return grid.withColumn("short_mean", pick("short_n")).withColumn("long_mean", pick("long_n"))


def diagonal_concat(frames: Sequence[DataFrame], schema: dict[str, str]) -> DataFrame:
    """Stack frames with differing columns, cast to one schema."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])


def sharded_anchor_quotes(anchors: DataFrame, quotes: DataFrame, shard_us: int, overlap_us: int) -> DataFrame:
    """Anchor quotes per time shard, merged, best row per anchor kept.

    The shard is a column, so shards run as one job; quotes near a shard's end
    belong to two shards and the duplicates are removed afterwards.
    """
    shard = lambda c: F.floor(F.col(c) / shard_us)
    own = anchors.withColumn("shard", shard("anchor_us"))
    spill = F.when(
        (F.col("us") % shard_us) < overlap_us, F.array(shard("us"), shard("us") - 1)
    ).otherwise(F.array(shard("us")))
    per_shard = asof_forward_grid(own, quotes.withColumn("shard", F.explode(spill)), ["symbol", "shard"], "anchor_us")
    best = F.min_by(
        F.struct("quote_us", "bid", "ask"),
        F.struct(F.col("quote_us").isNull(), "quote_us", "bid", "ask"),
    )
    return per_shard.groupBy("symbol", "anchor_us").agg(best.alias("q")).select("symbol", "anchor_us", "q.*")

"""Exact quantiles and ranks of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one task.
That is fine for bars and cells, not for ticks or trades: there the values are
counted first (map-side combine) and ranked by a two-level running count,
whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.series import Run, running


def value_ranks(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Distinct values per key with ``n_eq``, ``n_le``, ``n_lt`` and the size ``n``."""
    keyed = df.select(*keys, value.alias("value")).filter("value IS NOT NULL")
    counts = keyed.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n_eq"))
    ranked = running(counts, keys, ["value"], {"n_le": Run("sum", F.col("n_eq"))})
    ranked = ranked.join(ranked.groupBy(*keys).agg(F.max("n_le").alias("n")), list(keys))
    return ranked.withColumn("n_lt", F.col("n_le") - F.col("n_eq"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, plus the row count ``n``."""
    if not keys:
        return exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, qs).drop("_all")
    picks = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda p: F.max(F.when((F.col("n_lt") <= p) & (p < F.col("n_le")), F.col("value")))
        frac = F.max(pos - lo)
        picks.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return value_ranks(df, keys, value).groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def average_ranks(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Distinct values per key with their tie-averaged 1-based rank."""
    return value_ranks(df, keys, value).withColumn("avg_rank", F.col("n_lt") + (F.col("n_eq") + 1) / 2)

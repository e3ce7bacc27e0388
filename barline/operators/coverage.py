"""Windows over time: which rows fall inside ``[start, end)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.series import Run, running


def with_open_windows(
    rows: DataFrame, windows: DataFrame, keys: Sequence[str] = (), at: str = "ts", name: str = "open_windows"
) -> DataFrame:
    """Number of windows open at each row.

    Starts (+1), ends (-1) and rows are scanned together once, so neither many
    overlapping windows nor a crowded hour multiplies rows, as a range join does.
    """
    if not keys:
        one = F.lit(1)
        done = with_open_windows(rows.withColumn("_all", one), windows.withColumn("_all", one), ["_all"], at, name)
        return done.drop("_all")
    edge = windows.select(
        *keys,
        F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e"),
    )
    edge = edge.select(*keys, F.col("e.t").alias(at), F.col("e.d").alias("_d"), F.lit(0).alias("_side"))
    stacked = rows.withColumn("_side", F.lit(1)).unionByName(edge, allowMissingColumns=True)
    counted = running(stacked, keys, [at, "_side"], {name: Run("sum", F.coalesce("_d", F.lit(0)))})
    return counted.filter("_side = 1").drop("_side", "_d")


def outside_windows(rows: DataFrame, windows: DataFrame, keys: Sequence[str] = (), at: str = "ts") -> DataFrame:
    return with_open_windows(rows, windows, keys, at).filter("open_windows = 0").drop("open_windows")



def present_in_all(df: DataFrame, series: str, at: str) -> DataFrame:
    """Rows at times that every series of the table has."""
    n_series = df.agg(F.countDistinct(series)).scalar()
    common = df.groupBy(at).agg(F.countDistinct(series).alias("_n")).filter(F.col("_n") == n_series).select(at)
    return df.join(common, at, "left_semi")

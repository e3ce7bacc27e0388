"""Family-wise and false-discovery corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holm(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str], m: int | Column | None = None) -> DataFrame:
    """Step-down adjusted p-values (``p_adj``) per family.

    ``m`` is a fixed family size: missing members count as p = 1, which never
    changes the adjusted values of the present ones.  Families are tables of
    tests, so the ordered pass is small.
    """
    part = [F.col(c) for c in family] or [F.lit(1)]
    w = Window.partitionBy(*part).orderBy(p, *tie)
    size = F.count(F.lit(1)).over(Window.partitionBy(*part)) if m is None else (m if isinstance(m, Column) else F.lit(m))
    work = df.withColumn("_step", (size - F.row_number().over(w) + 1) * F.col(p))
    highest = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return work.withColumn("p_adj", F.least(F.lit(1.0), highest)).drop("_step")


def padded_family(grid: DataFrame, tested: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """The full grid; members without a test get p = 1 and ``status`` padded."""
    joined = grid.join(tested, list(keys), "left")
    return joined.withColumn("status", F.when(F.col(p).isNull(), "padded").otherwise("tested")).withColumn(
        p, F.coalesce(p, F.lit(1.0))
    )


def pass_counts(df: DataFrame, family: Sequence[str], p: str, n_slots: int, alpha: float = 0.05, q: float = 0.10) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg pass counts per family."""
    clean = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    part = [F.col(c) for c in family]
    i = F.row_number().over(Window.partitionBy(*part).orderBy(p))
    m = F.count(F.lit(1)).over(Window.partitionBy(*part))
    ranked = clean.withColumn("_i", i).withColumn("_ok", F.col(p) <= F.col("_i") / m * q)
    return ranked.groupBy(*family).agg(
        F.count_if(F.col(p) < alpha / n_slots).alias("pass_bonferroni"),
        F.coalesce(F.max(F.when(F.col("_ok"), F.col("_i"))), F.lit(0)).alias("pass_bh"),
    )


def precheck(df: DataFrame, family: Sequence[str], p: str, index: str, expected: int) -> DataFrame:
    """First reason a family is not fit for correction, or ``ok``."""
    agg = df.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(index).alias("_d"),
        F.min(index).alias("_lo"),
        F.max(index).alias("_hi"),
        F.count_if(F.col(p).isNull() | (F.col(p) < 0) | (F.col(p) > 1)).alias("_bad"),
    )
    reason = (
        F.when(F.col("n") != expected, "count_mismatch")
        .when(F.col("_d") != F.col("n"), "duplicate_index")
        .when(F.col("_bad") > 0, "p_out_of_range")
        .when((F.col("_lo") != 0) | (F.col("_hi") != F.col("n") - 1), "index_not_contiguous")
        .otherwise("ok")
    )
    return agg.withColumn("reason", reason).select(*family, "n", "reason")

"""Rater agreement, rank correlation, effective sample size, rank tests."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.stats import chi_square_p, clopper_pearson, correlation, mean_vif, student_p, two_sided_p
from barline.operators.quantiles import average_ranks


def fleiss_kappa(votes: DataFrame, keys: Sequence[str], raters: int) -> DataFrame:
    """``votes``: one row per subject with ``longs, shorts``; subjects with a
    missing vote are left out.  NULL when every vote falls in one category."""
    full = votes.filter(F.col("longs") + F.col("shorts") == raters)
    n = raters
    agree = (F.col("longs") * (F.col("longs") - 1) + F.col("shorts") * (F.col("shorts") - 1)) / (n * (n - 1))
    agg = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("subjects"),
        F.avg(agree).alias("_po"),
        (F.sum("longs") / (F.count(F.lit(1)) * n)).alias("_pl"),
    )
    pe = F.col("_pl") * F.col("_pl") + (1 - F.col("_pl")) * (1 - F.col("_pl"))
    return agg.select(*keys, "subjects", F.try_divide(F.col("_po") - pe, 1 - pe).alias("kappa"))


def pair_table(wide: DataFrame, keys: Sequence[str], pairs: Sequence[str]) -> DataFrame:
    """Long form of all rater pairs per subject: ``a, b, x, y`` (signs)."""
    combos = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
            for i, a in enumerate(pairs)
            for b in pairs[i + 1 :]
        ]
    )
    return wide.select(*keys, F.explode(combos).alias("c")).select(*keys, "c.*")


def cohen_kappa(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kappa of two raters over non-neutral signs ``x, y``."""
    agg = long.filter("x <> 0 AND y <> 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("x") == F.col("y")).cast("int")).alias("_po"),
        F.avg((F.col("x") == 1).cast("int")).alias("_px"),
        F.avg((F.col("y") == 1).cast("int")).alias("_py"),
    )
    pe = F.col("_px") * F.col("_py") + (1 - F.col("_px")) * (1 - F.col("_py"))
    return agg.select(*keys, "n", F.try_divide(F.col("_po") - pe, 1 - pe).alias("kappa"))


def spearman(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` (average ranks) per key."""

    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = long.withColumn("_rx", rank("x")).withColumn("_ry", rank("y"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("rho"))


def vif(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean variance inflation of the columns per key.

    Cross products are summed in executors; the small inverse runs on one row
    per key.
    """
    cols = list(columns)
    sums = [
        F.sum(F.col(a).cast("double") * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)
    ]
    moments = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    k = len(cols)

    @F.pandas_udf("double")
    def solve(n: pd.Series, m: pd.DataFrame) -> pd.Series:
        grid = m.to_numpy(float).reshape(-1, k, k)
        return pd.Series([mean_vif(g) if rows >= 3 else float("inf") for rows, g in zip(n, grid)])

    packed = F.struct(*[F.col(f"m_{i}_{j}") for i in range(k) for j in range(k)])
    return moments.select(*keys, "n", solve("n", packed).alias("vif"))


def n_effective(n: Column, rho: Column, vif_: Column) -> Column:
    bad = vif_.isNull() | F.isnan(vif_) | (vif_ <= 0) | (vif_ == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest((1.0 - rho) * n / vif_, F.lit(0.0)))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p at 1/2: twice the smaller tail, at most 1."""
    low = F.least(k, n - k)
    log_pmf = lambda i: _log_choose(n, i) - n * F.log(F.lit(2.0))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), low), F.lit(0.0), lambda acc, i: acc + F.exp(log_pmf(i)))
    return F.least(2.0 * tail, F.lit(1.0))


def _log_choose(n: Column, i: Column) -> Column:
    from barline.functions.stats import log_gamma_int

    return log_gamma_int(n + 1) - log_gamma_int(i + 1) - log_gamma_int(n - i + 1)


def proportion_interval(df: DataFrame, k: str, n: str) -> DataFrame:
    """Exact interval per row (one row per group)."""

    @F.pandas_udf("low double, high double")
    def solve(k_: pd.Series, n_: pd.Series) -> pd.DataFrame:
        return clopper_pearson(k_, n_)

    return df.withColumn("_ci", solve(k, n)).withColumn("ci_low", F.col("_ci.low")).withColumn("ci_high", F.col("_ci.high")).drop("_ci")


def rank_sums(df: DataFrame, keys: Sequence[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rank sum and size per (key, group); n and tie term per key."""
    ranks = average_ranks(df, keys, F.col(value))
    joined = df.filter(F.col(value).isNotNull()).join(ranks.withColumnRenamed("value", value), [*keys, value])
    sums = joined.groupBy(*keys, group).agg(F.sum("avg_rank").alias("rank_sum"), F.count(F.lit(1)).alias("size"))
    ties = ranks.groupBy(*keys).agg(
        F.sum("n_eq").alias("n"), F.sum(F.pow(F.col("n_eq").cast("double"), F.lit(3.0)) - F.col("n_eq")).alias("ties")
    )
    return sums, ties


def _solved(solver, x: Column | str, df: Column) -> Column:
    """A solver of one number per row, for tables of one row per key."""

    @F.pandas_udf("double")
    def solve(x_: pd.Series, df_: pd.Series) -> pd.Series:
        return solver(x_, df_)

    return solve(x, df.cast("double"))


def kruskal_wallis(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """H with tie correction, and its chi-square p, per key (one row per key reaches the solver)."""
    sums, ties = rank_sums(df, keys, group, value)
    parts = sums.groupBy(*keys).agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size")).alias("_s"), F.count(F.lit(1)).alias("groups")
    )
    n = F.col("n")
    h = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    out = parts.join(ties, list(keys)).select(
        *keys, "groups", "n", (h / (1 - F.col("ties") / (F.pow(n.cast("double"), F.lit(3.0)) - n))).alias("h")
    )
    return out.withColumn("p", _solved(chi_square_p, "h", F.col("groups") - 1))


def two_sample(df: DataFrame, keys: Sequence[str], flag: str, value: str) -> DataFrame:
    """Welch t, pooled t with its two-sided p, and volatility ratio of flagged against other rows."""
    yes, no = F.col(flag), ~F.col(flag)
    x = F.col(value)
    agg = df.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count_if(yes).alias("n1"), F.count_if(no).alias("n2"),
        F.avg(F.when(yes, x)).alias("m1"), F.avg(F.when(no, x)).alias("m2"),
        F.var_samp(F.when(yes, x)).alias("v1"), F.var_samp(F.when(no, x)).alias("v2"),
    )
    d = F.col("m1") - F.col("m2")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return agg.withColumn("welch_t", d / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).withColumn(
        "t", d / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    ).withColumn("p", _solved(student_p, "t", F.col("n1") + F.col("n2") - 2)).withColumn(
        "vol_ratio", F.when(F.col("v2") > 0, F.sqrt(F.col("v1") / F.col("v2"))).otherwise(1.0)
    )


def mann_whitney(df: DataFrame, keys: Sequence[str], flag: str, value: str) -> DataFrame:
    """U of the flagged rows per key and its two-sided p (normal, with tie and continuity corrections)."""
    sums, ties = rank_sums(df, keys, flag, value)
    n1, n = F.col("size"), F.col("n")
    rows = sums.filter(F.col(flag)).join(ties, list(keys)).withColumn("u", F.col("rank_sum") - n1 * (n1 + 1) / 2)
    both = n1 * (n - n1)
    spread = F.sqrt(both / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - both / 2) - 0.5, F.lit(0.0)) / spread
    return rows.select(*keys, "u", two_sided_p(z).alias("p"))


def levene(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Levene statistic around group medians, and its p for two groups (F with one degree is the square of t).

    Groups are days of one series, so a plain median is a bounded task.
    """
    x = df.filter(F.col(value).isNotNull())
    centres = x.groupBy(*keys, group).agg(F.median(value).alias("_c"))
    dev = x.join(centres, [*keys, group]).withColumn("_z", F.abs(F.col(value) - F.col("_c")))
    z = F.col("_z")
    per = dev.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"), F.avg("_z").alias("_zb"), F.sum(z * z).alias("_zz"))
    agg = per.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_groups"), F.sum(F.col("_n") * F.col("_zb")).alias("_s"),
        F.sum(F.col("_n") * F.col("_zb") * F.col("_zb")).alias("_ss"), F.sum("_zz").alias("_zz"),
    )
    between = F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_all")
    within = F.col("_zz") - F.col("_ss")
    df = F.col("_all") - F.col("_groups")
    out = agg.select(*keys, (df / (F.col("_groups") - 1) * between / within).alias("levene"), df.alias("_df"), "_groups")
    p = F.when(F.col("_groups") == 2, _solved(student_p, F.sqrt("levene"), F.col("_df")))
    return out.withColumn("p", p).drop("_df", "_groups")

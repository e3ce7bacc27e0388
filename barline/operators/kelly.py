"""Lower confidence bounds of win rate and payoff for position sizing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.stats import beta_quantile
from barline.operators.resampling import pool_counts, pools, replicate_sums


def kelly_lower_bounds(trades: DataFrame, keys: Sequence[str], row: Column, n: int, seed: int, level: float = 0.05) -> DataFrame:
    """``p_lower`` (Beta bound of the win rate) and ``b_lower`` (bias-corrected,
    accelerated bootstrap bound of gross profit / gross loss) per key.

    Replicate sums and jackknife moments are distributed aggregates; a key's
    ``n`` replicate values and a few sums reach one small solver call.
    Keys with under five trades, two wins or two losses give no row.
    """
    keys = list(keys)
    p = F.col("pnl")
    base = trades.select(*keys, row.alias("_row"), "pnl")
    sums = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p > 0).alias("k"),
        F.count_if(p < 0).alias("l"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gp"),
        F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("gl"),
    )
    sums = sums.filter("n >= 5 AND k >= 2 AND l >= 2")
    joined = base.join(sums, keys)

    # Leave-one-out values of log(gp / gl), through their power sums.
    left_out = F.when(p > 0, F.log((F.col("gp") - p) / F.col("gl"))).when(p < 0, F.log(F.col("gp") / (F.col("gl") + p)))
    shift = left_out - F.log(F.col("gp") / F.col("gl"))
    jack = joined.groupBy(*keys).agg(*[F.sum(F.pow(shift, F.lit(float(e)))).alias(f"j{e}") for e in (1, 2, 3)])

    pool = pools(joined, keys, p, F.col("_row"))
    sides = {"a": F.greatest("_x", F.lit(0.0)), "b": F.greatest(-F.col("_x"), F.lit(0.0))}
    reps = replicate_sums(pool, keys, F.col("_row"), sides, pool_counts("poisson"), n, seed, F.col("_n"))
    logs = reps.groupBy(*keys).agg(F.collect_list(F.when((F.col("a") > 0) & (F.col("b") > 0), F.log(F.col("a") / F.col("b")))).alias("logs"))

    @F.pandas_udf("p_lower double, b_lower double")
    def solve(s: pd.DataFrame) -> pd.DataFrame:
        nd = NormalDist()
        out = []
        for r in s.itertuples(index=False):
            values = np.sort(np.asarray(r.logs, float))
            theta = math.log(r.gp / r.gl)
            m = r.k + r.l
            mean = r.j1 / m
            m2 = r.j2 - m * mean**2
            m3 = r.j3 - 3 * mean * r.j2 + 2 * m * mean**3
            accel = -m3 / (6 * m2**1.5) if m2 > 0 else 0.0
            share = min(max((values < theta).mean(), 1 / (len(values) + 1)), len(values) / (len(values) + 1))
            z0, za = nd.inv_cdf(share), nd.inv_cdf(level / 2)
            q = nd.cdf(z0 + (z0 + za) / (1 - accel * (z0 + za)))
            out.append((beta_quantile(level, 0.5 + r.k, 0.5 + r.n - r.k), math.exp(float(np.quantile(values, q)))))
        return pd.DataFrame(out, columns=["p_lower", "b_lower"])

    ready = sums.join(jack, keys).join(logs, keys)
    ready = ready.withColumn("_s", solve(F.struct("n", "k", "l", "gp", "gl", "j1", "j2", "j3", "logs")))
    return ready.select(*keys, "n", "k", F.col("_s.p_lower").alias("p_lower"), F.col("_s.b_lower").alias("b_lower"))

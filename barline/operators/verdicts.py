"""Gates and verdicts over result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six gates and their limits.
GATES = ("abs_t_stat", "dsr_pvalue", "mean_pip_vs_cost", "fold_pf_4of5", "h1_h2_sign_agree", "bootstrap_ci_excludes_zero")


def six_gates() -> Column:
    """Array of (gate, passed, value, threshold) from a row of gate inputs."""
    h1, h2 = F.col("h1_mean"), F.col("h2_mean")
    cost = 2.0 * F.col("round_trip_cost")
    lo, hi = F.col("ci_low"), F.col("ci_high")
    rows = (
        (F.col("abs_t") > 4.40, F.col("abs_t"), F.lit(4.40)),
        (F.col("dsr_pvalue") < 0.05, F.col("dsr_pvalue"), F.lit(0.05)),
        (F.col("mean_pnl") > cost, F.col("mean_pnl"), cost),
        (F.col("folds_passing") >= 4, F.col("folds_passing").cast("double"), F.lit(4.0)),
        ((h1 != 0) & (h2 != 0) & (F.signum(h1) == F.signum(h2)), h1, h2),
        ((lo > 0) | (hi < 0), lo, hi),
    )
    return F.array(
        *[
            F.struct(F.lit(g).alias("gate"), F.coalesce(p, F.lit(False)).alias("passed"), v.alias("value"), t.alias("threshold"))
            for g, (p, v, t) in zip(GATES, rows)
        ]
    )


def failed_gates(gates: str) -> Column:
    return F.array_join(F.transform(F.filter(gates, lambda g: ~g["passed"]), lambda g: g["gate"]), ",")


def commit_gate(checks: Sequence[Column], max_dd: Column, pf: Column) -> tuple[Column, Column, Column]:
    """(majority, veto, approved): three of five, unless losses are severe."""
    count = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    majority = count >= 3
    veto = (max_dd < -0.40) | (pf < 1.0)
    return majority, veto, majority & ~veto


def cascade(kappa: Column, max_vif: Column, n_eff: Column) -> Column:
    """signal / drift / noise, first matching rule."""
    return (
        F.when(max_vif >= 10.0, "noise")
        .when(n_eff < 4.0, "noise")
        .when(kappa >= 0.61, "signal")
        .when(kappa >= 0.41, "drift")
        .otherwise("noise")
    )


def cell_verdict(n_eff: Column, ci_low: Column, ci_high: Column, sign_ratio: Column) -> tuple[Column, Column]:
    """PASS or FAIL, and the class of a failure."""
    ok = (n_eff >= 4) & (ci_low > 0) & (sign_ratio > 0)
    kind = (
        F.when(ok, None)
        .when(n_eff < 4, "sampling_noise")
        .when(((ci_low <= 0) & (ci_high >= 0)) | (sign_ratio <= 0), "structural")
        .otherwise("bug")
    )
    return F.when(ok, "PASS").otherwise("FAIL"), kind


def label_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per-label counts, precision, recall, F1 and the macro mean.

    The confusion counts are one small aggregate; everything else reads them.
    """
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        "n",
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.lit(1).alias("is_truth"), (F.col("t") == F.col("p")).cast("int").alias("hit")),
                F.struct(F.col("p").alias("label"), F.lit(0).alias("is_truth"), F.lit(0).alias("hit")),
            )
        ).alias("s"),
    ).select("n", "s.*")
    agg = sides.groupBy("label").agg(
        F.sum(F.col("n") * F.col("hit")).alias("tp"),
        F.sum(F.col("n") * F.col("is_truth")).alias("actual"),
        F.sum(F.col("n") * (1 - F.col("is_truth"))).alias("claimed"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("claimed")), F.lit(0.0))
    out = agg.select(
        "label",
        "tp",
        (F.col("claimed") - F.col("tp")).alias("fp"),
        (F.col("actual") - F.col("tp")).alias("fn"),
        f1.alias("f1"),
    )
    return out.withColumn("macro_f1", out.agg(F.avg("f1")).scalar())

"""Values worked out apart from the library: tails, gates, cliffs, draws, the shared folder."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import barline.session as session
from barline.functions import draws, stats
from barline.operators import agreement, quantiles, resampling, selection, trades, verdicts
from barline.plans import inference
from barline.plans.aggs import alpha_cliffs


def simpson(f, a, b, n=4000):
    x = np.linspace(a, b, n + 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((w * f(x)).sum() * (b - a) / n / 3)


@pytest.mark.parametrize(("t", "df"), [(0.0, 5), (0.7, 3), (2.228, 10), (-3.1, 41), (1.96, 500)])
def test_student_tail(t, df):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    want = 1 - 2 * simpson(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, abs(t))
    assert abs(stats.student_p(pd.Series([t]), pd.Series([float(df)]))[0] - want) < 1e-8


def test_known_quantiles():
    # Tabled points: t(10) at 5 %, chi-square(4) at 5 % and chi-square(11) at 1 %.
    assert abs(stats.student_p(pd.Series([2.228139]), pd.Series([10.0]))[0] - 0.05) < 1e-6
    got = stats.chi_square_p(pd.Series([9.487729, 24.724970]), pd.Series([4.0, 11.0]))
    assert abs(got[0] - 0.05) < 1e-7 and abs(got[1] - 0.01) < 1e-7


def test_deflated_sharpe_reasons(spark):
    """Too few rows, no variance and non-finite returns shut the gate, each under its own name."""
    rows = [("one", 1.0), *[("flat", 1.0)] * 3, *[("nan", x) for x in (1.0, float("nan"), 2.0)]]
    rows += [("noise", float(x)) for x in (-3, 1, 2, -1, 2, 0, 1, -2)] + [("good", 4.0 + 1.0 * (k % 2)) for k in range(400)]
    m = inference.moments(spark.createDataFrame(rows, "cell_id string, pnl double"), ["cell_id"], "pnl")
    d = m.withColumn("dsr", stats.deflated_sharpe(F.col("sr"), 20, F.col("sk"), F.col("ku"), F.col("n")))
    d = d.withColumn("why", inference.dsr_reason(F.col("n"), F.col("sr"), F.col("dsr")))
    got = {r["cell_id"]: r["why"] for r in d.collect()}
    assert got["one"] == "insufficient_trades" and got["flat"] == "zero_variance"
    assert got["nan"] == "non_finite_returns"
    assert got["noise"] == "dsr_probability_not_above_threshold" and got["good"] == "passed"


def test_hurdle_is_not_rescaled(spark):
    r = spark.range(1).select(stats.deflated_sharpe(F.lit(2.5), 96, F.lit(0.0), F.lit(3.0), F.lit(101)).alias("p")).first()
    hurdle = stats.expected_max_sharpe(96)
    z = (2.5 - hurdle) / math.sqrt((1 + 2.5**2 / 2) / 100)
    assert abs(r["p"] - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6


def test_levene_is_around_medians(spark):
    a, b = [1.0, 2.0, 3.0, 50.0], [1.0, 1.5, 2.0, 2.5, 3.0]
    rows = [("k", True, x) for x in a] + [("k", False, x) for x in b]
    za = np.abs(np.array(a) - np.median(a))
    zb = np.abs(np.array(b) - np.median(b))
    z = np.concatenate([za, zb])
    between = len(za) * (za.mean() - z.mean()) ** 2 + len(zb) * (zb.mean() - z.mean()) ** 2
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    got = agreement.levene(spark.createDataFrame(rows, "k string, f boolean, v double"), ["k"], "f", "v").first()
    assert abs(got["levene"] - 7 * between / within) < 1e-9
    assert abs(got["p"] - stats.student_p(pd.Series([math.sqrt(got["levene"])]), pd.Series([7.0]))[0]) < 1e-12


def test_mann_whitney_counts_pairs(spark):
    a, b = [1.0, 4.0, 4.0, 6.0], [2.0, 3.0, 4.0, 8.0, 9.0]
    rows = [("k", True, x) for x in a] + [("k", False, x) for x in b]
    got = agreement.mann_whitney(spark.createDataFrame(rows, "k string, f boolean, v double"), ["k"], "f", "v").first()
    assert got["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert 0 < got["p"] <= 1


def test_cliff_counts_missing_profit_factor_as_zero(spark, sf_dir):
    rows = {tuple(r)[:5]: r["alpha_cliff"] for r in alpha_cliffs(spark, sf_dir).collect()}
    from barline.sources import tables as T

    slots = {}
    for r in T.slot_reports(spark, sf_dir).collect():
        slots.setdefault((r["event"], r["pair"], r["wo"], r["hb"], r["et"]), []).append((r["fee"], r["pf"]))
    for key, fees in slots.items():
        low = [fee for fee, pf in fees if (pf or 0.0) < 2.0]
        assert rows[key] == (min(low) if low else None)


def test_trades_reach_the_last_bar(spark):
    t = spark.createDataFrame([(1, 700, 705, 5.0), (2, 699, 720, 1.0)], "id int, entry_bar int, exit_bar int, pnl double")
    got = {(r["id"], r["bar"]): r["bar_pnl"] for r in trades.expand_to_bars(t, F.lit(710)).collect()}
    assert got[(1, 705)] == 5.0 and got[(2, 710)] == 1.0 and max(b for _, b in got) == 710
    assert sum(got.values()) == 6.0


def test_gate_names_and_order(spark):
    row = spark.createDataFrame([(5.0, 0.01, 1.0, 0.1, 4, 1.0, 2.0, 0.1, 0.5)], "abs_t double, dsr_pvalue double, mean_pnl double, round_trip_cost double, folds_passing int, h1_mean double, h2_mean double, ci_low double, ci_high double")
    gates = row.select(verdicts.six_gates().alias("g")).first()["g"]
    assert [g["gate"] for g in gates] == ["abs_t_stat", "dsr_pvalue", "mean_pip_vs_cost", "fold_pf_4of5", "h1_h2_sign_agree", "bootstrap_ci_excludes_zero"]
    assert all(g["passed"] for g in gates)


def test_rows_do_not_share_draws(spark, sf_dir):
    from barline.sources import tables as T

    t = T.trades(spark, sf_dir)
    ids = t.select(F.expr(inference.ROW).alias("r")).distinct()
    assert ids.count() == t.select("ok", "ln", "pk", "sk").distinct().count()
    base = 123
    rows = np.array([base + k * draws.P for k in range(4000)] + [base + (k << 31) for k in range(1, 4000)], np.int64)
    u = draws.uniforms(rows, 6, 5)
    assert len({tuple(x) for x in u}) == len(rows)


def test_numpy_and_column_draws_agree(spark):
    rows = [0, 1, draws.P - 1, draws.P, 1 << 31, (1 << 62) + 12345, (1 << 63) - 1]
    got = spark.createDataFrame([(r,) for r in rows], "r bigint").select("r", *[draws.uniform(F.col("r"), k, 9).alias(f"u{k}") for k in range(3)]).collect()
    u = draws.uniforms(np.array(rows, np.int64), 3, 9)
    for line, r in zip(u, got, strict=True):
        assert [r["u0"], r["u1"], r["u2"]] == line.tolist()
        assert all(draws.mix_value(r["r"], k, 9) / draws.P == line[k] for k in range(3))


def test_replicate_sums_add_up_over_tasks(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id", F.col("id").cast("double").alias("x")).repartition(5)
    got = resampling.replicate_sums(df, ["k"], F.col("id"), {"s": F.col("x"), "n": F.lit(1.0)}, resampling.poisson_counts, 7, 3)
    ids = np.arange(5000)
    w = resampling.poisson_counts(draws.uniforms(ids, 7, 3))
    want = {(k, rep): (w[ids % 3 == k, rep] @ ids[ids % 3 == k], w[ids % 3 == k, rep].sum()) for k in range(3) for rep in range(7)}
    assert {(r["k"], r["rep"]): (r["s"], r["n"]) for r in got.collect()} == want


def test_front_by_merging(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.random((3000, 3)), 2)
    want = {tuple(p) for p in points if not ((points >= p).all(1) & (points > p).any(1)).any()}
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "a double, b double, c double")
    got = selection.pareto_front(df, ["a", "b", "c"]).collect()
    assert {tuple(r) for r in got} == want


def test_ranks_over_many_values(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 501).alias("v"))
    got = {(r["k"], r["value"]): (r["n_lt"], r["n_le"], r["n"]) for r in quantiles.value_ranks(df, ["k"], F.col("v")).collect()}
    for k in (0, 1):
        values = sorted(i * 7919 % 501 for i in range(2000) if i % 2 == k)
        for v in set(values):
            assert got[(k, v)] == (sum(x < v for x in values), sum(x <= v for x in values), len(values))


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        raise AssertionError("no folder may be chosen")


class _Session:
    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    def __init__(self, master):
        self.sparkContext = _Context(master)


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(_Session(master))


def test_pooled_draws_are_sums_of_single_ones():
    u = np.random.default_rng(4).random((1, 40_000))
    for size in (1, 3, 50, 2000):
        n = resampling.pool_counts("poisson")(u, np.array([size]))
        assert abs(n.mean() - size) < 4 * math.sqrt(size / 40_000) and abs(n.var() / size - 1) < 0.05
        s = resampling.kept_signs(u, np.array([size]))
        assert abs(s.mean()) < 4 * math.sqrt(size / 40_000) and abs(s.var() / size - 1) < 0.05
        assert ((s - size) % 2 == 0).all() and (abs(s) <= size).all()
    single = resampling.poisson_counts(u)
    assert (single == resampling.pool_counts("poisson")(u, np.array([1]))).mean() > 0.9999


def test_bootstrap_counts_exact_ties(spark):
    # Sparse, without spread, all wins: a resample whose sum is 0 lies exactly as far from the mean as 0 does.
    rows = [("sparse", i, float(v)) for i, v in enumerate([3, -1, -1, 1, -1])] + [("flat", i, 2.0) for i in range(9)]
    rows += [("zero", i, 0.0) for i in range(9)] + [("few", i, 1.0) for i in range(3)] + [("sparse", 99, None)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, x DOUBLE")
    got = {r.k: (r.n, r.mean, r.p_raw) for r in resampling.bootstrap_pvalues(df.repartition(3), ["k"], F.col("i"), F.col("x"), 500, 4).collect()}
    assert got["zero"] == (9, 0.0, 1.0) and got["few"] == (3, 1.0, 1.0) and got["flat"] == (9, 2.0, 0.0)
    pool = {3.0: (1, 0), -1.0: (3, 1), 1.0: (1, 3)}
    u = {x: draws.uniforms(np.array([row]), 500, 4)[0] for x, (_, row) in pool.items()}
    w = {x: resampling.pool_counts("poisson")(u[x][None, :], np.array([n]))[0] for x, (n, _) in pool.items()}
    s, size = sum(x * v for x, v in w.items()), sum(w.values())
    far = [abs(5 * a - 1 * b) >= b for a, b in zip(s, size, strict=True) if b > 0]
    assert ((s == 0) & (size > 0)).any() and got["sparse"] == (5, 0.2, sum(far) / len(far))


def test_correlation_of_few_series(spark):
    from barline.operators import portfolio

    rows = [(t, s, float((t * k) % 7 - 3)) for t in range(30) for k, s in ((2, "a"), (3, "b"), (5, "c"))]
    df = spark.createDataFrame(rows, "ts INT, slot STRING, r DOUBLE")
    series = np.array([[(t * k) % 7 - 3 for t in range(30)] for k in (2, 3, 5)])
    got = portfolio.mean_pairwise_correlation(df).first()
    assert got.pairs == 3 and math.isclose(got.mean_correlation, np.corrcoef(series)[np.triu_indices(3, 1)].mean(), abs_tol=1e-12)
    for few in (df.filter("slot = 'a'"), df.limit(0)):
        assert tuple(portfolio.mean_pairwise_correlation(few).first()) == (None, 0)


def test_front_is_thinned_in_the_tasks_of_the_scan(spark):
    df = spark.range(4000).select(*[((F.col("id") * k) % 97).cast("double").alias(c) for k, c in ((7, "a"), (11, "b"), (13, "c"))]).repartition(9)
    plan = selection.pareto_front(df, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.split("\n")]
    merges = [k for k, line in enumerate(lines) if line.startswith("MapInPandas")]
    assert len(merges) == 4 and all(lines[k + 1].startswith("Repartition") for k in merges[:-1])
    assert lines[merges[-1] + 1].startswith("Repartition 9")  # the table's own parts


def test_every_row_has_its_own_draws(spark):
    # Seven rows of one value: one draw for the pool would not give these counts and signs.
    x = np.array([2.0] * 7 + [-1.0, 3.0])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k STRING, i BIGINT, x DOUBLE")
    u = draws.uniforms(np.arange(9), 400, 4)
    w = resampling.poisson_counts(u)
    s, size, n, t = x @ w, w.sum(0), 9, x.sum()
    far = (abs(n * s - t * size) >= abs(t) * size)[size > 0]
    got = resampling.bootstrap_pvalues(df, ["k"], F.col("i"), F.col("x"), 400, 4, pooled=False).first()
    assert (got.n, got.mean, got.p_raw) == (9, t / 9, far.mean())
    extreme = int((x @ resampling.sign_flips(u) >= t).sum())
    got = resampling.sign_flip_pvalues(df, ["k"], F.col("i"), F.col("x"), 400, 4).first()
    assert (got.n, got.observed_sum, got.extreme, got.p_raw) == (9, t, extreme, (extreme + 1) / 401)


def test_poisson_counts_have_no_cap_that_draws_reach():
    assert resampling.poisson_counts(np.array([[0.0, 0.99999995, (draws.P - 1) / draws.P]])).tolist() == [[0.0, 10.0, 12.0]]


def test_fast_draws_at_the_ends():
    rows = np.array([0, 1, -1, 2**63 - 1, -(2**63), draws.P, (1 << 21) - 1, (1 << 42) - 1], np.int64)
    got = draws.uniforms(rows, 50, 7, first=990)
    want = [[draws.mix_value(int(r), rep, 7) / draws.P for rep in range(990, 1040)] for r in rows]
    assert got.tolist() == want

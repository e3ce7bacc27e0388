"""Corrections, resampling, selection, solvers, sources."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import stats as st
from barline.functions.draws import mix, mix_value, uniform
from barline.operators import multiple, resampling, selection
from barline.operators.policies import PolicyRule, evaluate
from barline.session import scratch_path
from barline.sources import files


def test_holm_with_padding(spark):
    df = spark.createDataFrame([(1, 0.02), (2, 0.01), (3, 0.04)], "i INT, p DOUBLE")
    got = {r.i: round(r.p_adj, 9) for r in multiple.holm(df, [], "p", ["i"], 5).collect()}
    assert got == {2: 0.05, 1: 0.08, 3: 0.12}


def test_draws_agree_and_look_uniform(spark):
    df = spark.range(20_000).select("id", mix(F.col("id"), F.lit(3), 42).alias("m"), uniform(F.col("id"), F.lit(3), 42).alias("u"))
    rows = df.collect()
    assert all(r.m == mix_value(r.id, 3, 42) for r in rows[:200])
    u = np.array([r.u for r in rows])
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.quantile(u, 0.9) - 0.9) < 0.01
    other = np.array([r[0] for r in df.select(uniform(F.col("id"), F.lit(4), 42)).collect()])
    assert abs(np.corrcoef(u, other)[0, 1]) < 0.03


def test_permutation_keeps_the_labels(spark):
    df = spark.createDataFrame([(i, "H" if i < 7 else "D") for i in range(20)], "cell_no INT, label STRING")
    out = resampling.shuffled(df, [], F.col("cell_no"), "label", 5, 1)
    counts = {(r.rep, r.shuffled): r["count"] for r in out.groupBy("rep", "shuffled").count().collect()}
    assert all(counts[(rep, "H")] == 7 and counts[(rep, "D")] == 13 for rep in range(5))
    assert len({tuple(r.shuffled for r in out.filter(f"rep={k}").orderBy("cell_no").collect()) for k in range(5)}) > 1


def test_block_bootstrap_sizes_and_spread(spark):
    flat = spark.createDataFrame([(1, i, 2.5) for i in range(97)], "k INT, i INT, x DOUBLE")
    means = resampling.block_bootstrap_means(flat, ["k"], ["i"], F.col("x"), 30, 9).collect()
    assert len(means) == 30 and all(math.isclose(r.mean, 2.5) for r in means)
    x = np.random.default_rng(1).normal(size=400)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k INT, i INT, x DOUBLE")
    m = np.array([r.mean for r in resampling.block_bootstrap_means(df, ["k"], ["i"], F.col("x"), 200, 9).collect()])
    assert abs(m.mean() - x.mean()) < 0.02 and 0.5 < m.std() / (x.std() / 20) < 1.5


def test_bootstrap_pvalue_separates(spark):
    rng = np.random.default_rng(2)
    rows = [("null", i, float(v)) for i, v in enumerate(rng.normal(size=300))] + [("edge", i, float(v)) for i, v in enumerate(rng.normal(0.5, 1, size=300))]
    rows += [("few", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k STRING, i INT, x DOUBLE")
    p = {r.k: r.p_raw for r in resampling.bootstrap_pvalues(df, ["k"], F.col("i"), F.col("x"), 200, 4).collect()}
    assert p["edge"] < 0.01 and p["null"] > 0.05 and p["few"] == 1.0


def test_ties_with_the_null_fail(spark):
    row = spark.range(1).select(resampling.exceeds_null(F.lit(3.0), F.lit(3.0)).alias("a"), resampling.exceeds_null(F.lit(3.1), F.lit(3.0)).alias("b")).first()
    assert (row.a, row.b) == (False, True)


@pytest.mark.parametrize("merges", [(64, 8, 1), (2, 1)])
def test_pareto_front_by_either_tree(spark, monkeypatch, merges):
    monkeypatch.setattr(selection, "MERGE_PARTS", merges)
    rnd = random.Random(3)
    pts = [(rnd.randrange(30), rnd.randrange(30), rnd.randrange(30)) for _ in range(600)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id INT, a INT, b INT, c INT").repartition(5)
    beats = lambda x, y: all(i >= j for i, j in zip(x, y)) and x != y
    want = {i for i, p in enumerate(pts) if not any(beats(q, p) for q in pts)}
    assert {r.id for r in selection.pareto_front(df, ["a", "b", "c"]).collect()} == want


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "big" if i < 40 else "small") for i in range(43)], "id INT, y STRING")
    out = {(r.y, r.split): r["count"] for r in selection.stratified_split(df, "id", "y", 1).groupBy("y", "split").count().collect()}
    assert out == {("big", "test"): 10, ("big", "train"): 30, ("small", "train"): 3}


def test_solvers():
    assert math.isclose(st.beta_quantile(0.05, 1, 1), 0.05, abs_tol=1e-9)
    assert math.isclose(st.beta_quantile(0.5, 2, 2), 0.5, abs_tol=1e-9)
    assert math.isclose(st.beta_quantile(0.975, 1, 10), 1 - 0.025**0.1, abs_tol=1e-9)
    assert math.isclose(st.beta_cdf(0.3, 2, 5), 0.579825, abs_tol=1e-6)
    assert math.isclose(st.mean_vif(np.eye(3)), 1.0)
    assert st.mean_vif(np.ones((2, 2))) == math.inf


def test_normal_cdf(spark):
    xs = [-3.0, -1.0, 0.0, 0.5, 1.96]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select("x", st.normal_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert math.isclose(r.p, 0.5 * (1 + math.erf(r.x / math.sqrt(2))), abs_tol=1e-7)


def test_policy_precedence(spark):
    rules = [PolicyRule("s", "v", "gte", "size", 1.0), PolicyRule("c", "v", "gte", "cap", 5.0, 3.0), PolicyRule("b", "v", "gte", "block", 9.0), PolicyRule("x", "gone", "exists", "block")]
    df = spark.createDataFrame([(0.5,), (2.0,), (6.0,), (9.5,), (-1.0,)], "v DOUBLE")
    got = {r.v: (r.decision_class, r.binding_rule, r.supporting_rules, r.allowed_size) for r in evaluate(df, rules, "v").collect()}
    assert got[0.5] == ("block", "malformed_policy.no_match", "", 0.0)
    assert got[2.0] == ("size", "s", "s", 2.0)
    assert got[6.0] == ("cap", "c", "c,s", 3.0)
    assert got[9.5] == ("block", "b", "b,c,s", 0.0)
    assert got[-1.0] == ("block", "invalid.requested_size", "", 0.0)


BAR = "datetime_ns BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def test_strict_bar_files(spark):
    good = spark.createDataFrame([(10**18, 1.0, 2.0, 0.5, 1.5, 3.0)], BAR)
    path = scratch_path(spark, "t")
    good.write.parquet(path)
    assert files.read_bars_parquet(spark, path).count() == 1
    for bad in (good.select("open", "datetime_ns", "high", "low", "close", "volume"), good.withColumn("close", F.lit(None).cast("double")), good.withColumn("volume", F.lit(1))):
        path = scratch_path(spark, "t")
        bad.write.parquet(path)
        with pytest.raises(files.ContractError):
            files.read_bars_parquet(spark, path)


def test_strict_csv_header(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame([(1, 1.0)], "datetime_ns BIGINT, opens DOUBLE").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        files.read_bars_csv(spark, path).collect()


def test_missing_files_are_an_error(spark):
    with pytest.raises(Exception):
        files.read_ticks_csv(spark, scratch_path(spark, "none") + "/*.csv").count()


def test_shards_written_once(spark):
    q = spark.createDataFrame([("a", "2024-01-05 00:00:00"), ("a", "2024-02-05 00:00:00"), ("b", "2024-01-01 00:00:00")], "symbol STRING, ts STRING").withColumn("ts", F.to_timestamp("ts"))
    path = scratch_path(spark, "t")
    assert files.write_tick_shards(q.filter("symbol = 'a'"), path) == 2
    assert files.write_tick_shards(q, path) == 1
    assert files.write_tick_shards(q, path) == 0 and spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("chunk, asked", [(1 << 20, 1 << 18), (16, 100)])
def test_block_bootstrap_of_a_series_in_chunks(spark, monkeypatch, chunk, asked):
    """Against blocks laid row by row; a series longer than a chunk is dealt over tasks, and its blocks are never rows."""
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    monkeypatch.setattr(resampling, "ASKED", asked)
    x = {"a": [float((i * i) % 23 - 9) for i in range(67)], "b": [4.0, -1.0, 2.0], "c": [5.0]}
    x["a"][0] = x["a"][30] = None
    df = spark.createDataFrame([(k, i, v) for k, s in x.items() for i, v in enumerate(s)], "k STRING, i INT, x DOUBLE")
    want = {}
    for key, s in x.items():
        n = len(s)
        p = min(max(1 / math.sqrt(n), 1e-6), 1 - 1e-6)
        for rep in range(25):
            taken, k = [], 1
            while len(taken) < n:
                u, at = (mix_value(k, rep, 9 + salt) / 2_147_483_647 for salt in (0, 1))
                length = math.floor(math.log(1 - max(u, 1e-12)) / math.log(1 - p)) + 1
                taken += [s[(math.floor(at * n) + j) % n] or 0.0 for j in range(min(length, n - len(taken)))]
                k += 1
            want[key, rep] = sum(taken) / n
    means = resampling.block_bootstrap_means(df.repartition(3), ["k"], ["i"], F.col("x"), 25, 9)
    assert {(r.k, r.rep): r["mean"] for r in means.collect()} == want
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "FlatMapGroupsInArrow" in plan


def test_gate_inputs_lay_no_blocks_as_rows(spark, sf_dir):
    from barline.plans.inference import REPS, gate_inputs

    g = gate_inputs(spark, sf_dir)
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "sequence(" not in plan and f"{REPS - 1})" not in plan

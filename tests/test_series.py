"""Ordered-series primitives against brute force, under skew and re-partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.operators.asof import asof_backward, asof_forward, asof_forward_grid
from barline.operators.coverage import with_open_windows
from barline.operators.quantiles import average_ranks, exact_percentiles
from barline.operators.series import Run, fan_out, rolling, running


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and many rows share one time."""
    rnd = random.Random(7)
    rows = [("hot", rnd.choice([5, 5, 5, rnd.randrange(100)]), i, float(rnd.randrange(-9, 10))) for i in range(3000)]
    rows += [(f"k{i % 40}", rnd.randrange(100), 10_000 + i, float(rnd.randrange(-9, 10))) for i in range(1000)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k STRING, t INT, id INT, x DOUBLE").cache()


def brute(df, value):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return {(r.k, r.id): r.v for r in df.select("k", "id", value(w).alias("v")).collect()}


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_running_matches_window(spark, skewed, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        runs = {"s": Run("sum", F.col("x")), "m": Run("max", F.col("x")), "n": Run("count", F.lit(1))}
        runs["last"] = Run("last", F.when(F.col("x") > 0, F.col("x")))
        got = running(skewed, ["k"], ["t", "id"], runs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 4000
    for name, value in (
        ("s", lambda w: F.sum("x").over(w)),
        ("m", lambda w: F.max("x").over(w)),
        ("n", lambda w: F.count(F.lit(1)).over(w)),
        ("last", lambda w: F.last(F.when(F.col("x") > 0, F.col("x")), True).over(w)),
    ):
        want = brute(skewed, value)
        assert all(want[(r.k, r.id)] == r[name] for r in got), name


def test_running_stages_and_exclusive(skewed):
    first, second = {"s": Run("sum", F.col("x"))}, {"peak": Run("max", F.col("s")), "before": Run("last", F.col("x"), False)}
    got = running(skewed, ["k"], ["t", "id"], first, second).collect()
    rows = {}
    for r in sorted(got, key=lambda r: (r.k, r.t, r.id)):
        s, peak, prev = rows.get(r.k, (0.0, None, None))
        s += r.x
        peak = s if peak is None else max(peak, s)
        assert (r.s, r.peak, r.before) == (s, peak, prev)
        rows[r.k] = (s, peak, r.x)


@pytest.mark.parametrize("block", [7, 50, 100_000])
def test_rolling_matches_window(skewed, block):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-5, 2)
    want = {(r.k, r.id): r.v for r in skewed.select("k", "id", F.sum("x").over(w).alias("v")).collect()}
    got = rolling(skewed, ["k"], ["t", "id"], lambda v: {"v": F.sum("x").over(v.rowsBetween(-5, 2))}, back=5, ahead=2, block_rows=block)
    assert {(r.k, r.id): r.v for r in got.collect()} == want


def test_exact_percentiles_and_ranks(skewed):
    got = {r.k: r for r in exact_percentiles(skewed, ["k"], F.col("x"), {"a": 0.05, "b": 0.5, "c": 0.83}).collect()}
    values = {}
    for r in skewed.collect():
        values.setdefault(r.k, []).append(r.x)
    for k, v in values.items():
        assert np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(v, [0.05, 0.5, 0.83]))
    ranks = average_ranks(skewed.withColumn("g", F.lit(1)), ["g"], F.col("x"))
    x = np.array([r.x for r in skewed.collect()])
    for r in ranks.collect():
        assert r.avg_rank == (x < r.value).sum() + ((x == r.value).sum() + 1) / 2


def test_forward_asof_boundaries(spark):
    quotes = [(s, b, b + 0.1) for s, b in ((0, 1.0), (29_900_000, 2.0), (30_000_000, 3.0), (59_900_000, 4.0), (60_000_000, 5.0))]
    q = spark.createDataFrame([("a", *r) for r in quotes], "symbol STRING, us BIGINT, bid DOUBLE, ask DOUBLE")
    a = spark.createDataFrame([("a", 0), ("a", 30_000_000), ("a", 60_000_000), ("a", 90_000_000), ("b", 0)], "symbol STRING, anchor_us BIGINT")
    want = {("a", 0): 1.0, ("a", 30_000_000): 3.0, ("a", 60_000_000): 5.0, ("a", 90_000_000): None, ("b", 0): None}
    for got in (asof_forward(a, q, ["symbol"], "anchor_us", 60_000_000), asof_forward_grid(a, q, ["symbol"], "anchor_us")):
        assert {(r.symbol, r.anchor_us): r.bid for r in got.collect()} == want


def test_forward_asof_tolerance_is_half_open(spark):
    q = spark.createDataFrame([("a", 60_000_000, 1.0, 1.1)], "symbol STRING, us BIGINT, bid DOUBLE, ask DOUBLE")
    a = spark.createDataFrame([("a", 0), ("a", 1)], "symbol STRING, anchor_us BIGINT")
    got = {r.anchor_us: r.bid for r in asof_forward(a, q, ["symbol"], "anchor_us", 60_000_000).collect()}
    assert got == {0: None, 1: 1.0}


def test_backward_asof_backfills(spark):
    src = spark.createDataFrame([(10, 1.0), (20, 2.0)], "t INT, v DOUBLE")
    tgt = spark.createDataFrame([(5,), (10,), (19,), (25,)], "t INT")
    got = {r.t: r.aux for r in asof_backward(tgt, src, [], "t", "v", "aux").collect()}
    assert got == {5: 1.0, 10: 1.0, 19: 1.0, 25: 2.0}
    got = {r.t: r.aux for r in asof_backward(tgt, src, [], "t", "v", "aux", backfill=False).collect()}
    assert got[5] is None
    assert asof_backward(tgt, src.filter("t > 99"), [], "t", "v", "aux").first().aux == 0.0


def test_open_windows_half_open(spark):
    win = spark.createDataFrame([(0, 10), (5, 15)], "start INT, end INT")
    rows = spark.createDataFrame([(-1,), (0,), (5,), (9,), (10,), (15,)], "ts INT")
    got = {r.ts: r.open_windows for r in with_open_windows(rows, win).collect()}
    assert got == {-1: 0, 0: 1, 5: 2, 9: 2, 10: 1, 15: 0}


def test_fan_out_keeps_rows(spark):
    assert fan_out(spark.range(5), "v", [1, 2, 3]).count() == 15


def test_bars_by_time_alone_agree(spark, sf_dir):
    from barline.operators.bars import ticks_to_bars
    from barline.sources.tables import quotes

    q = quotes(spark, sf_dir)
    assert q.groupBy("symbol", "us").count().filter("count > 1").isEmpty()
    a, b = ticks_to_bars(q, "1h"), ticks_to_bars(q, "1h", unique_times=True)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

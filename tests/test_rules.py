"""Indicators, rules and accounting from hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import history
from barline.operators import indicators as ind
from barline.operators.accounting import account, performance, sticky_position
from barline.operators.indicators import by
from barline.operators.rules import RULES, apply_rule, hysteresis
from barline.operators.states import defer_blackout, vol_bucket

K = ["symbol"]


def bars(spark, closes, minutes=60, start="2024-01-02 00:00:00"):
    rows = [("a", i, float(c)) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol STRING, i INT, close DOUBLE")
    t0 = F.lit(start).cast("timestamp")
    ts = F.timestamp_micros(F.unix_micros(t0) + F.col("i").cast("bigint") * minutes * 60_000_000)
    return df.select("symbol", ts.alias("ts"), F.col("close").alias("open"), (F.col("close") + 0.5).alias("high"), (F.col("close") - 0.5).alias("low"), "close", F.lit(1.0).alias("volume"))


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_sma_and_ema(spark):
    b = bars(spark, [1, 2, 3, 4, 5])
    assert column(b.withColumn("v", ind.sma(F.col("close"), 3, by(K))), "v") == [None, None, 2, 3, 4]
    assert np.allclose(column(ind.with_ema(b, K, F.col("close"), 3, "v"), "v"), [1, 1.5, 2.25, 3.125, 4.0625])


@pytest.mark.parametrize("span", [1, 2, 9, 60, 400])
def test_ema_blocks_match_recursion(spark, span):
    x = np.cumsum(np.random.default_rng(3).normal(size=900)) + 100
    want, a = [x[0]], 2 / (span + 1)
    for v in x[1:]:
        want.append(a * v + (1 - a) * want[-1])
    got = column(ind.with_ema(bars(spark, x), K, F.col("close"), span, "v"), "v")
    assert np.allclose(got, want, rtol=1e-11)


def test_rsi_without_losses_is_100(spark):
    got = column(ind.with_rsi(bars(spark, range(1, 8)), K, 3), "rsi")
    assert got[:3] == [None, None, None] and got[3:] == [100.0] * 4


def test_undefined_values_stick(spark):
    b = bars(spark, [1, 2, 3, 4, 5]).withColumn("x", F.when(F.col("close") > 1, F.col("close")))
    w = by(K)
    got = b.withColumn("a", ind.sma(F.col("x"), 2, w)).withColumn("s", ind.sma(F.col("x"), 2, w, nulls_stick=True))
    assert column(got, "a") == [None, None, 2.5, 3.5, 4.5]
    assert column(got, "s") == [None] * 5


def test_two_bar_lag_and_flatten(spark):
    signals = [1, 0, -2, 0, -1, 0, 0]
    b = bars(spark, [100, 110, 121, 121, 121, 121, 133.1]).withColumn("i", F.row_number().over(by(K)))
    b = b.withColumn("signal", F.element_at(F.array(*[F.lit(s) for s in signals]), F.col("i")))
    got = account(b, K, 0.0)
    assert column(got, "position") == [0, 1, 1, 0, 0, -1, -1]
    assert np.allclose(column(got, "ret"), [0, 0, 0.1, 0, 0, 0, -0.1])
    assert column(b.withColumn("p", sticky_position(K, mode=1)), "p") == [0, 1, 1, 0, 0, 0, 0]
    m = performance(got, K, 365.0).first()
    assert m.trades == 3 and math.isclose(m.profit_factor, 1.0) and math.isclose(m.max_drawdown, -0.1)


def test_sized_accounting(spark):
    b = apply_rule("sma_cross", bars(spark, 100 + 5 * np.sin(np.arange(120) / 5)), K)
    base, one, half = (performance(account(b, K, 0.001, size=s), K, 8760.0).first() for s in (1.0, 1.0, 0.5))
    assert base == one and half.trades == base.trades
    assert math.isclose(half.gross_profit, base.gross_profit / 2)


def test_no_losses_give_no_profit_factor(spark):
    b = bars(spark, range(100, 140)).withColumn("signal", F.when(F.col("close") == 100, 1).otherwise(0))
    assert performance(account(b, K, 0.0), K, 8760.0).first().profit_factor is None


def test_max_drawdown(spark):
    from barline.operators.accounting import with_drawdown

    b = bars(spark, [1, 2, 3, 4]).withColumn("equity", F.element_at(F.array(*[F.lit(x) for x in (1.0, 1.1, 0.9, 1.2)]), F.row_number().over(by(K))))
    assert math.isclose(min(column(with_drawdown(b, K), "drawdown")), -0.2 / 1.1)


def test_stop_before_target_and_rest_after_flatten(spark):
    b = bars(spark, [100, 100, 100, 100, 100, 100]).withColumn("atr", F.lit(0.4))
    sig = [0, 1, 1, 2, 1, 1]
    b = b.withColumn("signal", F.element_at(F.array(*[F.lit(s) for s in sig]), F.row_number().over(by(K))))
    got = history.stopped_accounting(b, K, 0.0, sl_atr=1.0, tp_atr=1.0)
    # Entry on bar 1, stop on bar 2 (high and low both hit), flat on bar 3,
    # entry on bar 4 because nothing was open to flatten.
    assert np.allclose(column(got, "ret"), [0, 0, -0.004, 0, 0, -0.004])
    wide = history.stopped_accounting(b, K, 0.0, sl_atr=10.0, tp_atr=10.0)
    assert column(wide, "closed") == [0, 0, 0, 1, 0, 0]


def test_hysteresis_passes_through_flat():
    z = np.array([np.nan, -2.0, -1.0, 2.5, 2.5, 0.0])
    yes = np.ones(6, bool)
    s, p = hysteresis(z, 1.5, 0.3, ~yes, yes, yes)
    assert p.tolist() == [0, 1, 1, 0, -1, 0] and s.tolist() == [0, 1, 0, -1, -1, 1]


def test_deferred_signal_latest_wins(spark):
    sig = [0, 1, -1, 0, 0, 2, 0, 0]
    black = [False, True, True, False, False, True, True, False]
    b = bars(spark, [1] * 8).withColumn("i", F.row_number().over(by(K)))
    b = b.withColumn("signal", F.element_at(F.array(*[F.lit(x) for x in sig]), F.col("i")))
    got = defer_blackout(b, K, F.element_at(F.array(*[F.lit(x) for x in black]), F.col("i")))
    assert column(got, "signal") == [0, 0, 0, -1, 0, 2, 0, 0]


def test_vol_bucket_edges(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (2.9,), (3.0,)], "v DOUBLE")
    got = [r[0] for r in df.select(vol_bucket(F.col("v"), F.lit(2.0), F.lit(3.0))).collect()]
    assert got == ["VOL_NA", "VOL_LOW", "VOL_MID", "VOL_MID", "VOL_HIGH"]


@pytest.mark.parametrize("name", [n for n in RULES if n not in ("macro_event_drift", "time_of_day_drift")])
def test_no_look_ahead(spark, name):
    x = 100 + np.cumsum(np.random.default_rng(5).normal(size=160))
    full, cut = bars(spark, x), bars(spark, x[:120])
    a = column(apply_rule(name, full, K), "signal")[:120]
    assert a == column(apply_rule(name, cut, K), "signal")


def test_purged_folds_keep_their_distance(spark):
    f = history.purged_folds(bars(spark, range(100)), 5, 4).collect()
    for k in range(5):
        oos = [r.idx for r in f if r.fold == k and r.role == "oos"]
        inside = [r.idx for r in f if r.fold == k and r.role == "is"]
        assert len(oos) == 20 and min(min(abs(i - o) for o in oos) for i in inside) > 4

"""Scans over several rules: a planted edge, exits by hand, merged summaries against whole stretches."""

import math

import numpy as np
from pyspark.sql import functions as F

from barline.operators import scan
from barline.operators.accounting import account, performance
from barline.operators.rules import apply_rule

SCHEMA = "symbol STRING, tf STRING, ts TIMESTAMP, high DOUBLE, low DOUBLE, close DOUBLE"


def bars(spark, close, symbol="a", wide=0.0):
    rows = [(symbol, "1h", i, c * (1 + wide), c * (1 - wide), c) for i, c in enumerate(map(float, close))]
    df = spark.createDataFrame(rows, SCHEMA.replace("ts TIMESTAMP", "i INT"))
    return df.select("symbol", "tf", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 3600).alias("ts"), "high", "low", "close")


def test_scan_agrees_with_the_single_rule(spark):
    close = 100 + np.cumsum(np.random.default_rng(1).normal(size=400))
    b = bars(spark, close)
    one = scan.Scan(scan.standard_rules([(3, 10), (5, 20)], [], [], []), modes=(0, 1))
    keys = [*scan.UNIT, "rule", "a", "b"]
    got = {(r.a, r.b, r.mode): r for r in scan.summaries(scan.units(b, one), keys).collect()}
    for short, long, mode in ((3, 10, 0), (5, 20, 0), (5, 20, 1)):
        signal = apply_rule("sma_cross", b.drop("tf"), ["symbol"], short_window=short, long_window=long)
        want = performance(account(signal, ["symbol"], one.fee, mode=mode), ["symbol"], 8760.0).first()
        r = got[float(short), float(long), mode]
        assert r.bars == want.bars and r.trades == want.trades
        assert math.isclose(r.gp, want.gross_profit, abs_tol=1e-9) and math.isclose(r.growth - 1, want.total_return, abs_tol=1e-9)
        assert math.isclose(r.drawdown, want.max_drawdown, abs_tol=1e-9)


def test_planted_edge_is_found(spark):
    """Waves of 40 bars: crosses that follow them earn, whatever noise the others see."""
    t = np.arange(1200)
    close = 100 * np.exp(0.04 * np.sin(2 * np.pi * t / 40))
    found = scan.Scan(scan.standard_rules([(2, 6), (30, 60)], [(3, 0.5)], [(20, 1.0)], [10]), fee=0.0001, modes=(0,))
    s = scan.summaries(scan.units(bars(spark, close), found), [*scan.UNIT, "rule", "a", "b"]).withColumns(scan.measures("", "", 8760.0))
    pf = {(r.rule, r.a): r.pf for r in s.collect()}
    assert len(pf) == found.trials and pf["cross", 2.0] > 2 and pf["momentum", 3.0] > 2 and pf["reversion", 20.0] < 1 and pf["cross", 30.0] < pf["cross", 2.0] / 2


def test_exits_by_hand(spark):
    # Up from bar 4 on: held from bar 5 (entry at its close), earns from bar 6; target 5 % above 106 is met on bar 8.
    close = [100, 100, 100, 100, 103, 106, 108, 110, 112, 113, 114]
    rule = scan.ScanRule("up", (("before", "a"),), lambda get: F.when(F.col("close") > get("before", "a"), 1).otherwise(0), ({"a": 1},))
    for e, last in ((scan.Exit("none"), 114.0), (scan.Exit("target", None, 0.05), 106 * 1.05), (scan.Exit("stop", 0.02, None), 114.0)):
        rows = scan.units(bars(spark, close), scan.Scan((rule,), (e,), (0,), fee=0.0)).orderBy("ts").collect()
        assert math.isclose(np.prod([1 + r.ret for r in rows]), last / 106, rel_tol=1e-12)
        assert [r.traded for r in rows].index(1) == 5 and sum(r.traded for r in rows) == 1 + (e.name == "target")
    falls = [*close[:7], 90, 91, 92, 93]
    rows = scan.units(bars(spark, falls), scan.Scan((rule,), (scan.Exit("stop", 0.02, 0.5),), (1,), fee=0.0)).orderBy("ts").collect()
    assert math.isclose((1 + rows[6].ret) * (1 + rows[7].ret), 0.98, rel_tol=1e-12) and rows[8].gross == 0


def test_merged_summaries_are_those_of_the_whole(spark):
    rng = np.random.default_rng(3)
    rows = [("k", i, float(r), float(r), int(i % 7 == 0), int(i // 60)) for i, r in enumerate(rng.normal(0, 0.02, 360))]
    df = spark.createDataFrame(rows, "k STRING, ts INT, ret DOUBLE, gross DOUBLE, traded INT, block INT")
    got = scan.merged(scan.summaries(df, ["k", "block"]), ["k"], "block").collect()
    for r in got:
        if r.block:
            whole = scan.summaries(df.filter(F.col("block") < r.block), ["k"]).first()
            for name in (*scan.SUMS, "growth", "drawdown"):
                assert math.isclose(r["is_" + name], whole[name], rel_tol=1e-9, abs_tol=1e-12), name


def test_walks_of_an_uptrend_pass(spark):
    t = np.arange(24 * 90)
    close = 100 * np.exp(0.0004 * t + 0.01 * np.sin(2 * np.pi * t / 48))
    up = scan.Scan(scan.standard_rules([(12, 96)], [], [], []), modes=(1,), fee=0.0)
    b = bars(spark, close)
    walks = scan.walk_metrics(b, up, (1, 0.4), 4, 8760.0)
    folds = walks.orderBy("fold").collect()
    assert [w.fold for w in folds] == [0, 1, 2, 3] and all(a.is_bars < c.is_bars for a, c in zip(folds, folds[1:], strict=False))
    s = scan.walk_summary(walks, up, 8760.0, scan.Gates()).first()
    assert s.passed and s.relaxed_pass and s.win_rate == 1.0 and 0 <= s.dsr_pvalue <= 1
    flat = scan.walk_summary(scan.walk_metrics(bars(spark, np.full(24 * 90, 100.0)), up, (1, 0.4), 4, 8760.0), up, 8760.0).first()
    assert not flat.passed and not flat.strict_pass and flat.combined_pf == 0.0 and flat.trades == 0

"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import time

from barline.operators.history import sweep
from barline.plans import catalog
from barline.plans.scans import SCAN, framed
from barline.plans.shapes import hourly
from barline.session import local_session

HEADLINE = (
    "flagship_sma_cross",
    "flagship_tick_study",
    "D01_tick_to_bars",
    "C01_asof_backward_ticks",
    "C02_asof_forward_tolerance",
    "C03_asof_forward_grid",
    "D05_source_audit",
    "D26_sign_tally",
    "E05_sma_ticks",
    "E06_ema",
    "E12_rolling_median",
    "E25_drawdown",
    "E29_loss_streak",
    "H02_ema_atr",
    "I10_batch_sweep",
    "D54_walk_summary",
    "I10_rule_scan",
    "D54_scan_summary",
    "I24_exit_replay",
    "I32_overlay_grid",
    "F03_pareto_front",
    "J02_block_bootstrap_interval",
    "J04_iid_bootstrap_pvalue",
    "J09_holm_padded",
    "J21_kruskal_weekday",
    "K22_html_paragraphs",
    "L05_policy_evaluation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "barline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.PLANS["D01_tick_to_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    # The one published rate to hold this against is work units per second of a
    # parameter sweep; here a unit is one symbol and parameter pair.
    grid = [(a, b) for a in range(2, 26, 2) for b in range(30, 150, 10)]
    bars = hourly(spark, sf_dir)
    start = time.perf_counter()
    sweep(bars, ["symbol"], grid, 0.0004, 8760.0).write.format("noop").mode("overwrite").save()
    units = 5 * len(grid) / (time.perf_counter() - start)
    # The general scan: a unit is one series, rule, parameter row, exit and mode; with walks the same units in the summary.
    series = framed(spark, sf_dir).select("symbol", "tf").distinct().count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sweep_units_per_sec": round(units, 2),
                "scan_units_per_sec": round(series * SCAN.trials / seconds["I10_rule_scan"], 2),
                "walk_units_per_sec": round(series * SCAN.trials / seconds["D54_scan_summary"], 2),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

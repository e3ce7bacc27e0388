"""Scans of rules over timeframes, exits, modes and parameters, and their anchored walks.

Rules are expressions over parameter *columns*.  Each different (indicator,
period) of a grid is computed once per bar; then a bar is repeated for the
parameter rows and picks what its row asks for, so a scan is one job whatever its
rules.  Repeated rows are spread by (series, parameter row).

Exits act inside a run of one held side: a stop or target, set from the close at
which the run began, ends the position until the rule changes its side.  That is
a flag over earlier bars of the run, not a loop.

Walks are anchored: in-sample parts are nested prefixes.  A unit's bars are cut
once at all walk borders, each block becomes one mergeable summary (sums, growth,
highest and lowest point, drawdown), and the summary of every prefix is a running
merge over blocks.  No bar is repeated for a walk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.stats import deflated_sharpe
from barline.operators.accounting import BOTH, LONG_ONLY, SHORT_ONLY, sticky_position
from barline.operators.history import DAYS_PER_MONTH
from barline.operators.indicators import by
from barline.operators.rules import position_to_signal

#: Indicators over a series' window and a period; null until the period is full.
INDICATORS: dict[str, Callable[[WindowSpec, int], Column]] = {
    "mean": lambda w, n: _full(w.rowsBetween(-(n - 1), 0), n, F.avg("close")),
    "spread": lambda w, n: _full(w.rowsBetween(-(n - 1), 0), n, F.stddev_pop("close")),
    "before": lambda w, n: F.lag("close", n).over(w),
    "highest": lambda w, n: _full(w.rowsBetween(-n, -1), n, F.max("high")),
    "lowest": lambda w, n: _full(w.rowsBetween(-n, -1), n, F.min("low")),
}


def _full(frame: WindowSpec, n: int, value: Column) -> Column:
    return F.when(F.count("close").over(frame) == n, value.over(frame))


@dataclass(frozen=True)
class ScanRule:
    """A rule: what it needs as (indicator, parameter), its side from these and the parameters, and its grid.

    ``position(get)`` gets ``get(indicator, parameter)`` for an indicator and
    ``get(None, parameter)`` for a parameter's own value.
    """

    name: str
    needs: tuple[tuple[str, str], ...]
    position: Callable[[Callable[[str | None, str], Column]], Column]
    grid: tuple[dict[str, float], ...]


@dataclass(frozen=True)
class Exit:
    """Stop and target as shares of the price at which a side was taken; None: never."""

    name: str
    stop: float | None = None
    target: float | None = None


@dataclass(frozen=True)
class Gates:
    """Least combined profit factor, win rate of walks, efficiency, trades a year; lowest drawdown; significance."""

    pf: float = 1.0
    win_rate: float = 0.5
    wfe: float = 0.4
    annual_trades: float = 0.0
    max_drawdown: float = -0.3
    alpha: float = 0.05


@dataclass(frozen=True)
class Scan:
    rules: tuple[ScanRule, ...]
    exits: tuple[Exit, ...] = (Exit("none"),)
    modes: tuple[int, ...] = (BOTH, LONG_ONLY, SHORT_ONLY)
    fee: float = 0.0004
    #: Names of all parameters, in output order.
    parameters: tuple[str, ...] = field(default=("a", "b"))

    @property
    def rows(self) -> list[tuple[ScanRule, dict[str, float]]]:
        return [(r, p) for r in self.rules for p in r.grid]

    @property
    def trials(self) -> int:
        """Units of one series: what its best one is deflated by."""
        return len(self.rows) * len(self.exits) * len(self.modes)


SERIES = ("symbol", "tf")
UNIT = (*SERIES, "param_id", "exit", "mode")


def _side(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def _cross(get) -> Column:
    return _side(get("mean", "a") > get("mean", "b"), get("mean", "a") < get("mean", "b"))


def _momentum(get) -> Column:
    moved = F.col("close") / get("before", "a") - 1
    return _side(moved > get(None, "b") / 100, moved < -get(None, "b") / 100)


def _reversion(get) -> Column:
    away = get(None, "b") * get("spread", "a")
    return _side(F.col("close") < get("mean", "a") - away, F.col("close") > get("mean", "a") + away)


def _breakout(get) -> Column:
    return _side(F.col("close") > get("highest", "a"), F.col("close") < get("lowest", "a"))


def standard_rules(crosses, momenta, reversions, breakouts) -> tuple[ScanRule, ...]:
    """Moving-average cross (a, b), momentum (a bars, b per cent), reversion to the mean (a bars, b deviations), breakout (a bars)."""
    pairs = lambda values: tuple({"a": a, "b": b} for a, b in values)
    return (
        ScanRule("cross", (("mean", "a"), ("mean", "b")), _cross, pairs(crosses)),
        ScanRule("momentum", (("before", "a"),), _momentum, pairs(momenta)),
        ScanRule("reversion", (("mean", "a"), ("spread", "a")), _reversion, pairs(reversions)),
        ScanRule("breakout", (("highest", "a"), ("lowest", "a")), _breakout, tuple({"a": a} for a in breakouts)),
    )


def positions(bars: DataFrame, scan: Scan) -> DataFrame:
    """``SERIES, param_id, rule, parameters, ts, high, low, close, signal`` and the columns of ``bars`` beside them."""
    w = by(SERIES)
    wanted = sorted({(kind, int(p[name])) for r, p in scan.rows for kind, name in r.needs})
    ready = bars.select("*", *[INDICATORS[kind](w, n).alias(f"_{kind}_{n}") for kind, n in wanted])
    rows = [
        F.struct(F.lit(i).alias("param_id"), F.lit(r.name).alias("rule"), *[F.lit(p.get(k)).cast("double").alias(k) for k in scan.parameters])
        for i, (r, p) in enumerate(scan.rows)
    ]
    wide = ready.withColumn("_p", F.explode(F.array(*rows))).select(*ready.columns, "_p.*")

    def get(kind: str | None, name: str) -> Column:
        if kind is None:
            return F.col(name)
        return F.coalesce(*[F.when(F.col(name) == n, F.col(f"_{k}_{n}")) for k, n in wanted if k == kind])

    side = F.lit(0)
    for r in (r for r in scan.rules if r.grid):
        side = F.when(F.col("rule") == r.name, r.position(get)).otherwise(side)
    keys = [*SERIES, "param_id"]
    work = wide.select(*bars.columns, "param_id", "rule", *scan.parameters, side.alias("position")).repartition(*keys)
    return position_to_signal(work, keys)


def units(bars: DataFrame, scan: Scan) -> DataFrame:
    """Per-bar ``ret``, ``gross`` (before fees) and ``traded`` of every unit: parameter row, exit and mode."""
    held = positions(bars, scan).withColumn("held", sticky_position([*SERIES, "param_id"]))
    nothing = F.lit(None).cast("double")
    variants = [
        F.struct(F.lit(e.name).alias("exit"), F.lit(m).alias("mode"), *[nothing.alias(k) if v is None else F.lit(v).alias(k) for k, v in (("stop", e.stop), ("target", e.target))])
        for e in scan.exits
        for m in scan.modes
    ]
    work = held.withColumn("_v", F.explode(F.array(*variants))).select(*held.columns, "_v.*")
    allowed = F.when(F.col("mode") == LONG_ONLY, F.greatest("held", F.lit(0))).when(F.col("mode") == SHORT_ONLY, F.least("held", F.lit(0)))
    work = work.withColumn("held", allowed.otherwise(F.col("held")).cast("int"))
    w = by(UNIT)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # Runs of one held side, and the close at which each began; a bar earns for the side held before it.
    work = work.withColumns({"_prev": F.lag("held").over(w), "_pc": F.lag("close").over(w)})
    work = work.withColumn("_run", F.sum(F.coalesce((F.col("held") != F.col("_prev")).cast("int"), F.lit(1))).over(so_far))
    entry = F.first("close").over(by([*UNIT, "_run"]).rowsBetween(Window.unboundedPreceding, 0))
    work = work.withColumn("_entry", entry).withColumns({"_run": F.lag("_run").over(w), "_entry": F.lag("_entry").over(w)})
    side, at = F.coalesce("_prev", F.lit(0)), F.col("_entry")
    adverse, kind = F.when(side > 0, F.col("low")).otherwise(F.col("high")), F.when(side > 0, F.col("high")).otherwise(F.col("low"))
    work = work.withColumns({"_side": side, "_stop": at * (1 - side * F.col("stop")), "_target": at * (1 + side * F.col("target"))})
    s = F.col("_side")
    stopped = F.coalesce((s != 0) & (s * adverse <= s * F.col("_stop")), F.lit(False))
    reached = F.coalesce((s != 0) & (s * kind >= s * F.col("_target")), F.lit(False))
    work = work.withColumns({"_stopped": stopped, "_hit": stopped | reached})
    gone = F.max(F.col("_hit").cast("int")).over(by([*UNIT, "_run"]).rowsBetween(Window.unboundedPreceding, -1))
    open_ = F.when(F.coalesce(gone, F.lit(0)) == 1, 0).otherwise(s)
    leave = F.when(F.col("_stopped"), F.col("_stop")).when(F.col("_hit"), F.col("_target")).otherwise(F.col("close"))
    work = work.withColumns({"_open": open_, "_leave": leave})
    o, hit = F.col("_open"), F.col("_hit")
    changed = F.coalesce(F.col("held") != F.col("_prev"), F.lit(False))
    traded = F.when(hit, F.abs(o)).otherwise(0) + F.when(changed, F.abs(F.col("held") - F.when(hit, 0).otherwise(o))).otherwise(0)
    gross = F.coalesce(o * (F.col("_leave") - F.col("_pc")) / F.col("_pc"), F.lit(0.0))
    out = work.withColumns({"traded": traded, "gross": gross})
    # No more than the stake is lost on a bar, so equity stays at or above 0.
    out = out.withColumn("ret", F.greatest(F.col("gross") - F.col("traded") * scan.fee, F.lit(-1.0)))
    return out.select(*bars.columns, "param_id", "rule", *scan.parameters, "exit", "mode", "held", "traded", "gross", "ret")


# --- mergeable summaries ----------------------------------------------------------------------------------------------

SUMS = ("bars", "trades", "gp", "gl", "gross_gp", "gross_gl", "s1", "s2")


def summaries(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One summary per key: ``SUMS``, growth, the highest and lowest point relative to the start (at most and at least 1), drawdown."""
    keys = list(keys)
    so_far = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    path = rows.withColumn("_e", F.product(1 + F.col("ret")).over(so_far))
    path = path.withColumn("_m", F.greatest(F.max("_e").over(so_far), F.lit(1.0)))
    gain = lambda c, sign: F.sum(F.greatest(sign * F.col(c), F.lit(0.0)))
    return path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(F.col("traded") > 0).alias("trades"),
        gain("ret", 1).alias("gp"),
        gain("ret", -1).alias("gl"),
        gain("gross", 1).alias("gross_gp"),
        gain("gross", -1).alias("gross_gl"),
        F.sum("ret").alias("s1"),
        F.sum(F.col("ret") * F.col("ret")).alias("s2"),
        F.max_by("_e", "ts").alias("growth"),
        F.greatest(F.max("_e"), F.lit(1.0)).alias("high"),
        F.least(F.min("_e"), F.lit(1.0)).alias("low"),
        F.least(F.min(F.col("_e") / F.col("_m") - 1), F.lit(0.0)).alias("drawdown"),
    )


def merged(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Summaries with, of all parts of the key before each one, the merged summary as ``is_*``."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("_g", F.coalesce(F.product("growth").over(w), F.lit(1.0)))
    out = out.withColumn("_h", F.coalesce(F.max(F.col("_g") * F.col("high")).over(w), F.lit(1.0)))
    # The worst fall that ends in a part: its own, or from the highest point before it to its lowest.
    out = out.withColumn("_d", F.least("drawdown", F.col("_g") * F.col("low") / F.col("_h") - 1))
    sums = {f"is_{c}": F.sum(c).over(w) for c in SUMS}
    return out.withColumns(sums | {"is_growth": F.col("_g"), "is_drawdown": F.min("_d").over(w)}).drop("_g", "_h", "_d")


def measures(prefix: str, out: str, ppy: Column | float) -> dict[str, Column]:
    """Profit factor and Sharpe ratio from the sums."""
    c = lambda name: F.col(prefix + name)
    n, spread = c("bars"), F.sqrt((c("s2") - c("s1") * c("s1") / c("bars")) / (c("bars") - 1))
    pf = F.when(c("gl") > 0, c("gp") / c("gl")).when(c("gp") > 0, float("inf")).otherwise(0.0)
    year = ppy if isinstance(ppy, Column) else F.lit(ppy)
    return {f"{out}pf": pf, f"{out}sharpe": F.when((n > 1) & (spread > 1e-12), c("s1") / n / spread * F.sqrt(year)).otherwise(0.0)}


def walk_borders(bars: DataFrame, is_months: int, oos_months: int, walks: int) -> DataFrame:
    """``SERIES, borders``: bar numbers where the first walk's in-sample part ends, and then every out-of-sample part."""
    span = bars.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000).alias("_days")
    )
    per_month = F.col("_n") / (F.col("_days") / DAYS_PER_MONTH)
    ends = F.transform(F.sequence(F.lit(0), F.lit(walks)), lambda k: F.floor((is_months + k * oos_months) * per_month))
    return span.select(*SERIES, F.filter(ends, lambda e: e <= F.col("_n")).alias("borders"))


def in_blocks(bars: DataFrame, is_months: int, oos_months: int, walks: int) -> DataFrame:
    """``block`` of every bar: 0 before the first border, k in the k-th out-of-sample part; bars after the last are left out."""
    numbered = bars.withColumn("_i", F.row_number().over(by(SERIES)) - 1)
    # Few series, a short list each.
    cut = numbered.join(walk_borders(bars, is_months, oos_months, walks), list(SERIES))
    block = F.size(F.filter("borders", lambda e: e <= F.col("_i")))
    return cut.withColumn("block", block).filter(F.col("block") < F.size("borders")).drop("_i", "borders")


def walk_metrics(bars: DataFrame, scan: Scan, months: tuple[int, int], walks: int, ppy: Column | float) -> DataFrame:
    """One row per unit and walk: in-sample and out-of-sample measures, and the efficiency between them."""
    keys = [*UNIT, "rule", *scan.parameters]
    parts = summaries(units(in_blocks(bars, *months, walks), scan), [*keys, "block"])
    out = merged(parts, keys, "block").filter("block > 0")
    out = out.withColumns(measures("is_", "is_", ppy) | measures("", "oos_", ppy))
    wfe = F.when(F.col("is_pf") > 0, F.col("oos_pf") / F.col("is_pf")).otherwise(0.0)
    return out.withColumns({"fold": F.col("block") - 1, "wfe": F.when(F.col("is_pf") == float("inf"), 0.0).otherwise(wfe)})


def walk_summary(walks: DataFrame, scan: Scan, ppy: Column | float, gates: Gates = Gates()) -> DataFrame:
    """One row per unit: combined out-of-sample measures, the deflated p-value against the series' trials, strict and relaxed pass.

    ``passed`` needs every gate, ``strict_pass`` the p-value beside them;
    ``relaxed_pass`` looks at the profit factor before fees alone.
    """
    keys = [*UNIT, "rule", *scan.parameters]
    pf = lambda gp, gl: F.when(F.sum(gl) > 0, F.sum(gp) / F.sum(gl)).when(F.sum(gp) > 0, float("inf")).otherwise(0.0)
    out = walks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("walks"),
        pf("gp", "gl").alias("combined_pf"),
        pf("gross_gp", "gross_gl").alias("gross_pf"),
        F.sum("trades").alias("trades"),
        F.avg("oos_sharpe").alias("mean_sharpe"),
        F.avg("wfe").alias("mean_wfe"),
        F.avg((F.col("oos_pf") > 1).cast("int")).alias("win_rate"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        (F.sum("trades") / F.sum("bars") * F.max(ppy if isinstance(ppy, Column) else F.lit(ppy))).alias("annual_trades"),
    )
    n = F.greatest("trades", F.lit(2))
    dsr = deflated_sharpe(F.col("mean_sharpe"), scan.trials, F.lit(0.0), F.lit(3.0), n)
    ok = (
        (F.col("combined_pf") >= gates.pf)
        & (F.col("win_rate") >= gates.win_rate)
        & (F.col("mean_wfe") >= gates.wfe)
        & (F.col("annual_trades") >= gates.annual_trades)
        & (F.col("max_drawdown") >= gates.max_drawdown)
    )
    out = out.withColumns({"dsr_pvalue": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dsr)), "passed": ok})
    strict = F.col("passed") & F.coalesce(F.col("dsr_pvalue") < gates.alpha, F.lit(False))
    return out.withColumns({"strict_pass": strict, "relaxed_pass": F.col("gross_pf") >= gates.pf})


def periods_per_year(table: dict[str, float]) -> Column:
    """Bars a year by timeframe."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("tf")]



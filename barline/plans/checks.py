"""SQL building blocks for the checks (plain SQL over the input tables)."""

from __future__ import annotations

QUOTES = """quotes AS (
  SELECT event_type AS symbol, ts, epoch_us(ts) AS us, event_id,
         (100 + value / 100) - (0.01::DOUBLE + 0.002::DOUBLE * (event_id % 5)::DOUBLE) AS bid,
         (100 + value / 100) + (0.01::DOUBLE + 0.002::DOUBLE * (event_id % 5)::DOUBLE) AS ask,
         (json_extract_string(props, '$.k')::INTEGER % 7)::DOUBLE AS bid_vol,
         (event_id % 5)::DOUBLE AS ask_vol
  FROM events)"""


FAST = (
    QUOTES
    + """, fast AS (SELECT * REPLACE ((us - 1704067200000000) // 60 + 1704067200000000 AS us,
  make_timestamp((us - 1704067200000000) // 60 + 1704067200000000) AS ts) FROM quotes)"""
)


def bars_sql(name: str, seconds: int) -> str:
    return f"""{name} AS (
  SELECT symbol, make_timestamp((us // {seconds * 1000000}) * {seconds * 1000000}) AS ts,
         arg_min((bid + ask) / 2, (us, event_id)) AS open, max((bid + ask) / 2) AS high,
         min((bid + ask) / 2) AS low, arg_max((bid + ask) / 2, (us, event_id)) AS close,
         sum(bid_vol + ask_vol) AS volume
  FROM quotes GROUP BY symbol, us // {seconds * 1000000})"""


BARS = bars_sql("bars", 3600)
BARS4 = bars_sql("bars4", 14400)

TRADES = """trades AS (
  SELECT l_returnflag AS pair, l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS cell_id,
         (l_suppkey % 3)::INTEGER AS fold, l_shipdate AS ts, l_orderkey AS ok, l_linenumber AS ln,
         l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty, l_extendedprice AS notional,
         (round(l_discount * 100) - 5) * 10 + (round(l_tax * 100) - 4) + (l_quantity - 25) AS pnl
  FROM lineitem)"""
TORD = "ts, ok, ln, pk, sk"

DAILY = """daily AS (
  SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         arg_min(floor(l_extendedprice * 100 / l_quantity) / 1000, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open,
         max(floor(l_extendedprice * 100 / l_quantity) / 1000) AS high, min(floor(l_extendedprice * 100 / l_quantity) / 1000) AS low,
         arg_max(floor(l_extendedprice * 100 / l_quantity) / 1000, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

REFERENCE = """reference AS (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(round(o_totalprice)) / count(*) AS value
  FROM orders GROUP BY 1)"""

SLOT_TRADES = """slot_trades AS (
  SELECT ['BOJ', 'ECB', 'FOMC', 'NFP'][(l_orderkey % 4 + 1)::INTEGER] AS event,
         'P' || (l_suppkey % 4) AS pair, (l_partkey % 16)::INTEGER AS wo, (l_linenumber % 6 + 1)::INTEGER AS hb,
         CASE WHEN l_quantity % 2 = 0 THEN 'none' ELSE 'fixed_pct' END AS et,
         (round(l_discount * 100) - 5) * 10 + (round(l_tax * 100) - 4) + (l_quantity - 25) AS pnl
  FROM lineitem)"""
SLOTS = (
    SLOT_TRADES
    + """, slots AS (
  SELECT *, gp / nullif(gl, 0) AS pf,
         coalesce(gp / nullif(gl, 0) >= 1.1::DOUBLE, false) AND trades >= 5 AS passed,
         CASE WHEN gp / nullif(gl, 0) IS NULL THEN 0 WHEN gp / nullif(gl, 0) >= 1 THEN 1 ELSE -1 END AS sign
  FROM (SELECT event, pair, wo, hb, et, fee, count(*) AS trades,
               sum(greatest(pnl - 10 * fee, 0)) AS gp, sum(greatest(10 * fee - pnl, 0)) AS gl,
               sum(pnl - 10 * fee) AS net_sum
        FROM slot_trades, (SELECT unnest([0.0, 1.0, 2.0, 3.0, 5.0])::DOUBLE AS fee) GROUP BY ALL))"""
)


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def ema_sql(expr: str, alpha: float, over: str = "PARTITION BY symbol ORDER BY ts") -> str:
    """The recursion itself, folded over the list of values so far."""
    a = repr(alpha)
    return (
        f"list_reduce(list({expr}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"lambda y, x: {a}::DOUBLE * x + (1 - {a}::DOUBLE) * y)"
    )


def signal_sql(keys: str = "symbol") -> str:
    """Signal of a ``position`` column."""
    return (
        f"greatest(-1, least(1, coalesce(position - lag(position) OVER (PARTITION BY {keys} ORDER BY ts), 0)))::INTEGER"
    )


def account_ctes(src: str, fee: str, keys: str = "symbol", mode: int = 0, size: str = "1.0", out: str = "acc",
                 flatten: bool = True) -> str:
    """Accounting of ``src`` (needs ts, close, signal) into CTE ``out``."""
    held = f"""coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER (
        PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
    if flatten:
        held = f"(CASE WHEN abs({held}) = 2 THEN 0 ELSE {held} END)"
    if mode == 1:
        held = f"greatest({held}, 0)"
    if mode == 2:
        held = f"least({held}, 0)"
    return f"""{out}_1 AS (SELECT *, {held} AS position_ FROM {src}),
{out}_2 AS (SELECT *, lag(position_) OVER (PARTITION BY {keys} ORDER BY ts) AS pp,
            lag(close) OVER (PARTITION BY {keys} ORDER BY ts) AS pc FROM {out}_1),
{out}_3 AS (SELECT *, coalesce(abs(position_ - pp), 0) AS traded_,
            coalesce((pp * (close - pc) / pc - abs(position_ - pp) * ({fee})) * {size}::DOUBLE, 0) AS ret_ FROM {out}_2),
{out}_4 AS (SELECT *, product(1 + ret_) OVER (PARTITION BY {keys} ORDER BY ts
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity_ FROM {out}_3),
{out} AS (SELECT *, max(equity_) OVER (PARTITION BY {keys} ORDER BY ts
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak_ FROM {out}_4)"""


def performance_select(src: str, ppy: float, keys: str = "symbol") -> str:
    return f"""SELECT {keys}, count(*) AS bars, round(arg_max(equity_, ts) - 1, 6) AS total_return,
  round(CASE WHEN stddev_samp(ret_) > 0 THEN avg(ret_) / stddev_samp(ret_) * sqrt({ppy}) ELSE 0 END, 6) AS sharpe,
  round(least(min((equity_ - peak_) / peak_), 0), 6) + 0.0 AS max_drawdown,
  round(coalesce(count(*) FILTER (traded_ > 0 AND ret_ > 0) / nullif(count(*) FILTER (traded_ > 0), 0)::DOUBLE, 0), 6)
    AS win_rate,
  count(*) FILTER (traded_ > 0) AS trades,
  round(sum(greatest(ret_, 0)), 6) AS gross_profit, round(sum(greatest(-ret_, 0)), 6) AS gross_loss,
  round(sum(greatest(ret_, 0)) / nullif(sum(greatest(-ret_, 0)), 0), 6) AS profit_factor
FROM {src} GROUP BY {keys}"""


def normal_cdf_sql(x: str) -> str:
    """Standard normal CDF by a rational approximation (error below 1e-7).

    Fixed values: the polynomial coefficients 26.2.17 of Abramowitz and Stegun.
    """
    t = f"(1.0::DOUBLE / (1.0 + 0.2316419::DOUBLE * abs({x})))"
    coefs = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = "0.0::DOUBLE"
    for c in reversed(coefs):
        poly = f"({poly} + {c}::DOUBLE) * {t}"
    tail = f"(exp(-({x}) * ({x}) / 2) / 2.5066282746310002::DOUBLE * ({poly}))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"

"""Ordered-series primitives that do not put a whole key into one task.

Bars are bounded per symbol (time span / timeframe), so plain window
functions serve them.  Ticks and trades are not bounded: one symbol or cell may
hold a large share of all rows.  The functions here range-partition on
``(keys, order)``, which splits any hot key, work inside the partitions, and
pass one small row per (key, partition) across the edges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.session import settle

PART, SEQ = "_part", "_seq"


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``kind`` over ``value`` from the key's start."""

    kind: str
    value: Column
    inclusive: bool = True


def _aggregate(kind: str, value: Column) -> Column:
    return {
        "sum": F.sum,
        "count": F.count,
        "max": F.max,
        "min": F.min,
        "product": F.product,
        "last": lambda c: F.last(c, ignorenulls=True),
        "first": lambda c: F.first(c, ignorenulls=True),
    }[kind](value)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry + local, local, carry)
    if kind == "product":
        return F.coalesce(carry * local, local, carry)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def place(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows in key and order sequence, spread over range partitions.

    ``_seq`` is a global row sequence whose upper bits are the partition; its
    size follows the session's advisory partition size, not the keys.
    """
    cols = [F.col(k) for k in keys]
    spread = df.repartitionByRange(*cols, *order).sortWithinPartitions(*cols, *order)
    return settle(spread.withColumn(SEQ, F.monotonically_increasing_id()), "series")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *stages: dict[str, Run],
) -> DataFrame:
    """Running aggregates per key in ``order`` (which must be a total order).

    Two levels: running values inside each range partition, plus the totals of
    the partitions before it.  The totals table has at most
    ``#keys + #partitions`` rows.  Several stages share one placement; a later
    stage may use the columns of the earlier ones.
    """
    placed = place(df, keys, order)
    for runs in stages:
        placed = _run(placed, list(keys), runs)
    return placed.drop(SEQ)


def _run(placed: DataFrame, keys: list[str], runs: dict[str, Run]) -> DataFrame:
    part = F.shiftright(SEQ, 33)
    columns = placed.columns
    work = placed.withColumn(PART, part).withColumns({f"_in_{n}": r.value for n, r in runs.items()})

    inside = Window.partitionBy(*keys, PART).orderBy(SEQ)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = work.select(
        *columns,
        PART,
        *[
            _aggregate(r.kind, F.col(f"_in_{n}")).over(up_to if r.inclusive else before).alias(f"_loc_{n}")
            for n, r in runs.items()
        ],
    )

    totals = work.groupBy(*keys, PART).agg(
        *[_partition_total(r.kind, F.col(f"_in_{n}")).alias(f"_tot_{n}") for n, r in runs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(PART).alias("_kp"),
        *[_carried(r.kind, F.col(f"_tot_{n}")).over(earlier).alias(f"_car_{n}") for n, r in runs.items()],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(PART) == F.col("_kp")]
    joined = local.join(carries, on, "left")
    return joined.select(
        *columns,
        *[_combine(r.kind, F.col(f"_car_{n}"), F.col(f"_loc_{n}")).alias(n) for n, r in runs.items()],
    )


def _partition_total(kind: str, value: Column) -> Column:
    """The aggregate over one (key, partition); first/last follow the order."""
    if kind not in ("first", "last"):
        return _aggregate(kind, value)
    rank = F.when(value.isNotNull(), F.col(SEQ))
    return (F.max_by if kind == "last" else F.min_by)(value, rank)


def _carried(kind: str, total: Column) -> Column:
    """How totals of earlier partitions add up (counts are summed)."""
    return F.sum(total) if kind == "count" else _aggregate(kind, total)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """1-based position of each row in its key's series."""
    return running(df, keys, order, {name: Run("count", F.lit(1))})


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    exprs: Callable[..., dict[str, Column]],
    back: int,
    ahead: int = 0,
    block_rows: int = 100_000,
    index: str | None = None,
) -> DataFrame:
    """Bounded ROWS-frame expressions over series of any length.

    Each key's series is cut into blocks of ``block_rows`` rows; a block also
    gets the ``back`` rows before and the ``ahead`` rows after it, so a frame
    never needs a row outside its block.  ``exprs(window)`` returns the columns;
    ``index`` names the row's position in its series where that is wanted too.
    """
    if block_rows < max(back, ahead):
        raise ValueError("block_rows must cover the frame")
    pos = F.col("_rn") - 1
    block = F.floor(pos / block_rows)
    offset = pos % block_rows
    homes = F.array(F.struct(block.alias("b"), F.lit(False).alias("halo")))
    if back:
        after = F.array(F.struct((block + 1).alias("b"), F.lit(True).alias("halo")))
        homes = F.when(offset >= block_rows - back, F.concat(homes, after)).otherwise(homes)
    if ahead:
        prior = F.array(F.struct((block - 1).alias("b"), F.lit(True).alias("halo")))
        homes = F.when((offset < ahead) & (block > 0), F.concat(homes, prior)).otherwise(homes)
    spread = row_index(df, keys, order, "_rn").withColumn("_home", F.explode(homes))
    w = Window.partitionBy(*keys, "_home.b").orderBy("_rn")
    done = spread.select("*", *[c.alias(n) for n, c in exprs(w).items()])
    done = done.filter(~F.col("_home.halo")).drop("_home")
    return done.withColumnRenamed("_rn", index) if index else done.drop("_rn")


def fan_out(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Repeat every row once per literal value (a map-side product)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))

"""Reproducible draws: a uniform number as a function of (row, replicate, seed).

Integer arithmetic below 2^63, so the value is the same on every engine, in
every partitioning and on every retry.  All 64 bits of the row id take part: its
three parts (21, 21 and 22 bits, each below the modulus, so none is folded) enter
at different steps, and ids that differ in any part draw different sequences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A Mersenne prime and multipliers of classic generators.
P = 2_147_483_647
A, B, C, D, E, G = 48_271, 69_621, 16_807, 12_345, 40_692, 40_014
#: Bits of the two lower parts of a row id.
BITS = 21
_PART = (1 << BITS) - 1


def mix(row: Column, rep: Column | int, seed: int) -> Column:
    rep_ = rep if isinstance(rep, Column) else F.lit(rep)
    rep_ = rep_.cast("bigint")
    row = row.cast("bigint")
    part = F.lit(_PART).cast("bigint")
    low = row.bitwiseAND(part)
    middle = F.shiftrightunsigned(row, BITS).bitwiseAND(part)
    high = F.shiftrightunsigned(row, 2 * BITS)
    x1 = (low * A + rep_ * B + seed) % P
    x2 = (x1 * x1 + middle * E + rep_ * C + D) % P
    return (x2 * x2 + high * G + low + middle) % P


def uniform(row: Column, rep: Column | int, seed: int) -> Column:
    """In [0, 1)."""
    return mix(row, rep, seed) / float(P)


def _fold(x: np.ndarray, spare: np.ndarray, times: int) -> None:
    """Towards ``x % P`` in place, for 0 <= x < 2^63: the upper bits of a Mersenne modulus are added to the lower ones."""
    for _ in range(times):
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, P, out=x)
        np.add(x, spare, out=x)


def uniforms(rows: np.ndarray, reps: int, seed: int, first: int = 0) -> np.ndarray:
    """The same draws for a batch of row ids and the replicates from ``first`` on: one line per row."""
    bits = rows.view(np.uint64)[:, None]
    low, middle = (((bits >> np.uint64(k)) & np.uint64(_PART)).astype(np.int64) for k in (0, BITS))
    high = (bits >> np.uint64(2 * BITS)).astype(np.int64)
    rep = np.arange(first, first + reps, dtype=np.int64)[None, :]
    x = low * A + (rep * B + seed)
    spare = np.empty_like(x)
    # Before a square, a value that is a little above P will do: squares stay below 2^63.
    _fold(x, spare, 2)
    np.multiply(x, x, out=x)
    np.add(x, middle * E + D, out=x)
    np.add(x, rep * C, out=x)
    _fold(x, spare, 2)
    np.multiply(x, x, out=x)
    np.add(x, high * G + low + middle, out=x)
    _fold(x, spare, 2)
    np.subtract(x, P, out=x, where=x >= P)
    out = spare.view(np.float64)
    return np.divide(x, float(P), out=out)


def mix_sql(row: str, rep: str, seed: int) -> str:
    row, rep = f"({row})::BIGINT", f"({rep})::BIGINT"
    low, middle, high = f"({row} & {_PART})", f"(({row} >> {BITS}) & {_PART})", f"(({row} >> {2 * BITS}) & {2 * _PART + 1})"
    x1 = f"(({low} * {A} + {rep} * {B} + {seed}) % {P})"
    x2 = f"(({x1} * {x1} + {middle} * {E} + {rep} * {C} + {D}) % {P})"
    return f"(({x2} * {x2} + {high} * {G} + {low} + {middle}) % {P})"


def uniform_sql(row: str, rep: str, seed: int) -> str:
    return f"({mix_sql(row, rep, seed)} / {P}.0::DOUBLE)"


def mix_value(row: int, rep: int, seed: int) -> int:
    """The same draw for a small configuration list."""
    low, middle, high = row & _PART, (row >> BITS) & _PART, (row >> 2 * BITS) & (2 * _PART + 1)
    x1 = (low * A + rep * B + seed) % P
    x2 = (x1 * x1 + middle * E + rep * C + D) % P
    return (x2 * x2 + high * G + low + middle) % P

"""Words, hashes and byte n-grams of a text column, computed on Arrow's own buffers.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed
and carriage return.  All functions take the UTF-8 bytes of several texts laid
end to end with their offsets, so nothing loops over texts or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; only a single longer text makes a larger piece.  A worker takes some hundred times as much at its peak.
PIECE = 1 << 18
#: Bytes whose prefix sums are held at once, whatever the length of a text.
SEGMENT = 1 << 18

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def pieces(
    column: pa.Array, limit: int = PIECE, rows: int = 1 << 16
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never run over the edge of a text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SEPARATOR[data]
    opens = np.empty_like(inside)
    opens[0] = True
    np.logical_not(inside[:-1], out=opens[1:])
    edge = offsets[:-1]
    opens[edge[edge < len(data)]] = True
    closes = np.empty_like(inside)
    closes[-1] = True
    np.logical_not(inside[1:], out=closes[:-1])
    edge = offsets[1:]
    closes[edge[edge > 0] - 1] = True
    starts = np.flatnonzero(inside & opens)
    ends = np.flatnonzero(inside & closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, SEGMENT + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + SEGMENT, side="right")))
        part = data[at : ends[hi - 1]]
        up, down = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        a, b = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        lo = hi
    return mix(out)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + (hashes[k : n + k] ^ np.uint64(k))
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(h[first]), first

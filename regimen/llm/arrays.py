"""Numpy helpers over Arrow text columns: byte buffers, word bounds, rolling hashes.

All hashes are 64-bit with wrap-around arithmetic. Texts are cut into slices of
about ``SLICE`` bytes (a longer text is a slice of its own), so that the arrays
of one slice stay small whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)

#: the ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as a byte table (1: part of a word)
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 from 0, bytes uint8) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type)
                                                or pa.types.is_large_string(column.type) else b"", column.type))
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(offsets: np.ndarray, data: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of consecutive slices of whole texts."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, offsets[row:end + 1] - offsets[row], data[offsets[row]:offsets[end]]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0..n-1, and to 0..-(n-1)."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, SLICE + (1 << 16))
        step = np.full(n, _BASE, np.uint64)
        step[0] = 1
        _POWERS = np.cumprod(step)
        step[1:] = pow(_BASE, -1, 1 << 64)
        _INVERSE = np.cumprod(step)
    return _POWERS, _INVERSE


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums: entry i covers the first i bytes."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, from :func:`prefix_sums`; equal bytes give equal hashes."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_bounds(offsets: np.ndarray, data: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last); words never cross texts."""
    inside = table[data]
    n = len(data)
    before = np.zeros(n, np.uint8)
    before[1:] = inside[:-1]
    after = np.zeros(n, np.uint8)
    after[:-1] = inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = 0
    after[cuts - 1] = 0
    starts = np.flatnonzero(inside & (before ^ 1))
    ends = np.flatnonzero(inside & (after ^ 1)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries (Rabin-Karp over ``hashes``), by doubling; a window
    that would run past the end is absent."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base, done, length, out = 0xD6E8FEB86659FD93, 0, 1, None
    power = hashes
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - done) if done < len(power) else 0
                out = out[:m] + np.uint64(pow(base, done, 1 << 64)) * power[done:done + m]
            done += length
        rest >>= 1
        if rest:
            power = power[:-length] + np.uint64(pow(base, length, 1 << 64)) * power[length:]
            length *= 2
    return mix(out[:len(hashes) - n + 1])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true entries."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)

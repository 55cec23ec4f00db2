"""Similarity of strings by longest common subsequence, as vectorized functions: a batch at a time in numpy.

The length of the subsequence is found bit-parallel (Hyyro 2004): the shorter string is a row of bits, one 64-bit word
for all pairs of a batch at once; pairs whose shorter side is longer than 64 go through Python's whole numbers. Windows of
the longer string are all found in one pass over the pair, by a braid of strands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of one diagonal that pairs compared at once make together.
GROUP_CELLS = 1 << 16


def _lcs_big(a: str, b: str) -> int:
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & place.get(c, 0)
        v = (v + u | v - u) & full
    return (full & ~v).bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    wide = np.array([len(s) > 64 for s in short], bool)
    for i in np.flatnonzero(wide):
        out[i] = _lcs_big(short[i], long[i])
    rows = np.flatnonzero(~wide & np.array([len(s) > 0 for s in short], bool))
    if not len(rows):
        return out
    size = np.array([len(long[i]) for i in rows])
    order = np.argsort(-size, kind="stable")
    rows, size = rows[order], size[order]
    match = np.zeros((size[0], len(rows)), np.uint64)
    for k, i in enumerate(rows):
        place: dict[str, int] = {}
        for j, c in enumerate(short[i]):
            place[c] = place.get(c, 0) | 1 << j
        match[: size[k], k] = [place.get(c, 0) for c in long[i]]
    v = np.full(len(rows), ~np.uint64(0))
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")
    for step in range(size[0]):
        n = alive[step]
        u = v[:n] & match[step, :n]
        v[:n] = (v[:n] + u) | (v[:n] - u)
    bits = np.array([len(short[i]) for i in rows], np.uint64)
    zeros = ~v & np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
    out[rows] = np.bitwise_count(zeros)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return np.where(total == 0, 100.0, 200.0 * lcs_lengths(a, b) / np.maximum(total, 1))


def _grid(strings: list[str], width: int, fill: int, low: bool) -> np.ndarray:
    """Code points of the strings as columns of ``width`` rows, filled up above (``low``) or below."""
    size = np.array([len(s) for s in strings])
    out = np.full((len(strings), width), fill, np.int64)
    at = np.arange(width)
    out[(at >= width - size[:, None]) if low else (at < size[:, None])] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(out.T)


def _braid(short: list[str], long: list[str]) -> np.ndarray:
    """Semi-local comparison of each pair (a braid of strands, Tiskin 2008), all pairs at once and a diagonal at a time.

    A strand enters at each character of both strings; two that meet at a cell cross unless the characters are equal or they
    have crossed before. At row k of the result stands where the strand that leaves below the k-th character of the longer string
    came in: at its character of that number, or from the shorter string (negative). The window [i, j) then shares with
    the shorter string j - i characters less the number of strands that came in at i or later and leave before j.
    """
    rows, columns = max(map(len, short)), max(map(len, long))
    a, b = _grid(short, rows, -1, True)[::-1], _grid(long, columns, -2, False)
    # strands of the shorter string: lower ones are less; those of filled rows never cross, as no strand is less
    own = np.arange(rows)[::-1, None] - rows + np.array([len(s) for s in short])[None, :]
    h = np.where(own >= 0, -1 - own, -(1 << 30)).astype(np.int32)
    v = np.repeat(np.arange(columns, dtype=np.int32)[:, None], len(short), axis=1)
    for d in range(rows + columns - 1):
        low, high, shift = rows - 1 - min(d, rows - 1), rows - max(0, d - columns + 1), d - rows + 1
        x, y = h[low:high], v[low + shift : high + shift]
        swap = (a[low:high] == b[low + shift : high + shift]) | (x > y)
        h[low:high], v[low + shift : high + shift] = np.where(swap, y, x), np.where(swap, x, y)
    return v


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of each shorter string with a window of the longer: of its own length, and shorter ones at the ends."""
    v = _braid(short, long)
    m, n = np.array([len(s) for s in short]), np.array([len(s) for s in long])
    columns, at = len(v), np.arange(len(v))[:, None]
    v[at >= n] = -1
    # windows from each place: those of full length, cut off at the end
    alone = np.zeros(v.shape, np.int64)
    for o in range(m.max()):
        alone[: columns - o] += (v[o:] >= at[: columns - o]) & (o < m)
    size = np.minimum(m, n - at)
    best = np.where(size > 0, 200.0 * (size - alone) / (m + np.maximum(size, 1)), 0.0).max(axis=0)
    # windows from the beginning, shorter than the shorter string
    size = np.minimum(at + 1, m)
    return np.maximum(best, np.where(at + 1 < m, 200.0 * (size - np.cumsum(v >= 0, axis=0)) / (m + size), 0.0).max(axis=0))


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of each pair's shorter string with a window of the longer; pairs of equal length both ways."""
    out = np.zeros(len(a))
    sides: list[tuple[int, int, int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x or not y:
            out[i] = 100.0 if x == y else 0.0
            continue
        for short, long in [(x, y), (y, x)] if len(x) == len(y) else [(x, y) if len(x) < len(y) else (y, x)]:
            sides.append((len(long), len(short), i, short, long))
    sides.sort(key=lambda s: s[:3])
    low = 0
    while low < len(sides):
        # the longest of a group sets its width
        high = low + 1
        while high < len(sides) and (high - low + 1) * sides[high][0] <= GROUP_CELLS:
            high += 1
        group = sides[low:high]
        np.maximum.at(out, [s[2] for s in group], _best_windows([s[3] for s in group], [s[4] for s in group]))
        low = high
    return out


@F.pandas_udf(T.DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[ok] = ratios(a[ok].tolist(), b[ok].tolist())
    return pd.Series(out).where(ok, None)


@F.pandas_udf(T.DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[ok] = partial_ratios(a[ok].tolist(), b[ok].tolist())
    return pd.Series(out).where(ok, None)


def indel_ratio(a, b):
    """0 to 100: 200 times the longest common subsequence over both lengths; two empty strings 100, null with null."""
    return _indel(a, b)


def partial_ratio(a, b):
    """The best ``indel_ratio`` of the shorter string with a window of the longer; null with null."""
    return _partial(a, b)

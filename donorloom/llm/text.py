"""Numpy kernels over Arrow string columns: words and word shingles of whole batches as 64-bit hashes.

A batch is cut into pieces of about a quarter of a megabyte, so that the working arrays stay small whatever the batch
size; one very long text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (splitmix64's finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_PLACE = mix(np.arange(1000, 1064, dtype=np.uint64) * np.uint64(_ODD))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word: white space alone, or all of ASCII that is no letter or digit.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 4096)
        step = np.full(size, _BASE, dtype=np.uint64)
        step[0] = 1
        back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(step), np.cumprod(back)
    return _powers["up"], _powers["down"]


@dataclass
class Piece:
    """Some texts of a batch: ``rows`` of the batch, their bytes, and where each one begins."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Words of a piece: hash, first and last byte, and for each text the range of its words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """Texts of an Arrow column, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield Piece(i, j - i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def words(piece: Piece, ends_word: np.ndarray = SPACE) -> Words:
    """Words by the bytes that end one, A-Z lower-cased. Equal words have equal hashes everywhere."""
    data = piece.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(piece.n + 1, np.int64))
    inside = ~ends_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = piece.offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes)
    up, down = _power(len(data) + 1)
    run = _BYTE[_LOWER[data]]
    run *= up[: len(data)]
    np.cumsum(run, out=run)
    total = run[ends]
    later = starts > 0
    total[later] -= run[starts[later] - 1]
    total *= down[starts]
    total += (ends - starts + 1).astype(np.uint64) * np.uint64(_ODD)
    return Words(mix(total), starts, ends, np.searchsorted(starts, piece.offsets))


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and for each text the range of its runs.

    A text of 1 to k-1 words has one run, its whole sequence; a text without words has none.
    """
    h, bounds = found.hashes, found.bounds
    count = np.diff(bounds)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    if not len(h):
        return np.zeros(0, np.uint64), out_bounds
    full = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        if len(full):
            full += h[j : j + len(full)] * _PLACE[j]
    text_of = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(text_of)) - out_bounds[text_of] + bounds[text_of]
    out = np.zeros(len(text_of), dtype=np.uint64)
    long = count[text_of] >= k
    out[long] = full[at[long]]
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = h[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = np.sum(np.append(own, np.uint64(len(own))) * np.append(_PLACE[: len(own)], _PLACE[-1]))
    return mix(out), out_bounds


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)

"""Words of Arrow string columns as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: A word is a longest run of bytes other than these (space, tab to carriage return).
SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Odd multipliers by position in a word; a longer word uses them again, mixed with the round.
_PLACES = 64
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, _PLACES, dtype=np.uint64) | np.uint64(1)
_ONE, _MIX = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one for each word
    doc: np.ndarray  # index of the row that each word belongs to
    offsets: np.ndarray  # the words of row i are offsets[i]:offsets[i + 1]
    starts: np.ndarray  # byte offsets in data
    ends: np.ndarray
    data: np.ndarray  # the bytes of all rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit of ``x`` over all bits."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``most`` bytes, or of one longer row, with the first row's index."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, column.slice(i, min(j, n) - i)
        i = min(j, n)


def words(column: pa.Array) -> Words:
    data, at = utf8(column)
    rows = len(at) - 1
    is_word = ~_IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    inner = at[1:-1]
    before[inner[inner < len(data)]] = False  # a row's first byte follows no word
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    after[inner[(inner > 0)] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    offsets = np.searchsorted(starts, at).astype(np.int64)
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    return Words(_hashes(data, starts, ends), doc, offsets, starts, ends, data)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    firsts = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(firsts, size)
    value = data[np.repeat(starts, size) + place].astype(np.uint64) + _ONE
    turn = (place // _PLACES).astype(np.uint64)
    value = (value + turn * np.uint64(257)) * _MULTIPLIERS[place % _PLACES]
    return mixed(np.add.reduceat(value, firsts) + size.astype(np.uint64) * _MIX)


def ngrams(found: Words, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within a row, and their rows."""
    h = found.hashes if hashes is None else hashes
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k]
    same = found.doc[: len(total)] == found.doc[n - 1 :]
    return mixed(total[same]), found.doc[: len(total)][same]

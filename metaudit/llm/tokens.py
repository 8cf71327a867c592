"""Words of Arrow text columns as numpy arrays: places, owners and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
#: Texts are taken in runs of whole documents of about so many bytes, which bounds a task's memory (a longer document is a run of its own).
RUN_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between ASCII white space.
NOT_SPACE = ~_SPACE
#: ASCII letters and digits, and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    """One odd number for each byte; A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    v[0x41:0x5B] = v[0x61:0x7B]
    return v


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, RUN_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, np.uint64(base))
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables if size <= 4 * RUN_BYTES else _powers  # tables for one very long text aren't kept
        return tables[0], tables[1]
    return _powers[0], _powers[1]


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of runs of whole texts; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, owner) of all runs of ``inside`` bytes; owner is the text's number."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    w = inside[data]
    opens, closes = w.copy(), w.copy()
    opens[1:] &= ~w[:-1]
    closes[:-1] &= ~w[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[edges] = w[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[edges] = w[edges]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 of each word's bytes, A-Z as a-z."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def combine(first: np.ndarray, second: np.ndarray, salt: int) -> np.ndarray:
    """A uint64 of ordered pairs of hashes."""
    return mix(first * np.uint64(0x9FB21C651E98DF25 + 2 * salt) + second)


def last_of_utf8(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each character: their sum counts code points."""
    return (data & 0xC0) != 0x80

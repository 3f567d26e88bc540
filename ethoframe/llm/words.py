"""Words of Arrow text columns as numpy arrays, without one Python object per word.

Texts stay in Arrow's UTF-8 buffer. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D (the same as for code points, since UTF-8 uses those bytes for
nothing else). Word and window hashes are 64-bit polynomial hashes with a final
mix; equal hashes are taken as equal words (n words collide with a chance of about
n^2 / 2^65).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK + (1 << 17))
        steps = np.full(n, _BASE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _inverses = np.multiply.accumulate(steps)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Some consecutive rows' texts: bytes, word spans, and words of each row.

    ``first[i]:first[i + 1]`` are row i's words in ``starts`` and ``ends``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int):
        self.data, self.offsets, self.row = data, offsets, row
        n = len(data)
        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        before[full] = True
        after[full[1:] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n_rows = len(offsets) - 1
        self.n_words = np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        _grow(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * _powers[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _inverses[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _BASE)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.n_words)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for each i; windows may cross rows."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _inverses[: n - width + 1] + np.uint64(width))


def spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[s:e] for each s and e."""
    n = len(words)
    _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def inside(first: np.ndarray, n_windows: int, width: int) -> np.ndarray:
    """Which of n_windows windows of this width lie within one row."""
    fits = np.zeros(n_windows + 1, np.int64)
    n = np.diff(first)
    long = n >= width
    np.add.at(fits, first[:-1][long], 1)
    np.add.at(fits, first[1:][long] - width + 1, -1)
    return np.cumsum(fits[:n_windows]) > 0


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash of each row's whole word sequence."""
    n = len(words)
    _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers[:n], out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) * _inverses[np.minimum(first[:-1], n)] + np.diff(first).astype(np.uint64) * _BASE)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    """Runs of rows of about ``size`` bytes; each row is whole."""
    if not len(column):
        return
    data, offsets = buffers(column)
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(offsets) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def joined(texts: Texts, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's kept words, joined by one space."""
    n = len(texts.data)
    edges = np.zeros(n + 1, np.int8)
    edges[texts.starts[keep]] = 1
    edges[texts.ends[keep]] -= 1
    held = np.cumsum(edges[:n], dtype=np.int8) > 0
    rows = texts.word_rows()[keep]
    follows = np.zeros(len(rows), bool)
    follows[1:] = rows[1:] == rows[:-1]
    gaps = texts.starts[keep][follows] - 1
    data = texts.data.copy()
    data[gaps] = 0x20
    held[gaps] = True
    count = np.zeros(n + 1, np.int64)
    np.cumsum(held, out=count[1:])
    return data[held], count[texts.offsets]

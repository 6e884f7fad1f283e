"""Vectorised byte-level text work shared by the corpus operators.

Arrow string columns are read as flat UTF-8 byte arrays, so that words, hashes and shingles of a whole batch are found with
a few numpy passes instead of one Python object per word. Nothing here looks at more than one piece of a batch at a time,
and a piece is never larger than ``PIECE_BYTES`` plus one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled by one set of numpy passes.
PIECE_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` well-spread 64-bit numbers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(salt))


_BYTE = seeds(256, 77)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a run of letters; bytes beyond ASCII count as letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, PIECE_BYTES + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _ODD), np.full(size, _ODD_INVERSE)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` (PIECE_BYTES) bytes each, or of a single longer row."""
    i, n, limit = 0, len(offsets) - 1, limit or PIECE_BYTES
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a piece: hashes, and by document where its words begin (``first`` has one entry more than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE):
        n = len(data)
        self.docs = len(offsets) - 1
        gap = gaps[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:] = gap[:-1]
            after[:-1] = gap[1:]
        self.start = np.flatnonzero(~gap & (before | edge[:n]))
        self.end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = _power_tables(n)
        self._down, self._total = down, np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=self._total[1:])
        self.hash = self._names(self.end)

    def raw(self, end: np.ndarray) -> np.ndarray:
        """Sum over each word's bytes, each with the power of its place in the word."""
        with np.errstate(over="ignore"):
            return (self._total[end] - self._total[self.start]) * self._down[self.start]

    def _names(self, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.raw(end) + (end - self.start).astype(np.uint64))

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of each word; of the whole word, if it is shorter."""
        return self._names(np.minimum(self.end, self.start + n))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class LongWords:
    """The words of one long text, read in slices: the same hashes as :class:`Words`; a word on a border is carried over."""

    docs = 1

    def __init__(self, data: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE, size: int | None = None):
        size = size or PIECE_BYTES
        found, total, length = [], 0, 0  # total and length: of the word that is open
        close = lambda: mix(np.array([(total + length) % (1 << 64)], np.uint64))
        for at in range(0, len(data), size):
            part = data[at : at + size]
            words = Words(part, np.array([0, len(part)]), lower, gaps)
            hashes, n = words.hash, len(words.hash)
            first = 0
            if length and not gaps[part[0]]:
                total = (total + int(words.raw(words.end)[0]) * pow(int(_ODD), length, 1 << 64)) % (1 << 64)
                length += int(words.end[0])
                first = 1
            if length and (not first or words.end[0] < len(part)):
                found.append(close())
                total = length = 0
            last = n
            if n > first and not gaps[part[-1]]:
                last = n - 1
                total, length = int(words.raw(words.end)[-1]), int(words.end[-1] - words.start[-1])
            found.append(hashes[first:last])
        if length:
            found.append(close())
        self.hash = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.first = np.array([0, len(self.hash)])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray, **how) -> Words | LongWords:
    """The word hashes of a piece."""
    return LongWords(data, **how) if len(offsets) == 2 and len(data) > PIECE_BYTES else Words(data, offsets, **how)


#: Words of a shingle.
WIDTH = 5
_PLACE = seeds(WIDTH, 5) | np.uint64(1)


def shingles(words: Words | LongWords) -> Iterator[np.ndarray]:
    """For each document of a piece, the sorted distinct 64-bit names of its shingles.

    Fewer than five words make one shingle of the whole sequence; no word, none.
    """
    h, m = words.hash, len(words.hash)
    with np.errstate(over="ignore"):
        if m >= WIDTH:
            full = h[: m - WIDTH + 1] * _PLACE[0]
            for j in range(1, WIDTH):
                full = full + h[j : m - WIDTH + 1 + j] * _PLACE[j]
            full = mix(full)
        for d in range(words.docs):
            a, b = int(words.first[d]), int(words.first[d + 1])
            if b - a >= WIDTH:
                yield np.unique(full[a : b - WIDTH + 1])
            elif b > a:
                part = h[a:b] * _PLACE[: b - a]
                yield mix(part.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)

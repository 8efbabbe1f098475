"""Words and their hashes for whole Arrow columns at once, in numpy, a bounded piece of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20                 # bytes of text worked on at once; a longer text is a piece of its own
GOLD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)
RADIX = 0xD1342543DE82EF95      # odd, so it has an inverse modulo 2^64
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((RADIX, RADIX_INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[i] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def pieces(column: pa.Array, rows: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of at most ``rows`` consecutive rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = min(first + rows, max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each row): maximal runs of bytes not in ``parts`` (white space); rows part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = ~parts[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = False
    edge[offsets] = True
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:-1]
    end[:-1] &= ~letter[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased; equal words have equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[LOWER[data]] * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLD)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; all words as one when there are fewer, nothing for no word."""
    if not len(words):
        return words
    used = min(size, len(words))
    out = np.full(len(words) - used + 1, np.uint64(used), np.uint64)
    for k in range(used):
        out = mix64(out * GOLD + words[k:len(words) - used + 1 + k])
    return out


def row_shingles(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its runs of ``size`` words in order) of every row."""
    for first, data, offsets in pieces(column):
        starts, ends, at = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        if len(hashes) >= size:
            runs = np.full(len(hashes) - size + 1, np.uint64(size), np.uint64)
            for k in range(size):
                runs = mix64(runs * GOLD + hashes[k:len(hashes) - size + 1 + k])
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            yield first + i, runs[a:b - size + 1] if b - a >= size else shingles(hashes[a:b], size)

"""Content-defined chunks of UTF-8 bytes by a rolling hash, over many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes that the rolling hash sees; a cut follows from them alone, so that equal passages are cut alike wherever they stand.
WINDOW = 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)


def rolling_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial hash of the WINDOW bytes before each position; needed only where a cut may be."""
    h = np.zeros(len(at), np.uint64)
    for i in range(WINDOW, 0, -1):
        h = h * _MULTIPLIER + _BYTE[data[at - i]]
    h ^= h >> np.uint64(29)
    return h * _MULTIPLIER


def chunk_starts(data: np.ndarray, offsets: np.ndarray, mean: int, most: int) -> np.ndarray:
    """Where the chunks of the texts data[offsets[i]:offsets[i+1]] begin; together they cover all bytes.

    A cut lies before a blank that follows a visible ASCII character, where the rolling hash lets it through; chunks
    have about `mean` bytes. A longer piece than `most` bytes is cut every `most` bytes as well, between characters.
    An empty text has no chunk.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    visible = (data > 32) & (data < 127)
    may = np.flatnonzero(visible[:-1] & blank[1:]) + 1
    may = may[may - offsets[np.searchsorted(offsets, may, "right") - 1] >= WINDOW]
    # About one position in six may be cut, so the hash has to let through one in mean / 6.
    bits = max(0, round(np.log2(max(1, mean / 6))))
    if bits:
        may = may[(rolling_hash(data, may) >> np.uint64(64 - bits)) == 0]
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], may)
    sizes = np.diff(np.append(starts, n))
    long = np.flatnonzero(sizes > most)
    if len(long):
        forced = np.concatenate([np.arange(starts[i] + most, starts[i] + sizes[i], most) for i in long])
        for _ in range(3):  # back to the first byte of a character
            forced = forced - ((data[forced] & 0xC0) == 0x80)
        starts = np.union1d(starts, forced)
    return starts

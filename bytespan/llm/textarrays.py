"""Whole texts of a batch as numpy arrays: bytes, words, word hashes.

Everything works on the UTF-8 buffer that Arrow hands over; no Python string
is made for a word.  Hashing goes in blocks, so its 8-byte arrays stay small
beside the text however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20      # bytes of text handled together
_BLOCK = 1 << 20
_BASE = 0x5851F42D4C957F2D

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64's multipliers)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POW.get("up", ())):
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POW["up"], _POW["down"] = np.cumprod(up), np.cumprod(down)
    return _POW["up"], _POW["down"]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows behind one another, and where each row begins (n + 1)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def bounds(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Start, end and row of the maximal runs of ``inside`` bytes; runs end at
    row borders and after bytes marked in ``cut``."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= ~inside[:-1]
    if cut is not None:
        edge[1:n] |= cut[:-1]
    start = np.flatnonzero(inside & edge[:n])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= ~inside[1:]
    if cut is not None:
        edge[1:] |= cut
    end = np.flatnonzero(inside & edge[1:]) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run data[start:end]; runs are in order and apart."""
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
            a, b = int(start[i]), int(end[j - 1])
            up, down = powers(b - a + 1)
            c = np.zeros(b - a + 1, np.uint64)
            np.cumsum(BYTE[data[a:b]] * up[:b - a], out=c[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def window_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words of a row, and their rows.
    A row with fewer words, but one at least, has its whole sequence as one run."""
    count = np.bincount(row, minlength=n_rows)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            h = h * np.uint64(_BASE) + mix(words[k:len(h) + k] + np.uint64(k))
        own = row[:len(h)] == row[size - 1:size - 1 + len(h)]
        h, r = mix(h[own]), row[:len(own)][own]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            first = np.cumsum(count) - count
            s = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = count[short] > k
                w = words[np.minimum(first[short] + k, len(words) - 1)]
                s = np.where(has, s * np.uint64(_BASE) + mix(w + np.uint64(k)), s)
            h, r = np.r_[h, mix(s + count[short].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))], np.r_[r, short]
    return h, r


def word_arrays(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row and hash of the words (runs without white space, A-Z lowered)."""
    low = LOWER[data]
    start, end, row = bounds(~SPACE[data], offsets)
    return start, end, row, run_hashes(low, start, end)

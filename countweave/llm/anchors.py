"""Anchors: where a text's fixed-length windows can be told to be equal from little.

A window of WINDOW bytes belongs to the place of its smallest GRAM-byte hash (the leftmost of equal
ones). Equal windows have their anchors at the same distance and with the same bytes, wherever they
stand. Windows that follow each other mostly share an anchor, so a text is cut into segments: runs of
windows of one anchor, each window in exactly one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import arrays

WINDOW = 100
GRAM = 32


@dataclass
class Segments:
    """Segment i covers the windows that start at lo[i]..lo[i] + n[i] - 1 of the data; its text is row[i] of the block."""

    row: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    gram: np.ndarray

    def stop(self) -> np.ndarray:
        return self.lo + self.n + WINDOW - 1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place that has so many after it."""
    n = len(data) - GRAM + 1
    word = words(data)
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        out = arrays.mixed(out + word[k:k + n] * np.uint64(0x9FB21C651E98DF25))
    return out


def words(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word at each place."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        size = (len(data) - k) // 8
        part = np.frombuffer(data[k:k + 8 * size].tobytes(), "<u8")
        out[k::8] = part[:len(out[k::8])]
    return out


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v) - width + 1
    rows = -(-len(v) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(v)] = v
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, offset: np.ndarray) -> Segments:
    """The segments of the texts data[offset[i]:offset[i + 1]]."""
    size = np.maximum(np.diff(offset) - WINDOW + 1, 0)
    if size.sum() == 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64))
    gram = _gram_hashes(data)
    place = np.arange(len(gram), dtype=np.uint64)
    low = _sliding_min((gram & np.uint64(0xFFFFFFFF00000000)) | place, WINDOW - GRAM + 1)
    row = np.repeat(np.arange(len(size)), size)
    start = np.repeat(offset[:-1] - (np.cumsum(size) - size), size) + np.arange(len(row))
    anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return Segments(row[new], start[new], np.diff(np.r_[new, len(row)]), gram[anchor[new]])

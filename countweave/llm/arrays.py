"""Whole texts of an Arrow batch as NumPy arrays: word places, and hashes of byte ranges.

Helpers for tasks; Spark deals out the rows. Blocks bound the memory: a block holds
whole texts, about BLOCK bytes of them, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: MASK[n] keeps the first n bytes of eight.
MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Block:
    """Rows lo..hi of a batch; text i is data[offset[i]:offset[i + 1]]."""

    lo: int
    hi: int
    data: np.ndarray
    offset: np.ndarray


@dataclass
class Words:
    """Word j is data[start[j]:end[j]]; text i has words first[i]..first[i + 1] - 1."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of a string column; null texts are empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offset = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + size, "right")) - 1)
        yield Block(lo, hi, data[offset[lo]:offset[hi]], offset[lo:hi + 1] - offset[lo])
        lo = hi


def words(block: Block, lower: bool = False) -> Words:
    """Runs of bytes outside [\\x20\\x09-\\x0D]; words never cross texts."""
    data = np.insert(block.data, block.offset[1:], 0x20)
    if lower:
        data = LOWER[data]
    white = WHITE[data]
    edge = np.empty(len(data), bool)
    edge[0] = not white[0]
    np.not_equal(white[1:], white[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    bound = block.offset + np.arange(len(block.offset))
    return Words(data, start, end, np.searchsorted(start, bound))


def single_spaced(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space between; new starts and ends."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - (size + 1)
    if len(start) == 0:
        return np.zeros(0, np.uint8), start, start
    take = np.repeat(w.start - start, size + 1) + np.arange(start[-1] + size[-1] + 1)
    data = w.data[take]
    end = start + size
    data[end] = 0x20
    return data, start, end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand; another seed, another hash.

    Eight bytes at a time are stirred in, so no two texts collide by their structure, as sums of powers do.
    """
    at, left = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    h = mixed(left.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero(left > 0)
    at, left = at[live], left[live]
    while len(live):
        x = eight[at] & MASK[np.minimum(left, 8)]
        h[live] = mixed((h[live] ^ x) * _STEP + np.uint64(1))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h

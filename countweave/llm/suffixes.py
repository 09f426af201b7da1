"""Suffix arrays by induced sorting, and permuted common prefixes, for the shards of one task.

Bytes are induced a bucket at a time with whole-array operations; the reduced text of
substring names, a third of the size and of a large alphabet, is sorted by the same method item by item.
"""

from __future__ import annotations

import numpy as np

from .anchors import words
from .arrays import range_hashes


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S), False for larger (L); the last, a sentinel, is S."""
    n = len(t)
    less = np.empty(n, bool)
    less[:-1] = t[:-1] < t[1:]
    less[-1] = True
    tied = np.flatnonzero(t[:-1] == t[1:])
    if len(tied):
        told = np.where(np.r_[t[:-1] != t[1:], True], np.arange(n), n)
        nxt = np.minimum.accumulate(told[::-1])[::-1]
        less[tied] = less[nxt[tied]]
    return less


def _dealt(pred: np.ndarray, chars: np.ndarray, sa: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put pred behind (step 1) or before (step -1) what its buckets already have, in the order given."""
    if len(pred) == 0:
        return
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    size = np.bincount(c, minlength=len(at))
    rank = np.arange(len(c)) - (np.cumsum(size) - size)[c]
    if step == 1:
        sa[at[c] + rank] = pred[order]
        at += size
    else:
        sa[at[c] - 1 - rank] = pred[order]
        at -= size


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, n_chars: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in the order given."""
    n = len(t)
    size = np.bincount(t, minlength=n_chars)
    stop = np.cumsum(size)
    begin = stop - size
    sa = np.full(n, -1, np.int64)
    c = t[lms]
    count = np.bincount(c, minlength=n_chars)
    by_char = lms[np.argsort(c, kind="stable")]
    edge = np.r_[0, np.cumsum(count)]
    head = begin.copy()
    for k in np.flatnonzero(size):
        done = begin[k]
        while done < head[k]:
            pred = sa[done:head[k]] - 1
            done = head[k]
            pred = pred[pred >= 0]
            pred = pred[~small[pred]]
            _dealt(pred, t[pred], sa, head, 1)
        pred = by_char[edge[k]:edge[k + 1]] - 1
        pred = pred[pred >= 0]
        _dealt(pred, t[pred], sa, head, 1)
    tail = stop.copy()
    sa[stop[t[-1]] - 1] = n - 1
    tail[t[-1]] -= 1
    for k in np.flatnonzero(size)[::-1]:
        done = stop[k]
        while done > tail[k]:
            pred = sa[tail[k]:done][::-1] - 1
            done = tail[k]
            pred = pred[pred >= 0]
            pred = pred[small[pred]]
            _dealt(pred, t[pred], sa, tail, -1)
        pred = sa[begin[k]:head[k]][::-1] - 1
        pred = pred[pred >= 0]
        pred = pred[small[pred]]
        _dealt(pred, t[pred], sa, tail, -1)
    return sa


def _item_by_item(t: list[int], n_chars: int) -> list[int]:
    """Suffix array of whole numbers whose last is the single smallest."""
    n = len(t)
    small = bytearray(n)
    small[n - 1] = 1
    for i in range(n - 2, -1, -1):
        if t[i] < t[i + 1] or (t[i] == t[i + 1] and small[i + 1]):
            small[i] = 1
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    size = [0] * n_chars
    for x in t:
        size[x] += 1
    begin, stop, total = [], [], 0
    for x in size:
        begin.append(total)
        total += x
        stop.append(total)

    def induced(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = stop[:]
        for i in reversed(order):
            tail[t[i]] -= 1
            sa[tail[t[i]]] = i
        head = begin[:]
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not small[j]:
                sa[head[t[j]]] = j
                head[t[j]] += 1
        tail = stop[:]
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and small[j]:
                tail[t[j]] -= 1
                sa[tail[t[j]]] = j
        return sa

    if len(lms) <= 1:
        return induced(lms)
    stops = {a: b for a, b in zip(lms, [*lms[1:], n - 1])}
    name, names, last = -1, {}, None
    for i in induced(lms):
        if i in stops:
            own = t[i:stops[i] + 1]
            if own != last:
                name, last = name + 1, own
            names[i] = name
    if name + 1 == len(lms):
        order = sorted(lms, key=names.__getitem__)
    else:
        order = [lms[k] for k in _item_by_item([names[i] for i in lms], name + 1)]
    return induced(order)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of the bytes in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.empty(n + 1, np.int64)
    t[:-1] = data
    t[:-1] += 1
    t[-1] = 0
    small = _smaller_than_next(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = _induced(t, small, lms, 257)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    number = np.full(n + 1, -1, np.int64)
    number[lms] = np.arange(len(lms))
    stop = np.r_[lms[1:] + 1, n + 1]
    padded = np.r_[data, np.uint8(0)]
    own = number[ordered]
    h, size = range_hashes(padded, ordered, stop[own]), stop[own] - ordered
    new = np.r_[True, (h[1:] != h[:-1]) | (size[1:] != size[:-1])]
    at_end = stop[own] == n + 1  # what holds the sentinel equals nothing else
    new |= at_end
    new[1:] |= at_end[:-1]
    if not new.all():
        names = np.empty(len(lms), np.int64)
        names[own] = np.cumsum(new) - 1
        ordered = lms[np.array(_item_by_item(names.tolist(), int(names.max()) + 1), np.int64)]
    return _induced(t, small, ordered, 257)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the array but the first, the bytes shared with the suffix before it (first: 0).

    Places whose preceding bytes differ are compared byte by byte; along the text every other place shares one byte
    less than the place before it, so a running maximum of place + length fills them.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    has = before >= 0
    direct = has & ((place == 0) | (before == 0))
    rest = np.flatnonzero(has & ~direct)
    direct[rest] = data[rest - 1] != data[before[rest] - 1]
    at = np.flatnonzero(direct)
    length = np.zeros(len(at), np.int64)
    word = words(np.r_[data, np.zeros(16, np.uint8)])
    a, b, live = at.copy(), before[at], np.arange(len(at))
    while len(live):
        inside = (a[live] < n) & (b[live] < n)
        live = live[inside]
        x = word[a[live]] ^ word[b[live]]
        bits = (x & (~x + np.uint64(1)))
        same = np.where(x == 0, 8, np.log2(np.maximum(bits, 1).astype(np.float64)).astype(np.int64) // 8)
        length[live] += same
        live = live[x == 0]
        a[live] += 8
        b[live] += 8
    length = np.minimum(length, n - np.maximum(at, before[at]))
    reach = np.full(n, -1, np.int64)
    reach[at] = at + length
    reach[~has] = place[~has]
    return np.maximum(np.maximum.accumulate(reach) - place, 0)[sa]

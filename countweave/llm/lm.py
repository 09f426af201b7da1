"""Stupid-backoff scores from n-gram counts of the whole corpus.

The count table is partitioned by the n-gram's hash; texts, exploded to n-grams, are joined with it and
their scores summed by document. To keep 100 million n-grams small, rows of these tables travel in arrays: a
chunk of texts asks for each of its n-grams once, a hash bucket adds up what all chunks counted and answers
each chunk in its own order. The counts cover every text, so they grow with the corpus; no vocabulary is
collected or broadcast. A frequent n-gram is one entry a chunk, whatever its number. Words and pairs are
counted in one pass over the texts, each longer order in a pass of its own; only the answers stay, as
tables, so the requests of one pass alone are on disk at a time.

By default a text is scored by the other texts: its own counts are left out, else it would
predict itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .store import keep, table, tasks_for

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a chunk, about; n-grams in a bucket, about.
CHUNK = 5_000_000
BUCKET = 1_000_000


def _grams(column: pa.ChunkedArray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """first (word places of each text), and for k = 1..order the hash of the k words that end at each place.

    Places whose k words would begin before the text hold the hash of fewer words; they are not used.
    """
    first, ones = [np.zeros(1, np.int64)], []
    for block in arrays.blocks(column.combine_chunks()):
        w = arrays.words(block, lower=True)
        ones.append(arrays.range_hashes(w.data, w.start, w.end))
        first.append(w.first[1:] + first[-1][-1])
    first = np.concatenate(first)
    h = [np.concatenate(ones) if ones else np.zeros(0, np.uint64)]
    del ones
    for k in range(2, order + 1):
        longer = h[-1].copy()
        longer[1:] = arrays.mixed(h[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + h[0][1:] + np.uint64(k))
        h.append(longer)
    return first, h


def _valid(first: np.ndarray, k: int) -> np.ndarray:
    """Places with k words of their text up to them, as 32-bit numbers."""
    n = np.diff(first)
    good = np.ones(int(n.sum()), bool)
    for skipped in range(k - 1):
        good[(first[:-1] + skipped)[n > skipped]] = False
    return np.flatnonzero(good).astype(np.int32)


def _passes(order: int) -> list[tuple[int, ...]]:
    """The orders that are counted together."""
    return [tuple(range(1, min(order, 2) + 1)), *((k,) for k in range(3, order + 1))]


def _asked(first: np.ndarray, h: list[np.ndarray], orders: tuple[int, ...]) -> np.ndarray:
    """The chunk's n-grams of some orders, sorted, with repeats."""
    key = np.concatenate([h[k - 1][_valid(first, k)] for k in orders])
    key.sort()
    return key


def _distinct(key: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _values(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _requests(rows: pa.Table, orders: tuple[int, ...], bits: int) -> pa.Table:
    """A chunk's distinct n-grams of some orders with counts, in order of hash, cut by bucket."""
    chunk = rows.column("chunk")[0].as_py()
    key = _asked(*_grams(rows.column("text"), orders[-1]), orders)
    at = _distinct(key)
    key, n = key[at], np.diff(np.r_[at, len(key)])
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.table([
        pa.array(np.full(len(some), chunk, np.int64)), pa.array(some),
        pa.array([_planes(key[cut[b]:cut[b + 1]]) for b in some], pa.binary()),
        pa.array([_planes(n[cut[b]:cut[b + 1]].astype(np.int64)) for b in some], pa.binary())],
        names=["chunk", "bucket", "grams", "counts"])


def _answers(rows: pa.Table) -> pa.Table:
    """The corpus counts of a bucket, for each chunk in the order it asked."""
    keys = np.concatenate([_values(x, np.uint64) for x in rows.column("grams").to_pylist()])
    counts = [_values(x, np.int64) for x in rows.column("counts").to_pylist()]
    cut = np.r_[0, np.cumsum([len(n) for n in counts])]
    order = np.argsort(keys, kind="stable").astype(np.int32)
    at = _distinct(keys[order])
    sums = np.add.reduceat(np.concatenate(counts)[order], at) if len(at) else np.zeros(0, np.int64)
    del counts
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(sums, np.diff(np.r_[at, len(keys)]))
    return pa.table([rows.column("chunk"), rows.column("bucket"),
                     pa.array([_planes(total[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["chunk", "bucket", "totals"])


def _own(owner: np.ndarray, at: np.ndarray, n_keys: int) -> np.ndarray:
    """How often each place's n-gram stands in its own text."""
    pair = owner * np.int64(n_keys) + at
    order = np.argsort(pair, kind="stable").astype(np.int32)
    runs = _distinct(pair[order])
    out = np.empty(len(pair), np.int32)
    size = np.diff(np.r_[runs, len(pair)])
    out[order] = np.repeat(size, size)
    return out


def _scored(rows: pa.Table, totals: pa.Table, order: int, backoff: float, all_words: int, own: bool) -> pa.Table:
    first, h = _grams(rows.column("text"), order)
    n = np.diff(first)
    if first[-1]:
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        words = np.full(len(owner), all_words, np.int64) if own else all_words - n[owner]
        score = np.log10(1 / (words + 1.0)) + (order - 1) * np.log10(backoff)  # a word no other text has
        before = None
        ordered = pc.sort_indices(totals, sort_keys=[("pass", "ascending"), ("bucket", "ascending")])
        for p, orders in enumerate(_passes(order)):
            key = _asked(first, h, orders)
            key = key[_distinct(key)]
            mine = ordered.filter(pc.equal(totals.column("pass").take(ordered), p).combine_chunks())
            total = np.concatenate([np.zeros(0, np.int64), *(_values(x.as_py(), np.int64) for x in totals.column("totals").take(mine))])
            for k in orders:  # one order at a time: its counts and those of the contexts before it
                good = _valid(first, k)
                at = np.searchsorted(key, h[k - 1][good]).astype(np.int32)
                c = np.zeros(len(owner), np.int64)
                c[good] = total[at]
                if not own:
                    c[good] -= _own(owner[good], at, len(key))
                seen = np.flatnonzero(c)
                context = words[seen] if k == 1 else before[seen - 1]
                score[seen] = np.log10(c[seen] / context) + (order - k) * np.log10(backoff)
                before = c
                if k == 1:
                    del words
                if k > 1 or order == 1:
                    h[k - 1] = None  # no longer hash is made of it any more
        summed = np.bincount(owner, score, len(n))
    else:
        summed = np.zeros(len(n))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = summed / n
    return pa.table([rows.column("id"), pa.array(n.astype(np.int64)), pa.array(summed), pa.array(mean, mask=n == 0)],
                    names=["id", "n_words", "log_score", "mean_log_score"])


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER,
           backoff: float = BACKOFF, own: bool = False, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: id, n_words, log_score (sum of log10), mean_log_score (by word, null without words).

    Words are runs of bytes outside [\\x20\\x09-\\x0D] with A-Z lower-cased. A word counts from the longest n-gram that ends there
    and was seen: count / count of its context, times backoff for each step down; a word never seen has one in
    all words + 1. own: count a text's own n-grams too. Null and empty texts have log_score 0. Repeated rows
    are texts of their own, so they predict each other. An empty table gives no rows; other columns are not read.
    """
    def chunked(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("chunk")

    d = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"),
                 F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("words")).first()
    dealt = d.select(chunked(tasks_for(size.n, chunk)), "id", "text")
    def requested(orders: tuple[int, ...]) -> DataFrame:
        bits = (tasks_for(size.words * len(orders), bucket) - 1).bit_length()
        return dealt.groupBy("chunk").applyInArrow(
            lambda t: _requests(t, orders, bits), "chunk long, bucket long, grams binary, counts binary")

    answered = None
    for p, orders in enumerate(_passes(order)):
        totals = keep(requested(orders).groupBy("bucket").applyInArrow(_answers, "chunk long, bucket long, totals binary"), free=True) \
            .withColumn("pass", F.lit(p))
        answered = totals if answered is None else answered.unionByName(totals)
    all_words = int(size.words)
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        lambda a, b: _scored(a, b, order, backoff, all_words, own),
        "id long, n_words long, log_score double, mean_log_score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

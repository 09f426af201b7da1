"""Quality classifier: a factorisation machine over hashed words and structure of the text.

Features are the words of a text, hashed to BUCKETS places and scaled to length 1, and a few
statistics of its structure. Every pair of features interacts through the product of two short
vectors; by the identity of the sum of squares, sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2, a
text is scored in time linear in its features. The machine is fitted on at most `max_rows` labelled texts,
those with the smallest hashes of their ids, so what comes to the driver is bounded by max_rows x BUCKETS
small numbers. Every text is scored, whole, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .store import table

BUCKETS = 4096
FACTORS = 8
MAX_ROWS = 4096
THRESHOLD = 0.3

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "bang": b"!?",
            "comma": b",;:", "stop": b".", "line": b"\n", "far": range(128, 256)}
_TABLE = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
STATISTICS = [*_CLASSES, "word_size", "repeat_word", "repeat_line", "spread", "length", "short", "one"]


@dataclass
class Features:
    """Row i has the places place[first[i]:first[i + 1]] with values value."""

    first: np.ndarray
    place: np.ndarray
    value: np.ndarray


def _per_text(mask: np.ndarray, bound: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    return (total[bound[1:]] - total[bound[:-1]]).astype(np.float64)


def features(block: arrays.Block) -> Features:
    w = arrays.words(block, lower=True)
    n_texts = block.hi - block.lo
    n = np.diff(w.first).astype(np.float64)
    owner = np.repeat(np.arange(n_texts), np.diff(w.first))
    h = arrays.range_hashes(w.data, w.start, w.end)
    key, tf = np.unique(owner.astype(np.int64) * BUCKETS + (h >> np.uint64(52)).astype(np.int64), return_counts=True)
    row, place = key // BUCKETS, key % BUCKETS
    value = np.sqrt(tf.astype(np.float64))
    distinct = np.bincount(row, minlength=n_texts).astype(np.float64)
    value /= np.sqrt(np.maximum(np.bincount(row, value * value, n_texts), 1e-9))[row]

    size = np.maximum(np.diff(block.offset), 1).astype(np.float64)
    own = [_per_text(_TABLE[k][block.data], block.offset) / size for k in _CLASSES]
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    words = np.maximum(n, 1)
    data = np.insert(block.data, block.offset[1:], 0x0A)
    end = np.flatnonzero(data == 0x0A)
    start = np.r_[0, end[:-1] + 1]
    full = end > start
    line = arrays.range_hashes(data, start[full], end[full])
    line_owner = np.searchsorted(block.offset[1:] + np.arange(n_texts), end[full])
    pair = np.lexsort((line, line_owner))
    again = np.zeros(len(line), bool)
    if len(line):
        again[1:] = (line[pair][1:] == line[pair][:-1]) & (line_owner[pair][1:] == line_owner[pair][:-1])
    n_lines = np.maximum(np.bincount(line_owner, minlength=n_texts), 1)
    own += [_per_text(w_size(w), w.first) / words / 16, _per_text(same, w.first) / words,
            np.bincount(line_owner[pair], again, n_texts) / n_lines, distinct / np.minimum(words, BUCKETS),
            np.log1p(n) / 10, (n < 20).astype(np.float64), np.ones(n_texts)]
    stats = np.stack(own, axis=1)
    n_stats = stats.shape[1]
    rows = np.r_[row, np.repeat(np.arange(n_texts), n_stats)]
    places = np.r_[place, np.tile(np.arange(BUCKETS, BUCKETS + n_stats), n_texts)]
    values = np.r_[value, stats.ravel()]
    order = np.argsort(rows, kind="stable")
    return Features(np.r_[0, np.cumsum(np.bincount(rows, minlength=n_texts))], places[order], values[order].astype(np.float32))


def w_size(w: arrays.Words) -> np.ndarray:
    return (w.end - w.start).astype(np.float64)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, x: Features) -> np.ndarray:
        cut = x.first[:-1]  # no row is without features
        linear = np.add.reduceat(self.weight[x.place] * x.value, cut)
        vx = self.factor[x.place] * x.value[:, None]
        return self.bias + linear + 0.5 * (np.add.reduceat(vx, cut) ** 2 - np.add.reduceat(vx * vx, cut)).sum(axis=1)

    def score(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def joined(parts: list[Features]) -> Features:
    sizes = np.concatenate([np.diff(p.first) for p in parts])
    return Features(np.r_[0, np.cumsum(sizes)], np.concatenate([p.place for p in parts]), np.concatenate([p.value for p in parts]))


def picked(x: Features, rows: np.ndarray) -> Features:
    size = np.diff(x.first)[rows]
    first = np.r_[0, np.cumsum(size)]
    at = np.repeat(x.first[rows] - first[:-1], size) + np.arange(first[-1])
    return Features(first, x.place[at], x.value[at])


def fit_machine(x: Features, y: np.ndarray, epochs: int = 30, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, small batches, Adam steps; without both labels the machine says 0.5 of everything."""
    rnd = np.random.default_rng(seed)
    width = BUCKETS + len(STATISTICS)
    m = Machine(0.0, np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32))
    if len(y) == 0 or y.min() == y.max():
        return m
    m.factor = rnd.normal(0, 0.05, m.factor.shape).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1, np.float32), m.weight, m.factor)]
    t = 0
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for lo in range(0, len(y), 256):
            rows = order[lo:lo + 256]
            b = picked(x, rows)
            err = (m.score(b) - y[rows]).astype(np.float32) / len(rows)
            size = np.diff(b.first)
            e = np.repeat(err, size) * b.value
            vx = m.factor[b.place] * b.value[:, None]
            s = np.repeat(np.add.reduceat(vx, b.first[:-1]), size, axis=0)
            g_w = np.bincount(b.place, e, width).astype(np.float32) + ridge * m.weight
            g_v = np.zeros_like(m.factor)
            np.add.at(g_v, b.place, e[:, None] * (s - vx))
            g_v += ridge * m.factor
            t += 1
            bias = np.array([m.bias], np.float32)
            for p, g, (a, v) in zip((bias, m.weight, m.factor), (np.array([err.sum()]), g_w, g_v), moments):
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                p -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            m.bias = float(bias[0])
    return m


def held_out(doc_id: Column) -> Column:
    """Ids that no label is learnt from: CRC-32 of the id as text divisible by 5. A null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text",
        max_rows: int = MAX_ROWS) -> Machine:
    """The machine, from labelled rows that are not held out.

    Null ids and labels are left out; of an id labelled twice the larger label counts, and of one with
    several rows each is a row, up to max_rows rows in all. The rows come in the order of their ids and features, so the fit
    can be repeated.
    """
    told = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column))) \
        .groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(F.col(label)).cast("int").alias("y")) \
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_column).cast("long").alias("own"), F.col(text_column).cast("string").alias("text")) \
        .join(F.broadcast(told), F.col("own") == F.col("id")).select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch.column(2)):
                f = features(block)
                part = batch.slice(block.lo, block.hi - block.lo)
                yield pa.record_batch([
                    part.column(0), part.column(1),
                    pa.array([f.place[a:b].astype("<u2").tobytes() for a, b in zip(f.first[:-1], f.first[1:])]),
                    pa.array([f.value[a:b].astype("<f4").tobytes() for a, b in zip(f.first[:-1], f.first[1:])])],
                    names=["id", "y", "place", "value"])

    rows = texts.mapInArrow(run, "id long, y int, place binary, value binary") \
        .orderBy("id", "value", "place").limit(max_rows).collect()
    if not rows:
        return fit_machine(Features(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)), np.zeros(0))
    place = [np.frombuffer(r.place, "<u2").astype(np.int64) for r in rows]
    x = Features(np.r_[0, np.cumsum([len(p) for p in place])], np.concatenate(place),
                 np.concatenate([np.frombuffer(r.value, "<f4") for r in rows]))
    return fit_machine(x, np.array([r.y for r in rows], np.float64))


def scored(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for every row of docs; null and empty texts have the score of a text without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [machine.score(features(b)) for b in arrays.blocks(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())],
                                  names=["id", "score"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")) \
        .mapInArrow(run, "id long, score double")


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores below the threshold, all columns as they are."""
    machine = fit(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [machine.score(features(b)) for b in arrays.blocks(batch.column(names.index("text")))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

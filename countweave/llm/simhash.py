"""SimHash near-duplicates: fingerprints, shard trees keyed by Hamming distance, components.

Fingerprints that differ in at most 3 of 64 bits agree on one of 4 sixteen-bit parts, so a
shard is one part with one value and every link lies in some shard. A shard above SPLIT
fingerprints is dealt again by quarters of the bits it has left, until none is, which loses no link. Each shard
has a BK-tree: the children of a node are keyed by their distance to it, and a search follows
only edges within the radius of the distance met. A tree is sent to the fingerprints of its
shard by the shuffle, in place of a broadcast of all trees to all rows: that would be the
square of the corpus. Equal fingerprints are one tree node, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .graph import components
from .store import keep, shuffle_partitions, table

RADIUS = 3
SPLIT = 4096


def _block_fingerprints(block: arrays.Block, shingle: int, seed: int) -> np.ndarray:
    w = arrays.words(block, lower=True)
    data, start, end = arrays.single_spaced(w)
    n = np.diff(w.first)
    count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    total = int(count.sum())
    out = np.zeros(len(n), np.uint64)
    if total == 0:
        return out
    begin = np.cumsum(count) - count
    at = np.repeat(w.first[:-1] - begin, count) + np.arange(total)
    last = np.minimum(at + shingle, np.repeat(w.first[1:], count)) - 1
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(start[at].tolist(), end[last].tolist())),
                    np.uint64, total)
    some = np.flatnonzero(count)
    ones = np.zeros((len(some), 64), np.int64)
    step = 1 << 16
    owner = np.repeat(np.arange(len(some)), count[some])
    for lo in range(0, total, step):
        bits = np.unpackbits(h[lo:lo + step].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[lo:lo + step]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    high = ones * 2 > count[some][:, None]
    out[some] = np.packbits(high, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row (id, fp) per row; fp is the fingerprint as a signed long.

    Words are runs of bytes outside [\\x20\\x09-\\x0D] with A-Z lower-cased; fewer words than a
    shingle make one shingle. Null and empty texts have fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_block_fingerprints(b, shingle, seed) for b in arrays.blocks(batch.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")) \
        .mapInArrow(run, "id long, fp long")


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest linked value of its component) for the values of one shard that have links."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    children: list[dict[int, int]] = [{}]
    for k in range(1, len(values)):
        x, stack = values[k], [0]
        while stack:
            i = stack.pop()
            d = (x ^ values[i]).bit_count()
            if d <= radius:
                a, b = root(i), root(k)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if children[i]:
                stack.extend(c for e, c in children[i].items() if d - radius <= e <= d + radius)
        i = 0
        while True:
            d = (x ^ values[i]).bit_count()
            nxt = children[i].get(d)
            if nxt is None:
                children[i][d] = k
                break
            i = nxt
        children.append({})
    return [(values[k], values[root(k)]) for k in range(len(values)) if root(k) != k]


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, fp); one shard at a time is held."""
    key, held = None, []

    def closed() -> list[tuple[int, int]]:
        return tree_links([v & 0xFFFFFFFFFFFFFFFF for v in held], RADIUS) if len(held) > 1 else []

    for batch in batches:
        found = []
        for shard, fp in zip(*(batch.column(i).to_pylist() for i in range(2))):
            if shard != key:
                found += closed()
                key, held = shard, []
            if not held or held[-1] != fp:
                held.append(fp)
        if found:
            yield _pairs(found)
    if last := closed():
        yield _pairs(last)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64).view(np.int64)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _opened(rows: DataFrame, width: int) -> DataFrame:
    """Each row (fp, shard, rest) once for each of four parts of its `width` bits left, in the shard of that part's value.

    Fingerprints of a shard that differ in 3 bits or fewer agree in one of the parts, and so meet in one of its shards.
    The fixed part is left out of the new rest. Shards of equal hashes only become one larger shard.
    """
    each, over = divmod(width, 4)
    parts, at = [], 0
    for j in range(4):
        size = each + (j < over)
        value = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << size) - 1))
        below = F.col("rest").bitwiseAND(F.lit((1 << at) - 1))
        at += size
        above = F.lit(0).cast("long") if at == 64 else F.shiftleft(F.shiftrightunsigned("rest", at), at - size)
        parts.append(F.struct(F.xxhash64("shard", F.lit(j), value).alias("shard"), below.bitwiseOR(above).alias("rest")))
    return rows.select("fp", F.explode(F.array(*parts)).alias("s")).select("fp", "s.shard", "s.rest")


def links(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints fp within the radius.

    Shards of more than `split` fingerprints are opened again by the bits they have left, until none is larger or three
    bits are left, where a shard has eight fingerprints at most.
    """
    width = 64
    rows = distinct.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"))
    small = []
    while True:
        rows, width = _opened(rows, width), width - width // 4
        if width <= RADIUS:
            break
        large = keep(rows.groupBy("shard").count().where(F.col("count") > split).select("shard"))
        if large.isEmpty():
            break
        small.append(rows.join(large, "shard", "left_anti").select("fp", "shard"))
        rows = keep(rows.join(large, "shard", "left_semi").select("fp", "shard", "rest"))
    final = reduce(DataFrame.unionByName, small, rows.select("fp", "shard"))
    dealt = final.repartition(shuffle_partitions(distinct.sparkSession), "shard") \
        .sortWithinPartitions("shard", "fp").select("shard", "fp")
    return dealt.mapInArrow(_shard_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    split: int = SPLIT) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over links of 3 bits or fewer.

    Equal fingerprints link. Null ids never name a component unless all its ids are null. Repeated
    rows each come back. Further columns of docs are not read.
    """
    prints = keep(fingerprints(docs, id_column, text_column))
    distinct = keep(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(distinct.select("fp"), split))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    classes = named.select("fp", "root").join(lowest, "root").select("fp", "component")
    return prints.join(classes, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs whose id names their component: one document of each near-duplicate group."""
    found = near_duplicates(docs, id_column, text_column)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component"))).select("id").distinct()
    # a row travels as one struct, so no column of docs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), docs[id_column].cast("long").alias("own"))
    return rows.join(gone, F.col("own").eqNullSafe(F.col("id")), "left_anti").select("row.*")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))

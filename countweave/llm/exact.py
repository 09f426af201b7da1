"""Exact duplicates: filters of immutable snapshots, exact buckets, byte checks.

A snapshot is a table of digests that no longer changes. Its distinct digests are dealt into
shards, and each shard has a static binary-fuse filter (3 places a key, 8-bit fingerprints, some
9 bits a digest). An incoming batch is grouped by digest first, so a text that a third of the
rows share is one row. Its digests meet the filter of their shard; those that pass are joined
with the exact buckets of the snapshot, the others are new. Texts of every bucket with more than
one row are then compared byte by byte. Digests stay in tables: none are collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep, table, tasks_for

#: Digests of one filter.
SHARD = 200_000


def normalised(text: Column) -> Column:
    """The text with each run of [\\x20\\x09-\\x0D] as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digested(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the normalised text, hex), row (a number of the row), kept as a table."""
    return keep(docs.select(F.col(id_column).cast("long").alias("id"),
                            F.sha2(normalised(F.col(text_column)), 256).alias("digest"),
                            F.monotonically_increasing_id().alias("row")))


def bucketed(rows: DataFrame) -> DataFrame:
    """digest, first (the row that stays: smallest id, nulls last, then row number), size."""
    return rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"),
                                      F.count(F.lit(1)).alias("size"))


def _key(digest: Column) -> Column:
    return F.xxhash64(digest)


# --- static filters -----------------------------------------------------------------------------

def _places(key: np.ndarray, seed: int, segment: int, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in successive segments, and its fingerprint."""
    x = key.view(np.uint64) + np.uint64(seed)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    first = ((x >> np.uint64(32)) * np.uint64(n_segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((x >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (x & mask)
    return np.stack([first, second, third]).astype(np.int64), ((x ^ (x >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, n_segments, slots) over distinct 64-bit keys; every key passes, about 1 in 256 others."""
    keys = np.unique(keys.astype(np.int64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
    n_segments = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1000):
        slots, mark = _places(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, segment, n_segments)
        size = (n_segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(n))
        peeled, front, left = [], np.flatnonzero(count == 1), n
        while len(front):
            key, at = np.unique(held[front], return_index=True)
            slot = front[at]
            peeled.append((key, slot))
            left -= len(key)
            touched = slots[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, key)
            front = np.unique(touched)
            front = front[count[front] == 1]
        if left == 0:
            out = np.zeros(size, np.uint8)
            for key, slot in reversed(peeled):
                a, b, c = (out[row] for row in slots[:, key])
                out[slot] = mark[key] ^ a ^ b ^ c ^ out[slot]
            return seed, segment, n_segments, out.tobytes()
        if seed % 10 == 9:
            n_segments += max(1, n_segments // 8)
    raise ValueError("no filter found")


def passes(keys: np.ndarray, seed: int, segment: int, n_segments: int, slots: bytes) -> np.ndarray:
    """Whether each key may be in the filter."""
    table_, place = np.frombuffer(slots, np.uint8), keys.astype(np.int64)
    at, mark = _places(place, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, segment, n_segments)
    return mark == table_[at[0]] ^ table_[at[1]] ^ table_[at[2]]


class Snapshot:
    """Exact buckets and filters of a set of digested rows; both are tables that stay as they are."""

    def __init__(self, rows: DataFrame):
        self.buckets = keep(bucketed(rows))
        self.n_shards = tasks_for(self.buckets.count(), SHARD)

        def built(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(pdf["shard"].iloc[0], *build_filter(pdf["key"].to_numpy()))],
                                columns=["shard", "seed", "segment", "n_segments", "slots"])

        self.filters = keep(self.buckets.select(self.shard(), _key(F.col("digest")).alias("key")).groupBy("shard")
                            .applyInPandas(built, "shard long, seed long, segment long, n_segments long, slots binary"))

    def shard(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(self.n_shards)).alias("shard")

    def screen(self, digests: DataFrame) -> DataFrame:
        """The distinct digests that may be in the snapshot: all that are, and a few more."""
        pieces = self.n_shards
        split = tasks_for(digests.count(), SHARD * pieces)  # a batch larger than the snapshot is dealt finer
        part = F.pmod(F.xxhash64(F.lit(2), "digest"), F.lit(split)).cast("long").alias("part")
        asked = digests.select(self.shard(), part, "digest", _key(F.col("digest")).alias("key"))
        filters = self.filters.withColumn("part", F.explode(F.expr(f"sequence(0L, {split - 1}L)")))

        def passed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"digest": pd.Series([], dtype=object)})
            f = right.iloc[0]
            return left.loc[passes(left["key"].to_numpy(), int(f["seed"]), int(f["segment"]), int(f["n_segments"]), f["slots"]), ["digest"]]

        return asked.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")) \
            .applyInPandas(passed, "digest string")


def against(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """Buckets of the snapshot and the digested batch together: digest, first, size."""
    new = keep(bucketed(batch))
    maybe = snapshot.screen(new.select("digest"))
    old = snapshot.buckets.select("digest", F.col("first").alias("old_first"), F.col("size").alias("old_size"))
    met = keep(maybe.join(new, "digest").join(old, "digest").select(
        "digest", F.least("first", "old_first").alias("first"), (F.col("size") + F.col("old_size")).alias("size")))
    seen = met.select("digest")
    return met.unionByName(new.join(seen, "digest", "left_anti")) \
        .unionByName(snapshot.buckets.join(seen, "digest", "left_anti"))


def byte_checked(docs: DataFrame, rows: DataFrame, buckets: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The buckets, after the texts of each bucket of more than one row were found to be one text.

    Texts are fetched by id, so a bucket's rows come from everywhere, and equal ones are folded
    before they are sent to their bucket. Different texts of one SHA-256 stop the job.
    """
    many = buckets.where("size > 1").select("digest")
    wanted = rows.join(many, "digest").select(F.col("id").alias("__id")).distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("__id"), normalised(F.col(text_column)).alias("norm"))
    fetched = texts.join(wanted, texts["__id"].eqNullSafe(wanted["__id"]), "left_semi") \
        .select(F.sha2("norm", 256).alias("digest"), "norm")
    distinct = fetched.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n_rows")).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_texts"))
    return buckets.join(distinct, "digest", "left").withColumn(
        "size", F.when(F.col("n_texts") > 1, F.raise_error(F.lit("different texts share a SHA-256"))).otherwise(F.col("size"))) \
        .drop("n_texts")


def exact_duplicates(docs: DataFrame, known: Column | None = None, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, row, digest, keep_id, group_size, kept.

    known marks the rows of the snapshot (an immutable part seen before), the others are the batch;
    by default ids up to the median. Where the line is drawn changes no result: of equal texts the smallest
    id stays, and of rows that repeat it the first. Null ids come last and stay only where all
    ids of a text are null. Null and empty texts are equal. Other columns are not read.
    """
    rows = digested(docs, id_column, text_column)
    if known is None:
        middle = rows.agg(F.percentile_approx("id", 0.5, 1000)).first()[0]
        known = F.col("id") <= F.lit(middle)
    old = rows.where(F.coalesce(known, F.lit(False)))
    new = rows.where(~F.coalesce(known, F.lit(False)))
    buckets = keep(against(Snapshot(old), new))
    checked = keep(byte_checked(docs, rows, buckets, id_column, text_column))  # so that a hot bucket's rows can be split
    return rows.join(checked, "digest").select(
        "id", "row", "digest", F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each text, all its columns as they are."""
    found = keep(exact_duplicates(docs, id_column=id_column, text_column=text_column))
    stays = found.groupBy("id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")) \
        .where("stays").select("id", "digest", "n")
    # a row travels as one struct, so no column of docs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("of"), F.sha2(normalised(F.col(text_column)), 256).alias("own"))
    left = rows.join(stays, F.col("of").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    single = left.where("n = 1").select("row")
    folded = left.where("n > 1").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(folded).select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

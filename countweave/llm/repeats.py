"""Repeated passages: bytes covered by a 100-byte string that also starts earlier in the corpus.

Texts are cut into segments by anchors, so equal 100-byte windows are in segments with one anchor gram.
 1. Each task folds its equal segments and sends the rest, packed, to the bucket of the gram.
 2. A bucket keeps the first of equal segments; the windows of the others all start earlier too. First
    segments of a gram that has several go on, with their bytes, to a shard.
 3. A shard builds the suffix array of its segments by induced sorting, and the permuted common prefixes.
    Stretches of the array with 100 common bytes are equal windows; all but the first one start earlier.
 4. Removed windows meet the text again, by document, and become spans.
Grams in very many contexts (a line that a third of the texts share) are found beforehand in a sample of
texts; their segments are dealt window by window, by the window's own bytes, so no shard gathers them. The
list only decides where a window is compared: results are the same whatever it holds.
Equal segments and hot windows are told by two 64-bit hashes, all else byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, suffixes
from .anchors import WINDOW, Segments, segments
from .store import keep, table, tasks_for

#: Segments of a bucket and bytes of a shard, about; contexts that make a gram hot; one text in so many is sampled.
BUCKET = 400_000
SHARD = 1_000_000
HOT = 20_000
SAMPLE = 64
MAX_HOT = 10_000

PACKED = "bucket int, uid binary, lo binary, n binary, gram binary, seg binary"
FIELDS = (("uid", np.int64), ("lo", np.int64), ("n", np.int32), ("gram", np.uint64), ("seg", np.uint64))


def _packed(a: np.ndarray) -> bytes:
    """Bytes by significance, so that like ones stand together."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _unpacked(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _by_window(s: Segments, pick: np.ndarray) -> Segments:
    """The picked segments, cut into windows."""
    n = s.n[pick]
    lo = np.repeat(s.lo[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Segments(np.repeat(s.row[pick], n), lo, np.ones(len(lo), np.int64), np.zeros(len(lo), np.uint64))


def _block_segments(block: arrays.Block, uids: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    s = segments(block.data, block.offset)
    is_hot = np.isin(s.gram, hot) if len(hot) else np.zeros(len(s.gram), bool)
    h = arrays.range_hashes(block.data, s.lo, s.stop())
    if is_hot.any():
        w = _by_window(s, is_hot)
        hw = arrays.range_hashes(block.data, w.lo, w.stop())
        cold = ~is_hot
        w.gram = arrays.mixed(hw ^ np.uint64(0x5DEECE66D1CE4E5B))
        s = Segments(*(np.r_[getattr(s, k)[cold], getattr(w, k)] for k in ("row", "lo", "n", "gram")))
        h = np.r_[h[cold], hw]
    return {"uid": uids[s.row], "lo": s.lo - block.offset[s.row], "n": s.n.astype(np.int32), "gram": s.gram,
            "seg": arrays.mixed(h + s.n.astype(np.uint64))}


def _runs(uid: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows lo..lo + n - 1 of each uid, those that follow each other as one."""
    order = np.lexsort((lo, uid))
    uid, lo, n = uid[order], lo[order], n[order]
    new = np.flatnonzero(np.r_[True, (uid[1:] != uid[:-1]) | (lo[1:] != lo[:-1] + n[:-1])]) if len(uid) else order
    total = np.r_[0, np.cumsum(n)]
    return uid[new], lo[new], total[np.r_[new[1:], len(uid)]] - total[new] if len(uid) else n


def _folded(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """x in the order of gram, segment, place; which are the first of equal segments."""
    order = np.lexsort((x["lo"], x["uid"], x["seg"], x["gram"]))
    x = {k: v[order] for k, v in x.items()}
    first = np.ones(len(order), bool)
    first[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["seg"][1:] != x["seg"][:-1])
    return x, first


def _sent(batches: Iterator[pa.RecordBatch], n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed segments; gone windows have an empty gram and go to the bucket of their text."""
    for batch in batches:
        uids = batch.column(0).to_numpy()
        parts = [_block_segments(b, uids[b.lo:b.hi], hot) for b in arrays.blocks(batch.column(1))]
        if not parts:
            continue
        x, first = _folded({k: np.concatenate([p[k] for p in parts]) for k, _ in FIELDS})
        gone = _runs(x["uid"][~first], x["lo"][~first], x["n"][~first].astype(np.int64))
        x = {k: v[first] for k, v in x.items()}
        rows = []
        for part, key in ((x, x["gram"]), (dict(zip(("uid", "lo", "n"), gone)), arrays.mixed(gone[0].astype(np.uint64)))):
            bucket = (key >> np.uint64(8)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.r_[0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=n_buckets))]
            part = {k: v[order].astype(kind) for k, kind in FIELDS if (v := part.get(k)) is not None}
            for b in np.flatnonzero(np.diff(cut)):
                own = {k: _packed(np.ascontiguousarray(v[cut[b]:cut[b + 1]])) for k, v in part.items()}
                rows.append((int(b), own["uid"], own["lo"], own["n"], own.get("gram", b""), own.get("seg", b"")))
        for lo in range(0, len(rows), 256):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[lo:lo + 256]), (pa.int32(), *[pa.binary()] * 5))],
                                  names=["bucket", "uid", "lo", "n", "gram", "seg"])


def _bucket_told(rows: pa.Table) -> pa.Table:
    """(uid, lo, n, gram): gone windows have no gram, the others are wanted by the gram's shard."""
    parts, gone = [], []
    for r in zip(*(rows.column(k).to_pylist() for k, _ in FIELDS)):
        own = {k: _unpacked(raw, kind) for (k, kind), raw in zip(FIELDS, r) if raw}
        (parts if "gram" in own else gone).append(own)
    out = [[np.concatenate([g[k] for g in gone]).astype(np.int64) for k in ("uid", "lo", "n")]] if gone else []
    wanted = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    if parts:
        x, first = _folded({k: np.concatenate([p[k] for p in parts]) for k, _ in FIELDS})
        out.append(_runs(x["uid"][~first], x["lo"][~first], x["n"][~first].astype(np.int64)))
        x = {k: v[first] for k, v in x.items()}
        start = np.flatnonzero(np.r_[True, x["gram"][1:] != x["gram"][:-1]])
        size = np.diff(np.r_[start, len(x["gram"])])
        many = np.repeat(size > 1, size)
        wanted = [x[k][many] for k in ("uid", "lo", "n", "gram")]
    uid, lo, n = (np.concatenate([o[k] for o in out] + [wanted[k].astype(np.int64)]) for k in range(3))
    n_gone = len(uid) - len(wanted[0])
    gram = pa.array(np.r_[np.zeros(n_gone, np.int64), wanted[3].view(np.int64)], mask=np.arange(len(uid)) < n_gone)
    return pa.table([pa.array(uid), pa.array(lo), pa.array(n), gram], names=["uid", "lo", "n", "gram"])


def _cut_out(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        shard, uids, lows, sizes, raw = [], [], [], [], []
        for uid, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = (text or "").encode()
            for w in wanted:
                shard.append((w["gram"] & 0x7FFFFFFFFFFFFFFF) % n_shards)
                uids.append(uid)
                lows.append(w["lo"])
                sizes.append(w["n"])
                raw.append(data[w["lo"]:w["lo"] + w["n"] + WINDOW - 1])
        for lo in range(0, len(raw), 20_000):
            at = slice(lo, lo + 20_000)
            yield pa.record_batch([pa.array(shard[at], pa.int64()), pa.array(uids[at], pa.int64()), pa.array(lows[at], pa.int64()),
                                   pa.array(sizes[at], pa.int64()), pa.array(raw[at], pa.binary())],
                                  names=["shard", "uid", "lo", "n", "raw"])


def equal_windows(uid: np.ndarray, lo: np.ndarray, n: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(uid, place) of each window of the segments that equals a window with a smaller (uid, place)."""
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    begin = np.cumsum(size) - size
    sa = suffixes.suffix_array(data)
    group = np.cumsum(suffixes.common_prefixes(data, sa) < WINDOW)
    row = np.full(len(data), -1, np.int64)
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row[at] = np.repeat(np.arange(len(raw)), n)
    owner = row[sa]
    sure = owner >= 0
    group, owner, place = group[sure], owner[sure], sa[sure]
    shared = np.zeros(len(group), bool)
    if len(group) > 1:
        same = group[1:] == group[:-1]
        shared[1:] |= same
        shared[:-1] |= same
    group, owner, place = group[shared], owner[shared], place[shared]
    spot = lo[owner] + place - begin[owner]
    order = np.lexsort((spot, uid[owner], group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    found = order[later]
    return uid[owner[found]], spot[found]


def _shard_told(rows: pa.Table) -> pa.Table:
    uid, lo, n = (rows.column(k).to_numpy() for k in ("uid", "lo", "n"))
    found, spot = equal_windows(uid, lo, n, rows.column("raw").to_pylist())
    runs = _runs(found, spot, np.ones(len(spot), np.int64))
    return pa.table([pa.array(a.astype(np.int64)) for a in runs], names=["uid", "lo", "n"])


def _spans(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal removed runs of bytes, from runs of removed windows."""
    order = np.argsort(lo, kind="stable")
    start, stop = lo[order], (lo + n + WINDOW - 1)[order]
    reach = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]


def _cleaned(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uid, name, text, gone in zip(*(batch.column(k).to_pylist() for k in range(4))):
            data = (text or "").encode()
            spans = []
            if gone:
                start, stop = _spans(np.array([g["lo"] for g in gone], np.int64), np.array([g["n"] for g in gone], np.int64))
                spans = list(zip(start.tolist(), stop.tolist()))
            left, at = [], 0
            for a, b in spans:
                left.append(data[at:a])
                at = b
            kept = b"".join([*left, data[at:]])
            rows.append((uid, name, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                         [{"start": a, "stop": b} for a, b in spans], kept if with_text else None))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (
                *[pa.int64()] * 5, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()))],
                names=["uid", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """uid, id, text: uid is the id where ids are unique and known, else the place in the order of (id, text)."""
    d = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    if d.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        return d.select(F.col("id").alias("uid"), "id", "text")
    return keep(d.orderBy(F.col("id").asc_nulls_last(), F.sha2("text", 256))
                .select(F.monotonically_increasing_id().alias("uid"), "id", "text"))


def _hot_grams(d: DataFrame, sample: int, least: int) -> np.ndarray:
    """Grams in very many different segments, judged by a sample; at most MAX_HOT of them, the most frequent ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in arrays.blocks(batch.column(0)):
                s = segments(b.data, b.offset)
                pair = np.unique(np.stack([s.gram, arrays.range_hashes(b.data, s.lo, s.stop())]), axis=1)
                gram, n = np.unique(pair[0], return_counts=True)
                often = n >= 2 if least > 2 * sample else n >= 1
                yield pa.record_batch([pa.array(gram[often].view(np.int64)), pa.array(n[often])], names=["gram", "n"])

    some = d.where(F.pmod(F.xxhash64(F.lit("sample"), "uid"), F.lit(sample)) == 0).select("text")
    found = some.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")) \
        .where(F.col("n") * sample >= least).orderBy(F.col("n").desc(), "gram").limit(MAX_HOT)
    return np.array([r.gram for r in found.collect()], np.int64).view(np.uint64)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False,
                    bucket: int = BUCKET, shard: int = SHARD, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes), kept.

    Earlier is a smaller id, null last, or in one document an earlier place. Rows that repeat an id are documents
    of their own, in the order of their texts' SHA-256. Null and empty texts, and those below 100 bytes, lose nothing. kept:
    the remaining bytes, if with_text. Strings are judged on the input. An empty table gives no rows.
    """
    d = _numbered(docs, id_column, text_column)
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    grams = _hot_grams(d, sample, hot)
    n_buckets = tasks_for(n_bytes // 32, bucket)
    sent = d.select("uid", "text").mapInArrow(lambda it: _sent(it, n_buckets, grams), PACKED)
    told = keep(sent.groupBy("bucket").applyInArrow(_bucket_told, "uid long, lo long, n long, gram long"))
    wanted = told.where("gram IS NOT NULL")
    n_shards = tasks_for(wanted.agg(F.coalesce(F.sum(F.col("n") + WINDOW), F.lit(0)).alias("n")).first().n, shard)
    by_text = wanted.groupBy("uid").agg(F.collect_list(F.struct("lo", "n", "gram")).alias("wanted"))
    cut = d.join(by_text, "uid").select("uid", "text", "wanted").mapInArrow(
        lambda it: _cut_out(it, n_shards), "shard long, uid long, lo long, n long, raw binary")
    later = cut.groupBy("shard").applyInArrow(_shard_told, "uid long, lo long, n long")
    gone = told.where("gram IS NULL").select("uid", "lo", "n").unionByName(later) \
        .groupBy("uid").agg(F.collect_list(F.struct("lo", "n")).alias("gone"))
    return d.join(gone, "uid", "left").select("uid", "id", "text", "gone").mapInArrow(
        lambda it: _cleaned(it, with_text), "uid long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
        " spans array<struct<start: bigint, stop: bigint>>, kept binary").drop("uid")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

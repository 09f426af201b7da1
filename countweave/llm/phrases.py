"""Collocations: word n-grams that stand together more often than their parts explain.

First pass. Texts are joined to blocks of one language, cut only where no phrase can cross. A block counts its own
n-grams and deals them over hash partitions. A partition merges the blocks' counts as Misra-Gries
summaries, tree-wise, never holding more than mass / threshold + 1 counters of a merged summary: what occurs
`threshold` times or more loses less than that, so it survives. The partition tells each block which of the
n-grams it sent are left, one bit each.

Second pass. Blocks write the phrases that are left with their own counts, and an ordinary grouped sum over
language and text counts them exactly. The first pass works on 64-bit hashes, where a collision can only let a phrase
through; the second one on texts. Everything after (parts, scores, containment, ranks) is joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays
from .store import keep, table, tasks_for

LONGEST = 3
THRESHOLD = 10
TOP = 2000
#: A longer candidate with this share (percent) of a phrase's occurrences hides it.
HIDES = 50
#: Bytes of text in a block, about; n-grams in a hash partition, about; summaries merged at once.
BLOCK = 6_000_000
PARTITION = 4_000_000
FAN_IN = 16
#: Parts of a language that are ranked by themselves first.
PARTS = 64

#: Bytes: 0 in words, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = bytes(arrays.LOWER)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(lang, block, data, n_words): lower-cased texts of one language, a line end between them."""
    place, made = TaskContext.get().partitionId(), 0
    held: dict[str, list[bytes]] = {}
    filled: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        nonlocal made
        data = b"\n".join(held.pop(lang)).translate(_LOWER)
        del filled[lang]
        made += 1
        inside = KIND[np.frombuffer(data, np.uint8)] == 0
        n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
        return pa.record_batch([pa.array([lang]), pa.array([(place << 32) + made], pa.int64()),
                                pa.array([data], pa.binary()), pa.array([n], pa.int64())],
                               names=["lang", "block", "data", "n_words"])

    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
        for lang, text in zip(batch.column(0).to_pylist(), texts):
            text = text.as_py()
            while len(text) > size and (end := _PIECE_END.search(text, size)):  # a long text, in several blocks
                held.setdefault(lang, []).append(text[:end.end()])
                filled[lang] = filled.get(lang, 0) + end.end()
                text = text[end.end():]
                yield out(lang)
            held.setdefault(lang, []).append(text)
            filled[lang] = filled.get(lang, 0) + len(text) + 1
            if filled[lang] >= size:
                yield out(lang)
            elif sum(filled.values()) > 3 * size:  # many languages
                yield out(max(filled, key=filled.get))
    for lang in list(held):
        yield out(lang)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of words, and the piece of each word."""
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    edge = np.empty(len(raw) + 1, bool)
    inside = kind == 0
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(raw) else (False, False)
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), start).astype(np.int32)
    return raw, start, end, piece


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lang: str, longest: int, seed: int = 0) -> Iterator[np.ndarray]:
    """For k = 1..longest the hash of the k words that begin at each word with k - 1 after it."""
    name = np.frombuffer(lang.encode(), np.uint8)
    own = arrays.range_hashes(name, np.array([0]), np.array([len(name)]), seed)[0]
    one = np.concatenate([np.zeros(0, np.uint64), *(arrays.range_hashes(
        raw[start[i]:end[min(i + 200_000, len(start)) - 1]], start[i:i + 200_000] - start[i],
        end[i:i + 200_000] - start[i], seed) for i in range(0, len(start), 200_000))])
    one ^= own
    h = one
    yield arrays.mixed(h)
    for k in range(2, longest + 1):
        h = arrays.mixed(h[:-1] * _SEED + one[k - 1:] + np.uint64(k))
        yield h


def _whole(piece: np.ndarray, k: int) -> np.ndarray:
    """Words with k - 1 more of their piece after them."""
    return np.flatnonzero(piece[:len(piece) - k + 1] == piece[k - 1:])


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]) if n is None else np.add.reduceat(n, first)


def _planes(a: np.ndarray) -> bytes:
    """Low bytes of all first, then the next ones: small counts compress well."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each hash partition's keys begin, in sorted keys."""
    if not bits:
        return np.array([0, len(keys)])
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _sent(batches: Iterator[pa.RecordBatch], longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A block's counts of its n-grams, by length and hash partition."""
    for batch in batches:
        for lang, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw, start, end, piece = _words(data)
            for k, h in enumerate(_hashes(raw, start, end, lang, longest), 1):
                keys, n = _counted(h[_whole(piece, k)])
                cut = _cuts(keys, bits)
                some = np.flatnonzero(np.diff(cut))
                if len(some) == 0:
                    continue
                yield pa.record_batch([
                    pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int64)),
                    pa.array(np.full(len(some), block, np.int64)),
                    pa.array([keys[cut[p]:cut[p + 1]].tobytes() for p in some], pa.binary()),
                    pa.array([_planes(n[cut[p]:cut[p + 1]].astype(np.uint32)) for p in some], pa.binary())],
                    names=["k", "part", "block", "grams", "counts"])


def merge(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """One Misra-Gries summary of several: keys in order and counters, `capacity` of them at most.

    Counters add up; where more are left, all lose the first one too many. So a key loses at most
    (mass - counters left) / (capacity + 1), whatever the order of the merges.
    """
    keys, n = _counted(np.concatenate([k for k, _ in summaries]), np.concatenate([c for _, c in summaries]))
    if len(keys) > capacity:
        n = n - np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1]
        keys, n = keys[n > 0], n[n > 0]
    return keys, n


def survivors(summaries: list[tuple[np.ndarray, np.ndarray]], threshold: int) -> np.ndarray:
    """Keys, in order, among them every one that occurs `threshold` times or more in all."""
    mass = sum(int(n.sum()) for _, n in summaries)
    capacity = mass // threshold + 1
    while len(summaries) > 1:
        summaries = [merge(summaries[i:i + FAN_IN], capacity) for i in range(0, len(summaries), FAN_IN)]
    keys, n = merge(summaries, capacity)
    lost = (mass - int(n.sum())) // (capacity + 1)
    return keys[n + lost >= threshold]


def _answered(rows: pa.Table, threshold: int) -> pa.Table:
    """For every block of a hash partition, which of the n-grams it sent are left."""
    sent = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
    counts = [_unplaned(x).astype(np.int64) for x in rows.column("counts").to_pylist()]
    left = survivors(list(zip(sent, counts)), threshold)
    del counts
    bits = []
    for keys in sent:
        at = np.minimum(np.searchsorted(left, keys), max(len(left) - 1, 0))
        bits.append(np.packbits(left[at] == keys if len(left) else np.zeros(len(keys), bool)).tobytes())
    return pa.table([rows.column("block"), rows.column("k"), rows.column("part"), pa.array(bits, pa.binary())],
                    names=["block", "k", "part", "bits"])


def _texts(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, k: int) -> pa.Array:
    """The k words from each of `first` on, one space between."""
    size = (end - start)[first[:, None] + np.arange(k)]
    width = size + 1
    width[:, -1] -= 1
    flat = width.ravel()
    to = np.cumsum(flat) - flat
    total = int(flat.sum())
    take = np.repeat(start[first[:, None] + np.arange(k)].ravel() - to, flat) + np.arange(total)
    data = raw[np.minimum(take, len(raw) - 1)]
    if k > 1:
        data[(to + size.ravel()).reshape(-1, k)[:, :-1].ravel()] = 0x20
    offset = np.r_[0, np.cumsum(width.sum(axis=1))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offset), pa.py_buffer(data)])


def _phrases(batches: Iterator[pa.RecordBatch], longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A block's n-grams that are left, as text, with its own counts; told by 128 bits within the block."""
    for batch in batches:
        for lang, data, answers in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw, start, end, piece = _words(data)
            held: dict[int, list[bytes | None]] = {k: [None] * (1 << bits) for k in range(1, longest + 1)}
            for a in answers:
                held[a["k"]][a["part"]] = a["bits"]
            second = _hashes(raw, start, end, lang, longest, seed=1)
            for k, (h, g) in enumerate(zip(_hashes(raw, start, end, lang, longest), second), 1):
                whole = _whole(piece, k)
                if len(whole) == 0:
                    continue
                order = np.argsort(h[whole], kind="stable")
                h, g, whole = h[whole][order], g[whole][order], whole[order]
                new = np.r_[True, h[1:] != h[:-1]]
                keys = h[new]
                cut = _cuts(keys, bits)
                good = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n))
                                       for x, n in zip(held[k], np.diff(cut)) if n]).astype(bool)
                mine = good[np.cumsum(new) - 1]
                h, g, whole = h[mine], g[mine], whole[mine]
                if len(h) == 0:
                    continue
                differ = g[1:] != g[:-1]
                if np.any(differ & (h[1:] == h[:-1])):  # two n-grams of one hash
                    order = np.lexsort((whole, g, h))
                    h, g, whole = h[order], g[order], whole[order]
                    differ = g[1:] != g[:-1]
                first = np.flatnonzero(np.r_[True, differ | (h[1:] != h[:-1])])
                n = np.diff(np.r_[first, len(h)])
                for lo in range(0, len(first), 200_000):
                    some = whole[first[lo:lo + 200_000]]
                    yield pa.record_batch([
                        pa.array([lang] * len(some)).cast(pa.string()), pa.array(np.full(len(some), k, np.int32)),
                        _texts(raw, start, end, some, k).cast(pa.string()), pa.array(n[lo:lo + 200_000].astype(np.int64))],
                        names=["lang", "k", "phrase", "f"])


def frequent(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", longest: int = LONGEST,
             threshold: int = THRESHOLD, block: int = BLOCK, partition: int = PARTITION) -> tuple[DataFrame, DataFrame]:
    """Every n-gram of 1 to `longest` words with at least `threshold` occurrences, and the words of each language.

    Two tables: (lang, k, phrase, f) with exact counts, and (lang, n). A-Z are lower-cased; texts are split into pieces
    at [.,;:!?\\x0A-\\x0D] and those into words [^\\x20\\x09]+; an n-gram lies within a piece. A null text is empty, a null
    language is `und`; a language without words has no row. Repeated rows are texts of their own. A very long text
    is read in several blocks, cut between pieces (one piece is never cut). An empty table gives empty
    tables; other columns are not read.
    """
    d = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
                    F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    blocks = keep(d.mapInArrow(partial(_blocks, size=block), "lang string, block long, data binary, n_words long"),
                  **{"parquet.block.size": 16 << 20, "compression": "zstd"})
    words = blocks.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0")
    mass = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = (tasks_for(mass, partition) - 1).bit_length()
    sent = blocks.select("lang", "block", "data").mapInArrow(
        partial(_sent, longest=longest, bits=bits), "k int, part long, block long, grams binary, counts binary")
    left = keep(sent.groupBy("k", "part").applyInArrow(
        lambda rows: _answered(rows, threshold), "block long, k int, part long, bits binary"), free=True)
    answers = left.groupBy("block").agg(F.collect_list(F.struct("k", "part", "bits")).alias("answers"))
    told = blocks.join(answers, "block").select("lang", "data", "answers").mapInArrow(
        partial(_phrases, longest=longest, bits=bits), "lang string, k int, phrase string, f long")
    total = told.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)
    return keep(total, free=True), words


def collocations(docs: DataFrame, top: int = TOP, hides: int = HIDES, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two words and more.

    a counts the phrase, l and r its parts at the cut with the lowest floor(1000000 a a / (l r)) (ties: the first cut).
    A phrase inside a longer one that has `hides` percent of its occurrences or more is left out. Order: score and a
    descending, phrase ascending by its bytes. Products are decimals of 38 digits, exact for counts below 10^15.
    Nulls, empty and very long texts, repeated rows and empty tables as in `frequent`.
    """
    counts, words = frequent(docs, **options)
    w = F.split("phrase", " ")
    long = counts.where("k > 1")
    cuts = long.select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")) \
        .select("*", F.array_join(F.slice(w, F.lit(1), F.col("cut")), " ").alias("left"),
                F.array_join(F.slice(w, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    exact = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn(
        "score", F.expr(f"({exact('a')} * {exact('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({exact('l')} * {exact('r')})"))
    lowest = scored.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # what a longer phrase holds: every shorter run of its words
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    held = long.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    shown = lowest.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * hides))
    # a language's first ones are among the first ones of its parts: no task sorts all of a language
    first = (F.desc("m.score"), F.desc("a"), "phrase")
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*first)
    near = shown.select("*", F.row_number().over(parts).alias("place")).where(F.col("place") <= top).drop("place")
    ranked = near.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*first)).alias("rank")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM
  (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM t)),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM
  (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) x(k) WHERE len(w) >= k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE f >= 10),
s AS (SELECT lang, k, phrase, f AS a, j, array_to_string(list_slice(string_split(phrase, ' '), 1, j), ' ') AS lp,
  array_to_string(list_slice(string_split(phrase, ' '), j + 1, k), ' ') AS rp FROM
  (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
m AS (SELECT s.lang, s.k, s.phrase, a, j, x.f AS l, y.f AS r,
  CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM s JOIN f x ON x.lang = s.lang AND x.phrase = lp JOIN f y ON y.lang = s.lang AND y.phrase = rp),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([
  array_to_string(list_slice(string_split(phrase, ' '), 1, 2), ' '), array_to_string(list_slice(string_split(phrase, ' '), 2, 3), ' ')]) AS phrase
  FROM f WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b
  LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase AND k = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, o.phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

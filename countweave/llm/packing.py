"""Best-fit packing of token sequences, hierarchical.

Documents become pieces of at most `capacity` tokens. Pieces are dealt over partitions and
packed there by best fit, longest first. Nearly full sequences are final; underfull ones go up
a tree as items of their own, several partitions to a task, and are packed by best fit again,
until one task is left. A sequence is a row with its pieces (at most `capacity` of them), so
a task holds a bounded number of rows and nothing is looked up later.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .store import keep, table, tasks_for

CAPACITY = 1024
END_ID = 2
#: Pieces of a first-round task; underfull sequences of a task in later rounds.
PIECES_PER_TASK = 50_000
ITEMS_PER_TASK = 40_000
#: Rounds end when more than this share of the sequences that came up goes up again.
WORTH = 0.95
#: Tokenised chunks a Python worker remembers.
REMEMBERED = 2_000_000

PIECE = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>"
SEQUENCE = f"root long, free int, pieces array<{PIECE}>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A, 0x09, 0x0D]] = True
#: All of the pattern's white space (Unicode White_Space), as UTF-8: single bytes, then longer ones.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), 0x20]] = True
_WHITE_LONG = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _white_ends(data: np.ndarray) -> np.ndarray:
    """Whether a white-space character ends at each byte."""
    white = _WHITE[data]
    for lead in {x[0] for x in _WHITE_LONG}:
        at = np.flatnonzero(data == lead)
        for c in (x for x in _WHITE_LONG if x[0] == lead):
            hit = at[at + len(c) <= len(data)]
            for i in range(1, len(c)):
                hit = hit[data[hit + i] == c[i]]
            white[hit + len(c) - 1] = True
    return white


class Encoder:
    """Token ids of whole texts; equal chunks are tokenised once.

    A chunk begins at an ASCII space that no white-space character (of any script) stands before. The tokenizer's
    pattern never joins a non-space character with a following space, so ids of chunks, put together, are those of the text.
    The ranks file holds the vocabulary of byte_bpe_50k.json; its ids are those of the `tokenizers`
    library (tested), at a fifth of the time. special: texts that are one id wherever they stand; what lies
    before, between and after them is tokenised by itself.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = special or {}
        longest = sorted((x.encode() for x in self.special), key=len, reverse=True)
        self.cut = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.n_flat = 0

    def encode(self, block: arrays.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and where each text's ids begin (one more at the end)."""
        data, offset = block.data, block.offset
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offset), np.int64)
        edge = np.empty(len(data), bool)
        edge[1:] = _SPACE[data[1:]] & ~_white_ends(data)[:-1]
        edge[0] = False
        edge[offset[:-1][offset[:-1] < len(data)]] = True
        raw = data.tobytes()
        if self.cut and self.cut.search(raw):
            for a, b in zip(offset[:-1].tolist(), offset[1:].tolist()):
                for m in self.cut.finditer(raw, a, b):
                    edge[m.start()] = True
                    edge[m.end():m.end() + 1] = True
        start = np.flatnonzero(edge)
        end = np.r_[start[1:], len(data)]
        key, at, back = np.unique(arrays.range_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.hash) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.hash, key)
        new = np.flatnonzero(np.r_[self.hash, np.uint64(0)][spot] != key) if len(self.hash) else np.arange(len(key))
        if len(new):
            texts = [raw[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())]
            ids = [[self.special[x]] if x in self.special else self.one(x) for x in texts]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())))
            self.hash = np.insert(self.hash, spot[new], key[new])
            self.first = np.insert(self.first, spot[new], self.n_flat + np.cumsum(size) - size)
            self.size = np.insert(self.size, spot[new], size)
            self.n_flat += int(size.sum())
            if len(self.flat) > 64:
                self.flat = [np.concatenate(self.flat)]
            spot = np.searchsorted(self.hash, key)
        flat = np.concatenate(self.flat) if len(self.flat) > 1 else self.flat[0]
        self.flat = [flat]
        size, first = self.size[spot][back], self.first[spot][back]
        total = np.r_[0, np.cumsum(size)]
        ids = flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offset)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def _added(path: str) -> dict[str, int]:
    """added_tokens of the tokenizer's JSON beside a ranks file."""
    with open(os.path.splitext(path)[0] + ".json", encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[x] for t in tokens for x in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"added tokens of {path} that take in or need what stands beside them")
    return {t["content"]: t["id"] for t in tokens}


def _encoder(path: str | None, added: bool = False) -> Encoder:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, public_tokenizers.PATTERN, _added(path) if added else None)
    return _encoders[path, added]


def _piece_rows(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, added: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, added)
    end_id = np.array([END_ID], "<u4")
    for batch in batches:
        names = batch.column(0).to_pylist()
        for block in arrays.blocks(batch.column(1)):
            ids, bound = encoder.encode(block)
            rows = []
            for i, name in enumerate(names[block.lo:block.hi]):
                own = np.concatenate([ids[bound[i]:bound[i + 1]].astype("<u4"), end_id])
                lo, piece = 0, 0
                hi = len(own) % capacity or min(capacity, len(own))
                while lo < len(own):
                    rows.append((name, piece, lo, hi - lo, zlib.crc32(own[lo:hi])))
                    lo, hi, piece = hi, hi + capacity, piece + 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           tokenizer: str | None = None, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and then id 2; a null text is empty, so every row has a piece.
    A document above the capacity is cut so that only its first piece is shorter. Repeated rows and
    ids give repeated pieces. tokenizer: a file of ranks, at the same place on every executor; by
    default that of the vocabulary byte_bpe_50k in the public_tokenizers module. added: added tokens of the JSON
    beside it (<|endoftext|>) that stand in a text are their one id, as the `tokenizers` library reads them; the query
    does so. Without it they are text like any other (the library's encode_special_tokens).
    """
    run = partial(_piece_rows, path=tokenizer, capacity=capacity, added=added)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items longest first, each into the fullest bin that has room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r exists
    for i in order:
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        by_room[room - size].append(k)
        rooms |= 1 << (room - size)
    return bins


def _round(batches: Iterator[pa.RecordBatch], capacity: int, spare: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Best fit over a task's items; root < 0 marks sequences that go up."""
    batches = list(batches)
    items = [x for b in batches for x in b.column("pieces").to_pylist()]
    if not items:
        return
    key = lambda p: (p["doc_id"] is None, p["doc_id"] or 0, p["piece"], p["start"], p["ids_crc32"])
    items.sort(key=lambda x: key(x[0]))  # the same bins however the shuffle orders the rows
    filled = [sum(p["length"] for p in x) for x in items]
    out = []
    for members in best_fit(filled, capacity):
        out.append((capacity - sum(filled[i] for i in members), [p for i in members for p in items[i]]))
    sent = set() if last else {k for k, (room, _) in enumerate(out) if room > spare}
    typed = next(b for b in batches if b.num_rows).column("pieces").type
    for lo in range(0, len(out), 2000):
        part = out[lo:lo + 2000]
        yield pa.record_batch([
            pa.array([-1 if lo + k in sent else 0 for k in range(len(part))], pa.int64()),
            pa.array([room for room, _ in part], pa.int32()),
            pa.array([x for _, x in part], typed)], names=["root", "free", "pieces"])


def pack(cut: DataFrame, capacity: int = CAPACITY, spare: int = 8, per_task: int = PIECES_PER_TASK,
         items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Every piece of `pieces` with sequence_id and offset.

    Sequences with at most `spare` tokens of room are final in the round that fills them; all others go up and are dealt
    anew, over fewer tasks as they get fewer, until one task is left or hardly any of them fits with another
    (WORTH). Empty input gives no rows; pieces that fill a sequence are one alone.
    """
    cut = cut.select(F.struct("doc_id", "piece", "start", "length", "ids_crc32").alias("p"))
    full = cut.where(F.col("p.length") >= capacity).select(F.array("p").alias("pieces"))
    tasks = tasks_for(cut.count(), per_task)
    items = cut.where(F.col("p.length") < capacity) \
        .select(F.pmod(F.xxhash64("p.doc_id", "p.piece"), F.lit(tasks)).cast("int").alias("task"), F.array("p").alias("pieces"))
    done, left, turn = [full], None, 0
    while True:
        run = partial(_round, capacity=capacity, spare=spare, last=tasks == 1)
        made = keep(items.repartition(tasks, "task").select("task", "pieces").mapInArrow(
            partial(_by_task, run=run), f"task int, {SEQUENCE}"))
        done.append(made.where("root = 0").select("pieces"))
        if tasks == 1:
            break
        up = made.where("root < 0")
        n = up.count()
        if left is not None and n > WORTH * left:
            done.append(up.select("pieces"))
            break
        left, turn, tasks = n, turn + 1, min(tasks, tasks_for(n, items_per_task))
        first = F.get("pieces", F.lit(0))
        items = up.select(F.pmod(F.xxhash64(F.lit(turn), first["doc_id"], first["piece"], first["start"], first["ids_crc32"]), F.lit(tasks))
                          .cast("int").alias("task"), "pieces")
    final = done[0]
    for x in done[1:]:
        final = final.unionByName(x)
    numbered = final.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    opened = numbered.select("sequence_id", "pieces", F.posexplode("pieces").alias("k", "p"))
    before = F.aggregate(F.slice("pieces", 1, F.col("k")), F.lit(0).cast("long"), lambda acc, p: acc + p["length"])
    return opened.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id",
                         before.alias("offset"))


def _by_task(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    """A partition may hold several tasks' items; each task is packed by itself."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        task = batch.column(0).to_numpy()
        for t in np.unique(task):
            part = batch.filter(pa.array(task == t))
            held.setdefault(int(t), []).append(part)
    for t in sorted(held):
        for out in run(iter(held[t])):
            yield pa.record_batch([pa.array(np.full(out.num_rows, t, np.int32)), *out.columns],
                                  names=["task", *out.schema.names])


def sequences(docs: DataFrame, placed: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              tokenizer: str | None = None, added: bool = False) -> DataFrame:
    """The packed sequences with their ids: sequence_id, ids array<int>, doc_ids (one per piece).

    Ids are made anew from the texts, document by document, and sorted into place; doc_id must be unique.
    tokenizer and added as for the pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, added)
        for batch in batches:
            for block in arrays.blocks(batch.column(1)):
                ids, bound = encoder.encode(block)
                yield pa.record_batch([
                    batch.column(0).slice(block.lo, block.hi - block.lo),
                    pa.array([[*ids[a:b].tolist(), END_ID] for a, b in zip(bound[:-1], bound[1:])], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    coded = texts.mapInArrow(run, "doc_id long, ids array<int>")
    parts = placed.join(coded, "doc_id").select(
        "sequence_id", F.struct("offset", "doc_id", F.expr("slice(ids, int(start + 1), int(length))").alias("ids")).alias("x"))
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ordered.select("sequence_id", F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"),
                          F.transform("x", lambda x: x["doc_id"]).alias("doc_ids"))


def packed(docs: DataFrame, **options) -> DataFrame:
    """Pieces of docs with their places."""
    return pack(keep(pieces(docs, **options)))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), added=True)

"""Chats as training text: a prefix tree of conversations, each shared turn once, depth first.

A turn becomes `<|im_start|>role<|im_sep|>text<|im_end|>`; control strings inside roles and texts are escaped, so a text
can be read back whatever it holds. Conversations that begin with the same turns share the nodes of a prefix
tree. A node is known by the digest of its path, so equal beginnings meet by key, wherever they lie.

Order without walking the tree: conversations sorted by their paths stand in depth-first order, and the first of them that has a
node owns it. A conversation's own nodes are a run of the stream, without a gap; the rest of its path lies in earlier runs, one
interval of each. So a node attends to the intervals of its run's ancestors and to its run up to itself,
and its position ids go on where its parent's end. All of it is sorts, sums and equality joins.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, table

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that steer a model: those of this template and those of common others.
CONTROL = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
LEARNED = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.DOTALL)

NODE = "node binary, parent binary, depth int"


def escaped(text: str) -> str:
    """Backslashes doubled, and one put after the first character of every control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation; anything beside whole turns is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


@lru_cache(4)
def _tokenizer(path: str | None):
    """The encoder of a ranks file, and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return one.encode_ordinary, {i: b for b, i in ranks.items()}


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place: adds each row's depth and the digests of its path and its parent's."""
    now, parent, depth = None, b"", 0
    for batch in batches:
        node, above, depths = [], [], []
        for conv, d in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if depth == 0 or conv != now:
                now, parent, depth = conv, b"", 0
            here = hashlib.sha256(parent + d).digest()[:16]
            node.append(here)
            above.append(parent or None)
            depths.append(depth := depth + 1)
            parent = here
        yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(node, pa.binary()), pa.array(above, pa.binary()),
                               pa.array(depths, pa.int32())], names=["conv", "role", "text", "node", "parent", "depth"])


def _tokenised(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """Each node's ids, where its text lies in them, and its place among the nodes of its task."""
    encode, _ = _tokenizer(path)
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = []
        for role, said in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            head, body, tail = encode(START + escaped(role) + MIDDLE), encode(escaped(said)), encode(END)
            rows.append((head + body + tail, len(head), len(head) + len(body), total))
            total += len(rows[-1][0])
        ids, lo, hi, before = zip(*rows) if rows else ([], [], [], [])
        yield pa.record_batch([
            *(batch.column(i) for i in range(5)), pa.array(ids, pa.list_(pa.int32())), pa.array(lo, pa.int32()),
            pa.array(hi, pa.int32()), pa.array(before, pa.int64()), pa.array([part] * len(rows), pa.int32())],
            names=["node", "parent", "depth", "owner", "role", "ids", "text_from", "text_to", "before", "part"])


def prefix_tree(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                text_column: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tree's nodes and the conversations' paths.

    Nodes: node, parent (null: a root), depth (from 1), owner (the run it stands in), role, ids, text_from, text_to (the text's
    ids among them), learned (an assistant's text is under the loss mask), start (its place in the stream), position (its
    first position id), attends (array of <lo, hi> in the stream: all it sees before itself, in order). Paths:
    conv, depth, node.

    A conversation is read by turn, nulls first, then role and text. Null roles and texts are empty ones, a null conversation is one of
    its own, repeated rows are turns like any other, a very long text is one node, and an empty table gives empty ones.
    Equal conversations share all nodes. One task reads a conversation's rows in order, in constant memory;
    its path (16 bytes a turn) is one value. Other columns are not read.
    """
    role, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = conversations.select(F.col(conv_column).cast("long").alias("conv"), role.alias("role"), said.alias("text"),
                                F.col(turn_column).cast("long").alias("turn"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    chained = keep(rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
                   .select("conv", "role", "text", digest.alias("d"))
                   .mapInArrow(_chained, f"conv long, role string, text string, {NODE}"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda e: e["node"])
    sorted_paths = chained.groupBy("conv").agg(path.alias("path")).repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    ranked = keep(sorted_paths.select("conv", "path", F.monotonically_increasing_id().alias("rank")))
    paths = keep(ranked.select("conv", "rank", F.posexplode("path").alias("i", "node"))
                 .select("conv", "rank", (F.col("i") + 1).alias("depth"), "node"))
    # of a node's bearers the first in order owns it; its row is taken from there
    mine = paths.groupBy("node").agg(F.min(F.struct("rank", "conv", "depth")).alias("own")) \
        .select(F.col("own.conv").alias("of"), F.col("own.depth").alias("at"), F.col("own.rank").alias("owner"))
    # a path's rows are told apart by conversation and depth; null conversations are one
    rows = chained.join(mine, F.col("conv").eqNullSafe(F.col("of")) & (F.col("depth") == F.col("at")))
    laid = keep(rows.select("node", "parent", "depth", "owner", "role", "text")
                .repartitionByRange("owner", "depth").sortWithinPartitions("owner", "depth")
                .mapInArrow(partial(_tokenised, path=tokenizer), f"{NODE}, owner long, role string, ids array<int>, text_from int, "
                                                                 "text_to int, before long, part int"))
    # one row a task of the write: its tokens, summed in order
    size = laid.groupBy("part").agg(F.sum(F.size("ids")).alias("n"))
    offset = size.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    placed = laid.join(offset, "part").withColumn("start", F.col("offset") + F.col("before"))
    narrow = keep(placed.select("node", "owner", "start", F.size("ids").alias("n")))
    # each conversation's part of every run on its path: one interval
    seen = paths.join(narrow, "node").groupBy("rank", "owner").agg(
        F.min("start").alias("lo"), F.max(F.col("start") + F.col("n")).alias("hi"))
    runs = seen.groupBy("rank").agg(
        F.min(F.when(F.col("owner") == F.col("rank"), F.col("lo"))).alias("run"),
        F.array_sort(F.collect_list(F.when(F.col("owner") != F.col("rank"), F.struct("lo", "hi")))).alias("above")) \
        .where("run IS NOT NULL").withColumnRenamed("rank", "owner")
    longs = F.coalesce(F.aggregate("above", F.lit(0).cast("long"), lambda acc, x: acc + x["hi"] - x["lo"]), F.lit(0).cast("long"))
    own = F.when(F.col("start") > F.col("run"), F.array(F.struct(F.col("run").alias("lo"), F.col("start").alias("hi")))) \
        .otherwise(F.array().cast("array<struct<lo: bigint, hi: bigint>>"))
    nodes = placed.join(keep(runs.select("owner", "run", "above", longs.alias("base"))), "owner").select(
        "node", "parent", "depth", "owner", "role", "ids", "text_from", "text_to", (F.col("role") == LEARNED).alias("learned"), "start",
        (F.col("base") + F.col("start") - F.col("run")).alias("position"), F.concat("above", own).alias("attends"))
    return nodes, paths.select("conv", "depth", "node")


def _read_back(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by conversation and depth: what a conversation reads, from their ids alone."""
    _, spelled = _tokenizer(path)
    now, done = None, []

    def finished() -> None:
        done.append((now["conv"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

    def batch_of() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)],
                              names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return out

    def spell(ids: list[int]) -> str:
        return b"".join([spelled[i] for i in ids]).decode()

    for batch in batches:
        for conv, depth, ids, lo, hi, learned in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if depth == 1:
                if now is not None:
                    finished()
                now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            formatted = spell(ids)
            [(role, said)] = parsed(formatted)
            now["n"] += 1
            now["chars"] += len(formatted)
            now["turns"].update(f"{role}\n{said}\n".encode())
            if learned:
                loss = unescaped(spell(ids[lo:hi]))
                now["loss_chars"] += len(loss)
                now["loss"].update(loss.encode())
        if len(done) >= 10_000:
            yield batch_of()
    if now is not None:
        finished()
    if done:
        yield batch_of()


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, out of the nodes' ids."""
    full = paths.join(nodes.select("node", "ids", "text_from", "text_to", "learned"), "node")
    return full.repartition("conv").sortWithinPartitions("conv", "depth").select(
        "conv", "depth", "ids", "text_from", "text_to", "learned").mapInArrow(
        partial(_read_back, path=tokenizer),
        "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    nodes, paths = prefix_tree(c.unionByName(more))
    return read_back(keep(nodes), paths).withColumnRenamed("conv", "conv_id")


def _escaped_sql(column: str) -> str:
    """`escaped` in SQL: no control string is part of another, nor overlaps one, so one after the other does."""
    out = rf"replace({column}, '\', '\\')"
    for c in CONTROL:
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations
   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({len(START + MIDDLE + END)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

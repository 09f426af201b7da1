"""Repair of conversations: cheapest edits that give a lawful order of roles.

Every row becomes a symbol, its role's initial with its fault, and a conversation a short string of them. Re-Pair
makes a grammar of all distinct strings: in each round the most frequent pairs of neighbours become
rules. A symbol has a min-plus matrix over the states of the role order: cheapest cost and audit (a rope) from state to
state. A rule's matrix is the product of its two parts', so rules are worked out once, bottom-up, and shared by every
conversation; a conversation multiplies the few matrices of its compressed string.

Texts are sorted once by conversation and place, over ranges, so one conversation may lie in many tasks. They come back for the
repaired text's digest only, which is one pass over a conversation's rows in constant memory.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, table

#: Costs of edits; an undeleted truncated row adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
#: Rules at most, rounds at most, pairs made rules in a round at most, and how often a pair must stand to become one.
RULES, ROUNDS, AT_ONCE, OFTEN = 600, 12, 100, 8
#: Symbols of a rule's string at most, so that its ropes stay short.
LENGTH = 4096
#: Rows of a conversation gathered at once.
SEGMENT = 4096

ROLES, FAULTS = "suao", "kbdt"
#: States: nothing yet, after s, after u, after a. What may follow, and where a conversation may end.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)


def symbol(role: str, fault: str) -> int:
    return ROLES.index(role) * len(FAULTS) + FAULTS.index(fault)


# ropes: a string, or (left, right, length)

def _length(rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[2]


def join(a, b):
    """Both ropes after one another; short ones become one string."""
    if not _length(a):
        return b
    if not _length(b):
        return a
    n = _length(a) + _length(b)
    return text(a) + text(b) if n <= 64 else (a, b, n)


def _leaves(rope) -> Iterator[str]:
    todo = [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += [x[1], x[0]]


def text(rope) -> str:
    return rope if isinstance(rope, str) else "".join(_leaves(rope))


def before(a, b) -> bool:
    """Whether rope a comes before b, by its characters."""
    if a is b:
        return False
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right = _leaves(a), _leaves(b)
    x, y = next(left, ""), next(right, "")
    while x and y:
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:] or next(left, ""), y[n:] or next(right, "")
    return not x and bool(y)


def better(a, b) -> bool:
    """Cheaper, or as cheap with the smaller audit; None is no way at all."""
    if a is None or b is None:
        return b is None and a is not None
    return a[0] < b[0] or (a[0] == b[0] and before(a[1], b[1]))


def times(a: list[list], b: list[list]) -> list[list]:
    """Min-plus product of two matrices of (cost, rope)."""
    out = []
    for row in a:
        line = []
        for j in range(len(b[0])):
            best = None
            for x, other in zip(row, b):
                if x is not None and other[j] is not None and (best is None or x[0] + other[j][0] <= best[0]):
                    way = (x[0] + other[j][0], join(x[1], other[j][1]))
                    if better(way, best):
                        best = way
            line.append(best)
        out.append(line)
    return out


def inserts() -> list[list]:
    """Rows put in between: none, one or two (more lead back to a state already passed)."""
    m = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    one = [[None] * 4 for _ in range(4)]
    for i, after in NEXT.items():
        for role, j in after.items():
            if role != "s":
                one[i][j] = (INSERT, "I")
    for way in (one, times(one, one)):
        for i in range(4):
            for j in range(4):
                if better(way[i][j], m[i][j]):
                    m[i][j] = way[i][j]
    return m


def matrix(role: str, fault: str) -> list[list]:
    """Inserts before a row, then the row: kept, given another role, or deleted."""
    m = [[None] * 4 for _ in range(4)]
    for i, after in NEXT.items():
        ways = [(i, (DELETE, "D"))]
        if fault in "kt":
            extra = TRUNCATED if fault == "t" else 0
            ways += [(j, (KEEP + extra, "K") if r == role else (REROLE + extra, "R")) for r, j in after.items()
                     if r == role or r != "s"]
        for j, way in ways:
            if better(way, m[i][j]):
                m[i][j] = way
    return times(inserts(), m)


class Grammar:
    """Rules in rounds and the matrix of every symbol; the same for all conversations."""

    def __init__(self, rounds: list[list[tuple[int, int, int]]]):
        self.rounds = [{(a, b): new for a, b, new in r} for r in rounds]
        self.matrix = {symbol(r, f): matrix(r, f) for r in ROLES for f in FAULTS}
        for r in rounds:
            for a, b, new in r:
                self.matrix[new] = times(self.matrix[a], self.matrix[b])
        self.last = inserts()
        self._short = lru_cache(100_000)(self._repaired)

    def repaired(self, letters: str) -> tuple[int, str]:
        """Cost and audit of a string of row symbols; short strings are remembered."""
        return self._short(letters) if len(letters) <= 64 else self._repaired(letters)

    def _repaired(self, letters: str) -> tuple[int, str]:
        row, settled = [[(0, ""), None, None, None]], []
        for n, x in enumerate(compressed([ord(c) - 65 for c in letters], self.rounds), 1):
            row = times(row, self.matrix[x])
            if n % 64 == 0:  # what all ways begin with is settled and no longer compared
                ways = [x and (x[0], text(x[1])) for x in row[0]]
                same = os.path.commonprefix([x[1] for x in ways if x])
                settled.append(same)
                row = [[x and (x[0], x[1][len(same):]) for x in ways]]
        row = times(row, self.last)[0]
        best = None
        for i in ENDS:
            if better(row[i], best):
                best = row[i]
        return best[0], "".join(settled) + text(best[1])


def replaced(symbols: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """Pairs that have a rule become its symbol, from the left."""
    out, i, n = [], 0, len(symbols)
    while i < n:
        new = rules.get((symbols[i], symbols[i + 1])) if i + 1 < n else None
        out.append(symbols[i] if new is None else new)
        i += 1 if new is None else 2
    return out


def compressed(symbols: list[int], rounds: list[dict[tuple[int, int], int]]) -> list[int]:
    for rules in rounds:
        if len(symbols) < 2:
            break
        symbols = replaced(symbols, rules)
    return symbols


_grammars: dict[tuple, Grammar] = {}


def _grammar(rounds: tuple) -> Grammar:
    """A worker works out a grammar's matrices once."""
    if rounds not in _grammars:
        _grammars.clear()
        _grammars[rounds] = Grammar([list(r) for r in rounds])
    return _grammars[rounds]


def _round(batches: Iterator[pa.RecordBatch], rules: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [replaced(x, rules) for x in batch.column(0).to_pylist()]
        yield pa.record_batch([pa.array(done, pa.list_(pa.int32())), batch.column(1)], names=["symbols", "n"])


def _letters(column: str) -> Column:
    return F.filter(F.split(column, ""), lambda c: c != "")


def grammar(strings: DataFrame, rules: int = RULES, rounds: int = ROUNDS, at_once: int = AT_ONCE, often: int = OFTEN) -> tuple:
    """Re-Pair over all strings (column `letters`): rounds of (left, right, new symbol).

    A string counts once for every conversation that has it. In a round the most frequent pairs become rules, none of which begins
    with a symbol another one ends with, so their places cannot overlap. Only pair counts, at most `at_once` a round, come to the
    driver. Bounds on rules and rounds bound the grammar, not the strings: what has no rule stays as it is.
    """
    work = keep(strings.groupBy("letters").agg(F.count(F.lit(1)).alias("n")).where(F.length("letters") > 1).select(
        F.transform(_letters("letters"), lambda c: F.ascii(c) - 65).alias("symbols"), "n"))
    length = dict.fromkeys(range(len(ROLES) * len(FAULTS)), 1)
    made, new = [], len(length)
    while len(made) < rounds and new < rules:
        two = F.transform(F.sequence(F.lit(0), F.size("symbols") - 2), lambda i: F.struct(
            F.get("symbols", i).alias("a"), F.get("symbols", i + 1).alias("b")))
        pairs = work.where(F.size("symbols") > 1).select(F.explode(two).alias("p"), "n").groupBy("p.a", "p.b").agg(
            F.sum("n").alias("n")).where(F.col("n") >= often).orderBy(F.desc("n"), "a", "b").limit(at_once).collect()
        begin, end, chosen = set(), set(), []
        for p in pairs:
            alone = p.a == p.b and p.a not in begin | end
            if (alone or (p.a != p.b and p.a not in end and p.b not in begin and not {p.a, p.b} & {a for a, b, _ in chosen if a == b})) \
                    and length[p.a] + length[p.b] <= LENGTH and new < rules:
                chosen.append((p.a, p.b, new))
                begin.add(p.a)
                end.add(p.b)
                length[new] = length[p.a] + length[p.b]
                new += 1
        if not chosen:
            break
        made.append(tuple(chosen))
        lookup = {(a, b): x for a, b, x in chosen}
        work = keep(work.mapInArrow(partial(_round, rules=lookup), "symbols array<int>, n long").where(F.size("symbols") > 1))
    return tuple(made)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: what the query does to rows before they are repaired (copies 0: dropped)."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    c = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                             some("role").alias("role"), some("text").alias("text"),
                             (F.crc32(F.concat_ws(":", some("conv_id"), some("turn"))) % 20).alias("hit"))
    return c.select("conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _illegal(letters: str) -> int:
    """Neighbours whose roles' initials are not su, ua or au."""
    roles = [ROLES[(ord(c) - 65) // len(FAULTS)] for c in letters]
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:]))


def _repairs(batches: Iterator[pa.RecordBatch], rounds: tuple) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of each conversation's string."""
    g = _grammar(rounds)
    for batch in batches:
        letters = batch.column(1).to_pylist()
        faults = [[FAULTS[(ord(c) - 65) % len(FAULTS)] for c in x] for x in letters]
        done = [g.repaired(x) for x in letters]
        yield pa.record_batch([
            batch.column(0), *(pa.array([x.count(f) for x in faults], pa.int64()) for f in "bdt"),
            pa.array([_illegal(x) for x in letters], pa.int64()),
            pa.array([c for c, _ in done], pa.int64()), pa.array([a for _, a in done], pa.string()), batch.column(2)],
            names=["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "gaps"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with an audit, then the conversation's rows in order; gives the digest of the repaired ones."""
    fields = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "gaps"]
    types = [pa.int64()] * 6 + [pa.string(), pa.int64()]
    now, done = None, []

    def put(role: str, said: str) -> None:
        if now["parts"]:
            now["sha"].update(b"\n")
        now["sha"].update(f"{role}:{said}".encode())
        now["state"] = NEXT[now["state"]][role[0]]
        now["parts"] += 1

    def wanted() -> str:
        return "assistant" if now["state"] == 2 else "user"

    def added() -> None:
        """Rows the audit puts in here."""
        audit = now["audit"]
        while now["at"] < len(audit) and audit[now["at"]] == "I":
            put(wanted(), "")
            now["at"] += 1

    def finished() -> None:
        added()
        done.append([*(now[f] for f in fields), now["sha"].hexdigest()])

    def batch_of() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), [*types, pa.string()])], names=[*fields, "repaired_sha256"])
        done.clear()
        return out

    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for i, place in enumerate(columns["pos"]):
            if place < 0:
                if now is not None:
                    finished()
                now = {f: columns[f][i] for f in fields} | {"sha": hashlib.sha256(), "state": 0, "at": 0, "parts": 0}
                continue
            added()
            edit = now["audit"][now["at"]]
            now["at"] += 1
            if edit != "D":
                put(columns["role"][i] if edit == "K" else wanted(), columns["text"][i])
        if len(done) >= 10_000:
            yield batch_of()
    if now is not None:
        finished()
    if done:
        yield batch_of()


def repaired(rows: DataFrame, **bounds) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv, turn, role, text and copies (0: the row is gone, its conversation is still returned). A conversation is
    read by turn, nulls first, then role and text. Its rows' first faults count: blank, duplicate (same role and text
    before), truncated (last character outside white space not one of .!?). Edits: Keep, Rerole, Delete, Insert; the cheapest
    audit, the smallest by its characters among equal ones, gives roles' initials `(s?(ua)+)?`; an empty role has none and is never kept. Texts are kept as they are; a digest
    is that of `role:text`, newline-joined. Null roles and texts are empty ones; a null conversation is one of its own; an empty table gives
    no rows. Very long texts are one row each; repeated rows are duplicates. A conversation of very many rows is sorted and matched in
    parts; its string and audit (a letter a row) are one value, and its digest is made by one task, row by row. Other columns are not read.
    """
    r = rows.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "copies")
    there = r.where("copies > 0").select(
        "conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        F.monotonically_increasing_id().alias("row"))  # equal rows change places freely: only spreads them over ranges
    placed = there.repartitionByRange("conv", "turn", "role", "text", "row", "copy") \
        .sortWithinPartitions("conv", "turn", "role", "text", "row", "copy") \
        .select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"),
                F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key"))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    last = F.substring(end, -1, 1)
    placed = keep(placed.withColumn("own", F.when(end == "", "b").when(last.isin(".", "!", "?"), "k").otherwise("t")))
    # the first of equal rows is found by a sum of firsts and joined by its place, which no two rows share
    first = placed.groupBy("conv", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("own") == "b", "b").when(F.col("first").isNull(), "d").otherwise(F.col("own"))
    code = sum((F.when(_initial(F.col("role")) == x, i * len(FAULTS)).otherwise(0) for i, x in enumerate(ROLES)), F.lit(65)) + \
        sum((F.when(fault == x, i).otherwise(0) for i, x in enumerate(FAULTS)), F.lit(0))
    lettered = placed.select("conv", "pos", "role", "own").join(first, "pos", "left").select("conv", "pos", F.char(code).alias("letter"))
    line = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "letter"))), lambda e: e["letter"]), "")
    part = F.expr(f"pos div {SEGMENT}")
    segments = lettered.groupBy("conv", part.alias("part")).agg(line("pos").alias("letter"))
    alive = F.when(F.col("copies") > 0, F.col("turn"))
    turns = r.select("conv", alive.alias("turn")).distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    strings = keep(segments.select("conv", "part", "letter", F.lit(None).cast("long").alias("gaps")).unionByName(
        turns.select("conv", F.lit(None).cast("long").alias("part"), F.lit(None).cast("string").alias("letter"), "gaps"))
        .groupBy("conv").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "letter")))),
                                     lambda e: e["letter"]), "").alias("letters"), F.max("gaps").alias("gaps")))
    rounds = grammar(strings.select("letters"), **bounds)
    found = strings.select("conv", "letters", "gaps").mapInArrow(
        partial(_repairs, rounds=rounds),
        "conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, gaps long")
    head = found.withColumn("pos", F.lit(-1).cast("long"))
    both = head.unionByName(placed.select("conv", "pos", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(
        _digests, "conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, gaps long, "
                  "repaired_sha256 string")


def repairs(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
            text_column: str = "text", **bounds) -> DataFrame:
    """`repaired` for conversations as they are, without damage."""
    c = conversations.select(F.col(conv_column).cast("long").alias("conv"), F.col(turn_column).cast("long").alias("turn"),
                             F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text"),
                             F.lit(1).alias("copies"))
    return repaired(c, **bounds).withColumnRenamed("conv", conv_column)


def edited_rows(conversations: DataFrame, found: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
                role_column: str = "role", text_column: str = "text") -> DataFrame:
    """The repaired conversations themselves: conv, place (from 0), role, text, edit.

    found: the audits of `repairs`. A conversation's rows are numbered in order and meet the edits that take a row; the roles
    of inserted and changed rows follow from their place, for users and assistants alternate after a first system row.
    """
    c = conversations.select(F.col(conv_column).cast("long").alias("conv"), F.col(turn_column).cast("long").alias("turn"),
                             F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = c.select(F.col("conv").alias("of"), F.row_number().over(order).alias("nth"), "role", "text")
    steps = Window.partitionBy("conv").orderBy("step")
    edits = found.select(F.col(conv_column).alias("conv"), F.posexplode(_letters("audit")).alias("step", "edit"))
    taken = F.sum(F.when(F.col("edit") == "I", 0).otherwise(1)).over(steps)
    edits = edits.select("*", F.when(F.col("edit") != "I", taken).alias("takes")).where("edit <> 'D'")
    rows = edits.join(numbered, F.col("conv").eqNullSafe(F.col("of")) & (F.col("takes") == F.col("nth")), "left")
    system = F.first((F.col("edit") == "K") & F.col("role").startswith("s")).over(steps)
    placed = rows.select("conv", "edit", "role", "text", (F.row_number().over(steps) - 1).alias("place"), system.alias("system"))
    user = (F.col("place") - F.col("system").cast("int")) % 2 == 0
    role = F.when(F.col("edit") == "K", F.col("role")).when(user, "user").otherwise("assistant")
    said = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return placed.select(F.col("conv").alias(conv_column), "place", role.alias("role"), said.alias("text"), "edit")


def op11_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(damaged(table(spark, sf_dir, "conversations")))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        "repaired_sha256")

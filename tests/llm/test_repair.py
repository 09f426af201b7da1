import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from countweave.llm import repair

WHITE = " \t\n\x0b\x0c\r"
LAWFUL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """The first fault of each (role, text), by reading: b, d, t or k."""
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(WHITE)
        out.append("b" if not end else "d" if (role, text) in seen else "k" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired rows by trying every sequence of edits that costs no more than deleting all."""
    fault = faults(rows)
    best = None

    def go(i, cost, audit, done):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        roles = "".join(r[:1] or "-" for r, _ in done)  # no role is no lawful role
        if not re.match(r"s?(ua)*u?\Z", roles):
            return
        if i == len(rows) and LAWFUL.match(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, done)
        if not audit.endswith("II"):
            for r in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*done, (r, "")])
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, cost + 3, audit + "D", done)
            if fault[i] in "kt":
                more = fault[i] == "t"
                go(i + 1, cost + more, audit + "K", [*done, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*done, (r, text)])

    best = (3 * len(rows), "D" * len(rows), [])
    go(0, 0, "", [])
    return best


def row_of(rows, turns):
    """The query's columns of one conversation."""
    fault = faults(rows)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, done = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in done)
    return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    """(conv, turn, role, text) rows after the query's damage, by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out.setdefault(conv, []).extend([(turn is not None, turn or 0, "user" if hit == 4 else role, text, turn)] * (0 if hit == 0 else 2 if hit == 3 else 1))
    return {c: sorted(v, key=lambda x: x[:4]) for c, v in out.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(seed, n, longest=6):
    rnd = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "tool", "", "s", "User", None]
    texts = ["Yes.", "No", "", " \n", "Why? ", "ok\x0b", "é!", "a.b", None, "Yes."]
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rnd.integers(1, longest)):
            turn += int(rnd.choice([0, 1, 1, 1, 3]))
            rows.append((c, None if rnd.random() < 0.05 else turn, str(r) if (r := rnd.choice(roles[:4] * 3 + roles[4:])) is not None else None,
                         str(t) if (t := rnd.choice(texts)) is not None else None))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"often": 2, "at_once": 5, "rounds": 4}, {"rules": 0}])
def test_query_against_all_edits(spark, tmp_path, bounds):
    rows = conversations(2, 250) + [(None, 1, "user", "Hm."), (None, None, "assistant", "So."), (-5, None, None, None)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int").write.parquet(path)
    read = spark.read.parquet(path)
    got = repair.repaired(repair.damaged(read), **bounds).collect()
    want = {c: row_of([x[2:4] for x in v], [x[4] for x in v]) for c, v in damaged(rows).items()}
    assert {r.conv: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert len(got) == len(want) == len({r[0] for r in rows})
    if not bounds:
        assert repair.op11_conversation_structure_repair(spark, str(tmp_path)).count() == len(want)


def test_every_short_string():
    """All strings of up to three symbols against all edits, through matrices alone."""
    g = repair.Grammar([])
    said = {"k": "Yes.", "t": "No"}
    for n in range(4):
        for kinds in itertools.product(itertools.product("suao", "kbt"), repeat=n):
            rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[r], "" if f == "b" else said[f] + " " * i)
                    for i, (r, f) in enumerate(kinds)]
            rows = [(r, t if f == "b" else t[:-1 - i] + str(i) + t[-1 - i:] if f == "k" else t + str(i)) for i, ((r, t), (_, f)) in enumerate(zip(rows, kinds))]
            letters = "".join(chr(65 + repair.symbol(r, f)) for r, f in kinds)
            assert g.repaired(letters) == cheapest(rows)[:2], kinds


def test_rules_change_nothing(spark):
    """Long strings give the same cost and audit with a grammar and without; runs of one symbol too."""
    rnd = np.random.default_rng(8)
    symbols = [chr(65 + repair.symbol(r, f)) for r in "uaso" for f in "ktbd"]
    odds = np.array([8, 2, 1, 1] * 2 + [1] * 8, float)
    strings = ["".join(rnd.choice(symbols, rnd.integers(1, 700), p=odds / odds.sum())) for _ in range(60)]
    strings += [symbols[0] * 999, (symbols[0] + symbols[4]) * 500, symbols[3] * 300]
    rounds = repair.grammar(spark.createDataFrame([(x,) for x in strings], "letters string"), often=3)
    assert len(rounds) > 3
    plain, with_rules = repair.Grammar([]), repair.Grammar([list(r) for r in rounds])
    for x in strings:
        assert with_rules.repaired(x) == plain.repaired(x)
        assert len(repair.compressed([ord(c) - 65 for c in x], with_rules.rounds)) <= len(x) / 2 or len(x) < 50


def test_repaired_rows(spark):
    rows = conversations(4, 120)
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repairs(c)
    digests = {}
    for r in sorted(repair.edited_rows(c, found).collect(), key=lambda r: (r.conv_id, r.place)):
        digests.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(digests.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repairs(empty).collect() == []
    long = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * 20_000 + f"{i}.") for i in range(30)]
    long += [(2, i, "user" if i % 3 else "assistant", f"{i}.") for i in range(9000)]
    got = {r.conv_id: r for r in repair.repairs(spark.createDataFrame(long, empty.schema)).collect()}
    assert (got[1].cost, got[1].audit) == (0, "K" * 30)
    text = "\n".join(f"{r}:{t}" for c, _, r, t in long if c == 1)
    assert got[1].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[2].illegal == sum(1 for i in range(8999) if not (i % 3 == 0 or (i + 1) % 3 == 0)) and got[2].cost > 0

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from countweave.llm import mixing

ROWS = [(i, "w " * (i % 7), "abc"[i % 3], f"s{i % 5}") for i in range(200)] + \
       [(500, None, None, "s1"), (None, "a b", "a", None), (3, "w w w", "a", "s3"), (3, "w w w", "a", "s3")]
LEVELS = ("lang", "source")
WEIGHTS = {"a": 3, "b": 0, "a/s1": 9, "c/s2": 4}


def water(children, budget):
    """children: name -> (weight, capacity)."""
    live = sorted((c for c in children if children[c][0] > 0), key=lambda c: (children[c][1] / children[c][0], c))
    out, left, weight = {c: 0 for c in children}, budget, sum(children[c][0] for c in live)
    for k, c in enumerate(live):
        w, cap = children[c]
        if cap * weight <= left * w:
            out[c], left, weight = cap, left - cap, weight - w
        else:
            for x in live[k:]:
                out[x] = left * children[x][0] // weight
            break
    return out


def brute(rows, share, epochs, seed):
    tok = [(i, len((t or "").split()), lang or "", s or "", k) for k, (i, t, lang, s) in enumerate(rows)]
    supply = defaultdict(int)
    for _, n, lang, s, _ in tok:
        supply[lang, s] += n
    top = water({x: (WEIGHTS.get(x, 1), epochs * sum(v for k, v in supply.items() if k[0] == x)) for x in {k[0] for k in supply}},
                int(sum(supply.values()) * share))
    out = []
    for x in top:
        leaves = water({s: (WEIGHTS.get(f"{x}/{s}", 1), epochs * v) for (a, s), v in supply.items() if a == x}, top[x])
        for s, b in leaves.items():
            full = b // supply[x, s] if supply[x, s] else 0
            rest, seen = b - full * supply[x, s], 0
            key = lambda r: (hashlib.md5(f"{seed}:{full}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[4])
            for i, n, *_ in sorted((r for r in tok if r[2:4] == (x, s)), key=key):
                seen += n
                out.append((i, n, x, s, full + (seen <= rest)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share,epochs,size", [(0.5, 1, 4096), (0.9, 4, 3), (1.0, 1, 5), (0.0, 2, 4096)])
def test_matches_plain_search(spark, monkeypatch, share, epochs, size):
    monkeypatch.setattr(mixing, "SLICE", size)
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, lang string, source string, copies int, slice string")
    got = mixing.mixed(df, {n: F.col(n) for n in LEVELS}, WEIGHTS, share, epochs, 5).collect()
    assert sorted([(r.id, r.n_tokens, r.lang, r.source, r.copies) for r in got], key=repr) == brute(ROWS, share, epochs, 5)


def test_siblings_take_a_shortage_before_ancestors(spark):
    leaves = spark.createDataFrame([("p", "x", 10, 1), ("p", "y", 1000, 1), ("q", "z", 1000, 1)], "__l0 string, __l1 string, supply long, n_docs long")
    got = {r["__l1"]: r.share for r in mixing.leaf_budgets(leaves, ["__l0", "__l1"], {}, F.lit(400), 1).collect()}
    assert got == {"x": 10, "y": 190, "z": 200}


def test_take_and_empty(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS[:200]], "doc_id long, text string, lang string, source string, __l0 int")
    out = mixing.take(df, levels={n: F.col(n) for n in LEVELS}, weights={}, budget_share=1.5, max_epochs=2)
    assert out.columns == df.columns and out.groupBy("doc_id").count().where("count > 2").isEmpty()
    assert mixing.take(df.limit(0), levels={n: F.col(n) for n in LEVELS}, weights={}).collect() == []

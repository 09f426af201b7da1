import random

import pytest
import xxhash

from countweave.llm import simhash


def brute(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    s = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1 if w else 0))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    ids = [(i, brute(t)) for i, t in rows]
    label = {k: k for k in range(len(ids))}
    for a in range(len(ids)):
        for b in range(a):
            if (ids[a][1] ^ ids[b][1]).bit_count() <= 3:
                x, y = label[a], label[b]
                label = {k: y if v == x else v for k, v in label.items()}
    low = {}
    for k, (i, _) in enumerate(ids):
        if i is not None:
            low[label[k]] = min(low.get(label[k], i), i)
    return sorted([(i, f"{f:016x}", low.get(label[k])) for k, (i, f) in enumerate(ids)], key=repr)


def texts():
    rnd = random.Random(1)
    base = " ".join(rnd.choice("Alpha beta gAmma delta épsilon zeta eta".split()) for _ in range(400))
    rows = [(i, base.replace("zeta", "Zeta", i % 3) + " tail" * (i % 4)) for i in range(8, 30)]
    return rows + [(1, None), (2, ""), (3, "one"), (4, "one"), (5, " one\ttwo "), (6, "a b c"), (7, "É à\n\x0b ü x"),
                   (7, "É à\n\x0b ü x"), (None, "one"), (40, "w " * 30000)]


@pytest.mark.parametrize("split", [1, 4096])
def test_matches_brute_force(spark, split):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, fp string, id int")
    got = [(r.id, f"{r.fp & 0xFFFFFFFFFFFFFFFF:016x}", r.component) for r in simhash.near_duplicates(df, split=split).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_tree_finds_every_link():
    rnd = random.Random(2)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    values = sorted({s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (1 << 64) - 1 for s in seeds for _ in range(6)})
    found = dict(simhash.tree_links(values, 3))
    label = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    assert {v: found.get(v, v) for v in values} == label


def test_shards_are_split_until_they_are_small(spark, monkeypatch):
    """Fingerprints that share 40 bits fall in one shard again and again; no link is lost and no shard stays large."""
    rnd = random.Random(3)
    fixed = rnd.getrandbits(40) << 24
    values = {fixed | rnd.getrandbits(24) for _ in range(1500)}
    values = sorted(values | {v ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 4))) for v in list(values)[:300]})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    monkeypatch.setattr(simhash, "_shard_links", lambda batches: batches)
    seen = simhash.links(df, 64).groupBy("a").agg({"b": "count"}).collect()
    dealt = [r[1] for r in seen]
    assert max(dealt) <= 64 and len(dealt) > 64
    monkeypatch.undo()

    def groups(pairs):
        label = {v: v for v in signed}
        def root(x):
            while label[x] != x:
                x = label[x]
            return x
        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            label[b] = a
        return {v: root(v) for v in signed}

    near = [(signed[i], signed[k]) for i in range(len(values)) for k in range(i) if (values[i] ^ values[k]).bit_count() <= 3]
    assert near and groups((r.a, r.b) for r in simhash.links(df, 64).collect()) == groups(near)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []

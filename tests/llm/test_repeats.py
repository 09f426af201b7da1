import hashlib
import random

import numpy as np
import pytest

from countweave.llm import repeats, suffixes


@pytest.mark.parametrize("n,chars", [(0, 3), (1, 2), (2, 1), (50, 1), (400, 2), (3000, 4), (2000, 255)])
def test_suffix_array_and_prefixes(n, chars):
    for seed in range(4):
        rnd = np.random.default_rng(seed)
        data = rnd.integers(0, chars, n).astype(np.uint8)
        if n > 300:
            data[100:200] = data[:100]
        raw = data.tobytes()
        sa = suffixes.suffix_array(data)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        got = suffixes.common_prefixes(data, sa).tolist()
        for k in range(1, n):
            a, b = raw[sa[k]:], raw[sa[k - 1]:]
            assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def rows():
    rnd = random.Random(5)
    w = ["the", "of", "naïve", "É", "and", "x", "12", "\n", "long-word"]
    text = lambda n: " ".join(rnd.choice(w) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [text(rnd.randrange(60)) for _ in range(3)]
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            a = rnd.randrange(len(s) // 2)
            parts.insert(rnd.randrange(len(parts)), s[a:a + rnd.randrange(90, 260)])
        out.append((i * 3 % 61, " ".join(parts)))
    out += [(100, None), (101, ""), (102, "ab" * 400), (103, "ab" * 400), (104, "z" * 100), (105, "z" * 100), (106, "z" * 99), (107, out[3][1]), (108, "y" * 101)]
    return out


def brute(data):
    seen, out = set(), []
    for i, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            x = b[s:s + 100]
            if x in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket": 50, "shard": 3000}, {"hot": 3, "sample": 1, "bucket": 200}])
def test_matches_brute_force(spark, options):
    df = spark.createDataFrame([(i, t, 9, b"k") for i, t in rows()], "doc_id long, text string, uid int, gram binary").repartition(5)
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, **options).collect())
    assert got == brute(sorted(rows(), key=lambda r: r[0]))


def test_repeated_and_null_ids(spark):
    data = rows()[:20] + [(None, rows()[1][1]), (3, rows()[2][1]), (3, rows()[2][1])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()), key=repr)
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(brute(order), key=repr)


def test_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    for r in repeats.without_repeats(df, with_text=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.n_removed == sum(s.stop - s.start for s in r.spans)
    assert repeats.without_repeats(df.limit(0)).collect() == []

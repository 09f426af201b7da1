import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from countweave.llm import exact

ROWS = [(5, "a b"), (3, "a  b"), (9, "a\n\tb"), (1, None), (2, ""), (4, "A b"), (7, " a b"), (8, "x" * 50_000), (6, "x" * 50_000),
        (10, "é"), (None, "a b"), (None, "only"), (None, "only"), (11, "rep"), (11, "rep"), (12, " "), (13, "\r\n")]


def brute(rows):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    low = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted([(i, low[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)], key=repr)


@pytest.mark.parametrize("known", [None, "true", "false", "id % 2 = 0"])
def test_matches_brute_force(spark, known):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in ROWS], "doc_id long, text string, digest string, row int")
    got = exact.exact_duplicates(df, known=known and F.expr(known)).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.digest) for r in got], key=repr) == brute(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.digest for r in got}) == len({r.digest for r in kept})
    assert all(r.id == r.keep_id for r in kept)


def test_drop_copies_keeps_columns(spark):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in ROWS], "doc_id long, text string, digest string, row int")
    out = exact.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([3, 1, 4, 7, 6, 10, None, 11, 12], key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 50, 30_000])
def test_filter(n):
    keys = np.random.default_rng(n).integers(-2**63, 2**63 - 1, n)
    f = exact.build_filter(keys)
    assert exact.passes(keys, *f).all()
    other = np.random.default_rng(7).integers(-2**63, 2**63 - 1, 20_000)
    assert exact.passes(other, *f).mean() < 0.02
    if n > 1000:
        assert len(f[3]) < 1.35 * n


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_duplicates(empty).collect() == [] and exact.drop_copies(empty).collect() == []

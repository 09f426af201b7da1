import math
import random
import re
from collections import Counter

import pytest

from countweave.llm import lm


def brute(texts, order, backoff, own):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    grams = [Counter(tuple(d[i:i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1)) for d in docs]
    every, total, out = sum(grams, Counter()), sum(map(len, docs)), []
    for d, g in zip(docs, grams):
        n, c = total - (0 if own else len(d)), every if own else every - g
        s = 0.0
        for i in range(len(d)):
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - k + 1:i + 1])
                if c[gram] > 0:
                    s += math.log10(backoff ** (order - k) * c[gram] / (c[gram[:-1]] if k > 1 else n))
                    break
            else:
                s += math.log10(backoff ** (order - 1) / (n + 1))
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("order,own,chunk,bucket", [(2, False, 12_000_000, 2_000_000), (3, False, 500, 300), (1, True, 400, 50), (2, True, 10**6, 100)])
def test_matches_brute_force(spark, order, own, chunk, bucket):
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice(["The", "the", "of", "Émile", "x", "\ty", "z"]) for _ in range(rnd.randrange(40))) for _ in range(60)] + [None, "", " ", "alone", "word " * 3000, "same text", "same text"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, chunk int")
    got = {r.id: r for r in lm.scored(df, order=order, own=own, chunk=chunk, bucket=bucket).collect()}
    for i, (n, s) in enumerate(brute(texts, order, 0.4, own)):
        assert got[i].n_words == n and abs(got[i].log_score - s) < 1e-6 * max(1, abs(s))
        assert (got[i].mean_log_score is None) == (n == 0)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert len(lm.scored(df).collect()) == 3
    assert lm.scored(df.limit(0)).collect() == []


def test_three_words_by_default(spark):
    """A text whose words and pairs are common is told from another by its triples."""
    texts = ["a b c", "x b c", "a b d", "a b c", "c a b", "b c a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.log_score for r in lm.scored(df, chunk=8, bucket=4).collect()}
    assert lm.ORDER >= 3
    for i, (_, s) in enumerate(brute(texts, 3, 0.4, False)):
        assert abs(got[i] - s) < 1e-9


def test_passes_leave_no_shuffle_files(spark):
    from pathlib import Path

    from countweave.llm.store import FREE, keep

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders, setting = [Path(x.getAbsolutePath()) for x in dirs], spark.conf.get(FREE, None)
    before = {f for top in folders for f in top.rglob("shuffle_*.data")}
    grouped = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").applyInArrow(lambda t: t.slice(0, 1), "k long")
    made = keep(grouped, free=True)
    assert {f for top in folders for f in top.rglob("shuffle_*.data")} <= before
    assert made.count() == 7
    assert spark.conf.get(FREE, None) == setting

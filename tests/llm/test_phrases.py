import collections
import re
from fractions import Fraction

import numpy as np
import pytest

from countweave.llm import phrases


def brute(rows, threshold=10, top=2000, hides=50):
    """Rows (lang, text) to the query's rows, by dictionaries."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    for lang in n:
        found = []
        for (x, p), a in f.items():
            if x != lang or len(p) < 2 or a < threshold:
                continue
            cuts = [(1000000 * a * a // (f[lang, p[:j]] * f[lang, p[j:]]), j) for j in range(1, len(p))]
            score, j = min(cuts)
            if any(y == lang and len(q) > len(p) and b >= threshold and 100 * b >= hides * a and
                   any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (y, q), b in f.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:j]], f[lang, p[j:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block, partition, top", [(6_000_000, 4_000_000, 2000), (300, 200, 7)])
def test_against_plain_counts(spark, block, partition, top):
    rnd = np.random.default_rng(5)
    words = ["a", "The", "river", "É", "bank", "of", "x y", "日本", "-", "k" * 30]
    odds = np.arange(1, 11) / 55
    gap = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b", " ; "]
    rows = [(rnd.choice(["en", "fr", None]), "".join(x + rnd.choice(gap) for x in rnd.choice(words, rnd.integers(0, 60), p=odds)))
            for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, None), ("no words", " .,"), ("en", "new york city. " * 30 + "York"), ("fr", "a a a a " * 40)]
    rows = [(None if a is None else str(a), b) for a, b in rows]
    docs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], "doc_id int, lang string, text string, phrase string, n string")
    got = rows_of(phrases.collocations(docs, block=block, partition=partition, top=top))
    assert got == brute([(a, b) for a, b in rows if (b or "").strip(" .,")], top=top)
    assert any(r[0] == "und" for r in got) and any(r[2] == "new york city" for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).collect() == []


def test_summaries_keep_what_is_frequent():
    """Every key at or above the threshold survives any split into summaries, and no merge holds more counters than allowed."""
    rnd = np.random.default_rng(1)
    for _ in range(30):
        parts = []
        for _ in range(rnd.integers(1, 60)):
            keys, n = np.unique(rnd.zipf(1.3, rnd.integers(1, 300)) % 4000, return_counts=True)
            parts.append((keys.astype(np.uint64), n.astype(np.int64)))
        total = collections.Counter()
        for keys, n in parts:
            total.update(dict(zip(keys.tolist(), n.tolist())))
        for threshold in (2, 10, 50):
            left = set(phrases.survivors(list(parts), threshold).tolist())
            assert {k for k, n in total.items() if n >= threshold} <= left
            capacity = sum(total.values()) // threshold + 1
            keys, n = phrases.merge(parts, capacity)
            assert len(keys) <= capacity
            for k, c in zip(keys.tolist(), n.tolist()):
                assert total[k] - Fraction(sum(total.values()) - int(n.sum()), capacity + 1) <= c <= total[k]


def test_long_text_in_several_blocks(spark):
    text = ("one two three. " * 3000) + "tail of it"
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    counts, words = phrases.frequent(docs, block=5000)
    assert {(r.phrase, r.f) for r in counts.collect()} == {(p, 3000) for p in ("one", "two", "three", "one two", "two three", "one two three")}
    assert words.collect()[0].n == 9003


def test_scores_do_not_overflow(spark):
    """Counts whose products pass 64 bits."""
    a = 3 * 10**12
    got = spark.sql(f"SELECT (CAST({a}L AS DECIMAL(18, 0)) * CAST({a}L AS DECIMAL(18, 0)) * CAST(1000000 AS DECIMAL(7, 0))) div "
                    f"(CAST({a + 1}L AS DECIMAL(18, 0)) * CAST({a + 7}L AS DECIMAL(18, 0))) AS s").first().s
    assert got == 10**6 * a * a // ((a + 1) * (a + 7)) == 999999

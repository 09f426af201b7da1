"""URL rules, licence scans and quality rules against plain searches."""
import re
from collections import Counter

import pytest

from countweave.llm import licenses, quality, urls

LOW = {c: c + 32 for c in range(65, 91)}


def test_urls(spark):
    rows = ["http://a.EXAMPLE.net/en/1", "https://example.net/EN/1", "x://net/", "http://net", "http://x.example.com/de/1?q=/en/", "http://example.com/den/",
            "http://y.org/fr/", "http://org/fr", "http://spam-farm.example.com/a", "http://www.cheap-pills.org/fr/1", None, "", "no scheme", "a://b://c/d",
            "http://10.0.0.1/x", "http://x.edu/login", "http://x.com/user/login", "http://é.com/ü#a", "http://x.com/payday-loans", "http://notexample.net?x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows + rows[:2])], "page_id int, url string, host string")

    def brute(u):
        u = u or ""
        m = re.search(r"://([^/?#]*)([^?#]*)(.*)", u, re.S)
        host, path, rest = (m[1].translate(LOW), m[2], m[3]) if m else ("", "", "")
        fit = [(len(t), t, a) for a, t in [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
               for h, p in [(t.partition("/")[0], "/" + t.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return host, path, max(fit)[1], max(fit)[2]
        soft = {r.action for r in urls.PATTERN_RULES if re.search(r.pattern, host + path + rest)}
        return host, path, None, "block" if soft == {"block"} else "allow"

    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(rows + rows[:2])}
    assert urls.judged(df.limit(0)).collect() == []
    assert {r.rule for r in urls.judged(df, rules=[]).collect()} == {None}


TEXTS = ["All rights\nreserved. CC-BY cc by, ccby Ücc by", "GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", None, "", "public license", "general public license " * 300,
         "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "plain words only é 12", "the permit is bsd", "All rights", "cc", "ALL RIGHTS RESERVED" * 2,
         "licensed under the MIT licensed under the MIT License", "CC BY 4.0", "copyright (c) 2001 x", "x" * 100_000 + " cc by"]


RULES = licenses.rules()


def brute_license(text):
    low = (text or "").translate(LOW)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    spans = [(m.start(), m.end(), k, lab, x) for k, lab, _, pat, x in RULES for m in re.finditer(pat, low, re.A)]
    left = [s for s in spans if not any(o is not s and o[0] <= s[0] and o[1] >= s[1] and (o[:2] != s[:2] or o[2] < s[2]) for o in spans)] if len(spans) < 2000 else spans
    base = sorted({x for _, x in at})
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(base),
            ",".join(sorted({*base, *(s[3] for s in left)})), max([s[4] for s in left] + [0.5 * bool(at)]))


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(TEXTS)] + [(None, "cc by", "l"), (0, TEXTS[0], "l")], "doc_id int, text string, labels string")
    got = Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.labelled(df).collect())
    assert got == Counter([(i, *brute_license(t)) for i, t in [*enumerate(TEXTS), (None, "cc by"), (0, TEXTS[0])]])
    assert licenses.labelled(df.limit(0)).collect() == []


def some_match(parsed, rng):
    """A string that the parsed pattern matches, branches and repeats drawn at random."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, value = arg[rng.randrange(len(arg))]
            out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(rng.randint(*value)) if str(kind) == "RANGE" else "",
                    "CATEGORY": lambda: rng.choice(" \n\t")}[str(kind)]()
        elif op == "BRANCH":
            out += some_match(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += some_match(arg[-1], rng)
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            out += "".join(some_match(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 2))))
        else:
            assert op in ("AT", "ASSERT_NOT"), op
    return out


def test_license_rules_imply_their_keywords_and_the_gate():
    """Whatever a rule matches holds its keywords and a word of the gate, so neither test loses a match."""
    import random

    rng = random.Random(5)
    assert len(RULES) >= 400 and len({r[3] for r in RULES}) == len(RULES)
    for k, _, words, pattern, _ in RULES:
        for _ in range(30):
            text = some_match(re._parser.parse(pattern, re.A), rng)
            assert re.search(pattern, text, re.A), (pattern, text)
            assert all(w in text for w in words), (words, text)
            assert any(w in text for w in licenses.GATE), text
    for phrase in licenses.PHRASES:
        assert any(w in phrase for w in licenses.GATE)


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = len({j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep


@pytest.fixture(scope="module")
def quality_rows():
    texts = [None, "", "a", "a b c d e", "a b c d e f a b c d e", "a a a a a a", "a a a a a", "x\n\nx\n x\nx", "é# | ü\x0b\x0c\r<>", "w " * 20_000, "a b c d e a b c d e a b c d e",
             " ".join(map(str, range(3000)))]
    return [(i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(texts)] + [(None, "a b", None, None, 1), (1, "", "en", "s", 1)]


def test_quality(spark, quality_rows):
    df = spark.createDataFrame(quality_rows, "doc_id int, text string, lang string, source string, n_words int")
    got = Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(df).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t, *_ in quality_rows)
    for r in quality.judged(df).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judged(df.limit(0)).collect() == []


def test_quality_sketch_and_fallback(spark):
    n = 3000
    df = spark.range(n).selectExpr("'en' AS lang", "IF(id < 20, 'few', 'many') AS source", "id * 3 AS symbol", "0L AS repeat", "id % 7 AS line")
    top = 10**9
    limits = quality.Limits(quantile=50, support=100, symbol=(0, top), repeat=(5, top), line=(0, top))
    got = {r.source: r for r in quality.thresholds(quality.sketches(df), limits).collect()}
    assert got["few"].symbol_limit >= 0.95 * 3 * n / 2 and abs(got["many"].symbol_limit / (3 * n / 2) - 1) < 0.08
    assert got["many"].repeat_limit == 5 and got["many"].line_limit == 3


def test_quality_limits_move_with_their_group_between_bounds(spark):
    """A source of mostly junk keeps a rule that works, a clean one keeps its tail, one in between has its own limit."""
    few = "IF(id % 50 < 2, 4000 + id % 7, 0)"
    df = spark.range(4000).selectExpr(
        "'en' AS lang", "element_at(array('clean', 'junk', 'between'), CAST(id % 3 + 1 AS INT)) AS source", "0L AS symbol", "0L AS repeat",
        f"CASE id % 3 WHEN 0 THEN id % 100 WHEN 1 THEN 9000L ELSE IF(id % 10 = 2, 3300L, {few} % 1000) END AS line")
    limits = quality.Limits()
    got = {r.source: r.line_limit for r in quality.thresholds(quality.sketches(df), limits).collect()}
    low, high = limits.line
    assert got["clean"] == low and got["junk"] == high and low < got["between"] < high and 3300 <= got["between"] < 3300 * 1.07


def test_quality_limits_of_the_given_table(spark):
    """On sf0.1 groups differ: limits strictly between their bounds, by language and source."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = docs.selectExpr("lang", "source", "filter(split(text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS l").selectExpr(
        "lang", "source", "0L AS symbol", "0L AS repeat", "CAST(floor((size(l) - size(array_distinct(l))) * 10000 / greatest(size(l), 1)) AS LONG) AS line")
    limits = quality.Limits()
    got = {r.line_limit for r in quality.thresholds(quality.sketches(lines), limits).collect()}
    assert len([x for x in got if limits.line[0] < x < limits.line[1]]) >= 2


LICENSE_LABELS = [
    ("MIT License", "mit", 0.5), ("BSD License", "bsd", 0.5), ("mit", "", 0.0), ("a bsd kernel", "", 0.0), ("Modified BSD license", "bsd-3-clause", 0.5),
    ("Apache License, Version 2.0", "apache-2.0", 0.5), ("Apache License", "apache", 0.5), ("GNU General Public License v3", "gpl,gpl-3.0", 0.5),
    ("gnu general public licence, version 2", "gpl-2.0", 0.5), ("Mozilla Public License 2.0", "mpl-2.0", 0.5),
    ("licensed under\nthe MIT License", "mit", 0.95), ("Released  under\r\n\tthe BSD\nlicense", "bsd", 0.9),
    ("subject to the GNU General\nPublic License", "gpl", 0.85), ("dedicated to the public\ndomain", "public-domain", 0.95),
    ("released under public\n domain", "public-domain", 0.9), ("the Apache\nLicense,\n Version 2.0", "apache-2.0", 0.5),
    ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0", 1.0), ("SPDX-License-Identifier: (MIT OR X)", "mit", 1.0), ("Licensed under the Apache-2.0 license.", "apache-2.0", 0.95),
    ("a BSD-3-Clause file", "bsd-3-clause", 0.8), ("released under LGPL v2.1", "lgpl-2.1", 0.9), ("licensed under GPLv3", "gpl-3.0", 0.95),
    ("distributed under the GPL", "gpl", 0.9), ("GPL-3.0-or-later", "gpl-3.0", 0.8), ("LGPL-2.1-only", "lgpl-2.1", 0.8),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa", 0.95), ("http://creativecommons.org/publicdomain/zero/1.0/", "cc0", 0.95),
    ("Permission is hereby granted, free of charge, to any person obtaining\na copy of this software", "mit", 0.95),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd", 0.9),
    ("https://www.apache.org/licenses/LICENSE-2.0.txt", "apache-2.0", 0.95), ("https://opensource.org/licenses/MIT", "mit", 0.95),
    ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0", 0.95), ("Some rights reserved", "some-reserved", 0.7),
    ("MPL-2.0", "mpl-2.0", 0.8), ("mpl-2.05", "", 0.0), ("an epl-2 table", "", 0.0), ("they permit a limit", "", 0.0),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa", 0.5), ("isc licensed", "isc", 0.7)]


def test_license_labels(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LICENSE_LABELS)], "doc_id int, text string")
    got = {r.id: (r.labels, r.score) for r in licenses.labelled(df).collect()}
    assert {x[0]: got[i] for i, x in enumerate(LICENSE_LABELS)} == {x[0]: x[1:] for x in LICENSE_LABELS}

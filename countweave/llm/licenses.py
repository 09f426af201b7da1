"""License scans: ordered signature rules behind a keyword test, with suppression of contained detections.

Rules are SPDX short names (tag, address, bare), signatures of licence texts and addresses, and families
(label, keyword, name pattern) in sentences that name a licence. A text that holds no word of the gate is done
after one pass; the pass also counts its words. In the others each keyword is tested once, and a rule runs only
where all its keywords stand. A detection is a span; one that lies within another span is suppressed, and of equal spans the rule that comes
first in the order stays. Everything but the suppression happens in the text's own row; that works on
detections alone, in the order of a text's spans.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, and what lies between two, in texts that keep their capitals.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases and labels, fixed values of the task.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, keyword (without white space), pattern of the name (over lower-case text; a space is any white space).
FAMILIES = [
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e(?:,? version)?(?: |-| v| v\. )?2(?:\.0)?"),
    ("apache-2.0", "apache", r"apache[ -]v?2(?:\.0)?(?: licen[cs]e)?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit", "mit", r"mit(?:[ /-]x11)?(?: licen[cs]e)?"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2-clause) bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"bsd[ -]2-clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause) bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"bsd[ -]3-clause(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: licen[cs]e)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v)?2(?:\.0)?(?:-only|-or-later|\+)?(?: licen[cs]e)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v)?3(?:\.0)?(?:-only|-or-later|\+)?(?: licen[cs]e)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: licen[cs]e)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v\.? ?)2\.1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl[ -]?(?:version |v)?2\.1(?:-only|-or-later|\+)?(?: licen[cs]e)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl[ -]?(?:version |v)?3(?:\.0)?(?:-only|-or-later|\+)?(?: licen[cs]e)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: licen[cs]e)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl[ -]?(?:version |v)?3(?:\.0)?(?:-only|-or-later|\+)?(?: licen[cs]e)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: licen[cs]e)?"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("mpl-2.0", "mpl", r"mpl[ -]?v?2(?:\.0)?(?: licen[cs]e)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,? (?:- )?(?:version |v\.? ?)?2(?:\.0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("cc0", "cc0", r"cc0(?:[ -]1\.0)?"),
    ("cc-by-nc-nd", "nc", r"cc[ -]by-nc-nd(?:[ -][1-4]\.0)?"),
    ("cc-by-nc-sa", "nc", r"cc[ -]by-nc-sa(?:[ -][1-4]\.0)?"),
    ("cc-by-nc", "nc", r"cc[ -]by-nc(?:[ -][1-4]\.0)?"),
    ("cc-by-nd", "nd", r"cc[ -]by-nd(?:[ -][1-4]\.0)?"),
    ("cc-by-sa", "sa", r"cc[ -]by-sa(?:[ -][1-4]\.0)?"),
    ("cc-by", "cc", r"cc[ -]by(?:[ -][1-4]\.0)?"),
    ("cc-by-nc-nd", "noderiv", r"creative commons attribution[ -]noncommercial[ -]noderiv(?:ative)?s(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "noncommercial", r"creative commons attribution[ -]noncommercial[ -]sharealike(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution[ -]noncommercial(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd", "noderiv", r"creative commons attribution[ -]noderiv(?:ative)?s(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa", "sharealike", r"creative commons attribution[ -]sharealike(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?"),
    ("public-domain", "domain", r"public domain"),
    ("unlicense", "unlicense", r"unlicense"),
    ("isc", "isc", r"isc(?: licen[cs]e)?"),
    ("zlib", "zlib", r"zlib licen[cs]e"),
    ("boost", "boost", r"boost software licen[cs]e"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("psf", "python", r"python software foundation licen[cs]e"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("odbl", "database", r"open database licen[cs]e"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
]
#: Sentences around a name (%s), a keyword that each implies, and the weight of a detection.
SENTENCES = [
    (r"(?:this (?:work|text|page|program) is )?licensed under (?:the |a )?(?:terms of the )?%s", "licensed", 0.95),
    (r"(?:released|distributed|published|available) under (?:the |a )?(?:terms of the )?%s", "under", 0.9),
    (r"(?:subject to|governed by) (?:the )?(?:terms of the )?%s", "", 0.85),
    (r"%s licen[cs]ed", "licen", 0.7),
    (r"%s", "", 0.5),
]
#: SPDX short names and the labels they get, fixed values. Those without a digit are ordinary words when they stand alone.
SPDX = {
    "0bsd": "0bsd", "afl-3.0": "afl", "agpl-3.0": "agpl-3.0", "agpl-3.0-only": "agpl-3.0", "agpl-3.0-or-later": "agpl-3.0",
    "apache-1.1": "apache", "apache-2.0": "apache-2.0", "artistic-2.0": "artistic", "bsd-2-clause": "bsd-2-clause",
    "bsd-3-clause": "bsd-3-clause", "bsd-4-clause": "bsd", "bsl-1.0": "boost", "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-sa-3.0": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa", "cc0-1.0": "cc0", "cddl-1.0": "cddl", "ecl-2.0": "ecl",
    "epl-1.0": "epl", "epl-2.0": "epl-2.0", "eupl-1.2": "eupl", "gfdl-1.3-only": "gfdl", "gfdl-1.3-or-later": "gfdl",
    "gpl-2.0": "gpl-2.0", "gpl-2.0-only": "gpl-2.0", "gpl-2.0-or-later": "gpl-2.0", "gpl-3.0": "gpl-3.0",
    "gpl-3.0-only": "gpl-3.0", "gpl-3.0-or-later": "gpl-3.0", "isc": "isc", "lgpl-2.1": "lgpl-2.1",
    "lgpl-2.1-only": "lgpl-2.1", "lgpl-2.1-or-later": "lgpl-2.1", "lgpl-3.0": "lgpl-3.0", "lgpl-3.0-only": "lgpl-3.0",
    "lgpl-3.0-or-later": "lgpl-3.0", "mit": "mit", "mit-0": "mit", "mpl-1.1": "mpl", "mpl-2.0": "mpl-2.0", "ms-pl": "ms-pl",
    "ncsa": "ncsa", "odbl-1.0": "odbl", "ofl-1.1": "ofl", "osl-3.0": "osl", "postgresql": "postgresql", "psf-2.0": "psf",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib",
}
#: Licence texts, addresses and notices: label, keyword, pattern, weight.
SIGNATURES = [
    ("mit", "permission", r"permission is hereby granted, free of charge(?:, to any person obtaining a copy)?", 0.95),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted", 0.9),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", 0.9),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at https?://www\.apache\.org", 0.95),
    ("gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license", 0.95),
    ("lgpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu lesser general public license", 0.95),
    ("agpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license", 0.95),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("zlib", "express", r"this software is provided '?as-is'?, without any express or implied warranty", 0.9),
    ("boost", "boost", r"boost software license - version 1\.0", 0.95),
    ("wtfpl", "public", r"do what the fuck you want to public license", 0.95),
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0", 0.95),
    ("gpl-2.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", 0.95),
    ("gpl-3.0", "gnu.org", r"gnu\.org/licenses/gpl-3\.0", 0.95),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl", 0.9),
    ("lgpl-2.1", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", 0.95),
    ("lgpl-3.0", "gnu.org", r"gnu\.org/licenses/lgpl-3\.0", 0.95),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/lgpl", 0.9),
    ("agpl", "gnu.org", r"gnu\.org/licenses/agpl(?:-3\.0)?", 0.9),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl", 0.9),
    ("cc-by", "creativecommons", r"creativecommons\.org/licenses/by/[1-4]\.[05]", 0.95),
    ("cc-by-sa", "creativecommons", r"creativecommons\.org/licenses/by-sa(?:/[1-4]\.[05])?", 0.95),
    ("cc-by-nd", "creativecommons", r"creativecommons\.org/licenses/by-nd(?:/[1-4]\.[05])?", 0.95),
    ("cc-by-nc", "creativecommons", r"creativecommons\.org/licenses/by-nc(?:/[1-4]\.[05])?", 0.95),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa(?:/[1-4]\.[05])?", 0.95),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd(?:/[1-4]\.[05])?", 0.95),
    ("cc0", "creativecommons", r"creativecommons\.org/publicdomain/zero(?:/1\.0)?", 0.95),
    ("public-domain", "creativecommons", r"creativecommons\.org/publicdomain/mark(?:/1\.0)?", 0.95),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0", 0.95),
    ("epl", "eclipse.org", r"eclipse\.org/legal/epl", 0.9),
    ("unlicense", "unlicense.org", r"unlicense\.org", 0.9),
    ("boost", "boost.org", r"boost\.org/license_1_0", 0.95),
    ("bsd", "opensource", r"opensource\.org/licenses?/bsd-license", 0.9),
    ("mit", "opensource", r"opensource\.org/licenses?/mit-license", 0.9),
    ("reserved", "rights", r"all rights reserved", 0.9),
    ("some-reserved", "rights", r"some rights reserved", 0.7),
    ("copyright", "copyright", r"copyright (?:\(c\) |© )?(?:19|20)[0-9]{2}", 0.6),
    ("no-warranty", "warrant", r"without warrant(?:y|ies) of any kind", 0.6),
    ("public-domain", "dedicated", r"dedicated to the public domain", 0.95),
    ("proprietary", "confidential", r"proprietary and confidential", 0.8),
    ("proprietary", "permission", r"no part of this (?:book|publication|document|work) may be reproduced(?: [a-z,]+){0,20} without(?: [a-z]+){0,6} permission", 0.85),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: [a-z,]+){0,12} is (?:strictly )?prohibited", 0.8),
]
#: Every rule and every phrase implies one of these in the text (checked in the tests).
GATE = ["licen", "rights", "public", "copyright", "warrant", "confidential", "cc", "gpl", "apache", "bsd", "released", "distributed",
        "published", "available", "subject", "governed", "creative", "hereby", "permission", "redistribut", "endorse",
        "prohibited", "provided", "gnu.org", ".org/", "-1.", "-2.", "-3.", "mit-0", "ms-pl", "mpl", "0bsd", "unencumbered"]
_MAY = "(?: licen[cs]e)?"
#: Every rule's keyword implies one of these in the text (checked in the tests), and so does every phrase.
STEMS = r"(?i)licen|rights|public|copyright|warrant|confidential|cc|\bmit\b|bsd|gpl|spdx|creative|published|released|distributed|subject to|governed by"


def _bare(label: str, name: str) -> str | None:
    """The name where it stands alone."""
    if label.startswith("cc"):
        return name
    if name.endswith(_MAY):
        return name.removesuffix(_MAY) + " licen[cs]e"
    return name if "licen" in name else None


def _wrapped(pattern: str) -> str:
    """The pattern with any white space, also of several lines, for each space."""
    return pattern.replace("[ -]?", r"(?:\s+|-)?").replace("[ -]", r"(?:\s+|-)").replace(" ?", r"\s*").replace(" ", r"\s+")


def rules() -> list[tuple[int, str, list[str], str, float]]:
    """(order, label, keywords, pattern, weight); earlier rules win equal spans.

    A bare name is a rule only where it says itself that it is a licence: a word for it that a sentence may leave out
    must be there. A bare SPDX name must hold a digit or be one that is no word.
    """
    made = []
    for name, label in SPDX.items():
        x = name.replace(".", r"\.")
        made.append((label, ["spdx", name], rf"spdx-license-identifier: ?\(? ?{x}", 1.0))
        made.append((label, [".org/", name], rf"(?:spdx|opensource)\.org/licenses?/{x}", 0.95))
        if "-" in name or name[0].isdigit():
            made.append((label, [name], x, 0.8))
    made += [(label, [word], pattern, weight) for label, word, pattern, weight in SIGNATURES]
    made += [(label, [w for w in (word, implied) if w], sentence % x, weight) for sentence, implied, weight in SENTENCES
             for label, word, name in FAMILIES if (x := _bare(label, name) if sentence == "%s" else name)]
    return [(k, label, words, rf"\b{_wrapped(pattern)}(?![0-9a-z])", weight) for k, (label, words, pattern, weight) in enumerate(made)]


def _array(made) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("label"), F.array(*map(F.lit, w)).alias("words"), F.lit(p).alias("re"),
                              F.lit(float(x)).alias("weight")) for k, a, w, p, x in made])


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, row, n_words, places (structs label, word), detections (structs k, label, weight, start, stop).

    start and stop are characters of the text with A-Z lower-cased. A null text has no words.
    """
    t = docs.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                    F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # folding more than A-Z can only let more texts through the gate
    t = t.withColumn("lower", F.lower("text")).withColumn("gate", reduce(or_, [F.contains("lower", F.lit(w)) for w in GATE]))
    t = t.withColumn("spaced", F.trim(F.regexp_replace("text", BETWEEN, " ")))
    n_words = F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1)
    t = t.select("id", "row", n_words.cast("long").alias("n_words"),
                 F.when(F.col("gate"), F.translate("text", _UPPER, _LOWER)).otherwise(F.lit("")).alias("low"))
    phrased = reduce(or_, [reduce(and_, [F.contains("low", F.lit(w)) for w in phrase.split()]) for phrase in PHRASES])
    t = t.withColumn("w", F.when(phrased, F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        found.append(f"CASE WHEN size(w) >= {len(words)} THEN transform(filter(sequence(0, size(w) - {len(words)}), i -> {test}),"
                     f" i -> named_struct('label', '{label}', 'word', CAST(i AS BIGINT))) ELSE array() END")
    t = t.withColumn("places", F.expr(f"concat({', '.join(found)})"))
    made = rules()
    keywords = sorted({w for r in made for w in r[2]})
    t = t.withColumn("held", F.when(F.col("low") == "", F.array().cast("array<string>")).otherwise(
        F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("low"), k))))
    none = F.array().cast("array<struct<k:int,label:string,words:array<string>,re:string,weight:double>>")
    t = t.withColumn("runs", F.when(F.size("held") == 0, none).otherwise(F.filter(_array(made), lambda r: (
        F.size(F.array_except(r["words"], F.col("held"))) == 0) & F.regexp_like("low", r["re"]))))
    # The spans of a rule: lengths of what lies between its matches and of the matches themselves.
    spans = F.expr("""flatten(transform(runs, r -> transform(
      aggregate(zip_with(split(low, r.re, -1), regexp_extract_all(low, r.re, 0),
                         (g, s) -> named_struct('gap', length(g), 'size', length(s))),
        named_struct('at', 0, 'out', CAST(array() AS array<struct<a: int, b: int>>)),
        (acc, x) -> CASE WHEN x.size IS NULL THEN acc ELSE named_struct('at', acc.at + x.gap + x.size,
          'out', concat(acc.out, array(named_struct('a', acc.at + x.gap, 'b', acc.at + x.gap + x.size)))) END).out,
      s -> named_struct('k', r.k, 'label', r.label, 'weight', r.weight, 'start', s.a, 'stop', s.b))))""")
    return t.select("id", "row", "n_words", "places", spans.alias("detections"))


def surviving(scans: DataFrame) -> DataFrame:
    """row, k, label, weight, start, stop of the detections that lie in no other."""
    opened = scans.select("row", F.explode("detections").alias("d")).select("row", "d.*")
    order = Window.partitionBy("row").orderBy("start", F.col("stop").desc(), "k")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return opened.withColumn("reach", before).where("reach IS NULL OR reach < stop").drop("reach")


def labelled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Empty tables give no rows; repeated rows each come back; other columns are not read. A very long text is one row's
    value; its words are opened only where a phrase may stand, and a regular expression runs over it only for rules whose keywords it holds.
    score: the largest weight of a surviving detection, at least 0.5 with a phrase, else 0.
    """
    scans = keep(scanned(docs, id_column, text_column))
    more = surviving(scans).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))
    base = F.transform("places", lambda p: p["label"])
    out = scans.join(more, "row", "left")
    return out.select(
        "id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

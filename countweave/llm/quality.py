"""Quality rules with thresholds that come from the data, per language and source.

Each text is measured by built-in functions. The ratios go into quantile sketches: counts of
values in buckets of fixed relative width, whole numbers below 32 exactly, then 16 buckets for each
doubling. Sketches of a (language, source) are merged to those of the language and of all texts by adding counts,
and a group below `support` texts uses the next wider one. A text is rejected where a ratio
is above its group's limit: the group's quantile, kept between two bounds, so that a clean group does not lose its
tail and a group of mostly junk keeps a working rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Ratios are in parts of 10,000: symbols to characters, repeated words to words, repeated lines to lines.

    quantile: in hundredths. A pair of bounds for each ratio: the lowest and the highest limit a group can have.
    """

    quantile: int = 98
    support: int = 200
    symbol: tuple[int, int] = (500, 1000)
    repeat: tuple[int, int] = (1000, 1500)
    line: tuple[int, int] = (2500, 5000)


RATIOS = ("symbol", "repeat", "line")
RATIO_KEYS = ["ratio", "bucket"]


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
             source_column: str = "source") -> DataFrame:
    """One row per row of docs: id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text has no words. Null languages and sources are the value "".
    """
    t = docs.select(F.col(id_column).cast("long").alias("id"),
                    F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
                    F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    t = t.select("id", "lang", "source", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"),
                 F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
                 F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    gram = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    t = t.select(
        "id", "lang", "source", "n_symbols", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(w) > {WINDOW} THEN transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({gram}))"
               " ELSE array() END").alias("h"))
    # Most texts repeat no window; only the others put theirs in order.
    t = t.withColumn("g", F.expr("CASE WHEN size(h) > size(array_distinct(h))"
                                 " THEN array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i))) ELSE array() END")).drop("h")
    after = "slice({0}, 2, greatest(size({0}) - 1, 0))"
    before = "concat(array(false), slice({0}, 1, greatest(size({0}) - 1, 0)))"
    t = t.withColumn("same", F.expr(f"zip_with(g, {after.format('g')}, (x, y) -> coalesce(x.h = y.h, false))"))
    t = t.withColumn("at", F.expr(
        f"array_sort(filter(zip_with(g, zip_with(same, {before.format('same')}, (a, b) -> a OR b),"
        " (x, f) -> CASE WHEN f THEN x.i END), i -> i IS NOT NULL))")).drop("g", "same")
    covered = F.expr(f"aggregate(zip_with(at, {after.format('at')}, (a, b) -> least(b - a, {WINDOW})), 0L, (n, x) -> n + x)")
    return t.withColumn("n_repeat_words", covered).drop("at")


def _parts(n: Column, of: Column) -> Column:
    return F.floor(n * 10000 / F.greatest(of, F.lit(1))).cast("long")


def _bucket(x: Column) -> Column:
    """Below 32 the value; above, its five leading bits and its length."""
    more = F.length(F.bin(x)) - 5
    return F.when(x < 32, x).otherwise(F.call_function("shiftright", x, more) + more * 16).cast("long")


def _top(bucket: Column) -> Column:
    """The largest value of a bucket."""
    more = F.floor(bucket / 16).cast("int") - 1
    return F.when(bucket < 32, bucket).otherwise(
        F.call_function("shiftleft", (bucket - more * 16) + 1, more) - 1).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: one sketch for each language, source and ratio."""
    opened = measures.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(r).alias("ratio"), _bucket(F.col(r)).alias("bucket")) for r in RATIOS])).alias("x"))
    return opened.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, limits: Limits) -> DataFrame:
    """lang, source and a limit for each ratio."""
    merged = sketch.groupingSets(
        [[F.col(x) for x in y] for y in (RATIO_KEYS + ["lang", "source"], RATIO_KEYS + ["lang"], RATIO_KEYS)],
        "ratio", "bucket", "lang", "source").agg(
        F.sum("n").alias("n"), F.grouping("lang").alias("no_lang"), F.grouping("source").alias("no_source"))
    group = Window.partitionBy("ratio", "no_lang", "no_source", "lang", "source")
    ranked = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    found = ranked.where(F.col("upto") * 100 >= F.col("total") * limits.quantile) \
        .groupBy("ratio", "no_lang", "no_source", "lang", "source").agg(F.min("bucket").alias("bucket"), F.first("total").alias("total")) \
        .select("*", _top(F.col("bucket")).alias("high"))
    own = found.where("no_source = 0").select("ratio", "lang", "source", "high", "total")
    lang = found.where("no_source = 1 AND no_lang = 0").select("ratio", "lang", F.col("high").alias("high1"), F.col("total").alias("total1"))
    every = found.where("no_lang = 1").select("ratio", F.col("high").alias("high2"))
    chosen = own.join(lang, ["ratio", "lang"]).join(every, "ratio").select(
        "lang", "source", "ratio", F.when(F.col("total") >= limits.support, F.col("high"))
        .when(F.col("total1") >= limits.support, F.col("high1")).otherwise(F.col("high2")).alias("high"))
    return chosen.groupBy("lang", "source").agg(*[
        F.least(F.greatest(F.max(F.when(F.col("ratio") == r, F.col("high"))), F.lit(low)), F.lit(high)).alias(f"{r}_limit")
        for r, (low, high) in ((r, getattr(limits, r)) for r in RATIOS)])


def judged(docs: DataFrame, limits: Limits = Limits(), **columns) -> DataFrame:
    """The measures with base_failed, the group's limits and kept, for every row of docs.

    An empty table gives no rows; repeated rows each come back; other columns are not read.
    """
    m = measured(docs, **columns)
    m = keep(m.select("*", _parts(F.col("n_symbols"), F.col("word_chars")).alias("symbol"),
                      _parts(F.col("n_repeat_words"), F.col("n_words")).alias("repeat"),
                      _parts(F.col("n_dup_lines"), F.col("n_lines")).alias("line")))
    out = m.join(keep(thresholds(sketches(m), limits)), ["lang", "source"])  # a row a group: sent whole where small
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = (F.col("symbol") <= F.col("symbol_limit")) & (F.col("repeat") <= F.col("repeat_limit")) & (F.col("line") <= F.col("line_limit"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _limit_sql(ratio: str, limits: Limits) -> str:
    low, high = getattr(limits, ratio)
    return (f"least(greatest(max(CASE WHEN ratio = '{ratio}' THEN CASE WHEN total >= {limits.support} THEN high"
            f" WHEN total1 >= {limits.support} THEN high1 ELSE high2 END END), {low}), {high}) AS {ratio}_limit")


def _sketch_sql(name: str, keys: str) -> str:
    by = f"ratio{', ' + keys if keys else ''}"
    return f"""{name} AS (SELECT {by}, CASE WHEN b < 32 THEN b ELSE ((b - (b // 16 - 1) * 16 + 1) << (b // 16 - 1)) - 1 END AS high, total FROM
 (SELECT {by}, min(b) AS b, any_value(total) AS total FROM (SELECT {by}, b, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS upto,
   sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, b, sum(n) AS n FROM k GROUP BY ALL)) WHERE upto * 100 >= total * {Limits().quantile} GROUP BY {by}))"""


OP9_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
q AS (SELECT *, CAST(floor(n_symbols * 10000 / greatest(word_chars, 1)) AS BIGINT) AS symbol,
  CAST(floor(n_repeat_words * 10000 / greatest(n_words, 1)) AS BIGINT) AS repeat,
  CAST(floor(n_dup_lines * 10000 / greatest(n_lines, 1)) AS BIGINT) AS line FROM m),
k AS (SELECT lang, source, ratio, CASE WHEN x < 32 THEN x ELSE (x >> (len(bin(x)) - 5)) + (len(bin(x)) - 5) * 16 END AS b, count(*) AS n
  FROM (UNPIVOT (SELECT lang, source, symbol, repeat, line FROM q) ON symbol, repeat, line INTO NAME ratio VALUE x) GROUP BY ALL),
{_sketch_sql('h0', 'lang, source')}, {_sketch_sql('h1', 'lang')}, {_sketch_sql('h2', '')},
limits AS (SELECT lang, source, {', '.join(_limit_sql(r, Limits()) for r in RATIOS)} FROM h0
  JOIN (SELECT ratio, lang, high AS high1, total AS total1 FROM h1) USING (ratio, lang)
  JOIN (SELECT ratio, high AS high2 FROM h2) USING (ratio) GROUP BY lang, source),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q JOIN limits USING (lang, source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbol <= symbol_limit AND repeat <= repeat_limit AND line <= line_limit AS kept FROM f
"""

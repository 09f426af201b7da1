"""Ranks, quantiles and lags that stay exact when one key holds most of the rows.

A window over a hot key would put that key into one task. Here each key is cut
into value ranges (or row ranges) first, every range is handled on its own, and
small per-range totals are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import SPAN, hash32

#: Rows for which a key gets one more value range; ranges a key gets at most, a power of two.
RANGE_ROWS = 50_000
BUCKETS = 1024
SALTS = 32


def attach(df: DataFrame, small: DataFrame, keys: list[str], copies: int = SALTS) -> DataFrame:
    """Join facts of a key (one row per key) to its rows, however many a key has.

    Rows of a key are dealt to ``copies`` join keys and the facts are repeated
    as often, so no task takes a whole hot key.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(copies))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))
    repeated = small.select("*", F.explode(salts).alias("_salt"))
    return df.withColumn("_salt", salt).join(repeated, [*keys, "_salt"]).drop("_salt")


def _with_edges(df: DataFrame, keys: list[str], value: str | Column, buckets: int, range_rows: int) -> DataFrame:
    """Add ``_edges``, the cut values of a row's key, and ``_ranges``, how many ranges they make.

    A key gets a range for every ``range_rows`` rows, cut by a mergeable, bounded
    quantile sketch. Both are NULL for keys that one range holds, so only large
    keys, at most one for every ``range_rows`` rows of the table, have facts to
    join; those are repeated, so that the rows of a hot key are dealt over all
    partitions.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    found = df.groupBy(*keys).agg(F.count(value).alias("_rows"), F.percentile_approx(value, cuts, 10000).alias("_cuts"))
    large = found.where(F.col("_rows") > range_rows).withColumn(
        "_ranges", F.least(F.ceil(F.col("_rows") / range_rows), F.lit(buckets)).cast("int"))
    edges = F.transform(F.sequence(F.lit(1), F.col("_ranges") - 1),
                        lambda i: F.get("_cuts", F.floor(i * buckets / F.col("_ranges")).cast("int") - 1))
    copies = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))
    facts = large.select(*keys, "_ranges", edges.alias("_edges"), F.explode(salts).alias("_salt"))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(copies))).join(facts, [*keys, "_salt"], "left").drop("_salt")


def _offsets(sizes: DataFrame, keys: list[str], bucket: list[str], total: str) -> DataFrame:
    """Rows before each range of a key, and rows of the key; works on range totals only."""
    by = keys or [F.lit(0)]
    run = Window.partitionBy(*by).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys, *bucket, F.coalesce(F.sum("_size").over(run), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*by)).alias(total),
    )


def _placed(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Replace ``_edges`` by ``_range``: how many cut values are smaller than the value.

    A binary search written out as a few columns, so it stays in generated
    code. Also adds ``_at_edge``: whether the value is itself a cut value.
    """
    out = df.withColumn("_range", F.lit(0))
    step = buckets // 2
    while step >= 1:
        probe = F.get("_edges", F.col("_range") + (step - 1))
        out = out.withColumn("_range", F.col("_range") + F.when(probe < F.col(value), step).otherwise(0))
        step //= 2
    return out.withColumn("_at_edge", F.coalesce(F.get("_edges", F.col("_range")) == F.col(value), F.lit(False))).drop("_edges")


def ranked(df: DataFrame, keys: list[str], value: str, tie: Column, tie_chunk: float | None, name: str = "rank",
           buckets: int = BUCKETS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """1-based ascending rank of ``value`` within ``keys``; equal values go by ``tie``.

    A key has a value range for every ``range_rows`` rows, at most ``buckets``
    (a power of two); the ranks do not depend on either.

    ``tie`` is a number that tells equal values apart; values common enough to
    be a cut value are split again into ranges of ``tie_chunk`` ties, or, where
    that is None and ties are hashes, into as many ranges as the key has. Adds
    ``name`` and ``<name>_total``.
    """
    if not keys:
        whole = ranked(df.withColumn("_whole", F.lit(0)), ["_whole"], value, tie, tie_chunk, name, buckets, range_rows)
        return whole.drop("_whole")
    chunk = F.lit(SPAN) / F.col("_ranges") if tie_chunk is None else F.lit(tie_chunk)
    placed = (
        _placed(_with_edges(df.where(F.col(value).isNotNull()), keys, value, buckets, range_rows), value, buckets)
        .withColumn("_tie", tie)
        # never NULL: an inferred not-null test would pull the whole search into the join condition
        .withColumn("_part", F.when(F.col("_at_edge"), F.coalesce(F.floor(F.col("_tie") / chunk), F.lit(0)))
                    .otherwise(F.lit(-1)))
        .drop("_at_edge", "_ranges")
    )
    where = ["_range", "_part"]
    sizes = placed.groupBy(*keys, *where).agg(F.count(F.lit(1)).alias("_size"))
    inside = Window.partitionBy(*keys, *where).orderBy(value, "_tie")
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(_offsets(sizes, keys, where, f"{name}_total"), [*keys, *where])
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop(*where, "_tie", "_before", "_at")
    )


def hash_tie(columns: list[str]) -> tuple[Column, None]:
    """Tie number, and no chunk, for rows that only have a compound key."""
    return hash32(*columns), None


def distinct_positions(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS,
                       range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct values per key with the 0-based sorted positions [first, last] they fill."""
    if not keys:
        return distinct_positions(df.withColumn("_whole", F.lit(0)), ["_whole"], value, buckets, range_rows).drop("_whole")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # the cut values read the counts too, so that every branch shares one counting shuffle
    counted_value = F.when(F.col("_n") > 0, F.col(value))
    placed = _placed(_with_edges(counted, keys, counted_value, buckets, range_rows), value, buckets).drop("_at_edge", "_ranges")
    sizes = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_upto", F.sum("_n").over(inside))
        .join(_offsets(sizes, keys, ["_range"], "total"), [*keys, "_range"])
        .select(*keys, value, (F.col("_before") + F.col("_upto") - F.col("_n")).alias("first"),
                (F.col("_before") + F.col("_upto") - 1).alias("last"), "total")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, targets: DataFrame | dict[str, float],
              buckets: int = BUCKETS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation at (n - 1) p.

    ``targets`` is either {output column: p}, the same for every key, or a
    table of ``keys`` with one probability column per output column.
    """
    positions = distinct_positions(df, keys, value, buckets, range_rows)
    if isinstance(targets, dict):
        names = list(targets)
        wanted = positions.select("*", *[F.lit(p).alias(f"_p_{n}") for n, p in targets.items()])
    else:
        names = [c for c in targets.columns if c not in keys]
        wanted = attach(positions, targets.select(*keys, *[F.col(n).alias(f"_p_{n}") for n in names]), keys)
    out = []
    for n in names:
        at = (F.col("total") - 1) * F.col(f"_p_{n}")
        low, high = F.floor(at), F.ceil(at)
        x = F.col(value)
        out.append((
            F.max(F.when((F.col("first") <= low) & (low <= F.col("last")), x)).alias(f"_lo_{n}"),
            F.max(F.when((F.col("first") <= high) & (high <= F.col("last")), x)).alias(f"_hi_{n}"),
            F.max(at - low).alias(f"_w_{n}"),
        ))
    picked = wanted.groupBy(*keys).agg(*[c for triple in out for c in triple])
    return picked.select(*keys, *[
        (F.col(f"_lo_{n}") + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in names
    ])


def successive_pairs(df: DataFrame, keys: list[str], position: str, value: str, chunk: int = 100_000) -> DataFrame:
    """(previous, current) value pairs in ``position`` order.

    Rows are cut into ranges of ``chunk`` positions; only the last row of each
    range crosses over to the next one.
    """
    cut = df.select(*keys, F.col(position).alias("_p"), F.col(value).alias("_v"),
                    F.floor(F.col(position) / chunk).alias("_chunk"))
    order = Window.partitionBy(*keys, "_chunk").orderBy("_p")
    within = (
        cut.withColumn("previous", F.lag("_v").over(order)).withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") > 1).select(*keys, "previous", F.col("_v").alias("current"))
    )
    ends = cut.groupBy(*keys, "_chunk").agg(F.min_by("_v", "_p").alias("current"), F.max_by("_v", "_p").alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_chunk")
    across = (
        ends.withColumn("previous", F.lag("_last").over(over)).withColumn("_n", F.row_number().over(over))
        .where(F.col("_n") > 1).select(*keys, "previous", "current")
    )
    return within.unionByName(across)

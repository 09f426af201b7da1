"""Token sums on the complete grid, reference fill, and grid-level aggregates.

The token pass is one hash aggregate with map-side combine. Everything after it
is grid sized. Series are kept as one row with arrays over bins until rows per
bin are wanted, so the join onto the grid moves series, not cells, and the
opened rows are already partitioned the way the window operators need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NO_RANDOM_EFFECT, name_missing, require_model_columns
from ..sources.storage import materialize
from . import design

CELL_KEYS = ("ran", "parent", "child", "treatment", "bin")


def known(x: Column) -> Column:
    """NaN to NULL, so that SQL aggregates skip it."""
    return F.when(~F.isnan(x), x)


def drop_missing(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("count").isNotNull() & ~F.isnan("count"))


def cell_sums(tokens: DataFrame) -> DataFrame:
    """One row per cell that has tokens: sum and number of non-missing tokens.

    Cells whose tokens are all missing stay (``n_tokens`` 0) because their
    levels still count. Groups and effects that are NULL are the level ``NA``.
    """
    effects = require_model_columns(tokens)
    value = known(F.col("count"))
    return name_missing(tokens, effects).groupBy("ran", "parent", "child", *effects, "bin").agg(
        F.sum(value).alias("total"), F.count(value).alias("n_tokens")
    )


def sums_levels(sums: DataFrame) -> tuple[DataFrame, list[str]]:
    """Levels and fixed effects of cell sums; the effects stand between ``child`` and ``bin``."""
    effects = sums.columns[sums.columns.index("child") + 1:sums.columns.index("bin")]
    return design.levels(sums, ["ran", "parent", "child", *effects]), effects


def bin_count(sums: DataFrame) -> int:
    """Number of bins = the largest bin seen; one aggregate, one number."""
    return int(sums.agg(F.max("bin")).first()[0])


def off_grid(sums: DataFrame, n_bins: int) -> DataFrame:
    """Cell sums that have no place on the grid: no bin, or one outside 1..n_bins."""
    return sums.where(F.col("bin").isNull() | ~F.col("bin").between(1, n_bins))


def fill_none(sums: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Reference fill per (parent, child, fixed effects, bin) from the observed cells."""
    _, effects = sums_levels(sums)
    total = F.col("total")
    return (
        sums.where(F.col("n_tokens") > 0)
        .groupBy(*extra, "parent", "child", *effects, "bin")
        .agg(
            F.round(F.round(F.expm1(F.avg(F.log1p(total))), 9), 0).alias("fill_log"),
            F.round(F.round(F.avg(total), 9), 0).alias("fill_mean"),
            F.count(F.lit(1)).alias("pool_size"),
        )
    )


def _on_bins(entries: Column, n_bins: int, field: str) -> Column:
    """Array over bins 1..n_bins from (bin, ...) structs; gaps become NULL."""
    straight = F.transform(F.array_sort(entries), lambda e: e[field])
    lookup = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["bin"], e[field])))
    gappy = F.transform(F.sequence(F.lit(1), F.lit(n_bins)), lambda b: F.try_element_at(lookup, b))
    return F.when(F.size(entries) == n_bins, straight).otherwise(gappy)


def series(tokens_or_sums: DataFrame, n_bins: int | None = None, log_fill: bool = True,
           strict: bool = False, leave_out: bool = False) -> DataFrame:
    """Every series of the complete grid: keys, fixed effects, ``n_tokens[]``, ``count[]``.

    Takes tokens or the result of :func:`cell_sums`. Sums made here are
    materialised, so the raw tokens are read exactly once.

    ``strict`` raises when a reference cell has nothing to be filled from;
    otherwise such cells stay NULL. Tokens off the grid raise, unless
    ``leave_out``: then :func:`off_grid` has them.
    """
    sums = tokens_or_sums
    if "n_tokens" not in sums.columns:
        sums = materialize(cell_sums(sums))
    if n_bins is None:
        n_bins = bin_count(sums)
    level_table, effects = sums_levels(sums)
    level_table = materialize(level_table)
    if not level_table.where((F.col("factor") == "ran") & (F.col("level") == NO_RANDOM_EFFECT)).isEmpty():
        raise ValueError(f"'{NO_RANDOM_EFFECT}' is reserved and cannot be a level of ran")
    if not leave_out and not off_grid(sums, n_bins).isEmpty():
        raise ValueError(f"tokens outside bins 1..{n_bins}; leave_out=True leaves them out, off_grid() returns them")
    out = on_grid(sums, design.series_grid(level_table, effects), effects, n_bins, log_fill)
    if strict:
        require_pools(out)
    return out


def on_grid(sums: DataFrame, frame: DataFrame, effects: list[str], n_bins: int, log_fill: bool = True,
            extra: tuple[str, ...] = ()) -> DataFrame:
    """Put cell sums on every series of ``frame`` and fill its reference series.

    Sums that :func:`off_grid` returns have no place here; :func:`series` raises on them first.
    """
    sums = sums.where(F.col("bin").between(1, n_bins))
    keys = [*extra, "ran", "parent", "child", *effects]
    reference_keys = [k for k in keys if k != "ran"]
    entries = F.collect_list(F.struct("bin", "total", "n_tokens"))
    seen = (
        sums.where(F.col("n_tokens") > 0)
        .groupBy(*keys)
        .agg(entries.alias("_entries"))
        .select(*keys, _on_bins(F.col("_entries"), n_bins, "n_tokens").alias("n_tokens"),
                _on_bins(F.col("_entries"), n_bins, "total").alias("count"))
    )
    fill = "fill_log" if log_fill else "fill_mean"
    filled = (
        fill_none(sums, extra)
        .groupBy(*reference_keys)
        .agg(F.collect_list(F.struct("bin", F.col(fill).alias("total"))).alias("_entries"))
        .select(*reference_keys, _on_bins(F.col("_entries"), n_bins, "total").alias("count"))
    )
    empty = F.array_repeat(F.lit(None).cast("double"), n_bins)
    no_tokens = F.array_repeat(F.lit(None).cast("bigint"), n_bins)
    names = [*extra, "ran", "parent", "child", "treatment", *effects]
    measured = frame.where(F.col("ran") != NO_RANDOM_EFFECT).join(seen, keys, "left").select(
        *names, F.coalesce("n_tokens", no_tokens).alias("n_tokens"), F.coalesce("count", empty).alias("count"),
    )
    reference = (
        frame.where(F.col("ran") == NO_RANDOM_EFFECT)
        .join(filled, reference_keys, "left")
        .select(*names, no_tokens.alias("n_tokens"), F.coalesce("count", empty).alias("count"))
    )
    return measured.unionByName(reference)


def require_pools(series_table: DataFrame) -> None:
    """Raise when any reference cell had no observed cell to be filled from."""
    gaps = (
        series_table.where(F.col("ran") == NO_RANDOM_EFFECT)
        .agg(F.sum(F.size(F.filter("count", lambda c: c.isNull()))).alias("n"))
        .first()["n"]
    )
    if gaps:
        raise ValueError(f"{gaps} reference cells have no observed cell to be filled from")


def open_bins(series_table: DataFrame) -> DataFrame:
    """Series to cells: one row per bin with n_tokens, count, count_log, observed."""
    rest = [c for c in series_table.columns if c not in ("n_tokens", "count")]
    return (
        series_table.select(*rest, F.posexplode(F.arrays_zip("n_tokens", "count")).alias("_b", "_v"))
        .select(
            *rest, (F.col("_b") + 1).alias("bin"), F.col("_v.n_tokens").alias("n_tokens"),
            F.col("_v.count").alias("count"), F.log1p(F.col("_v.count")).alias("count_log"),
            (F.col("_v.n_tokens").isNotNull() | (F.col("ran") == NO_RANDOM_EFFECT)).alias("observed"),
        )
    )


def cells(tokens_or_sums: DataFrame, n_bins: int | None = None, log_fill: bool = True,
          strict: bool = False, leave_out: bool = False) -> DataFrame:
    """The complete cell table (see :func:`open_bins` for its columns)."""
    return open_bins(series(tokens_or_sums, n_bins, log_fill, strict, leave_out))


def dispersion(cell_table: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Over-dispersion per (parent, child), over observed cells, reference cells included."""
    x = F.when(F.col("observed"), F.col("count"))
    stats = cell_table.groupBy(*extra_keys, "parent", "child").agg(
        F.avg(x).alias("mean"), F.var_pop(x).alias("var")
    )
    over = (F.col("var") / F.col("mean") - 1) / F.col("mean")
    return stats.withColumn("dispersion", F.when(F.col("var") > F.col("mean"), over).otherwise(F.lit(0.0)))


def log_means(cell_table: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean log count per (parent, child, treatment, bin) over every observed ran level."""
    return cell_table.groupBy(*extra_keys, "parent", "child", "treatment", "bin").agg(
        F.avg(F.when(F.col("observed"), F.col("count_log"))).alias("mean_log")
    )


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """NaN-skipping mean, population variance and population sd."""
    x = known(F.col(value))
    return df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("sd")
    )


def range_mean(df: DataFrame, keys: list[str], position: str, value: str, start: Column, stop: Column) -> DataFrame:
    """Mean of ``value`` where start <= position < stop; equal ends mean the single position."""
    p = F.col(position)
    inside = ((p >= start) & (p < stop)) | ((start == stop) & (p == start))
    return df.groupBy(*keys).agg(F.avg(F.when(inside, known(F.col(value)))).alias("range_mean"))


def residual_table(cell_table: DataFrame) -> DataFrame:
    """Mean, sample sd and variance of residuals, raw and log, for four groupings in one pass.

    Needs ``pred`` and ``pred_log``. Residual = predicted - observed.
    """
    whole = cell_table.where(
        F.col("count").isNotNull() & F.col("pred").isNotNull() & ~F.isnan("pred") & ~F.isnan("pred_log")
    ).select("ran", "treatment", "parent", "child",
             (F.col("pred") - F.col("count")).alias("r"), (F.col("pred_log") - F.col("count_log")).alias("rl"))
    sets = [[], ["ran"], ["treatment"], ["parent", "child"]]
    table = whole.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("ran"), F.col("treatment"), F.col("parent"), F.col("child")
    ).agg(
        F.grouping_id().alias("_g"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.var_samp("r").alias("variance"),
        F.avg("rl").alias("mean_log"), F.stddev_samp("rl").alias("sd_log"), F.var_samp("rl").alias("variance_log"),
    )
    # grouping id bits, high to low: ran, treatment, parent, child; a set bit = summed over
    label = (
        F.when(F.col("_g") == 15, F.lit("all"))
        .when(F.col("_g") == 7, F.concat(F.lit("ran_lvl_"), F.col("ran")))
        .when(F.col("_g") == 11, F.concat(F.lit("treatment_"), F.col("treatment")))
        .otherwise(F.concat_ws("_", "parent", "child"))
    )
    return table.withColumn("grouping", label).drop("_g")

"""Change points: consensus peaks of the averaged ratio curves, projected back to each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize
from . import windows
from .design import SERIES

GROUP = ["parent", "child"]
SCALES = ("r1", "r2", "r4")


def complete_series(cell_table: DataFrame, n_bins: int) -> DataFrame:
    """Rows of series in which every bin is observed and filled."""
    keep = Window.partitionBy(*SERIES)
    usable = F.col("observed") & F.col("count").isNotNull()
    return (
        cell_table.withColumn("_n", F.count(F.when(usable, 1)).over(keep))
        .where(F.col("_n") == n_bins)
        .drop("_n")
    )


def ratio_table(cell_table: DataFrame, n_bins: int, ws: int) -> DataFrame:
    """Ratio curves of every complete series."""
    kept = complete_series(cell_table, n_bins).select(*SERIES, "bin", "count_log")
    return windows.ratio_scales(kept, list(SERIES), "count_log", ws)


def mean_curves(ratios: DataFrame) -> DataFrame:
    """Average ratio curve per (parent, child, bin) at each scale."""
    return ratios.groupBy(*GROUP, "bin").agg(*[F.avg(r).alias(r) for r in SCALES])


def thresholds(curves: DataFrame, keys: list[str], columns: list[str], cutoff: float) -> DataFrame:
    """Outlier threshold per curve: mean + cutoff x population sd, as ``<column>_max``."""
    w = Window.partitionBy(*keys)
    return curves.select("*", *[
        (F.avg(c).over(w) + cutoff * F.stddev_pop(c).over(w)).alias(f"{c}_max") for c in columns
    ])


def _candidates(curves: DataFrame, keys: list[str], columns: list[str], ws: int, cutoff: float,
                position: str) -> DataFrame:
    """Positions above threshold and away from both ends: i (0-based), scale, v."""
    whole = Window.partitionBy(*keys)
    half = ws // 2
    i = F.col(position) - 1
    marked = thresholds(curves, keys, columns, cutoff).withColumn("_len", F.count(F.lit(1)).over(whole))
    opened = marked.select(*keys, i.alias("i"), "_len", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.col(c).alias("v"), F.col(f"{c}_max").alias("top"))
        for s, c in enumerate(columns)
    ])).alias("c"))
    return opened.where(
        (F.col("c.v") > F.col("c.top")) & (F.col("i") > half) & (F.col("i") < F.col("_len") - half)
    ).select(*keys, "i", "c.scale", "c.v")


def _fold_peaks(entries: Column, half: int) -> Column:
    """Scan candidates in order; within ``half`` of the last peak keep the larger value."""
    start = F.struct(
        F.array().cast("array<int>").alias("found"), F.lit(0).alias("last_i"),
        F.lit(0.0).alias("last_v"), F.lit(-1).alias("fired_at"),
    )

    def visit(s, c):
        apart = c["i"] - s["last_i"] > half
        fires = (c["i"] != s["fired_at"]) & (apart | (c["v"] > s["last_v"]))
        kept = F.when(apart | (F.size(s["found"]) == 0), s["found"]).otherwise(
            F.slice(s["found"], 1, F.size(s["found"]) - 1)
        )
        taken = F.struct(
            F.concat(kept, F.array(c["i"])).alias("found"), c["i"].alias("last_i"),
            c["v"].alias("last_v"), c["i"].alias("fired_at"),
        )
        return F.when(fires, taken).otherwise(s)

    return F.aggregate(entries, start, visit, lambda s: F.transform(s["found"], lambda i: i + 1))


def peaks(curves: DataFrame, keys: list[str], columns: list[str], ws: int, cutoff: float,
          position: str = "bin") -> DataFrame:
    """Change points (1-based) found on one curve or on several scales of it.

    With several columns each position tries them in order and the first that
    fires wins. Groups without a change point do not appear. A group holds at
    most n_bins x scales candidates.
    """
    found = _candidates(curves, keys, columns, ws, cutoff, position)
    entry = F.struct(F.col("i").cast("int").alias("i"), "scale", "v")
    return found.groupBy(*keys).agg(
        _fold_peaks(F.array_sort(F.collect_list(entry)), ws // 2).alias("points")
    )


#: Steps of a slope-limited alignment (symmetric, P = 1/2): rows and columns moved. Of equal costs the first step wins.
STEPS = [(1, 3), (1, 2), (1, 1), (2, 1), (3, 1)]


def _cost_rows(curve: Column, target: Column) -> Column:
    """Cheapest way to every (curve position, target position): rows of structs (cost, move), null where none leads.

    A step matches one cell for each row or column that it moves, the first at double weight. Cells that no
    path from corner to corner can visit are skipped.
    """
    last = F.size(target) - 1

    def gap(i, j):
        return F.abs(F.get(curve, i) - F.get(target, j))

    def cheapest(rows, i, j):
        options = []
        for move, (di, dj) in enumerate(STEPS):
            cost = F.get(F.get(rows, i - di), j - dj)["cost"]
            for t in reversed(range(max(di, dj))):
                g = gap(i - min(t, di - 1), j - min(t, dj - 1))
                cost = cost + (2 * g if t == max(di, dj) - 1 else g)
            options.append(F.struct(cost.alias("cost"), F.lit(move).alias("move")))
        return F.array_min(F.filter(F.array(*options), lambda o: o["cost"].isNotNull()))

    def next_row(rows, i):
        def cell(j):
            inside = (j <= 3 * i) & (i <= 3 * j) & (last - j <= 3 * (last - i)) & (last - i <= 3 * (last - j))
            return F.when(inside, cheapest(rows, i, j))

        return F.concat(rows, F.array(F.transform(F.sequence(F.lit(0), last), cell)))

    first = F.transform(F.sequence(F.lit(0), last), lambda j: F.when(
        j == 0, F.struct(gap(F.lit(0), F.lit(0)).alias("cost"), F.lit(None).cast("int").alias("move"))))
    after_first = F.slice(F.sequence(F.lit(0), last), F.lit(2), last + 1)
    return F.aggregate(after_first, F.array(first), next_row)


def matched_points(curve: Column, target: Column, points: Column) -> Column:
    """Mean positions (1-based, rounded half to even) on the curve that the target's points (1-based) are matched with.

    Curve and target are arrays of one length; a null of the curve counts as 1. Without a path, as with
    a null at a corner of the target, all are null. Two folds over the rows: one for the costs, one back along the moves.
    """
    last = F.size(target) - 1
    filled = F.transform(curve, lambda v: F.coalesce(F.nanvl(v, F.lit(1.0)), F.lit(1.0)))
    rows_moved, columns_moved = (F.array(*[F.lit(s[side]) for s in STEPS]) for side in (0, 1))
    start = F.struct(_cost_rows(filled, target).alias("rows"), last.alias("i"), last.alias("j"),
                     F.array().cast("array<struct<i:int,j:int>>").alias("cells"))

    def back(s, _):
        move = F.get(F.get(s["rows"], s["i"]), s["j"])["move"]
        di, dj = F.get(rows_moved, move), F.get(columns_moved, move)
        passed = F.transform(F.sequence(F.lit(0), F.greatest(di, dj) - 1), lambda t: F.struct(
            (s["i"] - F.least(t, di - 1)).alias("i"), (s["j"] - F.least(t, dj - 1)).alias("j")))
        return F.when(move.isNull(), s).otherwise(F.struct(
            s["rows"].alias("rows"), (s["i"] - di).alias("i"), (s["j"] - dj).alias("j"),
            F.concat(s["cells"], passed).alias("cells")))

    def means(s):
        corner = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))
        cells = F.when((s["i"] == 0) & (s["j"] == 0), F.concat(s["cells"], F.array(corner)))

        def mean(p):
            at = F.transform(F.filter(cells, lambda c: c["j"] == p - 1), lambda c: c["i"])
            total = F.aggregate(at, F.lit(0), lambda acc, i: acc + i)
            return F.when(F.size(at) > 0, F.rint(total / F.size(at) + 1)).cast("int")

        return F.transform(points, mean)

    return F.aggregate(F.sequence(F.lit(0), last), start, back, means)


def project(ratios: DataFrame, curves: DataFrame, points: DataFrame, n_bins: int, ws: int) -> DataFrame:
    """Consensus change points carried to every series, 0-based and clamped to [ws, n_bins - ws].

    The middle scale is aligned, a series at a time.
    """
    def along(df, keys, name):
        return df.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("bin", "r2"))), lambda e: e["r2"]).alias(name)
        )

    consensus = along(curves, GROUP, "target").join(points, GROUP)
    moved = along(ratios, SERIES, "curve").join(consensus, GROUP)
    matched = matched_points(F.col("curve"), F.col("target"), F.col("points"))
    return (
        moved.select(*SERIES, F.posexplode(matched).alias("k", "at"))
        .select(*SERIES, "k", clamp(F.col("at"), n_bins, ws).alias("bin0"))
    )


def clamp(at: Column, n_bins: int, ws: int) -> Column:
    """1-based to 0-based, kept within [ws, n_bins - ws]."""
    return F.least(F.greatest(at - 1, F.lit(ws)), F.lit(n_bins - ws))


def change_points(cell_table: DataFrame, n_bins: int, ws: int, cutoff: float) -> DataFrame:
    """Change points of every complete series: keys, k, bin0.

    Ratios and mean curves are each read twice, so both are materialised.
    """
    ratios = materialize(ratio_table(cell_table, n_bins, ws))
    curves = materialize(mean_curves(ratios))
    points = peaks(curves, GROUP, list(SCALES), ws, cutoff)
    return project(ratios, curves, points, n_bins, ws)


def degrees(series_change_points: DataFrame, groups: DataFrame) -> DataFrame:
    """Number of change points of every (parent, child) in ``groups``, 0 where none."""
    counted = series_change_points.groupBy(*GROUP).agg((F.max("k") + 1).alias("degree"))
    return groups.select(*GROUP).distinct().join(counted, GROUP, "left").select(
        *GROUP, F.coalesce("degree", F.lit(0)).alias("degree")
    )


def treatment_points(series_change_points: DataFrame) -> DataFrame:
    """Change points averaged over the ran levels that have one."""
    return series_change_points.groupBy(*GROUP, "treatment", "k").agg(
        F.avg("bin0").alias("point"), F.round(F.avg("bin0")).cast("int").alias("bin0")
    )


def buffered_merge(a: DataFrame, b: DataFrame, keys: list[str], point: str, gap: int) -> DataFrame:
    """Union of two point sets per key; a point is kept when more than ``gap`` after the last kept."""
    both = a.select(*keys, point).unionByName(b.select(*keys, point)).where(F.col(point) >= 1).distinct()
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.col(point).cast("int"))), F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap),
                              F.concat(acc, F.array(x))).otherwise(acc),
    )
    return both.groupBy(*keys).agg(kept.alias("points"))


def interval_index(points: Column, x: Column) -> Column:
    """Indices (0-based) of the sorted points on either side of x; -1 where there is none.

    Equal to a point counts as above it, and the lower side stays -1 when x
    equals it exactly while a higher point exists.
    """
    upper = F.size(F.filter(points, lambda p: p <= x))
    n = F.size(points)
    has_upper = upper < n
    below = F.get(points, upper - 1)
    lower = F.when(n == 0, -1).when(~has_upper, n - 1).when((upper > 0) & (x > below), upper - 1).otherwise(-1)
    return F.struct(lower.alias("lower"), F.when(has_upper, upper).otherwise(-1).alias("upper"))

"""Block rates, transitions, and their split into baseline and treatment effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash01
from ..schema import COMPONENTS, NO_RANDOM_EFFECT, REFERENCE, WARPS
from ..sources.storage import materialize
from .design import targets

PROFILE = ["parent", "child", "treatment"]


def profiles(log_mean_table: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Mean log count per (parent, child, treatment) as an array over bins (bounded by n_bins)."""
    entries = F.array_sort(F.collect_list(F.struct("bin", "mean_log")))
    return log_mean_table.groupBy(*extra, *PROFILE).agg(
        F.transform(entries, lambda e: e["mean_log"]).alias("profile")
    )


def _mean_between(profile: Column, start: Column, stop: Column) -> Column:
    """Mean of the known values at 0-based positions [start, stop); the one at start when equal."""
    part = F.filter(F.slice(profile, F.greatest(start, F.lit(0)) + 1, F.greatest(stop - start, F.lit(0))),
                    lambda v: v.isNotNull())
    total = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(start == stop, F.get(profile, start)).when(F.size(part) > 0, total / F.size(part))


def block_ranges(points: Column, n_bins: int) -> Column:
    """Half-open 0-based ranges of the blocks between change points.

    Later blocks start one bin before their change point and the last one ends
    one bin early; without change points one block covers every bin.
    """
    degree = F.size(points)
    return F.transform(
        F.sequence(F.lit(0), degree),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get(points, k - 1) - 1).alias("start"),
            F.when(degree == 0, F.lit(n_bins)).when(k == degree, F.lit(n_bins - 1))
            .otherwise(F.get(points, k)).alias("stop"),
        ),
    )


def _run_length(profile: Column, before: Column, after: Column, rise: Column, n_bins: int) -> Column:
    """Bins needed to complete the transition into block ``after``.

    Widen one bin forward, then one back, until the observed rise reaches
    ``rise`` or both blocks are used up.
    """
    at = after["start"]
    size_before, size_after = before["stop"] - before["start"], after["stop"] - after["start"]
    sign = F.when(rise < 0, -1.0).otherwise(1.0)
    start = F.struct(F.lit(0).alias("back"), F.lit(0).alias("ahead"), F.lit(0.0).alias("found"))

    def widen(s, turn):
        short = (s["found"] * sign < rise * sign) & ((s["back"] < size_before) | (s["ahead"] < size_after))
        seen = _mean_between(profile, at, at + s["ahead"]) - _mean_between(profile, at - s["back"], at)
        forward = turn % 2 == 0
        wider = F.struct(
            F.when(~forward & (s["back"] < size_before), s["back"] + 1).otherwise(s["back"]).alias("back"),
            F.when(forward & (s["ahead"] < size_after), s["ahead"] + 1).otherwise(s["ahead"]).alias("ahead"),
            seen.alias("found"),
        )
        return F.when(F.coalesce(short, F.lit(False)), wider).otherwise(s)

    turns = F.sequence(F.lit(0), F.lit(2 * n_bins + 2))
    return F.aggregate(turns, start, widen, lambda s: F.greatest(s["back"] + s["ahead"], F.lit(1)))


def block_estimates(profile_table: DataFrame, treatment_points: DataFrame, n_bins: int,
                    rise_threshold_factor: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per (parent, child, treatment): arrays points, bins, rates, runs.

    ``treatment_points`` are held fixed over the extra keys.
    """
    held = treatment_points.groupBy(*PROFILE).agg(
        F.array_sort(F.collect_list(F.struct("k", "point", "bin0"))).alias("_p")
    )
    none = F.array().cast("array<struct<k:int,point:double,bin0:int>>")
    base = profile_table.join(held, PROFILE, "left").select(
        *extra, *PROFILE, "profile", F.coalesce("_p", none).alias("_p")
    )
    base = base.select(
        *extra, *PROFILE, "profile", F.transform("_p", lambda p: p["point"]).alias("points"),
        F.transform("_p", lambda p: p["bin0"]).alias("bins"),
    ).withColumn("_blocks", block_ranges(F.col("bins"), n_bins))
    rated = base.withColumn(
        "rates", F.transform("_blocks", lambda b: _mean_between(F.col("profile"), b["start"], b["stop"]))
    )
    steps = F.when(F.size("bins") > 0, F.sequence(F.lit(1), F.size("bins"))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(steps, lambda k: _run_length(
        F.col("profile"), F.get("_blocks", k - 1), F.get("_blocks", k),
        (F.get("rates", k) - F.get("rates", k - 1)) * rise_threshold_factor, n_bins,
    ))
    return rated.select(*extra, *PROFILE, "points", "bins", "rates", runs.alias("runs"))


def slope_of_run(run: Column, min_slope: float) -> Column:
    return F.greatest(4.0 / run, F.lit(min_slope))


def component_values(estimates: DataFrame, min_slope: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Long form of block estimates: component (Rt, tslope, tpoint), k, value."""
    def entries(column, name, value=lambda x: x):
        return F.transform(column, lambda x, k: F.struct(
            F.lit(name).alias("component"), k.alias("k"), value(x).cast("double").alias("value")))

    parts = F.concat(
        entries("rates", "Rt"), entries("runs", "tslope", lambda r: slope_of_run(r, min_slope)),
        entries("points", "tpoint"),
    )
    return estimates.select(*extra, *PROFILE, F.explode(parts).alias("e")).select(*extra, *PROFILE, "e.*")


def split_effects(values: DataFrame, pairs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per-treatment values to baseline + additive effects (inclusion-exclusion over subsets).

    An effect is NULL when any value it depends on is missing.
    """
    y = values.select(*keys, F.col(value).alias("_y"), F.col("treatment").alias("_effect"))
    to = targets(pairs).withColumnRenamed("effect", "_effect")
    total = y.join(to, "_effect").groupBy(*keys, "treatment").agg(
        F.sum(F.col("sign") * F.col("_y")).alias("_b"), F.count("_y").alias("_have"), F.max("need").alias("_need"))
    return total.select(*keys, "treatment", F.when(F.col("_have") == F.col("_need"), F.col("_b")).alias(value))


def combine_effects(effects: DataFrame, pairs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Inverse of :func:`split_effects`: sum the effects that apply to each treatment."""
    b = effects.select(*keys, F.col(value).alias("_b"), F.col("treatment").alias("_effect"))
    to = pairs.select(F.col("effect").alias("_effect"), "treatment")
    return b.join(to, "_effect").groupBy(*keys, "treatment").agg(F.sum("_b").alias(value))


def initial_warps(ran_children: DataFrame, seed: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Uniform(-0.1, 0.1) start per (ran, child, kind), keyed by hash; ``none`` has no warp."""
    kinds = F.explode(F.array(*[F.lit(w) for w in WARPS]))
    return (
        ran_children.where(F.col("ran") != NO_RANDOM_EFFECT)
        .select(*extra, "ran", "child", kinds.alias("component"))
        .withColumn("value", -0.1 + 0.2 * hash01(seed, *extra, "ran", "child", "component"))
    )


def parameter_table(effects: DataFrame, warps: DataFrame, treatment_table: DataFrame,
                    extra: tuple[str, ...] = ()) -> DataFrame:
    """One named, indexed table of parameters.

    Order: component, parent, child, block or transition, treatment; then the
    warps by child, ran and kind. Offsets are summed per (component, parent,
    child), so no window spans the whole table.
    """
    def place(options, column):
        return F.array_position(F.array(*[F.lit(o) for o in options]), column).cast("int") - 1

    spot = F.concat(F.lit("Tns/Blk"), (F.col("k") + 1).cast("string"))
    named = F.when(
        F.col("treatment") == REFERENCE, F.concat_ws("_", F.lit("baseline"), "parent", "component", "child", spot)
    ).otherwise(F.concat_ws("_", F.lit("beta"), "component", "parent", "child", "treatment", F.lit("X"), spot))
    fixed = effects.join(treatment_table.select("treatment", "treatment_idx"), "treatment").select(
        *extra, F.when(F.col("treatment") == REFERENCE, "baseline").otherwise("beta").alias("kind"),
        "component", "parent", "child", F.lit(None).cast("string").alias("ran"), "treatment",
        F.col("k").cast("int").alias("k"), named.alias("name"), "value",
        place(COMPONENTS, F.col("component")).alias("_section"),
        F.lpad(F.col("k").cast("string"), 9, "0").alias("_o1"),
        F.col("treatment_idx").alias("_o2"),
    )
    random = warps.select(
        *extra, F.lit("wfactor").alias("kind"), "component", F.lit(None).cast("string").alias("parent"), "child",
        "ran", F.lit(None).cast("string").alias("treatment"), F.lit(None).cast("int").alias("k"),
        F.concat_ws("_", F.lit("wfactor"), "component", "ran", F.lit("X"), "child").alias("name"), "value",
        F.lit(len(COMPONENTS)).alias("_section"), F.col("ran").alias("_o1"),
        place(WARPS, F.col("component")).alias("_o2"),
    )
    # read for the counts and again for the rows
    rows = materialize(fixed.unionByName(random).withColumn("_parent", F.coalesce("parent", F.lit(""))))
    block = [*extra, "_section", "_parent"]
    counts = rows.groupBy(*block, "child").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*block).orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.groupBy(*block).agg(F.sum("_n").alias("_n"))
    # a few rows per component and parent
    earlier = Window.partitionBy(*(extra or [F.lit(0)])).orderBy("_section", "_parent").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        .join(heads.withColumn("_head", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), block)
        .withColumn("_offset", F.col("_in") + F.col("_head")).drop("_in", "_head")
    )
    inside = Window.partitionBy(*block, "child").orderBy("_o1", "_o2")
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, [*block, "child"])
        .select(*extra, (F.col("_offset") + F.col("_at")).alias("param_idx"), "kind", "component", "parent",
                "child", "ran", "treatment", "k", "name", "value")
    )

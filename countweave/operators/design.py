"""Levels, treatments and the complete bin x group grid.

Level lists are metadata: one array per factor, built by aggregation and opened
with ``explode``. The grid therefore needs no join at all, and is spread over
the cluster before its long axes are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_RANDOM_EFFECT, REFERENCE

SERIES = ("ran", "parent", "child", "treatment")
LEVELS_PER_BLOCK = 128


def levels(df: DataFrame, factors: list[str]) -> DataFrame:
    """Sorted distinct levels: factor, level, level_idx (0-based), is_ref."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in factors])
    found = df.select(F.explode(pairs).alias("p")).select("p.factor", "p.level").distinct()
    order = Window.partitionBy("factor").orderBy("level")
    return (
        found.where(F.col("level").isNotNull())
        .withColumn("level_idx", F.row_number().over(order) - 1)
        .withColumn("is_ref", F.col("level_idx") == 0)
    )


def level_counts(level_table: DataFrame) -> DataFrame:
    """How many levels each factor has, and whether they are enough for a fixed effect: factor, n_levels, enough."""
    n = F.count(F.lit(1))
    return level_table.groupBy("factor").agg(n.alias("n_levels"), (n >= 2).alias("enough"))


def check_fixed_effects(level_table: DataFrame, fixed_effects: list[str]) -> None:
    """Every fixed effect needs two levels or more. One row per factor reaches the driver."""
    found = level_counts(level_table.where(F.col("factor").isin(*fixed_effects))).where("enough").collect()
    thin = [f for f in fixed_effects if f not in {r["factor"] for r in found}]
    if thin:
        raise ValueError(f"fixed effects with fewer than 2 levels: {thin}")


def level_arrays(level_table: DataFrame, factors: list[str]) -> DataFrame:
    """One row; per factor a sorted array ``<factor>_levels``."""
    return level_table.groupBy().agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("factor") == f, F.col("level")))).alias(f"{f}_levels")
            for f in factors
        ]
    )


def _crossed_with(factor_idx: int, factor: str):
    """Extend one partial treatment by every level of a factor; its first level adds no component."""

    def extend(t):
        def with_level(level, j):
            added = {
                "factor_idx": F.lit(factor_idx), "level_idx": j,
                "components": F.concat(F.lit(factor + "="), level), "component_levels": level,
            }
            grown = [F.when(j > 0, F.concat(t[n], F.array(v))).otherwise(t[n]).alias(n) for n, v in added.items()]
            return F.struct(*grown, F.concat(t["values"], F.array(level)).alias("values"))

        return F.transform(F.col(f"{factor}_levels"), with_level)

    return extend


def _treatment_array(fixed_effects: list[str]) -> Column:
    """Ordered array of treatment structs, from the ``<factor>_levels`` arrays of one row."""
    empty = {
        "factor_idx": "array<int>", "level_idx": "array<int>", "components": "array<string>",
        "component_levels": "array<string>", "values": "array<string>",
    }
    partial = F.array(F.struct(*[F.array().cast(t).alias(n) for n, t in empty.items()]))
    for i, f in enumerate(fixed_effects):
        partial = F.flatten(F.transform(partial, _crossed_with(i, f)))
    # order: number of components, then which factors, then which levels
    named = F.transform(partial, lambda t: F.struct(
        F.size(t["components"]).alias("n_components"), t["factor_idx"].alias("factor_idx"),
        t["level_idx"].alias("level_idx"), t["components"].alias("components"),
        t["component_levels"].alias("component_levels"), t["values"].alias("values"),
        F.when(F.size(t["components"]) == 0, F.lit(REFERENCE))
        .otherwise(F.concat_ws("", t["component_levels"])).alias("treatment"),
    ))
    ordered = F.array_sort(named)
    names = F.transform(ordered, lambda t: t["treatment"])
    # joined level names can coincide; then spell out the components instead
    spelled = F.transform(ordered, lambda t: t.withField("treatment", F.when(
        F.size(t["components"]) == 0, F.lit(REFERENCE)).otherwise(F.concat_ws("*", t["components"]))))
    return F.when(F.size(F.array_distinct(names)) < F.size(names), spelled).otherwise(ordered)


def treatments(level_table: DataFrame, fixed_effects: list[str]) -> DataFrame:
    """All combinations of non-reference levels, ``ref`` first.

    Columns: treatment_idx, treatment, components (``factor=level`` strings),
    component_levels, then the value of every fixed-effect column.
    """
    arrays = level_arrays(level_table, fixed_effects)
    return arrays.select(F.posexplode(_treatment_array(fixed_effects)).alias("treatment_idx", "t")).select(
        "treatment_idx", "t.treatment", "t.components", "t.component_levels",
        *[F.col("t.values")[i].alias(f) for i, f in enumerate(fixed_effects)],
    )


def subsets(components: Column) -> Column:
    """All subsets of an array, smallest index pattern first."""
    start = F.array(F.slice(components, 1, 0))
    return F.aggregate(
        components, start,
        lambda acc, c: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(c)))),
    )


def effect_pairs(treatment_table: DataFrame) -> DataFrame:
    """Which effects apply to which treatment, with the inclusion-exclusion sign.

    An effect applies when its components are a subset of the treatment's. The
    subsets are opened and looked up by equality, so no pairwise test is needed.
    """
    effects = treatment_table.select(
        F.col("components").alias("_s"), F.col("treatment").alias("effect"), F.size("components").alias("_m")
    )
    listed = treatment_table.select(
        "treatment", F.size("components").alias("_n"), F.explode(subsets(F.col("components"))).alias("_s")
    )
    return listed.join(effects, "_s").select(
        "treatment", "effect",
        F.when((F.col("_n") - F.col("_m")) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"),
    )


def targets(pairs: DataFrame) -> DataFrame:
    """Per effect the treatments it takes part in: effect, treatment, sign, need (effects of that treatment).

    Joined by equality of the effect. ``pairs`` read from storage have a known size, so they are sent whole
    where they are small and shuffled like any table where the design is large.
    """
    counted = pairs.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("treatment")))
    return counted.select("effect", "treatment", "sign", "need")


def series_grid(level_table: DataFrame, fixed_effects: list[str]) -> DataFrame:
    """One row per (ran, parent, child, treatment), ``none`` included; no bins."""
    arrays = level_arrays(level_table, ["ran", "parent", "child", *fixed_effects])
    # one row becomes one row per block of ran x child levels; those are spread before they open
    blocks = (
        arrays.withColumn("treatments", _treatment_array(fixed_effects))
        .select("parent_levels", "treatments", "child_levels", F.posexplode(_blocks(
            F.concat(F.array(F.lit(NO_RANDOM_EFFECT)), F.col("ran_levels")))).alias("_r", "rans"))
        .select("parent_levels", "treatments", "_r", "rans",
                F.posexplode(_blocks(F.col("child_levels"))).alias("_c", "children"))
        .repartition("_r", "_c")
    )
    return (
        blocks.select("parent_levels", "treatments", "children", F.explode("rans").alias("ran"))
        .select("ran", "parent_levels", "treatments", F.explode("children").alias("child"))
        .select("ran", "child", "treatments", F.explode("parent_levels").alias("parent"))
        .select("ran", "parent", "child", F.explode("treatments").alias("t"))
        .select("ran", "parent", "child", "t.treatment",
                *[F.col("t.values")[i].alias(f) for i, f in enumerate(fixed_effects)])
    )


def _blocks(levels_: Column, size: int = LEVELS_PER_BLOCK) -> Column:
    """Cut an array into arrays of at most ``size``."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(levels_), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.slice(levels_, i, F.lit(size)))


def grid(level_table: DataFrame, fixed_effects: list[str], n_bins: int | Column) -> DataFrame:
    """Complete ran x parent x child x treatment x bin grid."""
    stop = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    return series_grid(level_table, fixed_effects).select(
        "*", F.explode(F.sequence(F.lit(1), stop)).alias("bin")
    )


def even_sequence(df: DataFrame, start: Column, stop: Column, length: int, integer: bool = False,
                  name: str = "x") -> DataFrame:
    """Open each row into ``length`` evenly spaced points; integer steps truncate."""
    if length < 2:
        raise ValueError("length must be at least 2")
    step = (stop - start) / F.lit(float(length - 1))
    if integer:
        step = F.when(step < 0, F.ceil(step)).otherwise(F.floor(step))
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i")).withColumn(
        name, start + F.col("i") * step
    )

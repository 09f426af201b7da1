"""Prediction, likelihood, constraints and penalty at series grain.

Model components are worked out once per series, joined to the series rows
(never to cells), and only then opened along the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model
from ..schema import COMPONENTS, NO_RANDOM_EFFECT, WARPS, ModelSettings
from . import cells, effects
from .design import SERIES

BAD_OBJECTIVE = 1e100
GROUP = ["parent", "child", "treatment"]


def _series_values(params: DataFrame, pairs: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """Per (parent, child, treatment): unwarped arrays Rt, tslope, tpoint."""
    fixed = params.where(F.col("kind") != "wfactor").select(
        *extra, "parent", "child", "component", "k", "treatment", "value"
    )
    summed = effects.combine_effects(fixed, pairs, [*extra, "parent", "child", "component", "k"])
    return summed.groupBy(*extra, *GROUP).agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("component") == c, F.struct("k", "value")))),
            lambda e: e["value"],
        ).alias(c)
        for c in COMPONENTS
    ])


def _series_warps(params: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """Per (ran, child): one column per warp kind."""
    return params.where(F.col("kind") == "wfactor").groupBy(*extra, "ran", "child").agg(*[
        F.max(F.when(F.col("component") == w, F.col("value"))).alias(f"w_{w}") for w in WARPS
    ])


def warped_series(series_keys: DataFrame, params: DataFrame, pairs: DataFrame, n_bins: int,
                  settings: ModelSettings, extra: tuple[str, ...] = ()) -> DataFrame:
    """Warped model components of every series (once per draw when ``extra`` names draws).

    ``series_keys`` may carry further columns; they are kept.
    """
    shared = [c for c in extra if c in series_keys.columns]
    with_values = series_keys.join(_series_values(params, pairs, extra), [*shared, *GROUP])
    joined = with_values.join(_series_warps(params, extra), [*extra, "ran", "child"], "left")
    bounds = {"Rt": ("rate", settings.unbounded), "tslope": ("slope", settings.unbounded),
              "tpoint": ("point", float(n_bins))}

    def warped(component: str) -> Column:
        kind, bound = bounds[component]
        w = F.when(F.col("ran") == NO_RANDOM_EFFECT, F.lit(0.0)).otherwise(F.col(f"w_{kind}"))
        return F.transform(component, lambda v: model.warp(v, bound, w))

    rest = [c for c in series_keys.columns if c not in extra]
    return joined.select(*extra, *rest, *[warped(c).alias(c) for c in COMPONENTS])


def predict(warped: DataFrame, n_bins: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Predicted log rate and rate on the complete grid, unobserved cells included."""
    return (
        warped.select(*extra, *SERIES, *COMPONENTS, F.explode(F.sequence(F.lit(1), F.lit(n_bins))).alias("bin"))
        .withColumn("pred_log", model.step_curve(F.col("bin").cast("double"), F.col("Rt"), F.col("tslope"), F.col("tpoint")))
        .withColumn("pred", F.expm1("pred_log"))
        .drop(*COMPONENTS)
    )


def with_dispersion(series_table: DataFrame, dispersion: DataFrame) -> DataFrame:
    """Attach the dispersion of (parent, child) to series rows."""
    on = [c for c in dispersion.columns if c in series_table.columns and c not in ("count", "n_tokens")]
    return series_table.join(dispersion.select(*on, "dispersion"), on)


def predicted_cells(series_table: DataFrame, params: DataFrame, pairs: DataFrame, n_bins: int,
                    settings: ModelSettings, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cells with their predictions; the joins move series rows, not cells.

    A ``dispersion`` column of the series is carried along.
    """
    carried = ["dispersion"] if "dispersion" in series_table.columns else []
    keyed = series_table.select(*SERIES, *carried, "n_tokens", "count")
    opened = cells.open_bins(warped_series(keyed, params, pairs, n_bins, settings, extra))
    return (
        opened.withColumn("pred_log", model.step_curve(
            F.col("bin").cast("double"), F.col("Rt"), F.col("tslope"), F.col("tpoint")))
        .withColumn("pred", F.expm1("pred_log"))
        .drop(*COMPONENTS)
    )


def likelihood(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Negative log likelihood over observed cells, per ``keys``.

    Needs ``dispersion`` on the cells (see :func:`with_dispersion`). Any
    negative, missing or infinite prediction makes it 1e100.
    """
    p = F.col("pred_log")
    bad = p.isNull() | F.isnan(p) | (p < 0) | (F.abs(p) == float("inf"))
    term = model.cell_log_likelihood(F.col("count_log"), p, F.col("dispersion"))
    rows = predicted.where(F.col("observed") & F.col("count").isNotNull()).select(
        *keys, F.when(~bad, term).alias("_term"))
    off = F.col("_term").isNull() | F.isnan("_term") | (F.abs("_term") == float("inf"))
    out = rows.groupBy(*keys).agg(
        F.sum(F.when(~off, -F.col("_term"))).alias("_nll"), F.bool_or(off).alias("_bad"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    value = F.when(F.col("_bad") | (F.col("_nll") > BAD_OBJECTIVE), F.lit(BAD_OBJECTIVE)).otherwise(F.col("_nll"))
    return out.select(*keys, value.alias("neg_loglik"), "n_cells")


def boundary_distances(warped: DataFrame, n_bins: int, buffer: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Distance of every series to each constraint: what (slope, gap, rate), k, distance.

    Slopes and rates must be positive; 0, the transition points and n_bins must
    keep ``buffer`` between neighbours. Undefined distances are 0.
    """
    d = F.col("d.distance")
    return warped.select(*extra, *SERIES, F.explode(_distances(n_bins, buffer)).alias("d")).select(
        *extra, *SERIES, "d.what", "d.k", d.alias("distance")
    )


KINDS = ("slope", "gap", "rate")


def _distances(n_bins: int, buffer: float) -> Column:
    """All distances of a warped series: slopes, then gaps, then rates, as (what, k, distance)."""
    def entries(column, what):
        return F.transform(column, lambda x, k: F.struct(
            F.lit(what).alias("what"), k.alias("k"),
            F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x).alias("distance")))

    ends = F.concat(F.array(F.lit(0.0)), F.col("tpoint"), F.array(F.lit(float(n_bins))))
    gaps = F.transform(F.sequence(F.lit(1), F.size("tpoint") + 1),
                       lambda k: F.get(ends, k) - F.get(ends, k - 1) - F.lit(buffer))
    some = F.size("tpoint") > 0
    parts = (F.col("tslope"), F.when(some, gaps).otherwise(F.array().cast("array<double>")), F.col("Rt"))
    return F.concat(*[entries(c, what) for c, what in zip(parts, KINDS)])


def _coefficient_arrays(coefficients: DataFrame) -> DataFrame:
    """Per series its penalty coefficients in the order of :func:`_distances`."""
    order = F.array_position(F.array(*[F.lit(w) for w in KINDS]), F.col("what"))
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), "k", "coefficient")))
    return coefficients.groupBy(*SERIES).agg(F.transform(entries, lambda e: e["coefficient"]).alias("_a"))


def crowded(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any transition point sits closer than the buffer."""
    return distances.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.when(F.col("what") == "gap", F.col("distance") < 0)), F.lit(False)).alias("crowded")
    )


def smallest_distance(distances: DataFrame, keys: list[str]) -> DataFrame:
    return distances.groupBy(*keys).agg(F.min("distance").alias("min_distance"))


def penalty_coefficients(start_distances: DataFrame, start_nll: DataFrame, factor: float,
                         extra: tuple[str, ...] = ()) -> DataFrame:
    """Coefficients that make the whole penalty ``factor`` x likelihood at the starting point.

    A distance that starts at 0 has none and adds no penalty.
    """
    n, nll = F.count(F.lit(1)), F.sum("neg_loglik")
    if extra:
        scale = start_distances.groupBy(*extra).agg(n.alias("_n")).join(
            start_nll.groupBy(*extra).agg(nll.alias("_nll")), list(extra))
        keyed, per_nll = start_distances.join(scale, list(extra)), F.col("_n") / (F.col("_nll") * factor)
    else:
        keyed = start_distances
        per_nll = start_distances.agg(n).scalar() / (start_nll.agg(nll).scalar() * factor)
    return keyed.select(
        *extra, *SERIES, "what", "k", F.try_divide(F.sqrt(per_nll), F.col("distance")).alias("coefficient")
    )


def penalties(distances: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Summed barrier penalty and smallest distance per ``keys``."""
    on = [c for c in coefficients.columns if c != "coefficient"]
    return distances.join(coefficients, on).groupBy(*keys).agg(
        F.sum(model.penalty(F.col("distance"), F.col("coefficient"))).alias("penalty"),
        F.min("distance").alias("min_distance"),
    )


def objective(nll: DataFrame, penalty_table: DataFrame, keys: list[str]) -> DataFrame:
    """Penalised objective = negative log likelihood + penalty."""
    return nll.join(penalty_table, keys).withColumn("objective", F.col("neg_loglik") + F.col("penalty"))


def feasible(predicted: DataFrame, distances: DataFrame, keys: list[str]) -> DataFrame:
    """No crowded transition points and no negative prediction anywhere on the grid."""
    p = F.col("pred_log")
    signs = predicted.groupBy(*keys).agg(
        F.bool_and(F.coalesce((p >= 0) & ~F.isnan(p), F.lit(False))).alias("nonnegative"))
    return signs.join(crowded(distances, keys), keys, "left").select(
        *keys, "nonnegative", F.coalesce("crowded", F.lit(False)).alias("crowded"),
        (F.col("nonnegative") & ~F.coalesce("crowded", F.lit(False))).alias("feasible"),
    )


def score_draws(series_table: DataFrame, draws: DataFrame, pairs: DataFrame, dispersion: DataFrame,
                coefficients: DataFrame, n_bins: int, settings: ModelSettings,
                draw_keys: tuple[str, ...] = ("draw_id",), by: tuple[str, ...] = ("child",)) -> DataFrame:
    """Likelihood, smallest distance and objective of many parameter sets at once.

    Facts that do not depend on the draw are joined to the series first. Then
    every (draw, series) is warped once, and one pass sums its penalty and its
    cells to (draw, child) before anything else touches them.
    """
    keyed = (
        with_dispersion(series_table, dispersion)
        .join(_coefficient_arrays(coefficients), list(SERIES))
        .select(*SERIES, "dispersion", "_a", "n_tokens", "count")
    )
    warped = warped_series(keyed, draws, pairs, n_bins, settings, draw_keys)
    d = F.transform(_distances(n_bins, settings.buffer(n_bins)), lambda e: e["distance"])
    charged = warped.withColumn("_d", d).withColumn(
        "_penalty", F.aggregate(F.zip_with("_d", "_a", model.penalty), F.lit(0.0),
                                lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    ).withColumn("_least", F.array_min("_d")).drop("_d", "_a")
    keys = [*draw_keys, *by]
    p, first = F.col("_p"), F.col("bin") == 1
    used = F.col("observed") & F.col("count").isNotNull()
    usable = (p >= 0) & ~F.isnan(p) & (p < float("inf"))
    term = F.when(used & usable, model.cell_log_likelihood(F.col("count_log"), p, F.col("dispersion")))
    rows = cells.open_bins(charged).withColumn("_p", model.step_curve(
        F.col("bin").cast("double"), F.col("Rt"), F.col("tslope"), F.col("tpoint"))).select(
        *keys, F.when(first, F.col("_penalty")).alias("_penalty"), F.when(first, F.col("_least")).alias("_least"),
        used.alias("_used"), term.alias("_term"))
    off = F.col("_used") & (F.col("_term").isNull() | F.isnan("_term"))
    totals = rows.groupBy(*keys).agg(
        F.sum(F.when(~off, -F.col("_term"))).alias("_nll"), F.bool_or(off).alias("_bad"),
        F.sum("_penalty").alias("penalty"), F.min("_least").alias("min_distance"))
    nll = F.when(F.col("_bad") | (F.col("_nll") > BAD_OBJECTIVE), F.lit(BAD_OBJECTIVE)).otherwise(F.col("_nll"))
    return totals.select(*keys, nll.alias("neg_loglik"), "penalty", "min_distance").withColumn(
        "objective", F.col("neg_loglik") + F.col("penalty"))

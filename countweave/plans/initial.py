"""From cells to the first parameter table (no fit yet)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, changepoints, curve, design, effects
from ..schema import NO_RANDOM_EFFECT, ModelSettings
from ..sources.storage import materialize


@dataclass
class InitialModel:
    """Tables of a model before fitting."""

    n_bins: int
    settings: ModelSettings
    sums: DataFrame
    levels: DataFrame
    treatments: DataFrame
    pairs: DataFrame
    series: DataFrame
    cells: DataFrame
    dispersion: DataFrame
    change_points: DataFrame
    treatment_points: DataFrame
    estimates: DataFrame
    params: DataFrame


def build(tokens: DataFrame, settings: ModelSettings, n_bins: int | None = None, strict: bool = False) -> InitialModel:
    """Run every step up to the initial parameters.

    Tables read by several later steps are materialised: the token sums, the
    design, the series, the change points and the parameters.
    """
    sums = materialize(cells.cell_sums(tokens))
    n_bins = n_bins or cells.bin_count(sums)
    level_table, fixed = cells.sums_levels(sums)
    level_table = materialize(level_table)
    design.check_fixed_effects(level_table, fixed)
    treatment_table = materialize(design.treatments(level_table, fixed))
    pairs = materialize(design.effect_pairs(treatment_table))
    series = materialize(cells.series(sums, n_bins, strict=strict))
    cell_table = cells.open_bins(series)
    points = materialize(
        changepoints.change_points(cell_table, n_bins, settings.window(n_bins), settings.cutoff)
    )
    at = changepoints.treatment_points(points)
    estimates = effects.block_estimates(
        effects.profiles(cells.log_means(cell_table)), at, n_bins, settings.rise_threshold_factor
    )
    params = materialize(initial_parameters(estimates, series, treatment_table, pairs, settings))
    return InitialModel(
        n_bins, settings, sums, level_table, treatment_table, pairs, series, cell_table,
        cells.dispersion(cell_table), points, at, estimates, params,
    )


def initial_parameters(estimates: DataFrame, series: DataFrame, treatment_table: DataFrame, pairs: DataFrame,
                       settings: ModelSettings, extra: tuple[str, ...] = ()) -> DataFrame:
    values = effects.component_values(estimates, settings.min_initial_slope, extra)
    split = effects.split_effects(values, pairs, [*extra, "parent", "child", "component", "k"])
    warps = effects.initial_warps(series.select(*extra, "ran", "child").distinct(), settings.rng_seed, extra)
    return effects.parameter_table(split, warps, treatment_table, extra)


def start_coefficients(model: InitialModel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Warped series, cells with predictions, and penalty coefficients at the initial parameters."""
    keyed = model.series.select("ran", "parent", "child", "treatment")
    warped = curve.warped_series(keyed, model.params, model.pairs, model.n_bins, model.settings)
    ready = curve.with_dispersion(model.series, model.dispersion)
    predicted = curve.predicted_cells(ready, model.params, model.pairs, model.n_bins, model.settings)
    nll = curve.likelihood(predicted, ["child"])
    distances = curve.boundary_distances(warped, model.n_bins, model.settings.buffer(model.n_bins))
    coefficients = curve.penalty_coefficients(
        distances, nll, model.settings.max_penalty_at_distance_factor
    )
    return warped, predicted, coefficients

"""The whole run: tokens in, fitted model with draws, statistics and residuals out."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, curve, diagnostics, effects, fit, resample, stats
from ..schema import ChainSettings, ModelSettings, Variables, select_model_columns
from ..sources.storage import materialize
from . import initial


@dataclass
class FittedModel:
    """Named result tables; ``start`` holds the model before fitting."""

    start: initial.InitialModel
    params: DataFrame
    predicted: DataFrame
    draws: DataFrame
    draw_diagnostics: DataFrame
    stats: DataFrame
    residuals: DataFrame
    chain_draws: DataFrame | None = None
    chain_diagnostics: DataFrame | None = None
    alpha: float = 0.05
    extra: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        s = self.start
        out = {
            "cells": self.predicted, "params": self.params, "dispersion": s.dispersion, "levels": s.levels,
            "treatments": s.treatments, "effect_pairs": s.pairs, "change_points": s.change_points,
            "draws": self.draws, "draw_diagnostics": self.draw_diagnostics, "stats": self.stats,
            "residuals": self.residuals, "reference_pools": cells.fill_none(s.sums),
            "settings": settings_table(self.params.sparkSession, s.settings, s.n_bins),
            "recommended_draws": stats.recommended_draws(self.params, self.alpha).withColumn(
                "actual_draws", self.draws.agg(F.countDistinct("draw_id")).scalar()),
            **self.extra,
        }
        if self.chain_draws is not None:
            out |= {"chain_draws": self.chain_draws, "chain_diagnostics": self.chain_diagnostics}
        return out


def settings_table(spark: SparkSession, settings: ModelSettings, n_bins: int) -> DataFrame:
    """Settings of a model, one row each: name, value as text."""
    rows = [(f.name, str(getattr(settings, f.name))) for f in dataclasses.fields(settings)] + [("n_bins", str(n_bins))]
    return spark.createDataFrame(rows, "name string, value string")


def _prepared(start: initial.InitialModel, series: DataFrame, dispersion: DataFrame, params: DataFrame,
              replicate: bool = False) -> fit.Problems:
    """Problems at feasible starts, with their penalty."""
    return fit.with_penalty(fit.make_feasible(fit.problems(
        series, dispersion, params, start.pairs, start.n_bins, start.settings, replicate)))


def full_fit(start: initial.InitialModel) -> tuple[DataFrame, fit.Problems]:
    """Fit of the full data, one row per parameter, and its problems at the fit."""
    ready = _prepared(start, start.series, start.dispersion, start.params)
    fits = fit.fit(ready)
    return materialize(fit.fitted_params(ready, fits)), ready.at(fits)


def bootstrap_fits(tokens: DataFrame, start: initial.InitialModel, replicates: int) -> DataFrame:
    """Resample, re-estimate everything but degrees and change points, and fit each replicate."""
    _, fixed = cells.sums_levels(start.sums)
    resampled = materialize(resample.bootstrap_sums(tokens, replicates, start.settings.rng_seed, start.sums))
    series = materialize(
        resample.bootstrap_series(resampled, start.levels, fixed, start.n_bins, replicates))
    params, dispersion = reestimate(start, series)
    ready = _prepared(start, series, dispersion, params, True)
    return materialize(fit.fitted_params(ready, fit.fit(ready)))


def reestimate(start: initial.InitialModel, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parameters and dispersion of every replicate, change points held fixed."""
    rep = ("replicate",)
    opened = cells.open_bins(series)
    estimates = effects.block_estimates(
        effects.profiles(cells.log_means(opened, rep), rep), start.treatment_points, start.n_bins,
        start.settings.rise_threshold_factor, rep)
    params = initial.initial_parameters(estimates, series, start.treatments, start.pairs, start.settings, rep)
    return materialize(params), materialize(cells.dispersion(opened, rep))


def draws_of_fits(fits: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Long draws and one diagnostics row per draw; the full-data fit is marked."""
    full = (F.col("replicate") == fit.FULL_FIT).alias("is_full_fit")
    draws = fits.select(F.lit(source).alias("source"), F.col("replicate").alias("draw_id"), full, "param_idx", "value")
    per_child = fits.select("replicate", "child", "status", "objective", "neg_loglik", "evals").distinct()
    # a replicate counts as converged only when every child's fit did
    worst = F.when(F.bool_and(F.col("status") == stats.CONVERGED), stats.CONVERGED).otherwise(
        F.max(F.when(F.col("status") != stats.CONVERGED, F.col("status"))))
    diag = per_child.groupBy("replicate").agg(
        worst.alias("status"), F.sum("objective").alias("objective"), F.sum("neg_loglik").alias("neg_loglik"),
        F.sum("evals").alias("evals"))
    return draws, diag.select(F.lit(source).alias("source"), F.col("replicate").alias("draw_id"), full, "status",
                              "objective", "neg_loglik", "evals")


def chain_tables(walk: DataFrame, fits: DataFrame, burnin: int = 0) -> tuple[DataFrame, DataFrame]:
    """Draws and diagnostics of chains joined over children, with the full fit as marked row."""
    draw = (F.col("chain") * F.lit(1_000_000_000) + F.col("draw_id")).cast("bigint")
    base, base_diag = draws_of_fits(fits, "chain")
    draws = walk.where(F.col("draw_id") >= burnin).select(
        F.lit("chain").alias("source"), draw.alias("draw_id"), F.lit(False).alias("is_full_fit"), "param_idx", "value"
    ).unionByName(base)
    per_child = walk.where(F.col("draw_id") >= burnin).select(
        draw.alias("draw_id"), "child", "objective", "neg_loglik", "acceptance", "proposals").distinct()
    diag = per_child.groupBy("draw_id").agg(
        F.sum("objective").alias("objective"), F.sum("neg_loglik").alias("neg_loglik"),
        F.avg("acceptance").alias("acceptance"), F.max("proposals").alias("proposals"))
    diag = diag.select(F.lit("chain").alias("source"), "draw_id", F.lit(False).alias("is_full_fit"), "objective",
                       "neg_loglik", "acceptance", "proposals")
    full = base_diag.select("source", F.col("draw_id").cast("bigint").alias("draw_id"), "is_full_fit", "objective",
                            "neg_loglik", F.lit(1.0).alias("acceptance"), F.lit(0).cast("bigint").alias("proposals"))
    return draws, diag.unionByName(full)


def run(data: DataFrame, variables: Variables | dict | None = None, settings: ModelSettings | None = None,
        bootstraps: int = 0, chain: ChainSettings | None = None, n_chains: int = 1, use_median: bool = False,
        converged_only: bool = True, alpha: float = 0.05, method: str = "holm",
        n_bins: int | None = None) -> FittedModel:
    """Fit the model to raw observations.

    Draws come from the bootstrap when ``bootstraps`` > 0, from the chains
    otherwise; at least one of the two must be asked for.
    """
    settings = settings or ModelSettings()
    if bootstraps <= 0 and chain is None:
        raise ValueError("ask for bootstraps, a chain, or both")
    tokens = select_model_columns(data, variables)
    start = initial.build(tokens, settings, n_bins)
    fits, at_fit = full_fit(start)
    chain_draws = chain_diag = None
    if chain is not None:
        walk = materialize(fit.chains(
            at_fit, chain.steps + chain.burnin, chain.neighbor_filter, chain.step_size, chain.prior, n_chains))
        chain_draws, chain_diag = chain_tables(walk, fits, chain.burnin)
    if bootstraps > 0:
        boot = bootstrap_fits(tokens, start, bootstraps)
        draws, diag = draws_of_fits(fits.unionByName(boot), "bootstrap")
        used = stats.keep_converged(draws, diag, converged_only=converged_only)
        seen = stats.convergence(diag).first()
        if converged_only and not seen["enough"]:
            warnings.warn(f"only {seen['share']:.0%} of {seen['draws']} fits converged; all draws are used", stacklevel=2)
    else:
        draws, diag, used = chain_draws, chain_diag, chain_draws
    estimates = stats.median_values(draws) if use_median else stats.full_fit_values(draws)
    estimates = materialize(estimates)
    params = start.params.drop("value").join(
        estimates.select("param_idx", F.col("estimate").alias("value")), "param_idx")
    predicted = materialize(curve.predicted_cells(start.series, params, start.pairs, start.n_bins, settings))
    summary = materialize(stats.summary(used, params, estimates, alpha, method))
    extra = {
        "residual_groups": diagnostics.residual_groups(predicted),
        "rate_count": diagnostics.rate_count(predicted),
        "effect_histograms": diagnostics.effect_histograms(used, params),
        "parameter_rows": diagnostics.parameter_rows(params, summary, used),
        "objective_traces": diagnostics.objective_traces(diag),
    }
    if bootstraps > 0 and chain is not None:
        both = materialize(draws.unionByName(chain_draws))
        extra |= {f"compared_{name}": t for name, t in diagnostics.compare_sources(both).items()}
    return FittedModel(start, params, predicted, draws, diag, summary, cells.residual_table(predicted), chain_draws,
                       chain_diag, alpha, extra)

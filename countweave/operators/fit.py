"""Fitting: feasible starts, fits and chains of every (replicate, child) problem.

The objective is a sum over children, so each has a vector of its own; all are moved together, step by step, by
:mod:`descent` and :mod:`walk`, with values and gradients from :mod:`objective`. Rows are problems
and series; nothing of a child is gathered but its parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ModelSettings
from ..sources.storage import materialize
from . import descent, objective, walk
from .objective import FULL_FIT, PROBLEM  # noqa: F401

FEASIBLE_AT = 0.01


@dataclass(frozen=True)
class Problems:
    """``params``: parameters with their places; ``series``: the data; ``points``: where each problem stands (x, warp, prior_on)."""

    params: DataFrame
    series: DataFrame
    points: DataFrame
    n_bins: int
    settings: ModelSettings

    def at(self, points: DataFrame) -> "Problems":
        """The same problems at other vectors x."""
        return replace(self, points=materialize(self.points.drop("x").join(points.select(*PROBLEM, "x"), PROBLEM)))


def problems(series: DataFrame, dispersion: DataFrame, params: DataFrame, pairs: DataFrame, n_bins: int, settings: ModelSettings,
             replicate: bool = False) -> Problems:
    """The tables of a fit, from a model's series, dispersion and parameters."""
    own = materialize(objective.problem_params(params, replicate))
    data = materialize(objective.spread(objective.problem_series(series, dispersion, own, pairs, replicate)))
    points = objective.vectors(own, warp=F.col("kind") == "wfactor",
                               prior_on=~((F.col("kind") == "baseline") & (F.col("component") == "tpoint")))
    return Problems(own, data, materialize(points), n_bins, settings)


def make_feasible(p: Problems) -> Problems:
    """Move starts that break a constraint inside; where that fails they stay.

    The summed squared shortfall of all distances is brought down until each is at least FEASIBLE_AT; unlike the smallest
    distance it is smooth and adds up over series. Warps are held at first: a large one flattens every
    point onto its bound, and there is no way back from there.
    """
    def on(series: DataFrame) -> descent.Evaluate:
        return lambda trials, ids: objective.shortfall(series, trials, p.n_bins, p.settings, ids, 2 * FEASIBLE_AT)

    def moved(points: DataFrame, state: DataFrame) -> DataFrame:
        series = materialize(p.series.join(points.select(*PROBLEM), PROBLEM, "left_semi"))
        return descent.descend(state, on, series, 0.0, p.settings.max_evals, FEASIBLE_AT**2)

    hold = F.transform("warp", lambda w: F.when(w, F.lit(0.0)).otherwise(F.lit(1.0)))
    state = descent.begin(p.points.select(*PROBLEM, "x", hold.alias("free")), on(p.series))
    outside = materialize(state.where((F.col("least") < 0) | F.col("negative")))
    if outside.isEmpty():
        return p
    first = moved(outside, outside)
    inside = first.where("least > 0").select(*PROBLEM, "x")
    still = materialize(p.points.join(first.where("NOT least > 0").select(*PROBLEM), PROBLEM, "left_semi"))
    if not still.isEmpty():
        free = F.transform("x", lambda _: F.lit(1.0))
        state = descent.begin(still.select(*PROBLEM, "x", free.alias("free")), on(p.series))
        second = moved(still, state)
        inside = inside.unionByName(second.where("least > 0").select(*PROBLEM, "x"))
    found = p.points.select(*PROBLEM, F.col("x").alias("x0")).join(inside, PROBLEM, "left")
    return p.at(found.select(*PROBLEM, F.coalesce("x", "x0").alias("x")))


def with_penalty(p: Problems) -> Problems:
    """Series with penalty coefficients that weigh every distance alike where the problems stand.

    Their scale is the replicate's: of its total likelihood and number of distances. A distance that starts at 0 has none.
    """
    at = materialize(objective.start_distances(p.series, p.points, p.n_bins, p.settings).drop("x"))
    bare = at.withColumn("coefficients", F.transform("distances", lambda _: F.lit(None).cast("double")))
    nll = objective.penalised(bare, p.points.withColumn("trial", F.lit(0)), p.n_bins, p.settings, [*PROBLEM, "trial"], gradient=False)
    sizes = at.groupBy("replicate").agg(F.sum(F.size("distances")).alias("n"))
    scales = nll.groupBy("replicate").agg(F.least(F.sum("neg_loglik"), F.lit(objective.BAD_OBJECTIVE)).alias("nll")).join(sizes, "replicate") \
        .select("replicate", F.sqrt(F.col("n") / (F.col("nll") * p.settings.max_penalty_at_distance_factor)).alias("scale"))
    charged = at.join(scales, "replicate").withColumn(
        "coefficients", F.transform("distances", lambda d: F.try_divide(F.col("scale"), d))).drop("distances", "scale")
    return replace(p, series=materialize(objective.spread(charged)))


def value_and_gradient(p: Problems) -> DataFrame:
    """Objective, likelihood, smallest distance and gradient where the problems stand: a row per parameter."""
    found = objective.penalised(p.series, p.points.withColumn("trial", F.lit(0)), p.n_bins, p.settings, [*PROBLEM, "trial"])
    opened = found.select(*PROBLEM, "value", "neg_loglik", "least", F.explode("g").alias("e")).select(
        *PROBLEM, F.col("value").alias("objective"), "neg_loglik", F.col("least").alias("min_distance"), "e.place", F.col("e.share").alias("slope"))
    return p.params.drop("value").join(opened, [*PROBLEM, "place"]).drop("place")


def fit(p: Problems) -> DataFrame:
    """Minimise the penalised objective of every problem (see :func:`with_penalty`).

    One row per problem: x, value, neg_loglik, least, status, evals.
    """
    def on(series: DataFrame) -> descent.Evaluate:
        return lambda trials, ids: objective.penalised(series, trials, p.n_bins, p.settings, ids)

    state = descent.begin(p.points.select(*PROBLEM, "x"), on(p.series))
    return descent.descend(state, on, p.series, p.settings.ctol, p.settings.max_evals).select(
        *PROBLEM, "x", "value", "neg_loglik", "least", "status", "evals")


def fitted_params(p: Problems, fits: DataFrame) -> DataFrame:
    """Fits as one row per parameter: replicate, child, param_idx, value, status, objective, neg_loglik, evals."""
    opened = fits.select(*PROBLEM, "status", F.col("value").alias("objective"), "neg_loglik", "evals", F.posexplode("x").alias("place", "at"))
    return p.params.select(*PROBLEM, "place", "param_idx").join(opened, [*PROBLEM, "place"]).select(
        *PROBLEM, "param_idx", F.col("at").alias("value"), "status", "objective", "neg_loglik", "evals")


def chains(p: Problems, steps: int, every: int, step_size: float, prior_sd: float, n_chains: int = 1) -> DataFrame:
    """Draws of independent chains from where the problems stand (usually the full-data fit), one row per parameter.

    Children walk separately: the posterior is a product over them. Step lengths are set by the start.
    """
    def on(trials: DataFrame, ids: list[str]) -> DataFrame:
        return objective.penalised(p.series, trials, p.n_bins, p.settings, ids, gradient=False)

    at = on(p.points.withColumn("trial", F.lit(0)), [*PROBLEM, "trial"]).select(*PROBLEM, (F.col("value") - F.col("neg_loglik")).alias("penalty"))
    length = F.transform("x", lambda v: step_size * (F.abs(v) + 1.0) / (F.greatest("penalty", F.lit(0.0)) + 1.0))
    starts = p.points.join(at, PROBLEM).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_chains - 1))).alias("chain"), *PROBLEM, "x", length.alias("length"), "prior_on")
    draws = walk.walk(materialize(starts), on, p.settings.rng_seed, steps, every, prior_sd)
    opened = draws.select("chain", "child", "draw_id", F.posexplode("x").alias("place", "at"), F.col("value").alias("objective"),
                          "neg_loglik", "acceptance", "proposals")
    return p.params.select("child", "place", "param_idx").join(opened, ["child", "place"]).select(
        "chain", "child", "draw_id", "param_idx", F.col("at").alias("value"), "objective", "neg_loglik", "acceptance", "proposals")

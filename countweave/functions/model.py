"""The step-curve model, its densities and its penalty, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import log_gamma

LOG_2PI = math.log(2 * math.pi)


def warp_ratio(basis: Column, bound, w: Column) -> Column:
    return -F.expm1(-(w * w) * basis / bound)


def warp(value: Column, bound, w: Column) -> Column:
    """Pull a value toward its bound (w > 0) or toward zero (w < 0); w = 0 leaves it."""
    bound = F.lit(float(bound)) if not isinstance(bound, Column) else bound
    up = value + warp_ratio(value, bound, w) * (bound - value)
    down = value - warp_ratio(bound - value, bound, w) * value
    return F.when(w > 0, up).otherwise(down)


def warp_checked(value: Column, bound, w: Column) -> Column:
    """:func:`warp` that refuses values above the bound."""
    limit = F.lit(float(bound)) if not isinstance(bound, Column) else bound
    return F.when(value > limit, F.raise_error(F.lit("value must be less than or equal to its bound")).cast("double")
                  ).otherwise(warp(value, limit, w))


def logistic(x: Column) -> Column:
    """Overflow-safe logistic function."""
    small = F.exp(-F.abs(x))
    return F.when(x > 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def step_curve(position: Column, rates: Column, slopes: Column, points: Column) -> Column:
    """Rates joined by logistic steps; the first infinite later rate is returned as is."""
    steps = F.sequence(F.lit(1), F.size(points))
    total = F.aggregate(
        F.when(F.size(points) > 0, steps).otherwise(F.array().cast("array<int>")),
        rates[0],
        lambda acc, k: acc + (F.get(rates, k) - F.get(rates, k - 1))
        * logistic(F.get(slopes, k - 1) * (position - F.get(points, k - 1))),
    )
    infinite = F.get(F.filter(F.slice(rates, 2, F.greatest(F.size(rates) - 1, F.lit(0))),
                              lambda r: F.abs(r) == float("inf")), F.lit(0))
    return F.coalesce(infinite, total)


def normal_density(x, mu, sd) -> Column:
    return F.exp(normal_log_kernel(x, mu, sd)) / (math.sqrt(2 * math.pi) * sd)


def normal_log_density(x, mu, sd) -> Column:
    return normal_log_kernel(x, mu, sd) - F.ln(2 * math.pi * sd * sd) / 2


def normal_log_kernel(x, mu, sd) -> Column:
    """Log density up to its peak, which is 0."""
    return -((x - mu) * (x - mu)) / (2.0 * sd * sd)


def gamma_log_density(x, mean, variance) -> Column:
    shape, rate = mean * mean / variance, mean / variance
    return shape * F.ln(rate) + (shape - 1.0) * F.ln(x) - rate * x - log_gamma(shape)


def gamma_density(x, mean, variance) -> Column:
    return F.exp(gamma_log_density(x, mean, variance))


def poisson_log_density(x, rate) -> Column:
    return x * F.ln(rate) - rate - log_gamma(x + 1.0)


def poisson_density(x, rate) -> Column:
    return F.exp(poisson_log_density(x, rate))


def beta_log_density(x, shape) -> Column:
    """Beta density with both shapes equal, in logs."""
    return (shape - 1.0) * (F.ln(x) + F.ln(1.0 - x)) - (2.0 * log_gamma(shape) - log_gamma(2.0 * shape))


def gamma_poisson_log(y: Column, mean: Column, variance: Column) -> Column:
    """Log probability of y when a Poisson rate is itself gamma distributed; NULL without variance."""
    shape, rate = F.try_divide(mean * mean, variance), F.try_divide(mean, variance)
    return (
        shape * F.ln(rate) + log_gamma(y + shape)
        - log_gamma(y + 1.0) - log_gamma(shape) - (y + shape) * F.log1p(rate)
    )


def gamma_poisson(y: Column, mean: Column, variance: Column) -> Column:
    return F.exp(gamma_poisson_log(y, mean, variance))


def log1p_variance(variance: Column, mean: Column) -> Column:
    """First-order variance of log(x + 1)."""
    return variance / ((mean + 1.0) * (mean + 1.0))


def cell_log_likelihood(count_log: Column, pred_log: Column, dispersion: Column) -> Column:
    """Log likelihood of one observed cell; NULL-safe inputs are the caller's duty."""
    rate = F.expm1(pred_log)
    spread = log1p_variance(rate + dispersion * rate * rate, rate)
    return gamma_poisson_log(count_log, pred_log, spread)


def penalty(distance: Column, coefficient: Column) -> Column:
    """Inverse-square barrier; non-positive distances count as 1e-30."""
    x = F.when(distance <= 0, F.lit(1e-30)).otherwise(distance)
    return 1.0 / ((coefficient * x) * (coefficient * x))

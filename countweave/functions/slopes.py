"""Derivatives of the step-curve model as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import model
from .special import STIRLING, log_gamma, polynomial
from .vectors import places


def digamma(x: Column, inv: Column) -> Column:
    """Derivative of log Gamma(x) for x > 0: shift by eight, then the Stirling series. ``inv`` is 1 / (x + 8)."""
    series = inv * inv * polynomial(inv * inv, [(2 * i + 1) * c for i, c in enumerate(STIRLING)])
    shifts = reduce(lambda acc, k: acc + 1.0 / (x + float(k)), range(1, 8), 1.0 / x)
    return F.ln(x + 8.0) - 0.5 * inv - series - shifts


def warps(values: Column, bound: float, w: Column) -> Column:
    """Warped values ``v`` with their derivatives by the value, ``dv``, and by the warp, ``dw``."""
    rate, up = w * w / bound, w > 0
    less = lambda x: F.expm1(F.when(up, -rate * x).otherwise(-rate * (bound - x)))

    def parts(e: Column) -> Column:
        v, room, gone, grown = e["x"], bound - e["x"], e["e"], 1.0 + e["e"]
        return F.struct(
            F.when(up, v - gone * room).otherwise(v + gone * v).alias("v"),
            (grown + rate * grown * F.when(up, room).otherwise(v)).alias("dv"),
            (2.0 * w / bound * v * room * grown * F.when(up, 1.0).otherwise(-1.0)).alias("dw"))
    return F.transform(F.transform(values, lambda x: F.struct(x.alias("x"), less(x).alias("e"))), parts)


def curve(position: Column, rates: Column, slopes: Column, points: Column) -> Column:
    """The step curve from arrays of warped values (fields ``v``)."""
    v = lambda a, k: F.get(a, k)["v"]
    return F.aggregate(places(F.size(points)), v(rates, F.lit(0)), lambda acc, k: acc + (
        v(rates, k + 1) - v(rates, k)) * model.logistic(v(slopes, k) * (position - v(points, k))))


def cells(observed: Column, dispersion: Column) -> Column:
    """Minus the log likelihood of observed cells (at, y, r), ``value``, and its derivative by the prediction r, ``slope``.

    Both NULL where the likelihood does not exist: no positive finite prediction, or one without variance. Each
    transform is a stage of the formula, so that nothing is worked out twice.
    """
    def means(c: Column) -> Column:
        exists = (c["r"] > 0) & (c["r"] < 700.0) & (dispersion >= 0) & (c["y"] >= 0)
        return F.struct(c["at"].alias("at"), c["y"].alias("y"), F.when(exists, c["r"]).alias("r"), F.expm1(c["r"]).alias("p"))

    def variances(c: Column) -> Column:
        p, d = c["p"], dispersion
        return F.struct(c["at"].alias("at"), c["y"].alias("y"), c["r"].alias("r"),
                        ((p + d * p * p) / ((p + 1.0) * (p + 1.0))).alias("v"),
                        ((1.0 - p + 2.0 * d * p) / ((p + 1.0) * (p + 1.0))).alias("dv"))

    def shapes(c: Column) -> Column:
        r, v, dv = c["r"], c["v"], c["dv"]
        return F.struct(c["at"].alias("at"), c["y"].alias("y"), (r * r / v).alias("s"), (r / v).alias("q"),
                        (2.0 * r / v - r * r * dv / (v * v)).alias("ds"), (1.0 / v - r * dv / (v * v)).alias("dq"))

    def sums(c: Column) -> Column:
        t = c["y"] + c["s"]
        return F.struct(*[c[n].alias(n) for n in ("at", "y", "s", "q", "ds", "dq")], t.alias("t"), F.ln(c["q"]).alias("lq"),
                        F.log1p(c["q"]).alias("l1"), (1.0 / (t + 8.0)).alias("it"), (1.0 / (c["s"] + 8.0)).alias("is"))

    def terms(c: Column) -> Column:
        y, s, q, t = c["y"], c["s"], c["q"], c["t"]
        value = s * c["lq"] + log_gamma(t) - log_gamma(y + 1.0) - log_gamma(s) - t * c["l1"]
        by_s = c["lq"] + digamma(t, c["it"]) - digamma(s, c["is"]) - c["l1"]
        return F.struct(c["at"].alias("at"), (-value).alias("value"), (-(by_s * c["ds"] + (s / q - t / (q + 1.0)) * c["dq"])).alias("slope"))

    staged = observed
    for stage in (means, variances, shapes, sums, terms):
        staged = F.transform(staged, stage)
    return staged

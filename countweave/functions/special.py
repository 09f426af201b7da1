"""Special functions as Column expressions (no Python on rows)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Stirling series for log-gamma, 1/(12x), -1/(360x^3), ...
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]

# Wichura's AS241 (PPND16) rational approximations of the normal quantile.
PPND_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
          4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
PPND_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
          3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
PPND_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
          1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
PPND_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
PPND_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
          2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
PPND_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]

# Hart's rational approximation of the normal tail, as published by West (2005).
TAIL_P = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
          221.213596169931, 220.206867912376]
TAIL_Q = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
          637.333633378831, 793.826512519948, 440.413735824752]


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """c0 + c1 x + c2 x^2 + ... by Horner's rule."""
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: shift by eight, then the Stirling series."""
    z = x + 8.0
    shifted = reduce(lambda acc, k: acc * (x + float(k)), range(1, 8), x)
    inv = 1.0 / z
    series = inv * polynomial(inv * inv, STIRLING)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(shifted)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""
    q = p - 0.5
    near = 0.180625 - q * q
    centre = q * polynomial(near, PPND_A) / polynomial(near, PPND_B)
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p)))
    mid, far = r - 1.6, r - 5.0
    tail = F.when(r <= 5, polynomial(mid, PPND_C) / polynomial(mid, PPND_D)).otherwise(
        polynomial(far, PPND_E) / polynomial(far, PPND_F)
    )
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -tail).otherwise(tail))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, about 1e-15 absolute."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    p, q = polynomial(a, TAIL_P[::-1]), polynomial(a, TAIL_Q[::-1])
    fraction = reduce(lambda acc, k: a + F.lit(float(k)) / acc, (4, 3, 2, 1), a + 0.65)
    tail = F.when(a < 7.07106781186547, bell * p / q).otherwise(bell / fraction / math.sqrt(2 * math.pi))
    return F.when(x > 0, 1.0 - tail).otherwise(tail)

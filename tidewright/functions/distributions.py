"""Gamma, chi-square and normal distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

#: Lanczos coefficients for g = 7. Fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Coefficients of a public rational approximation of the normal quantile. Fixed values.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TERMS = 200


def lgamma(z: Column) -> Column:
    """log gamma for z > 0."""
    x = z - 1
    total = sum((F.lit(c) / (x + i) for i, c in enumerate(LANCZOS) if i), F.lit(LANCZOS[0]))
    w = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(w) - w + F.log(total)


def _scale(a: Column, x: Column) -> Column:
    return F.exp(-x + a * F.log(x) - lgamma(a))


def gamma_series(a: Column, x: Column) -> Column:
    """P(a, x) by its series; for x < a + 1."""
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda s, i: bound(s["term"] * x / (a + i), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))))
    return F.when(x <= 0, 0.0).otherwise(done["sum"] * _scale(a, x))


def gamma_fraction(a: Column, x: Column) -> Column:
    """Q(a, x) by its continued fraction; for x >= a + 1."""
    tiny = 1e-300
    near = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    b = x + 1 - a
    start = F.struct(b.alias("b"), F.lit(1 / tiny).alias("c"), (1 / near(b)).alias("d"), (1 / near(b)).alias("h"))

    def step(s: Column, i: Column) -> Column:
        an = -i * (i - a)
        nb = s["b"] + 2
        d, c = near(an * s["d"] + nb), near(nb + an / s["c"])
        return bound(F.struct(c.alias("c"), (1 / d).alias("d")), lambda t: F.struct(nb.alias("b"), t["c"].alias("c"), t["d"].alias("d"), (s["h"] * t["c"] * t["d"]).alias("h")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["h"] * _scale(a, x)


def gammp(a: Column, x: Column) -> Column:
    return F.when(x <= 0, 0.0).when(x < a + 1, gamma_series(a, x)).otherwise(1 - gamma_fraction(a, x))


def gammq(a: Column, x: Column) -> Column:
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - gamma_series(a, x)).otherwise(gamma_fraction(a, x))


def chi2_sf(x: Column, df: Column) -> Column:
    return gammq(df / 2, x / 2)


def norm_cdf(z: Column) -> Column:
    tail = lambda z: bound(z * z / 2, lambda x: 0.5 * gammq(F.lit(0.5), x))
    return bound(z, lambda z: bound(tail(z), lambda t: F.when(z >= 0, 1 - t).otherwise(t)))


def _poly(cs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out


def norm_ppf_raw(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    middle = _poly(PPF_A, r) * q / (_poly(PPF_B, r) * r + 1)
    tail = lambda u: bound(F.sqrt(-2 * F.log(u)), lambda t: _poly(PPF_C, t) / (_poly(PPF_D, t) * t + 1))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)


def norm_ppf_step(x: Column, p: Column) -> Column:
    """One step of Halley's method."""
    return bound((norm_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))


def norm_ppf(p: Column) -> Column:
    return bound(p, lambda p: bound(bound(norm_ppf_raw(p), lambda x: norm_ppf_step(x, p)), lambda x: norm_ppf_step(x, p)))

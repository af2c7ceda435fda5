"""Lag polynomials and state-space matrices as array columns; orders are Python numbers, coefficients are columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import both, bound, dot, each, lyapunov, madd, mmul, msym, mtrans, solve, maug, msub, meye, upto


def polymul(a: Column, b: Column) -> Column:
    """Product of dense polynomials, constant first."""

    def product(a: Column, b: Column) -> Column:
        na, nb = F.size(a), F.size(b)
        return each(na + nb - 1, lambda k: F.aggregate(F.filter(upto(na), lambda i: (i <= k) & (k - i < nb)), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, k - i)))

    return both(a, b, product)


def short_poly(c: Column, sign: float) -> Column:
    return F.concat(F.array(F.lit(1.0)), F.transform(c, lambda x: x * sign))


def seasonal_poly(c: Column, s: int, sign: float) -> Column:
    """1 + sign * sum c_i L**(i s)."""
    gap = F.array(*[F.lit(0.0)] * (s - 1)) if s > 1 else F.array().cast("array<double>")
    return F.concat(F.array(F.lit(1.0)), F.flatten(F.transform(c, lambda x: F.concat(gap, F.array(x * sign)))))


def expand_ar(phi: Column, sphi: Column, s: int) -> Column:
    """Coefficients 1.. of the reduced autoregression."""
    return F.transform(bound(polymul(short_poly(phi, -1.0), seasonal_poly(sphi, s, -1.0)), lambda p: F.slice(p, F.lit(2), F.size(p) - 1)), lambda x: -x)


def expand_ma(theta: Column, stheta: Column, s: int) -> Column:
    return bound(polymul(short_poly(theta, 1.0), seasonal_poly(stheta, s, 1.0)), lambda p: F.slice(p, F.lit(2), F.size(p) - 1))


def difference_poly(d: int, sd: int, s: int) -> list[float]:
    """Coefficients of (1 - L)**d (1 - L**s)**sd."""
    out = [1.0]
    for gap, times in ((1, d), (s, sd)):
        for _ in range(times):
            out = [a - b for a, b in zip(out + [0.0] * gap, [0.0] * gap + out, strict=True)]
    return out


def split_params(params: Column, r: int, p: int, q: int, sp: int, sq: int) -> Column:
    """A struct of the blocks beta, phi, theta, sphi, stheta and sigma2."""
    at, parts = 1, []
    for name, n in (("beta", r), ("phi", p), ("theta", q), ("sphi", sp), ("stheta", sq)):
        parts.append(F.slice(params, at, n).alias(name))
        at += n
    return F.struct(*parts, F.get(params, F.lit(at - 1)).alias("sigma2"))


def k_states(p: int, q: int, sp: int, sq: int, s: int) -> int:
    return max(p + s * sp, q + s * sq + 1)


def kdiff(d: int, sd: int, s: int) -> int:
    return d + s * sd


def build_z(k: int, d: int = 0, sd: int = 0, s: int = 1) -> Column:
    """Observation row; k is the size of the ARMA block."""
    n = kdiff(d, sd, s)
    ones = {*range(d), *(d + (g + 1) * s - 1 for g in range(sd)), n}
    return F.array(*[F.lit(1.0 if i in ones else 0.0) for i in range(n + k)])


def build_t(ar: Column, k: int, d: int = 0, sd: int = 0, s: int = 1) -> Column:
    """Transition: the companion matrix, behind differencing states if there are any."""
    n = kdiff(d, sd, s)
    ones = {(n + i, n + i + 1) for i in range(k - 1)}
    tops = [d + g * s for g in range(sd)]
    for i in range(d):
        ones |= {(i, j) for j in range(i, d)} | {(i, x + s - 1) for x in tops} | {(i, n)}
    for g, x in enumerate(tops):
        ones |= {(x, y + s - 1) for y in tops[g : g + 2]} | {(x, n)} | {(i, i - 1) for i in range(x + 1, x + s)}
    w = n + k
    return F.array(*[F.coalesce(F.get(ar, F.lit(i - n)), F.lit(0.0)) if j == n and i >= n else F.lit(1.0 if (i, j) in ones else 0.0) for i in range(w) for j in range(w)])


def build_r(ma: Column, k: int, n: int = 0) -> Column:
    """Selection: n zeros, 1, the moving-average coefficients, zeros."""
    return F.array(*[F.lit(0.0)] * n, F.lit(1.0), *[F.coalesce(F.get(ma, F.lit(i)), F.lit(0.0)) for i in range(k - 1)])


def build_rqr(r: Column, sigma2: Column, k: int) -> Column:
    return each(k * k, lambda x: F.get(r, F.floor(x / k).cast("int")) * sigma2 * F.get(r, x % k))


def trend_values(degrees: tuple[int, ...], tau: Column, start: int, n: int) -> Column:
    """sum tau_g t**g for t = start .. start + n - 1."""
    return F.transform(F.sequence(F.lit(start), F.lit(start + n - 1)), lambda t: sum((F.get(tau, F.lit(i)) * F.pow(t.cast("double"), F.lit(float(g))) for i, g in enumerate(degrees)), F.lit(0.0)))


def p1_of(t: Column, rqr: Column, k: int) -> Column:
    """Stationary variance of an ARMA block."""
    return lyapunov(t, rqr, k)


def a1_of(t: Column, k: int, c1: Column) -> Column:
    """(I - T)**-1 e1 c1."""
    rhs = F.array(c1, *[F.lit(0.0)] * (k - 1))
    return solve(maug(msub(meye(k), t), rhs, k, 1), k, 1)["x"]


def partial_step(r: Column) -> Column:
    """Durbin-Levinson: partial autocorrelations to coefficients."""
    return F.aggregate(r, F.array().cast("array<double>"), lambda y, x: F.array_append(F.zip_with(y, F.reverse(y), lambda a, b: a + x * b), x))


def constrain_block(u: Column, sign: float) -> Column:
    return F.transform(partial_step(F.transform(u, lambda x: x / F.sqrt(1 + x * x))), lambda x: x * sign)


def unconstrain_block(c: Column, sign: float) -> Column:
    """The inverse; a null element outside the region."""

    def step(state: Column, _: Column) -> Column:
        y = state["y"]
        last = F.element_at(y, -1)
        head = F.slice(y, F.lit(1), F.size(y) - 1)
        body = F.zip_with(head, F.reverse(head), lambda a, b: F.try_divide(a - last * b, 1 - last * last))
        return F.struct(body.alias("y"), F.array_prepend(state["r"], last).alias("r"))

    start = F.struct(F.transform(c, lambda x: x * sign).alias("y"), F.array().cast("array<double>").alias("r"))
    return F.transform(F.aggregate(c, start, step)["r"], lambda r: F.when(F.abs(r) < 1, r / F.sqrt(1 - r * r)))


def transform_params(u: Column, front: int, p: int, q: int, sp: int, sq: int, concentrate: bool = False, back: bool = False) -> Column:
    """Free to valid parameters, or with `back` the inverse."""
    f = unconstrain_block if back else constrain_block
    parts, at = [F.slice(u, 1, front)], front + 1
    for n, sign in ((p, -1.0), (q, 1.0), (sp, -1.0), (sq, 1.0)):
        if n:
            parts.append(f(F.slice(u, at, n), sign))
            at += n
    if not concentrate:
        v = F.get(u, F.lit(at - 1))
        parts.append(F.array(F.sqrt(v) if back else v * v))
    return F.concat(*parts)


def filter_array(y: Column, t: Column, rqr: Column, p1: Column, k: int) -> Column:
    """The Kalman filter over an array of observations (null: missing), in the JVM: an array of (v, f)."""

    def step(state: Column, obs: Column) -> Column:
        a, p = state["a"], state["p"]
        f = F.get(p, F.lit(0))
        v = obs - F.get(a, F.lit(0))

        def moved(tp: Column) -> Column:
            g = lambda i: F.get(tp, i * k)
            gain = F.coalesce(F.try_divide(v, f), F.lit(0.0))
            a2 = each(k, lambda i: dot(lambda j: F.get(t, i * k + j), lambda j: F.get(a, j), k) + g(i) * gain)
            row, col = (lambda x: F.floor(x / k).cast("int")), (lambda x: x % k)
            less = lambda x: F.when(v.isNull(), F.lit(0.0)).otherwise(F.try_divide(g(row(x)) * g(col(x)), f))
            spread = mmul(tp, mtrans(t, k, k), k, k, k)
            p2 = madd(bound(spread, lambda m: each(k * k, lambda x: F.get(m, x) - less(x))), rqr)
            return F.struct(a2.alias("a"), msym(p2, k).alias("p"), F.array_append(state["out"], F.struct(v.alias("v"), f.alias("f"))).alias("out"))

        return bound(mmul(t, p, k, k, k), moved)

    start = F.struct(F.array(*[F.lit(0.0)] * k).alias("a"), p1.alias("p"), F.array().cast("array<struct<v:double,f:double>>").alias("out"))
    return F.aggregate(y, start, step)["out"]

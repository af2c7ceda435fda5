"""Matrices as row-major arrays of doubles, in higher-order functions: no UDF, so plans stay in the JVM.

Sizes are Python numbers or integer columns. Inner sums run in index order, so results repeat bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = int | Column


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a: Column, b: Num) -> Column:
    return F.floor(a / _c(b)).cast("int")


def upto(n: Num) -> Column:
    """0 .. n-1, empty for 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(_c(n).cast("int") - 1, F.lit(0))), lambda i: i < _c(n))


def each(n: Num, f: Callable[[Column], Column]) -> Column:
    return F.transform(upto(n), lambda i: f(i))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def both(x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of x and y, each evaluated once: a cell's lambda would evaluate them for every cell."""
    return bound(x, lambda a: bound(y, lambda b: f(a, b)))


def mget(a: Column, i: Num, j: Num, n: Num) -> Column:
    """Element (i, j), from 1."""
    return F.get(a, (_c(i) - 1) * _c(n) + _c(j) - 1)


def mzeros(m: Num, n: Num) -> Column:
    return each(_c(m) * _c(n), lambda i: F.lit(0.0))


def meye(n: Num) -> Column:
    return each(_c(n) * _c(n), lambda i: F.when(_div(i, n) == i % _c(n), 1.0).otherwise(0.0))


def madd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def msub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mscale(a: Column, c: Column | float) -> Column:
    return F.transform(a, lambda x: x * (c if isinstance(c, Column) else F.lit(float(c))))


def mtrans(a: Column, m: Num, n: Num) -> Column:
    """m x n to n x m."""
    return bound(a, lambda a: each(_c(m) * _c(n), lambda i: F.get(a, (i % _c(m)) * _c(n) + _div(i, m))))


def msym(p: Column, k: Num) -> Column:
    """(P + P') / 2."""
    return bound(p, lambda p: each(_c(k) * _c(k), lambda i: (F.get(p, i) + F.get(p, (i % _c(k)) * _c(k) + _div(i, k))) * 0.5))


def dot(a: Callable[[Column], Column], b: Callable[[Column], Column], n: Num) -> Column:
    """Sum of a(i) * b(i), in order."""
    return F.aggregate(upto(n), F.lit(0.0), lambda acc, i: acc + a(i) * b(i))


def mmul(a: Column, b: Column, m: Num, k: Num, n: Num) -> Column:
    """A (m x k) times B (k x n)."""
    return both(a, b, lambda a, b: each(_c(m) * _c(n), lambda x: dot(lambda i: F.get(a, _div(x, n) * _c(k) + i), lambda i: F.get(b, i * _c(n) + x % _c(n)), k)))


def mkron(a: Column, b: Column, ma: Num, na: Num, mb: Num, nb: Num) -> Column:
    w = _c(na) * _c(nb)
    return both(a, b, lambda a, b: each(_c(ma) * _c(mb) * w, lambda x: F.get(a, _div(_div(x, w), mb) * _c(na) + _div(x % w, nb)) * F.get(b, (_div(x, w) % _c(mb)) * _c(nb) + (x % w) % _c(nb))))


def mvec(a: Column, m: Num, n: Num) -> Column:
    """Columns of A, stacked."""
    return mtrans(a, m, n)


def munvec(v: Column, m: Num, n: Num) -> Column:
    return mtrans(v, n, m)


def maug(a: Column, b: Column, n: Num, nrhs: Num) -> Column:
    """[A | B], row by row."""
    w = _c(n) + _c(nrhs)
    return both(a, b, lambda a, b: each(_c(n) * w, lambda x: F.when(x % w < _c(n), F.get(a, _div(x, w) * _c(n) + x % w)).otherwise(F.get(b, _div(x, w) * _c(nrhs) + x % w - _c(n)))))


def solve(aug: Column, n: Num, nrhs: Num) -> Column:
    """Gauss-Jordan with partial pivoting on [A | B]: a struct (x, pivmin, ok); ok is false for a pivot of at most 1e-12."""
    w = _c(n) + _c(nrhs)

    def step(state: Column, c: Column) -> Column:
        def at(m: Column, i: Column, j: Column) -> Column:
            return F.get(m, i * w + j)

        def eliminated(m: Column, best: Column) -> Column:
            piv, row = best["size"], -best["neg"]

            def swapped(i: Column, j: Column) -> Column:
                return F.when(i == c, at(m, row, j)).when(i == row, at(m, c, j)).otherwise(at(m, i, j))

            def cell(x: Column) -> Column:
                i, j = _div(x, w), x % w
                head = swapped(c, j) / swapped(c, c)
                return F.when(i == c, head).otherwise(swapped(i, j) - swapped(i, c) * head)

            out = F.when(piv < 1e-300, m).otherwise(each(_c(n) * w, cell))
            return F.struct(out.alias("m"), F.least(state["pivmin"], piv).alias("pivmin"))

        best = F.array_max(F.transform(F.filter(upto(n), lambda i: i >= c), lambda i: F.struct(F.abs(at(state["m"], i, c)).alias("size"), (-i).alias("neg"))))
        return bound(best, lambda b: eliminated(state["m"], b))

    start = F.struct(aug.alias("m"), F.lit(float("inf")).alias("pivmin"))
    done = F.aggregate(upto(n), start, step)
    return bound(done, lambda s: F.struct(each(_c(n) * _c(nrhs), lambda x: F.get(s["m"], _div(x, nrhs) * w + _c(n) + x % _c(nrhs))).alias("x"), s["pivmin"].alias("pivmin"), (s["pivmin"] > 1e-12).alias("ok")))


def inverse(a: Column, n: Num) -> Column:
    return solve(maug(a, meye(n), n, n), n, n)


def lyapunov(t: Column, q: Column, k: Num) -> Column:
    """P = T P T' + Q, from (I - T kron T) vec(P) = vec(Q)."""
    kk = _c(k) * _c(k)
    left = msub(meye(kk), mkron(t, t, k, k, k, k))
    return munvec(solve(maug(left, mvec(q, k, k), kk, 1), kk, 1)["x"], k, k)


def pivots(a: Column, n: Num) -> Column:
    """Absolute pivots of elimination with partial pivoting, in order."""

    def step(state: Column, c: Column) -> Column:
        m = state["m"]
        best = F.array_max(F.transform(F.filter(upto(n), lambda i: i >= c), lambda i: F.struct(F.abs(F.get(m, i * _c(n) + c)).alias("size"), (-i).alias("neg"))))

        def next_(b: Column) -> Column:
            row = -b["neg"]

            def old(i: Column, j: Column) -> Column:
                return F.get(m, F.when(i == c, row).when(i == row, c).otherwise(i) * _c(n) + j)

            def cell(x: Column) -> Column:
                i, j = _div(x, n), x % _c(n)
                return F.when(i <= c, old(i, j)).otherwise(old(i, j) - old(i, c) / old(c, c) * old(c, j))

            return F.struct(F.when(b["size"] > 0, each(_c(n) * _c(n), cell)).otherwise(m).alias("m"), F.array_append(state["p"], b["size"]).alias("p"))

        return bound(best, next_)

    return F.aggregate(upto(n), F.struct(a.alias("m"), F.array().cast("array<double>").alias("p")), step)["p"]

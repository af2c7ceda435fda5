"""The Kalman filter in parallel over time.

A range of times is an element: what it makes of the filtered state x before it, whatever that is. Given x, the state after the range has mean A x + b and variance C; the
range's observations give x the information J and the vector eta; logs and ssq are their parts of the likelihood at x = 0. Elements are found by an
ordinary filter that starts from a known x and carries A along, and two neighbours make one element (`joined`), in any order of joining. So a
likelihood is one pass over all ranges at once and a few small joins, and a second pass can replay every range from its own start.

Within a range the same is done on lanes: stretches of some hundred steps that numpy takes side by side, so a step's cost is shared.
The first range starts from the model's initial state (A = 0), and only there observations are burnt in.

The state is the plain one, seen through design(): in the shifted basis a known state would already hold the next observation.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from math import isqrt

import numpy as np

from ..functions import kernel as K


@dataclass
class Element:
    """Arrays with the same leading axes; k is the state's size."""

    n: np.ndarray
    logs: np.ndarray
    ssq: np.ndarray
    bad: np.ndarray
    a: np.ndarray  # k x k
    b: np.ndarray  # k
    c: np.ndarray  # k x k
    eta: np.ndarray  # k
    j: np.ndarray  # k x k

    def at(self, i) -> Element:
        return Element(*[getattr(self, f.name)[i] for f in fields(self)])

    def flat(self) -> np.ndarray:
        """(.., numbers)"""
        lead = self.n.shape
        return np.concatenate([getattr(self, f.name).reshape(*lead, -1) for f in fields(self)], axis=-1)

    @classmethod
    def of(cls, flat: np.ndarray, k: int) -> Element:
        lead, out, i = flat.shape[:-1], [], 0
        for shape in ((), (), (), (), (k, k), (k,), (k, k), (k,), (k, k)):
            size = int(np.prod(shape))
            out.append(flat[..., i : i + size].reshape((*lead, *shape)))
            i += size
        return cls(*out)


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _turned(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def joined(one: Element, two: Element) -> Element:
    """The element of a range and the one after it."""
    k = one.b.shape[-1]
    inner = np.eye(k) + one.c @ two.j
    with np.errstate(all="ignore"):
        g = np.linalg.solve(inner, np.broadcast_to(np.eye(k), inner.shape))
        logs = np.linalg.slogdet(inner)[1]
    p = g @ one.c
    p = (p + _turned(p)) * 0.5
    e = _times(_turned(g), two.eta)
    m = _turned(g) @ two.j
    m = (m + _turned(m)) * 0.5
    at = _turned(one.a)
    mb = _times(m, one.b)
    ssq = one.ssq + two.ssq - (two.eta * _times(p, two.eta)).sum(-1) - 2 * (e * one.b).sum(-1) + (one.b * mb).sum(-1)
    return Element(
        one.n + two.n,
        one.logs + two.logs + logs,
        ssq,
        np.maximum(one.bad, two.bad),
        two.a @ g @ one.a,
        _times(two.a, _times(g, one.b) + _times(p, two.eta)) + two.b,
        two.a @ p @ _turned(two.a) + two.c,
        one.eta + _times(at, e - mb),
        one.j + at @ m @ one.a,
    )


def after(b: np.ndarray, c: np.ndarray, e: Element) -> tuple[np.ndarray, np.ndarray]:
    """The filtered state (mean, variance) after a range, from the one before it."""
    k = b.shape[-1]
    p = np.linalg.solve(np.eye(k) + c @ e.j, c)
    p = (p + _turned(p)) * 0.5
    return _times(e.a, b + _times(p, e.eta - _times(e.j, b))) + e.b, e.a @ p @ _turned(e.a) + e.c


def folded(e: Element) -> Element:
    """The element of all that stand along the first axis."""
    while len(e.n) > 1:
        n = len(e.n) // 2 * 2
        both = joined(e.at(slice(0, n, 2)), e.at(slice(1, n, 2)))
        e = both if n == len(e.n) else Element(*[np.concatenate([getattr(both, f.name), getattr(e, f.name)[n:]]) for f in fields(e)])
    return e.at(0)


class Range:
    """A stretch of a series on the model scale; `start` is the time of its first row, from 1."""

    def __init__(self, spec: K.Spec, par: np.ndarray, y: np.ndarray, x: np.ndarray, start: int):
        self.spec, self.sys, self.start, self.n, self.z = spec, K.system(spec, par), start, len(y), K.design(spec)
        kd, arma = spec.kdiff, K.system(replace(spec, d=0, sd=0), par)
        self.a1, self.p1 = np.zeros_like(self.sys.a), np.zeros_like(self.sys.p)
        self.a1[:, kd:], self.p1[:, kd:, kd:] = arma.a, arma.p
        self.p1[:, np.arange(kd), np.arange(kd)] = K.DIFFUSE
        self.tau, beta = spec.split(par)[:2]
        self.obs = y[:, None] - (x @ beta.T if spec.r else 0.0)
        self.seen = ~(np.isnan(y) | np.isnan(x).any(axis=1))
        self.c = K.trend_values(spec, self.tau, start, self.n).T if spec.degrees else None
        lanes = max(1, min(isqrt(max(self.n, 1)), self.n // (spec.kdiff + 2)))
        self.size = self.n // lanes
        cut = lanes * self.size
        #: (first row, lanes, rows in each)
        self.blocks = [(0, lanes, self.size)] * (cut > 0) + [(cut, 1, self.n - cut)] * (self.n > cut)

    def _open(self, at: np.ndarray) -> np.ndarray | None:
        """What is added to the state on the way into the rows at: the trend at the time before them."""
        if self.c is None:
            return None
        t = self.start + at - 1
        return sum((self.tau[None, :, i] * t[:, None].astype(float) ** g for i, g in enumerate(self.spec.degrees)), np.zeros((len(at), len(self.tau))))

    def _predicted(self, at: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predicted state at rows at, from the filtered one before them."""
        t, row = self.sys.t, self.spec.kdiff
        b, c = _times(t, b), t @ c @ _turned(t) + self.sys.rqr
        if (more := self._open(at)) is not None:
            b[..., row] += more
        return b, (c + _turned(c)) * 0.5

    def _pass(self, first: int, lanes: int, size: int, a: np.ndarray | None, b: np.ndarray, c: np.ndarray) -> tuple[Element, np.ndarray, np.ndarray]:
        """The element of each lane and its last filtered state in it, and innovations and their variances (rows, lanes, probes); a is None where they are all that is asked."""
        t, tt, burn, z, probes = self.sys.t, _turned(self.sys.t), self.spec.kdiff, self.z, len(self.tau)
        cut = lambda z: z[first : first + lanes * size].reshape(lanes, size, *z.shape[1:]).swapaxes(0, 1)
        obs, seen, trend = cut(self.obs), cut(self.seen), None if self.c is None else cut(self.c)
        at = self.start + first + np.arange(lanes) * size
        n, logs, ssq = np.zeros((lanes, probes)), np.zeros((lanes, probes)), np.zeros((lanes, probes))
        bad, eta, j = np.zeros((lanes, probes), bool), np.zeros_like(b), np.zeros_like(c)
        vs, fs = np.full((size, lanes, probes), np.nan), np.empty((size, lanes, probes))
        with np.errstate(all="ignore"):
            for i in range(size):
                zc = c @ z
                f, there = zc @ z, seen[i][:, None]
                v = np.where(there, obs[i] - b @ z, 0.0)
                counted = there & (at + i > burn)[:, None]
                n += counted
                bad |= counted & ~(f > 0)
                logs += np.where(counted, np.log(f), 0.0)
                ssq += np.where(counted, v * v / f, 0.0)
                fs[i] = f
                vs[i] = np.where(there, v, np.nan)
                g = np.where(there[..., None], zc / f[..., None], 0.0)
                if a is not None:
                    w = z @ a
                    eta += np.where(there[..., None], w * (v / f)[..., None], 0.0)
                    j += np.where(there[..., None, None], w[..., :, None] * (w / f[..., None])[..., None, :], 0.0)
                    a = a - g[..., :, None] * w[..., None, :]
                b = b + g * v[..., None]
                c = c - g[..., :, None] * zc[..., None, :]
                if i < size - 1:
                    b, c = _times(t, b), t @ c @ tt + self.sys.rqr
                    c = (c + _turned(c)) * 0.5
                    if a is not None:
                        a = t @ a
                    if trend is not None:
                        b[..., burn] += trend[i]
        return Element(n, logs, ssq, bad.astype(float), np.zeros_like(c) if a is None else a, b, (c + _turned(c)) * 0.5, eta, j), vs, fs

    def lanes(self) -> Element:
        """Each lane's element, along the first axis."""
        parts = []
        probes, k = self.sys.t.shape[:2]
        for first, lanes, size in self.blocks:
            a = np.broadcast_to(self.sys.t, (lanes, probes, k, k)).copy()
            at = first + np.arange(lanes) * size
            b, c = self._predicted(at, np.zeros((lanes, probes, k)), np.zeros((lanes, probes, k, k)))
            if self.start + first == 1:
                a[0], b[0], c[0] = 0.0, self.a1, self.p1
            parts.append(self._pass(first, lanes, size, a, b, c)[0])
        return Element(*[np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Element)])

    def element(self) -> Element:
        return folded(self.lanes())

    def traced(self, b: np.ndarray | None, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Innovations (NaN: missing) and their variances (rows, probes), from the filtered state before the range; None: the series' start."""
        each = self.lanes()
        probes, k = self.sys.t.shape[:2]
        bs, cs = np.zeros((len(each.n), probes, k)), np.zeros((len(each.n), probes, k, k))
        b, c = (np.zeros((probes, k)), np.zeros((probes, k, k))) if b is None else (b, c)
        for i in range(len(each.n)):
            bs[i], cs[i] = b, c
            b, c = after(b, c, each.at(i))
        v, f = np.empty((self.n, probes)), np.empty((self.n, probes))
        done = 0
        for first, lanes, size in self.blocks:
            mine = slice(done, done + lanes)
            p, q = self._predicted(first + np.arange(lanes) * size, bs[mine], cs[mine])
            if self.start + first == 1:
                p[0], q[0] = self.a1, self.p1
            _, vs, fs = self._pass(first, lanes, size, None, p, q)
            rows = slice(first, first + lanes * size)
            v[rows], f[rows] = (z.swapaxes(0, 1).reshape(lanes * size, probes) for z in (vs, fs))
            done += lanes
        return v, f


def likelihood(spec: K.Spec, e: Element) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood (NaN where the probe is no valid model) and scale of a whole series' element."""
    n = e.n
    with np.errstate(all="ignore"):
        scale = e.ssq / np.maximum(n, 1) if spec.concentrate else np.ones_like(e.ssq)
        ll = -0.5 * (n * K.LOG2PI + e.logs + (n * np.log(scale) + n if spec.concentrate else e.ssq))
    return np.where((e.bad > 0) | ~np.isfinite(ll), np.nan, ll), scale


def last_state(spec: K.Spec, par: np.ndarray, e: Element, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Predicted state after the n rows of a whole series, as the sequential filter leaves it."""
    end = Range(spec, par, np.zeros(0), np.zeros((0, spec.r)), n + 1)
    b, c = end._predicted(np.zeros(1, np.int64), e.b[None], e.c[None])
    if spec.kdiff:  # the shifted basis is one step ahead, its trend still to come
        t = end.sys.t
        b, c = _times(t, b), t @ c @ _turned(t) + end.sys.rqr
    return b[0], (c[0] + _turned(c[0])) * 0.5

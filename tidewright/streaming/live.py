"""The filter over an unbounded stream: Structured Streaming keeps each series' state between micro-batches.

`follow` takes a stream of (keys.., t, y) and a fitted model's table, and gives one row for each series that a micro-batch brings rows of. What is
kept of a series has a fixed size (state, its variance, counters, the last rows that differencing needs, and with `delay` at most that many
rows that wait), whatever the length of the stream; a restart from the query's checkpoint goes on where it stopped. The result after any
micro-batch is the one that the filter over all rows so far would give.

Contract: t is the position from 1, a whole number. Positions that no row came for, and rows with a null y, are missing observations. A row
whose position was passed already, that repeats one, or has no position from 1 on, changes nothing and is counted in `late`; of rows
with one position in a micro-batch the smallest y counts. `delay` holds rows back until one that is `delay` positions later has come, so that rows may come
in disorder within it. A series without a model fails the query. Models with regressors are refused. A micro-batch's rows of one series are sorted in
one task: the source's limit a trigger (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds them. A gap takes a step of the filter for each position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernel as K
from ..session import ship

RESULT = "t long, n_eff long, n_seen long, late long, waiting long, loglik double, scale2 double, a array<double>, p array<double>"
STATE = "at long, t long, newest long, seen long, cnt long, late long, logs double, ssq double, bad boolean, a array<double>, p array<double>, tail array<double>, wait_t array<long>, wait_y array<double>"
#: Positions that are filtered at once.
PIECE = 1 << 16


def packed(model: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys.., __spec, __params, __trend), a row a series: what filtering needs of a model table."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("idx", "value")))), lambda c: c["value"])
    return model.groupBy(*keys).agg(of("spec").alias("__spec"), of("param").alias("__params"), of("trend").alias("__trend"))


def _spec(values: list[float], degrees: list[float]) -> K.Spec:
    p, d, q, sp, sd, sq, s, r, _, _, sdiff, conc = (int(v) for v in values[:12])
    trend = next(k for k, g in K.TRENDS.items() if g == tuple(int(v) for v in degrees))
    return K.Spec(p, d, q, sp, sd, sq, s, r, trend, conc == 1, sdiff == 1)


class Series:
    """One series between micro-batches."""

    def __init__(self, spec: K.Spec, params: np.ndarray, held: tuple | None):
        self.spec, self.run = spec, K.Run(spec, params[None])
        self.t = self.newest = self.seen = self.late = 0
        self.tail, self.wait_t, self.wait_y = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        if held is not None:
            r = self.run
            r.at, self.t, self.newest, self.seen, r.cnt, self.late, logs, ssq, bad, a, p, tail, wait_t, wait_y = held
            r.logs[:], r.ssq[:], r.bad[:] = logs, ssq, bad
            r.a, r.cov = np.array(a, float)[None], np.array(p, float).reshape(1, len(a), len(a))
            self.tail, self.wait_t, self.wait_y = np.array(tail, float), np.array(wait_t, np.int64), np.array(wait_y, float)

    def held(self) -> tuple:
        r = self.run
        return (int(r.at), int(self.t), int(self.newest), int(self.seen), int(r.cnt), int(self.late), float(r.logs[0]), float(r.ssq[0]), bool(r.bad[0]), r.a[0].tolist(), r.cov[0].ravel().tolist(), self.tail.tolist(), self.wait_t.tolist(), self.wait_y.tolist())

    def take(self, t: np.ndarray, y: np.ndarray, delay: int) -> None:
        """New rows; y is NaN where it is null."""
        came = np.concatenate([np.zeros(len(self.wait_t)), np.ones(len(t))])
        t, y = np.concatenate([self.wait_t, t]), np.concatenate([self.wait_y, y])
        order = np.lexsort((y, came, t))
        t, y = t[order], y[order]
        new = np.concatenate([[True], t[1:] != t[:-1]]) & (t > self.t) if len(t) else np.zeros(0, bool)
        self.late += int((~new).sum())
        t, y = t[new], y[new]
        if len(t):
            self.newest = max(self.newest, int(t[-1]))
        ready = int(np.searchsorted(t, self.newest - delay, "right"))
        self.wait_t, self.wait_y = t[ready:], y[ready:]
        if ready:
            self.step(t[:ready], y[:ready])

    def step(self, t: np.ndarray, y: np.ndarray) -> None:
        spec, last = self.spec, int(t[-1])
        lost = spec.lost if spec.simple_differencing else 0
        self.seen += int((~np.isnan(y)).sum())
        for lo in range(self.t, last, PIECE):
            hi = min(lo + PIECE, last)
            a, b = np.searchsorted(t, [lo, hi], "right")
            dense = np.full(hi - lo, np.nan)
            dense[t[a:b] - lo - 1] = y[a:b]
            cells = np.concatenate([self.tail, dense])
            w = K.difference(cells, spec.d, spec.sd, spec.s) if lost and len(cells) > lost else cells[lost:]
            self.tail = cells[len(cells) - min(lost, len(cells)) :]
            self.run.feed(w, np.zeros((len(w), 0)))
        self.t = last

    def row(self) -> tuple:
        ll, scale = self.run.result()
        out = (self.t, self.run.at - self.spec.kdiff, self.seen, self.late, len(self.wait_t))
        return (*out, None if np.isnan(ll[0]) else float(ll[0]), float(scale[0]), self.run.a[0].tolist(), self.run.cov[0].ravel().tolist())


def follow(stream: DataFrame, model: DataFrame, y_col: str, t_col: str, keys: tuple[str, ...], delay: int = 0) -> DataFrame:
    """(keys.., t, n_eff, n_seen, late, waiting, loglik, scale2, a, p) of each series that a micro-batch has rows of: its last applied position, observations on the
    model scale as everywhere, rows with a y, rows that were refused, rows that wait, and the filter's state after t. Append mode."""
    if delay < 0:
        raise ValueError("delay must not be negative")
    if not keys:
        raise ValueError("name the columns that tell series apart")
    ship(stream.sparkSession)
    rows = stream.select(*keys, F.col(t_col).cast("long").alias("__t"), F.col(y_col).cast("double").alias("__y")).join(packed(model, keys), list(keys), "left")
    names = [*keys, *T.StructType.fromDDL(RESULT).names]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at = None
        t, y = [], []
        for part in parts:
            if at is None:
                at = part.iloc[0]
            t.append(part["__t"].fillna(0).to_numpy(np.int64))
            y.append(part["__y"].to_numpy(float))
        if at["__spec"] is None:
            raise ValueError(f"no model for {key}")
        spec = _spec(list(at["__spec"]), list(at["__trend"]))
        if spec.r:
            raise ValueError("a streamed series takes no regressors")
        one = Series(spec, np.array(at["__params"], float), state.get if state.exists else None)
        one.take(np.concatenate(t), np.concatenate(y), delay)
        state.update(one.held())
        yield pd.DataFrame([(*key, *one.row())], columns=names)

    schema = T.StructType([stream.schema[k] for k in keys] + T.StructType.fromDDL(RESULT).fields)
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", "NoTimeout")

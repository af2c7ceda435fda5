"""The Kalman filter over probes: many parameter vectors for one or more series, as DataFrames.

Probes are rows (probe_id, params), a caller's list. They are dealt in blocks, and a block is one vectorised pass over the series, so probes run in
parallel across tasks and side by side within one. Probes with one ARMA block stand side by side, so that they share its pass over variances and gains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions import polynomials as P
from ..functions.arrays import bound
from ..session import ship

BLOCK = 64


def distinct_systems(probes: DataFrame, spec: K.Spec) -> DataFrame:
    """(system_id, arma, n_probes): probes that share their ARMA block share a system."""
    arma = F.slice("params", spec.front + 1, max(spec.size - spec.front, 0))
    got = probes.groupBy(arma.alias("arma")).agg(F.min("probe_id").alias("system_id"), F.count("*").alias("n_probes"))
    return got.select("system_id", "arma", "n_probes")


def systems(probes: DataFrame, spec: K.Spec) -> DataFrame:
    """(probe_id, k, karma, kdiff, cidx, burn, tmat, rqr, a1, p1): state space of each probe, one build a distinct ARMA block."""
    ship(probes.sparkSession)
    arma = F.slice("params", spec.front + 1, max(spec.size - spec.front, 0))
    schema = "probe_id long, k int, karma int, kdiff int, cidx int, burn int, tmat array<double>, rqr array<double>, a1 array<double>, p1 array<double>"
    arrow = _arrow(schema)

    def run(t: pa.Table) -> pa.Table:
        par = np.array(t.column("params").to_pylist(), float).reshape(t.num_rows, -1)
        same = np.zeros((1, spec.front))
        s = K.system(spec, np.concatenate([same, par[:1, spec.front :]], axis=1))
        rows = []
        for i, key in enumerate(t.column("probe_id").to_pylist()):
            a = K.system(spec, par[i : i + 1]).a[0] if spec.degrees else s.a[0]
            rows.append((key, len(a), spec.karma, spec.kdiff, spec.kdiff + 1, spec.kdiff, s.t[0].ravel().tolist(), s.rqr[0].ravel().tolist(), a.tolist(), s.p[0].ravel().tolist()))
        return pa.table([list(c) for c in zip(*rows, strict=True)], names=arrow.names).cast(arrow)

    return probes.withColumn("__arma", F.to_json(arma)).groupBy("__arma").applyInArrow(run, schema)


def system_tables(probes: DataFrame, spec: K.Spec) -> DataFrame:
    """(probe_id, name, i, j, v), from 1: transition, selection, design, state_cov and obs_cov of each probe's state space."""
    n, k = P.kdiff(*((0, 0, 1) if spec.simple_differencing else (spec.d, spec.sd, spec.s))), P.k_states(*spec.arma, spec.s)
    orders = (spec.d, spec.sd, spec.s) if n else (0, 0, 1)
    parts = P.split_params(F.slice("params", len(spec.degrees) + 1, max(spec.size - len(spec.degrees), 0)), spec.r, *spec.arma)
    q = probes.select("probe_id", parts.alias("b"))
    var = F.lit(1.0) if spec.concentrate else F.col("b.sigma2")
    tables = {
        "transition": (n + k, P.build_t(P.expand_ar(F.col("b.phi"), F.col("b.sphi"), spec.s), k, *orders)),
        "selection": (1, P.build_r(P.expand_ma(F.col("b.theta"), F.col("b.stheta"), spec.s), k, n)),
        "design": (n + k, P.build_z(k, *orders)),
        "state_cov": (1, F.array(var)),
        "obs_cov": (1, F.array(F.lit(0.0))),
    }
    cells = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(width).alias("width"), v.alias("v")) for name, (width, v) in tables.items()])
    rows = q.select("probe_id", F.explode(cells).alias("m")).select("probe_id", "m.name", "m.width", F.posexplode("m.v").alias("at", "v"))
    return rows.select("probe_id", "name", F.expr("cast(at div width + 1 as int)").alias("i"), F.expr("cast(at % width + 1 as int)").alias("j"), "v")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def obs_intercept(exog: DataFrame, beta: list[float]) -> DataFrame:
    """(t, d): x_t' beta of long regressors, summed in the order of j."""
    b = F.array(*[F.lit(float(x)) for x in beta])
    cells = F.array_sort(F.collect_list(F.struct("j", "x")))
    return exog.groupBy("t").agg(F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["x"] * F.get(b, c["j"] - 1)).alias("d"))


def adjusted(series: DataFrame, exog: DataFrame | None, probes: DataFrame, spec: K.Spec) -> DataFrame:
    """(probe_id, t, yd, ct): y less its regression, and the trend's value. A null y or regressor gives a null yd."""
    wide = None
    if spec.r:
        wide = exog.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"]).alias("xs"))
        series = series.join(wide, "t", "left")
    both = series.crossJoin(F.broadcast(probes.select("probe_id", "params")))  # probes are a caller's list
    kt = len(spec.degrees)
    fitted = F.aggregate(F.arrays_zip("xs", F.slice("params", kt + 1, spec.r).alias("b")), F.lit(0.0), lambda s, c: s + c["xs"] * c["b"]) if spec.r else F.lit(0.0)
    trend = sum((F.get("params", F.lit(i)) * F.pow(F.col("t").cast("double"), F.lit(float(g))) for i, g in enumerate(spec.degrees)), F.lit(0.0))
    return both.select("probe_id", "t", (F.col("y") - fitted).alias("yd"), trend.alias("ct"))


def _packed(series: DataFrame, exog: DataFrame | None, spec: K.Spec) -> DataFrame:
    if spec.r:
        wide = exog.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"]).alias("xs"))
        return series.select("t", "y").join(wide, "t", "left")
    return series.select("t", "y", F.array().cast("array<double>").alias("xs"))


def dealt(probes: DataFrame, spec: K.Spec) -> DataFrame:
    """(block, probes), BLOCK probes each, in the order of their ARMA blocks."""
    place = F.row_number().over(Window.orderBy(F.slice("params", spec.front + 1, max(spec.size - spec.front, 0)), "probe_id"))
    rows = probes.select("probe_id", "params", F.floor((place - 1) / BLOCK).alias("block"))
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("probe_id", "params"))).alias("probes"))


def _run(series: DataFrame, exog: DataFrame | None, probes: DataFrame, spec: K.Spec, ddl: str, rows) -> DataFrame:
    ship(series.sparkSession)
    blocks = dealt(probes, spec)
    packed = _packed(series, exog, spec).crossJoin(F.broadcast(blocks.select("block")))  # a row a block of probes

    schema = _arrow(ddl)

    def run(t: pa.Table, b: pa.Table) -> pa.Table:
        if not b.num_rows or not t.num_rows:
            return schema.empty_table()
        t = t.sort_by("t")
        y = t.column("y").cast(pa.float64()).fill_null(float("nan")).to_numpy().astype(float)
        x = np.array([[np.nan] * spec.r if v is None else [np.nan if u is None else u for u in v] for v in t.column("xs").to_pylist()], float).reshape(len(y), spec.r)
        p = b.column("probes")[0].as_py()
        ids, par = [r["probe_id"] for r in p], np.array([r["params"] for r in p], float).reshape(len(p), spec.size)
        out = rows(ids, y, x, par)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return packed.groupBy("block").cogroup(blocks.withColumnRenamed("block", "b").groupBy("b")).applyInArrow(run, ddl)


def loglik(series: DataFrame, probes: DataFrame, spec: K.Spec, exog: DataFrame | None = None) -> DataFrame:
    """(probe_id, n_eff, loglik, scale2) of a model-scale series (t, y); loglik is null for a probe that is no valid model."""

    def rows(ids, y, x, par):
        got = K.kalman(spec, y, x, par)
        return [(i, len(y) - spec.kdiff, None if np.isnan(a) else float(a), float(s)) for i, a, s in zip(ids, got.loglik, got.scale, strict=True)]

    return _run(series, exog, probes, spec, "probe_id long, n_eff long, loglik double, scale2 double", rows)


def trace(series: DataFrame, probes: DataFrame, spec: K.Spec, exog: DataFrame | None = None) -> DataFrame:
    """(probe_id, t, v, f): innovation (null where y is missing) and its variance at every step."""

    def rows(ids, y, x, par):
        got = K.kalman(spec, y, x, par, trace=True)
        return [(i, t + 1, None if np.isnan(got.v[t, k]) else float(got.v[t, k]), float(got.f[t, k])) for k, i in enumerate(ids) for t in range(len(y))]

    return _run(series, exog, probes, spec, "probe_id long, t long, v double, f double", rows)


def final_state(series: DataFrame, probes: DataFrame, spec: K.Spec, exog: DataFrame | None = None) -> DataFrame:
    """(probe_id, n_eff, a, p, loglik): the state after the last observation."""

    def rows(ids, y, x, par):
        got = K.kalman(spec, y, x, par)
        return [(i, len(y) - spec.kdiff, got.a[k].tolist(), got.p[k].ravel().tolist(), None if np.isnan(got.loglik[k]) else float(got.loglik[k])) for k, i in enumerate(ids)]

    return _run(series, exog, probes, spec, "probe_id long, n_eff long, a array<double>, p array<double>, loglik double", rows)


def native_loglik(trace_rows, burn: int = 0):
    """Log-likelihood of an array of (v, f) in the JVM, for filter_array()."""
    from pyspark.sql.functions import aggregate, lit, log, slice, size

    used = bound(trace_rows, lambda r: F.filter(slice(r, lit(burn + 1), size(r)), lambda c: c["v"].isNotNull()))
    return bound(used, lambda u: -0.5 * aggregate(u, lit(0.0), lambda s, c: s + K.LOG2PI + log(c["f"]) + c["v"] * c["v"] / c["f"]))

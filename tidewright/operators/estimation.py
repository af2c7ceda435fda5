"""The steps of a fit one by one, as DataFrames: start values, transforms, the optimizer, standard errors, forecasts from states."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernel as K
from .differencing import anchors, difference, difference_exog, integrate, integration_weights
from .filter import _run, final_state


def _num(v) -> float | None:
    return None if v is None or not np.isfinite(v) else float(v)


def start_params(series: DataFrame, spec: K.Spec, exog: DataFrame | None = None) -> DataFrame:
    """(probe_id, x0, params0): the optimizer's start for a model-scale series (t, y), free and valid."""

    def rows(ids, y, x, _):
        u = K.start_values(spec, y, x)
        return [(ids[0], u.tolist(), K.constrain(spec, u[None])[0].tolist())]

    return _run(series, exog, _sized(series, spec), spec, "probe_id long, x0 array<double>, params0 array<double>", rows)


def _sized(series: DataFrame, spec: K.Spec) -> DataFrame:
    return series.sparkSession.createDataFrame([(0, [0.0] * spec.size)], "probe_id long, params array<double>")


def optimum(series: DataFrame, spec: K.Spec, exog: DataFrame | None = None, ceiling: float = 1e-2) -> DataFrame:
    """(x_opt, params, loglik, scale2, converged, iterations, grad_norm, restarted) of a model-scale series."""

    def rows(ids, y, x, _):
        m = K.maximize(spec, y, x, ceiling=ceiling)
        return [(m.u.tolist(), m.params.tolist(), _num(m.loglik), _num(m.scale), m.status == 1, m.iterations, _num(m.gradient), m.restarted)]

    return _run(series, exog, _sized(series, spec), spec, "x_opt array<double>, params array<double>, loglik double, scale2 double, converged boolean, iterations int, grad_norm double, restarted boolean", rows)


def standard_errors(series: DataFrame, probes: DataFrame, spec: K.Spec, exog: DataFrame | None = None) -> DataFrame:
    """(probe_id, bse) at the probes' parameters; a null element where the Hessian gives none."""

    def rows(ids, y, x, par):
        return [(i, [_num(v) for v in K.standard_errors(spec, y, x, p)]) for i, p in zip(ids, par, strict=True)]

    return _run(series, exog, probes, spec, "probe_id long, bse array<double>", rows)


def loglik_free(series: DataFrame, probes: DataFrame, spec: K.Spec, exog: DataFrame | None = None) -> DataFrame:
    """(probe_id, loglik): the objective at free parameters."""

    def rows(ids, y, x, u):
        return [(i, _num(v)) for i, v in zip(ids, K.kalman(spec, y, x, K.constrain(spec, u)).loglik, strict=True)]

    return _run(series, exog, probes, spec, "probe_id long, loglik double", rows)


def forecast_states(states: DataFrame, probes: DataFrame, spec: K.Spec, horizon: int, future: DataFrame | None = None) -> DataFrame:
    """(probe_id, h, mean_diff, var_diff, omega) from (probe_id, n_eff, a, p): omega[j] is the covariance of the errors at h and j <= h.

    future: (h, xs) with the regressors of every step on the model scale."""
    both = states.join(probes, "probe_id")
    if spec.r:
        packed = future.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "xs"))), lambda r: r["xs"]).alias("future"))
        both = both.crossJoin(packed)  # one row
    else:
        both = both.withColumn("future", F.array().cast("array<array<double>>"))
    schema = "probe_id long, h int, mean_diff double, var_diff double, omega array<double>"

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                a = np.array(r["a"])
                x = np.array(r["future"], float).reshape(-1, spec.r)[:horizon] if spec.r else np.zeros((horizon, 0))
                if len(x) < horizon and spec.r:
                    raise ValueError(f"future regressors lack steps {len(x) + 1} to {horizon}")
                f = K.forecast(_whole(spec), np.array(r["params"]), a, np.array(r["p"]).reshape(len(a), -1), r["n_eff"] + spec.kdiff, horizon, x, [])
                rows = [(r["probe_id"], h + 1, float(f["mean_diff"][h]), float(f["var_diff"][h]), f["omega"][h, : h + 1].tolist()) for h in range(horizon)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())), strict=True)], ["probe_id", "h", "mean_diff", "var_diff", "omega"])

    return both.select("probe_id", "n_eff", "a", "p", "params", "future").mapInArrow(run, schema)


def _whole(spec: K.Spec) -> K.Spec:
    """The spec on the model scale: differencing that was done before the filter is left out."""
    if not spec.simple_differencing:
        return spec
    return K.Spec(spec.p, 0, spec.q, spec.sp, 0, spec.sq, spec.s, spec.r, spec.trend, spec.concentrate)


def forecast_original(forecast: DataFrame, held: DataFrame, d: int, sd: int, s: int, horizon: int) -> DataFrame:
    """(probe_id, h, mean_orig, var_orig): means as running sums over the anchors, variances from integration weights and omega."""
    spark = forecast.sparkSession
    ids = forecast.select("probe_id").distinct()
    anchors = held.crossJoin(F.broadcast(ids))  # probes are a caller's list
    means = integrate(forecast.select("probe_id", "h", F.col("mean_diff").alias("w")), anchors, d, sd, s, ("probe_id",)).withColumnRenamed("yhat", "mean_orig")
    c = integration_weights(spark.range(1, horizon + 1).withColumnRenamed("id", "h"), d, sd, s).filter("c <> 0")
    cells = forecast.select("probe_id", F.col("h").cast("long").alias("i"), F.posexplode("omega").alias("j", "o")).withColumn("j", (F.col("j") + 1).cast("long"))
    left = c.select("h", F.col("l").alias("i"), F.col("c").alias("ci"))
    right = c.select("h", F.col("l").alias("j"), F.col("c").alias("cj"))
    terms = cells.join(left, "i").join(right, ["h", "j"]).withColumn("z", F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("ci") * F.col("cj") * F.col("o"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "j", "z")))
    var = terms.groupBy("probe_id", "h").agg(F.aggregate(ordered, F.lit(0.0), lambda a, t: a + t["z"]).alias("var_orig"))
    return means.withColumn("h", F.col("h").cast("long")).join(var, ["probe_id", "h"])



def forecast_run(series: DataFrame, probes: DataFrame, spec: K.Spec, horizon: int, exog: DataFrame | None = None) -> DataFrame:
    """(probe_id, h, mean_diff, se_diff, mean_orig, se_orig) of a series (t, y), t from 1: differencing, filter, and forecasts on both scales.

    exog: long regressors (t, j, x) of the series and of the horizon's steps after it."""
    orders = (spec.d, spec.sd, spec.s)
    if not spec.simple_differencing:
        raise ValueError("the chain differences first; model.forecast() takes models with differences in the state")
    w = difference(series, *orders).withColumnRenamed("w", "y") if spec.lost else series
    x = future = None
    if spec.r:
        x = difference_exog(exog, *orders) if spec.lost else exog
        n = w.agg(F.max("t").alias("n"))  # one row
        later = x.crossJoin(F.broadcast(n)).filter((F.col("t") > F.col("n")) & (F.col("t") <= F.col("n") + horizon)).withColumn("h", F.col("t") - F.col("n"))
        future = later.groupBy("h").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"]).alias("xs"))
    f = forecast_states(final_state(w, probes, spec, x), probes, spec, horizon, future)
    if spec.lost:
        both = f.withColumn("h", F.col("h").cast("long")).join(forecast_original(f, anchors(series, *orders), *orders, horizon), ["probe_id", "h"])
    else:
        both = f.withColumns({"mean_orig": F.col("mean_diff"), "var_orig": F.col("var_diff")})
    return both.select("probe_id", F.col("h").cast("int").alias("h"), "mean_diff", F.sqrt("var_diff").alias("se_diff"), "mean_orig", F.sqrt("var_orig").alias("se_orig"))

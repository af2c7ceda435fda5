"""Fit, forecast and diagnose seasonal ARIMA models of one or of many series.

A fitted model is a long table (keys.., kind, name, idx, value, value_list) that can be written, joined and forecast from without
a refit. Series, orders and keys are what runs in parallel: each (key, model) is one Arrow group, in which the
optimizer evaluates all probes of a gradient together. Keys must hold series that fit a task; streaming.chunked is for longer ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernel as K
from ..functions.distributions import chi2_sf, norm_cdf, norm_ppf
from ..session import ship, written
from ..sources.series import MAX_REGRESSORS, numbered, trend_name
from .lags import acf, acf_of, run_products

MODEL = "kind string, name string, idx int, value double, value_list array<double>"
SPEC_NAMES = ("p", "d", "q", "sp", "sd", "sq", "s", "r", "n", "n_eff", "sdiff", "conc", "ktrend", "burn")
META_NAMES = ("loglik", "aic", "bic", "converged", "iterations", "grad_norm", "restarted", "sigma2")
Z95 = 1.959963984540054


def parameter_names(spec: K.Spec, exog: list[str]) -> list[str]:
    names = [trend_name(g) for g in spec.degrees] + list(exog)
    names += [f"ar.L{i + 1}" for i in range(spec.p)] + [f"ma.L{i + 1}" for i in range(spec.q)]
    names += [f"ar.S.L{spec.s * (i + 1)}" for i in range(spec.sp)] + [f"ma.S.L{spec.s * (i + 1)}" for i in range(spec.sq)]
    return names + ([] if spec.concentrate else ["sigma2"])


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    c = t.column(column).cast(pa.float64())
    return c.fill_null(float("nan")).to_numpy().astype(float)


def _matrix(t: pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([_numbers(t, c) for c in columns]) if columns else np.zeros((t.num_rows, 0))


def _in_order(t: pa.Table, t_col: str) -> pa.Table:
    t = t.sort_by(t_col)
    times = t.column(t_col)
    if times.null_count or len(times.unique()) < len(times):
        raise ValueError(f"time column {t_col} has a null or a repeated value")
    return t


def clock(times: pa.ChunkedArray) -> np.ndarray | None:
    """Times as numbers that doubles hold exactly: whole numbers, days of dates, seconds of timestamps; None of other types and of numbers too large."""
    kind = times.type
    if pa.types.is_date(kind):
        times = times.cast(pa.date32()).cast(pa.int32())
    elif pa.types.is_timestamp(kind):
        return times.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() / 1e6
    elif not pa.types.is_integer(kind):
        return None
    at = times.to_numpy()
    return at.astype(float) if not len(at) or np.abs(at.astype(float)).max() < 2**53 else None


def span(at: np.ndarray | None) -> list[float] | None:
    """[first, last] of sorted times, and their step where it is one whole number: what a model remembers of its times."""
    if at is None or not len(at):
        return None
    step = np.unique(np.diff(at))
    return [float(at[0]), float(at[-1]), *([float(step[0])] if len(step) == 1 and step[0] == int(step[0]) else [])]


def model_scale(spec: K.Spec, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not spec.simple_differencing:
        return y, x
    if len(y) < spec.lost + 1:
        raise ValueError(f"the series has {len(y)} rows; differencing needs at least {spec.lost + 1}")
    return K.difference(y, spec.d, spec.sd, spec.s), K.difference(x, spec.d, spec.sd, spec.s)


def check_rank(x: np.ndarray, names: list[str]) -> None:
    """Fails on a regressor that depends on those before it (on the model scale)."""
    full = x[~np.isnan(x).any(axis=1)]
    g = full.T @ full
    trace = np.trace(g)
    for i in range(len(g)):
        rest = g[i, i] if not i else g[i, i] - g[i, :i] @ np.linalg.lstsq(g[:i, :i], g[:i, i], rcond=None)[0]
        if not rest >= 1e-10 * trace:
            raise ValueError(f"regressor {names[i]} depends on the others")


def fit_rows(spec: K.Spec, y: np.ndarray, x: np.ndarray, exog: list[str], compute_bse: bool = True, params: list[float] | None = None, times: list[float] | None = None) -> list[tuple]:
    """The model table's rows of one series; y is NaN where it is missing. With params nothing is estimated. times: span() of the series."""
    if not len(y) or np.isnan(y).all():
        raise ValueError("the series is empty or has no value")
    if np.isnan(x).any():
        j = int(np.flatnonzero(np.isnan(x).any(axis=0))[0])
        at = np.flatnonzero(np.isnan(x[:, j])) + 1
        raise ValueError(f"regressor {exog[j]} has null values at times {at[0]} to {at[-1]}")
    n = len(y)
    w, z = model_scale(spec, y, x)
    if spec.r:
        check_rank(K.difference(x, spec.d, spec.sd, spec.s), exog)
    if params is None:
        m = K.maximize(spec, w, z)
    else:
        if len(params) != spec.size:
            raise ValueError(f"the model has {spec.size} parameters; got {len(params)}")
        par = np.array(params, float)
        at = K.kalman(spec, w, z, par[None])
        m = K.Optimum(par, K.unconstrain(spec, par[None])[0], float(at.loglik[0]), float(at.scale[0]), 1 if np.isfinite(at.loglik[0]) else 3, 0, 0.0, False)
    got = K.kalman(spec, w, z, m.params[None])
    bse = K.standard_errors(spec, w, z, m.params) if compute_bse else np.full(spec.size, np.nan)
    lost = max(n - spec.lost, 0)
    return model_rows(spec, exog, m, bse, n, len(w), y[lost:], x[lost:], got.a[0], got.p[0], times)


def model_rows(spec: K.Spec, exog: list[str], m: K.Optimum, bse: np.ndarray, n: int, n_eff: int, tail: np.ndarray, tail_x: np.ndarray, a: np.ndarray, p: np.ndarray, times: list[float] | None = None) -> list[tuple]:
    """The model table's rows; tail, tail_x: the last rows that undoing differences needs; a, p: the state after the series. The row of n holds `times`."""
    k = spec.size + spec.concentrate
    ll = m.loglik
    sigma2 = m.scale if spec.concentrate else (float(m.params[-1]) if spec.size else float("nan"))
    nobs = n_eff - spec.kdiff
    names = parameter_names(spec, exog)
    num = lambda v: None if v is None or not np.isfinite(v) else float(v)
    rows = [("param", c, i + 1, num(v), None) for i, (c, v) in enumerate(zip(names, m.params, strict=True))]
    rows += [("param_unc", c, i + 1, num(v), None) for i, (c, v) in enumerate(zip(names, m.u, strict=True))]
    rows += [("bse", c, i + 1, num(v), None) for i, (c, v) in enumerate(zip(names, bse, strict=True))]
    spec_values = (spec.p, spec.d, spec.q, spec.sp, spec.sd, spec.sq, spec.s, spec.r, n, n_eff, int(spec.simple_differencing), int(spec.concentrate), len(spec.degrees), spec.kdiff)
    rows += [("spec", c, i + 1, float(v), times if c == "n" else None) for i, (c, v) in enumerate(zip(SPEC_NAMES, spec_values, strict=True))]
    meta = (ll, 2 * k - 2 * ll, k * np.log(nobs) - 2 * ll, float(m.status == 1), float(m.iterations), m.gradient, float(m.restarted), sigma2)
    rows += [("meta", c, i + 1, num(v), None) for i, (c, v) in enumerate(zip(META_NAMES, meta, strict=True))]
    rows += [("trend", trend_name(g), i + 1, float(g), None) for i, g in enumerate(spec.degrees)]
    if spec.simple_differencing:
        for i, held in enumerate(K.anchors(tail, spec.d, spec.sd, spec.s)):
            rows += [("anchor", f"endog:{i + 1}", j + 1, num(v), None) for j, v in enumerate(held)]
        for j in range(spec.r):
            rows += [("anchor", f"exog:{j + 1}", i + 1, num(v), None) for i, v in enumerate(tail_x[:, j])]
    rows += [("exog_col", c, i + 1, None, None) for i, c in enumerate(exog)]
    rows += [("state", "a", 1, None, a.tolist()), ("state", "P", 2, None, p.ravel().tolist()), ("state", "k", 3, float(len(a)), None)]
    return rows


class Model:
    """One model read back from its rows."""

    def __init__(self, t: pa.Table):
        rows = list(zip(*(t.column(c).to_pylist() for c in ("kind", "name", "idx", "value", "value_list")), strict=True))
        of = lambda kind: sorted((i, n, v, l) for k, n, i, v, l in rows if k == kind)  # noqa: E731, E741
        get = {n: v for _, n, v, _ in of("spec")}
        self.meta = {n: v for _, n, v, _ in of("meta")}
        degrees = tuple(int(v) for _, _, v, _ in of("trend"))
        trend = next(k for k, g in K.TRENDS.items() if g == degrees)
        self.spec = K.Spec(*(int(get[n]) for n in ("p", "d", "q", "sp", "sd", "sq", "s", "r")), trend=trend, concentrate=get["conc"] == 1, simple_differencing=get["sdiff"] == 1)
        self.n, self.n_eff = int(get["n"]), int(get["n_eff"])
        self.times = next((l for _, n, _, l in of("spec") if n == "n"), None)
        self.params = np.array([np.nan if v is None else v for _, _, v, _ in of("param")], float)
        self.exog = [n for _, n, _, _ in of("exog_col")]
        held = {}
        for i, n, v, _ in of("anchor"):
            held.setdefault(n, []).append((i, np.nan if v is None else v))
        at = lambda name: np.array([v for _, v in sorted(held.get(name, []))], float)
        self.endog = [at(f"endog:{i + 1}") for i in range(self.spec.d + self.spec.sd)] if self.spec.simple_differencing else []
        self.past = np.column_stack([at(f"exog:{j + 1}") for j in range(self.spec.r)]) if self.spec.r and self.spec.simple_differencing and self.spec.lost else np.zeros((0, self.spec.r))
        state = {n: l for _, n, _, l in of("state")}
        self.a = np.array(state["a"], float)
        self.p = np.array(state["P"], float).reshape(len(self.a), len(self.a))
        self.scale = self.meta["sigma2"] if self.spec.concentrate else 1.0

    def check(self, exog: list[str]) -> None:
        if list(exog) != self.exog:
            raise ValueError(f"the model's regressors are {self.exog}; got {list(exog)}")


def _grouped(df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    return (df, keys) if keys else (df.withColumn("__all", F.lit(1)), ("__all",))


def _schema(df: DataFrame, keys: tuple[str, ...], ddl: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(ddl).fields)


def _table(key: tuple, schema: T.StructType, rows: list[tuple]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    lists = list(zip(*[(*key, *r) for r in rows], strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(lists, arrow, strict=True)], schema=arrow)


def _key(t: pa.Table, keys: tuple[str, ...]) -> tuple:
    return tuple(t.column(k)[0].as_py() for k in keys)


def fit(df: DataFrame, y_col: str, t_col: str, p: int = 0, d: int = 0, q: int = 0, sp: int = 0, sd: int = 0, sq: int = 0, s: int = 1, exog_cols: tuple[str, ...] | list[str] = (), trend: str = "n", concentrate: bool = False, simple_differencing: bool = True, compute_bse: bool = True, keys: tuple[str, ...] = (), params: list[float] | None = None, out_of_core: bool = False) -> DataFrame:
    """The model table of every series, at given parameters if there are any. Orders are checked here; the data in the tasks, with errors that say what is wrong.

    out_of_core: one series that no task could hold, read as a stream at every evaluation (streaming.chunked), with its start values; df may be such a Stream."""
    exog = list(exog_cols)
    if len(exog) > MAX_REGRESSORS:
        raise ValueError(f"at most {MAX_REGRESSORS} regressors; got {len(exog)}")
    spec = K.Spec(p, d, q, sp, sd, sq, s, len(exog), trend, concentrate, simple_differencing)
    if out_of_core:
        from ..streaming.chunked import fit_stream

        if keys:
            raise ValueError("a series that is read as a stream has no keys")
        return fit_stream(df, y_col, t_col, spec, exog, compute_bse, params=params)
    ship(df.sparkSession)
    src, by = _grouped(df.select(*keys, t_col, y_col, *exog), keys)
    schema = _schema(src, by, MODEL)

    def run(t: pa.Table) -> pa.Table:
        t = _in_order(t, t_col)
        return _table(_key(t, by), schema, fit_rows(spec, _numbers(t, y_col), _matrix(t, exog), exog, compute_bse, params, span(clock(t.column(t_col)))))

    return src.groupBy(*by).applyInArrow(run, schema).select(*keys, *T.StructType.fromDDL(MODEL).names)


def _with_model(model: DataFrame, df: DataFrame, keys: tuple[str, ...], ddl: str, f: Callable[[Model, pa.Table], list[tuple]]) -> DataFrame:
    """f(model, rows) of each key, cogrouped."""
    ship(df.sparkSession)
    left, by = _grouped(model, keys)
    right, _ = _grouped(df, keys)
    left = left.select(*[F.col(k).alias(f"__m{i}") for i, k in enumerate(by)], *T.StructType.fromDDL(MODEL).names)
    schema = _schema(right, by, ddl)
    ours = tuple(f"__m{i}" for i in range(len(by)))

    def run(m: pa.Table, rows: pa.Table) -> pa.Table:
        if not m.num_rows:
            if not rows.num_rows:
                return _table((), schema, [])
            raise ValueError(f"no model for {_key(rows, by)}")
        return _table(_key(m, ours), schema, f(Model(m), rows))

    return left.groupBy(*ours).cogroup(right.groupBy(*by)).applyInArrow(run, schema).select(*keys, *T.StructType.fromDDL(ddl).names)


def future_rows(m: Model, h: int, times: pa.ChunkedArray, x: np.ndarray) -> np.ndarray:
    """Rows of x after the series, in order. Rows at times up to the series' last are history and left out; where the series' times have one step, the next h
    times must be there and are taken."""
    at = clock(times)
    if not m.times or at is None:
        return x
    first, last, *step = m.times
    x, at = x[at > last], at[at > last]
    if not step or len(x) < h:  # forecast_rows() names the steps
        return x
    want = last + step[0] * np.arange(1, h + 1)
    if len(missing := np.flatnonzero(~np.isin(want, at))):
        name = (lambda v: str(np.datetime64(int(v), "D"))) if pa.types.is_date(times.type) else (lambda v: str(int(v)))
        raise ValueError(f"future regressors lack times {name(want[missing[0]])} to {name(want[missing[-1]])}, {len(missing)} of the {h} from {name(want[0])} to {name(want[-1])}")
    return x[np.isin(at, want)]


def forecast_rows(m: Model, h: int, x: np.ndarray) -> list[tuple]:
    """(h, yhat, var, yhat_diff, var_diff); x: the regressors after the series."""
    future = np.zeros((h, 0))
    if m.spec.r:
        if len(x) < h:
            raise ValueError(f"future regressors lack steps {len(x) + 1} to {h}")
        x = x[:h]
        for j, name in enumerate(m.exog):
            if len(at := np.flatnonzero(np.isnan(x[:, j]))):
                raise ValueError(f"regressor {name} lacks steps {at[0] + 1} to {at[-1] + 1}")
        future = np.vstack([m.past, x])
        if m.spec.simple_differencing:
            future = K.difference(future, m.spec.d, m.spec.sd, m.spec.s)
    f = K.forecast(m.spec, m.params, m.a, m.p, m.n_eff, h, future, m.endog)
    return [(i + 1, float(f["mean"][i]), float(f["var"][i] * m.scale), float(f["mean_diff"][i]), float(f["var_diff"][i] * m.scale)) for i in range(h)]


def residual_rows(m: Model, y: np.ndarray, x: np.ndarray) -> list[tuple]:
    """(t, v, f, std_resid) of a series on the model scale."""
    y, x = model_scale(m.spec, y, x)
    got = K.kalman(m.spec, y, x, m.params[None], trace=True)
    f = got.f[:, 0] * m.scale
    num = lambda v: None if np.isnan(v) else float(v)
    with np.errstate(all="ignore"):
        z = got.v[:, 0] / np.sqrt(f)
    return [(i + 1, num(got.v[i, 0]), num(f[i]), num(z[i])) for i in range(len(y))]


def grid_row(spec: K.Spec, y: np.ndarray) -> tuple:
    """(loglik, aic, bic, converged, error): an order that the series is too short for is a result too."""
    try:
        got = {r[1]: r[3] for r in fit_rows(spec, y, np.zeros((len(y), 0)), [], False) if r[0] == "meta"}
    except ValueError as e:
        return None, None, None, None, str(e)
    return got["loglik"], got["aic"], got["bic"], got["converged"], None


def forecast(model: DataFrame, h: int, newdata: DataFrame | None = None, t_col: str | None = None, exog_cols: tuple[str, ...] | list[str] = (), level: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., h, yhat, se, lo, hi, yhat_diff, se_diff); newdata holds the future rows of the regressors, if there are any.

    Times that are whole numbers, dates or timestamps are compared with the series': see future_rows()."""
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    exog = list(exog_cols)
    ddl = "h int, yhat double, var double, yhat_diff double, var_diff double"

    def rows(m: Model, t: pa.Table) -> list[tuple]:
        m.check(exog)
        if not m.spec.r or not t.num_rows:
            return forecast_rows(m, h, np.zeros((0, m.spec.r)))
        t = _in_order(t, t_col)
        return forecast_rows(m, h, future_rows(m, h, t.column(t_col), _matrix(t, exog)))

    if newdata is None and exog:
        raise ValueError("newdata is needed: the model has regressors")
    if newdata is not None:
        out = _with_model(model, newdata.select(*keys, *([t_col] if t_col else []), *exog), keys, ddl, rows)
    else:
        ship(model.sparkSession)
        src, by = _grouped(model, keys)
        schema = _schema(src, by, ddl)
        out = src.groupBy(*by).applyInArrow(lambda t: _table(_key(t, by), schema, rows(Model(t), t.slice(0, 0))), schema).select(*keys, *T.StructType.fromDDL(ddl).names)
    z = norm_ppf(F.lit(0.5 + level / 2))
    se = F.sqrt("var")
    return out.select(*keys, "h", "yhat", se.alias("se"), (F.col("yhat") - z * se).alias("lo"), (F.col("yhat") + z * se).alias("hi"), "yhat_diff", F.sqrt("var_diff").alias("se_diff"))


def _stream(model: DataFrame, data: DataFrame, y_col: str, t_col: str, exog: list[str], keys: tuple[str, ...]):
    from ..streaming.chunked import model_stream

    if keys:
        raise ValueError("out of core there is one series, without keys")
    return model_stream(model, data, y_col, t_col, exog)


def residuals(model: DataFrame, data: DataFrame, y_col: str, t_col: str, exog_cols: tuple[str, ...] | list[str] = (), keys: tuple[str, ...] = (), out_of_core: bool = False) -> DataFrame:
    """(keys.., t, v, f, std_resid) on the model scale; v and std_resid are null where y is missing.

    out_of_core: one series longer than a task's memory, filtered in parallel ranges of time; data may be its streaming.chunked.Stream."""
    exog = list(exog_cols)
    if out_of_core:
        stream, params, scale = _stream(model, data, y_col, t_col, exog, keys)
        return stream.residuals(params, scale)

    def rows(m: Model, t: pa.Table) -> list[tuple]:
        m.check(exog)
        if not t.num_rows:
            return []
        t = _in_order(t, t_col)
        return residual_rows(m, _numbers(t, y_col), _matrix(t, exog))

    return _with_model(model, data.select(*keys, t_col, y_col, *exog), keys, "t long, v double, f double, std_resid double", rows)


def summary(model: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., idx, name, coefficient, std_error, z_stat, p_value, ci_lo, ci_hi), intervals at 95 %."""
    of = lambda kind, c: model.filter(F.col("kind") == kind).select(*keys, "idx", "name", F.col("value").alias(c))
    both = of("param", "coefficient").join(of("bse", "std_error").drop("name"), [*keys, "idx"])
    z = F.try_divide(F.col("coefficient"), F.col("std_error"))
    return both.select(*keys, "idx", "name", "coefficient", "std_error", z.alias("z_stat"), (2 * (1 - norm_cdf(F.abs(z)))).alias("p_value"), (F.col("coefficient") - Z95 * F.col("std_error")).alias("ci_lo"), (F.col("coefficient") + Z95 * F.col("std_error")).alias("ci_hi"))


def metrics(model: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., loglik, aic, bic, sigma2, n_eff, converged)."""
    pick = lambda kind, name: F.max(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("value")))
    return model.groupBy(*keys).agg(*[pick("meta", n).alias(n) for n in ("loglik", "aic", "bic", "sigma2")], pick("spec", "n_eff").alias("n_eff"), pick("meta", "converged").alias("converged"))


def evaluate(model: DataFrame, data: DataFrame, y_col: str, t_col: str, exog_cols: tuple[str, ...] | list[str] = (), keys: tuple[str, ...] = (), out_of_core: bool = False) -> DataFrame:
    """metrics() with resid_finite_frac, the share of finite ones among the residuals that aren't null."""
    if out_of_core:
        stream, params, scale = _stream(model, data, y_col, t_col, list(exog_cols), keys)
        got = stream.residual_counts(params, scale).select(F.try_divide("good", "n").alias("resid_finite_frac"))
        return metrics(model).crossJoin(got)  # one row each
    r = residuals(model, data, y_col, t_col, exog_cols, keys)
    good = F.count_if(F.col("std_resid").isNotNull() & ~F.isnan("std_resid") & (F.abs("std_resid") < float("inf")))
    got, m = r.groupBy(*keys).agg((good / F.count("std_resid")).alias("resid_finite_frac")), metrics(model, keys)
    return m.join(got, list(keys)) if keys else m.crossJoin(got)  # without keys one row each


def ljungbox_of(resid: DataFrame, nlags: int, keys: tuple[str, ...] = (), value: str = "std_resid") -> DataFrame:
    """(keys.., lag, stat, pvalue) of residuals (keys.., t, value); nulls are left out and the rest closed up."""
    r = numbered(resid.filter(F.col(value).isNotNull()).select(*keys, F.col("t").alias("__t"), F.col(value).alias("y")), "__t", keys, again=False).select(*keys, "t", "y")
    n = r.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    return _ljungbox(acf(r, nlags, keys), n, keys)


def _ljungbox(a: DataFrame, n: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    a = (a.join(n, list(keys)) if keys else a.crossJoin(n)).filter("lag >= 1")
    upto = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    stat = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(upto)
    return a.select(*keys, "lag", stat.alias("stat")).withColumn("pvalue", chi2_sf(F.col("stat"), F.col("lag").cast("double")))


def ljungbox(model: DataFrame, data: DataFrame, y_col: str, t_col: str, nlags: int, exog_cols: tuple[str, ...] | list[str] = (), keys: tuple[str, ...] = (), out_of_core: bool = False) -> DataFrame:
    if out_of_core:
        stream, params, scale = _stream(model, data, y_col, t_col, list(exog_cols), keys)
        runs, n, mean = stream.residual_runs(params, scale)
        return _ljungbox(acf_of(written(run_products(runs, nlags, mean=mean), "products")), model.sparkSession.range(1).select(F.lit(float(n)).alias("n")))
    return ljungbox_of(residuals(model, data, y_col, t_col, exog_cols, keys), nlags, keys)


def grid(df: DataFrame, y_col: str, t_col: str, orders: list[tuple[int, int, int, int, int, int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., p, d, q, sp, sd, sq, s, loglik, aic, bic, converged, error), best AIC first; one group for each series and order.

    orders is a list given by the caller; each series is sent once for every one of them."""
    spark = ship(df.sparkSession)
    names = ["p", "d", "q", "sp", "sd", "sq", "s"]
    o = spark.createDataFrame([tuple(map(int, x)) for x in orders], ", ".join(f"{n} int" for n in names))
    src = df.select(*keys, F.col(t_col).alias("__t"), F.col(y_col).alias("__y")).crossJoin(F.broadcast(o))
    by = (*keys, *names)
    ddl = "loglik double, aic double, bic double, converged double, error string"
    schema = _schema(src, by, ddl)

    def run(t: pa.Table) -> pa.Table:
        key = _key(t, by)
        try:
            row = grid_row(K.Spec(*key[len(keys) :]), _numbers(_in_order(t, "__t"), "__y"))
        except ValueError as e:  # so are bad times and orders
            row = (None, None, None, None, str(e))
        return _table(key, schema, [row])

    return src.groupBy(*by).applyInArrow(run, schema).orderBy(*keys, F.asc_nulls_last("aic"))

"""Fits, forecasts and diagnostics as table functions for SQL: Arrow batches in, partitioned by series and ordered by time.

    SELECT * FROM tw_fit(TABLE(x) PARTITION BY series ORDER BY (t), '{"p": 1, "d": 1, "q": 1}')

The table has the columns series, t and y, and further ones are regressors, in their order. The options are a JSON object: the orders and
settings of functions.kernel.Spec, and

    params         fixed parameters instead of a fit's
    compute_bse    standard errors in tw_fit and tw_summary (true)
    h, level       tw_forecast's steps (12) and the share that its interval holds (0.95)
    nlags          tw_ljungbox's lags (10)
    orders         tw_grid's list of [p, d, q, sp, sd, sq, s]

tw_forecast of a model with regressors reads the future ones from the last h rows, whose y isn't used. A series without rows gives none.

A fitted model that was saved is used without a fit if the table also has a model table's columns kind, name, idx, value and value_list:
rows with a kind are the model's (their t and y are null), the others are the data.

    SELECT * FROM tw_forecast(TABLE(tagged) PARTITION BY series ORDER BY (t), '{"h": 12}')

with_model(model, data) makes such a table. tw_forecast then takes the future regressors as its only data, and none for a model without them;
tw_summary takes the model alone. tw_fit and tw_grid refuse models; options must not repeat orders or parameters, and every series with data
needs its model's rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

FIT = "series string, kind string, name string, idx int, value double, value_list array<double>"
FORECAST = "series string, h int, yhat double, se double, lo double, hi double, yhat_diff double, se_diff double"
RESIDUALS = "series string, t long, v double, f double, std_resid double"
SUMMARY = "series string, idx int, name string, coefficient double, std_error double, z_stat double, p_value double, ci_lo double, ci_hi double"
EVALUATE = "series string, loglik double, aic double, bic double, sigma2 double, n_eff double, converged double, resid_finite_frac double"
LJUNGBOX = "series string, lag long, stat double, pvalue double"
GRID = "series string, p int, d int, q int, sp int, sd int, sq int, s int, loglik double, aic double, bic double, converged double, error string"


class _Series:
    """Gathers one series' batches; the subclasses' rows() are the result."""

    schema = ""

    def __init__(self):
        self.batches, self.options = [], {}

    def eval(self, rows, options=None):
        if options is not None and len(options):
            self.options = json.loads(options[0].as_py())
        self.batches.append(rows)
        return iter(())

    def terminate(self):
        import pyarrow as pa

        of = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        arrow = pa.schema([(n, of[t]) for n, t in (c.split() for c in self.schema.split(", "))])  # workers have no session to parse it
        table = pa.Table.from_batches(self.batches) if self.batches else None
        if table is None or not table.num_rows:
            return
        key = str(table.column("series")[0].as_py())
        out = [(key, *r) for r in self.rows(table)]
        lists = list(zip(*out, strict=True)) if out else [()] * len(arrow)
        yield pa.table([pa.array(c, f.type) for c, f in zip(lists, arrow, strict=True)], schema=arrow)

    def opened(self, table, saved=False):
        """Orders (None with a saved model), y, regressors and their names, and what of the options isn't a setting of the model."""
        import numpy as np
        import pyarrow as pa

        from tidewright.functions.kernel import Spec

        times = table.column("t").to_pylist()
        if any(t is None for t in times) or any(a >= b for a, b in zip(times, times[1:], strict=False)):
            raise ValueError("the rows need ORDER BY t, without null or repeated times")
        number = lambda c: table.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy().astype(float)
        exog = [n for n in table.column_names if n not in ("series", "t", "y")]
        o, own = dict(self.options), {}
        for name, usual in (("params", None), ("compute_bse", True), ("h", 12), ("level", 0.95), ("nlags", 10), ("orders", None)):
            own[name] = o.pop(name, usual)
        x = np.column_stack([number(c) for c in exog]) if exog else np.zeros((table.num_rows, 0))
        return None if saved else Spec(r=len(exog), **o), number("y"), x, exog, own

    def saved(self, table):
        """The saved model's rows, or None where the table has no model columns, and the data."""
        import pyarrow.compute as pc

        columns = ["kind", "name", "idx", "value", "value_list"]
        if "kind" not in table.column_names:
            return None, table
        ours = pc.is_valid(table.column("kind"))
        data = table.filter(pc.invert(ours)).drop_columns(columns)
        rows = list(zip(*(table.filter(ours).column(c).to_pylist() for c in columns), strict=True))
        if not rows:
            raise ValueError(f"no model for {table.column('series')[0].as_py()}")
        if clash := set(self.options) - {"h", "level", "nlags", "compute_bse"}:
            raise ValueError(f"a saved model has its own {', '.join(sorted(clash))}")
        return rows, data

    def model(self, rows):
        """The model read from its table's rows."""
        import pyarrow as pa

        from tidewright.operators import model as M

        kind, name, idx, value, lists = zip(*rows, strict=True)
        return M.Model(pa.table({"kind": list(kind), "name": list(name), "idx": list(idx), "value": pa.array(value, pa.float64()), "value_list": pa.array(lists, pa.list_(pa.float64()))}))

    def given(self, table, ahead=False):
        """The model, y and x of its data, and the options: a saved model, or one of the series (with ahead, of what comes before the last h rows of regressors)."""
        from tidewright.operators import model as M

        rows, table = self.saved(table)
        spec, y, x, exog, own = self.opened(table, rows is not None)
        if rows is not None:
            m = self.model(rows)
            if m.exog or not ahead:
                m.check(exog)
            return m, y, M.future_rows(m, own["h"], table.column("t"), x) if ahead and m.exog else x, own
        n = len(y) - own["h"] if ahead and exog else len(y)
        if n < 1:
            raise ValueError(f"a model with regressors needs the series and {own['h']} rows of the future")
        m = self.model(M.fit_rows(spec, y[:n], x[:n], exog, False, own["params"]))
        return m, y, x[n:] if ahead else x, own

    def residuals(self, table):
        """The model, and (t, v, f, std_resid) on its scale."""
        from tidewright.operators import model as M

        m, y, x, own = self.given(table)
        return m, M.residual_rows(m, y, x) if len(y) else [], own


class Fit(_Series):
    schema = FIT

    def rows(self, table):
        from tidewright.operators import model as M

        if self.saved(table)[0]:
            raise ValueError("tw_fit takes no saved model")
        spec, y, x, exog, own = self.opened(table)
        return M.fit_rows(spec, y, x, exog, own["compute_bse"], own["params"], M.span(M.clock(table.column("t"))))


class Forecast(_Series):
    schema = FORECAST

    def rows(self, table):
        from statistics import NormalDist

        from tidewright.operators import model as M

        m, _, future, own = self.given(table, ahead=True)
        if not 0 < own["level"] < 1:
            raise ValueError("level must be between 0 and 1")
        z = NormalDist().inv_cdf(0.5 + own["level"] / 2)
        return [(i, mean, v**0.5, mean - z * v**0.5, mean + z * v**0.5, d, dv**0.5) for i, mean, v, d, dv in M.forecast_rows(m, own["h"], future)]


class Residuals(_Series):
    schema = RESIDUALS

    def rows(self, table):
        return self.residuals(table)[1]


class Summary(_Series):
    schema = SUMMARY

    def rows(self, table):
        from math import erfc, sqrt

        from tidewright.operators.model import Z95, fit_rows

        rows, table = self.saved(table)
        if rows is None:
            spec, y, x, exog, own = self.opened(table)
            rows = fit_rows(spec, y, x, exog, own["compute_bse"], own["params"])
        bse = {i: v for kind, _, i, v, _ in rows if kind == "bse"}
        for kind, name, i, c, _ in rows:
            if kind == "param":
                e = bse.get(i)
                z = c / e if c is not None and e else None
                span = (c - Z95 * e, c + Z95 * e) if c is not None and e is not None else (None, None)
                yield (i, name, c, e, z, None if z is None else erfc(abs(z) / sqrt(2)), *span)


class Evaluate(_Series):
    schema = EVALUATE

    def rows(self, table):
        from math import isfinite

        m, found, _ = self.residuals(table)
        z = [r[3] for r in found if r[3] is not None]
        good = sum(map(isfinite, z)) / len(z) if z else None
        return [(*(m.meta[n] for n in ("loglik", "aic", "bic", "sigma2")), float(m.n_eff), m.meta["converged"], good)]


class LjungBox(_Series):
    schema = LJUNGBOX

    def rows(self, table):
        from math import erfc, exp, lgamma, log, sqrt

        import numpy as np

        _, found, own = self.residuals(table)
        z = np.array([r[3] for r in found if r[3] is not None])
        if not len(z):
            return []
        z, n = z - z.mean(), len(z)
        stat, tails = 0.0, {}
        for k in range(1, own["nlags"] + 1):
            stat += n * (n + 2) * float(z[k:] @ z[:-k] / (z @ z)) ** 2 / (n - k)
            half, a = stat / 2, 1.0 if k % 2 == 0 else 0.5
            tail = exp(-half) if a == 1 else erfc(sqrt(half))
            while a < k / 2 and half > 0:  # Q(a + 1, x) = Q(a, x) + x**a exp(-x) / gamma(a + 1)
                tail += exp(a * log(half) - half - lgamma(a + 1))
                a += 1
            tails[k] = (k, stat, min(tail, 1.0))
        return list(tails.values())


class Grid(_Series):
    schema = GRID

    def rows(self, table):
        from tidewright.functions.kernel import Spec
        from tidewright.operators import model as M

        if self.saved(table)[0]:
            raise ValueError("tw_grid takes no saved model")
        _, y, x, exog, own = self.opened(table)
        if exog or own["orders"] is None:
            raise ValueError("tw_grid needs orders and takes no regressors")
        for o in own["orders"]:
            yield (*o, *M.grid_row(Spec(*o), y))


FUNCTIONS = {"tw_fit": Fit, "tw_forecast": Forecast, "tw_residuals": Residuals, "tw_summary": Summary, "tw_evaluate": Evaluate, "tw_ljungbox": LjungBox, "tw_grid": Grid}


def with_model(model: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """model (series, kind, name, idx, value, value_list) and data (series, t, y, regressors..) as one table for the functions; y may be left out of the
    future's rows. Without data the model alone, for forecasts without regressors and summaries."""
    held = model.select(F.col("series").cast("string"), "kind", "name", "idx", "value", "value_list")
    if data is None:
        data = model.sparkSession.createDataFrame([], "series string, t long, y double")
    elif clash := set(data.columns) & {"kind", "name", "idx", "value", "value_list"}:
        raise ValueError(f"columns {', '.join(sorted(clash))} of the data are the model's")
    data = data.withColumn("series", F.col("series").cast("string"))
    return held.unionByName(data if "y" in data.columns else data.withColumn("y", F.lit(None).cast("double")), allowMissingColumns=True)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to spark.sql()."""
    for name, of in FUNCTIONS.items():
        spark.udtf.register(name, arrow_udtf(of, returnType=of.schema))

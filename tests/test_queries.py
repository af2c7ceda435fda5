"""Every registered query against its SQL twin, and what the public calls refuse."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.operators import checks, model
from tidewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    value = lambda v: round(v, 7) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = plain(tuple(r) for r in df.select(cols).collect())
    assert rows
    if name in registry.ORACLES:
        got = db.execute(registry.ORACLES[name])
        at = [[d[0] for d in got.description].index(c) for c in cols]
        assert rows == plain(tuple(r[i] for i in at) for r in got.fetchall())


def series(spark, rows, schema="t int, y double, x double"):
    return spark.createDataFrame(rows, schema)


def test_what_fit_refuses(spark):
    good = [(i, float(i % 5), float(i)) for i in range(30)]
    with pytest.raises(Exception, match="null or a repeated"):
        model.fit(series(spark, [*good, (3, 1.0, 1.0)]), "y", "t").collect()
    with pytest.raises(Exception, match="no value"):
        model.fit(series(spark, [(i, None, 1.0) for i in range(9)]), "y", "t").collect()
    with pytest.raises(Exception, match="regressor x has null values at times 31 to 31"):
        model.fit(series(spark, [*good, (40, 1.0, None)]), "y", "t", exog_cols=["x"]).collect()
    with pytest.raises(Exception, match="regressor z depends"):
        model.fit(series(spark, good).withColumn("z", F.col("x") * 2), "y", "t", exog_cols=["x", "z"]).collect()
    with pytest.raises(Exception, match="too short"):
        model.fit(series(spark, good[:10]), "y", "t", p=1, sq=1, s=12).collect()
    with pytest.raises(ValueError, match="at most 32"):
        model.fit(series(spark, good), "y", "t", exog_cols=[f"x{i}" for i in range(33)])


def test_what_forecast_refuses(spark):
    m = model.fit(series(spark, [(i, float(i % 5), float(i)) for i in range(30)]), "y", "t", exog_cols=["x"])
    with pytest.raises(ValueError, match="newdata"):
        model.forecast(m, 3, exog_cols=["x"])
    future = series(spark, [(31, None, 1.0), (32, None, 2.0)])
    with pytest.raises(Exception, match="lack steps 3 to 3"):
        model.forecast(m, 3, future, "t", ["x"]).collect()
    with pytest.raises(Exception, match="regressors are"):
        model.forecast(m, 2, future, "t", ["y"]).collect()


def test_future_regressors_are_covered_by_time(spark):
    """History is left out, further rows aren't read, and times that lack are named though the number of rows is right."""
    import datetime as dt

    rows = [(10 + 5 * i, float(i % 5), float(i)) for i in range(40)]
    df = series(spark, rows)
    m = model.fit(df.filter("t < 160"), "y", "t", exog_cols=["x"], params=[2.0, 1.0])
    got = model.forecast(m, 3, df, "t", ["x"]).orderBy("h").collect()
    assert [r["yhat"] for r in got] == [60.0, 62.0, 64.0]
    with pytest.raises(Exception, match="lack times 165 to 165, 1 of the 3 from 160 to 170"):
        model.forecast(m, 3, df.filter("t > 155 AND t <> 165"), "t", ["x"]).collect()
    with pytest.raises(Exception, match="lack steps 1 to 3"):
        model.forecast(m, 3, df.filter("t < 160"), "t", ["x"]).collect()
    days = spark.createDataFrame([(dt.date(2024, 2, 1) + dt.timedelta(i), float(i % 5), float(i)) for i in range(60)], "t date, y double, x double")
    m = model.fit(days.filter("t < '2024-02-29'"), "y", "t", exog_cols=["x"], params=[2.0, 1.0])
    with pytest.raises(Exception, match="lack times 2024-02-29 to 2024-03-02"):
        model.forecast(m, 4, days.filter("t > '2024-03-02'"), "t", ["x"]).collect()
    streamed = model.fit(days.filter("t < '2024-02-29'"), "y", "t", exog_cols=["x"], params=[2.0, 1.0], out_of_core=True)
    with pytest.raises(Exception, match="lack times 2024-02-29 to 2024-03-02"):
        model.forecast(streamed, 4, days.filter("t > '2024-03-02'"), "t", ["x"]).collect()
    stamps = days.withColumn("t", F.col("t").cast("timestamp"))
    m = model.fit(stamps.filter("t < '2024-02-29'"), "y", "t", exog_cols=["x"], params=[2.0, 1.0])
    assert [r["yhat"] for r in model.forecast(m, 2, stamps, "t", ["x"]).orderBy("h").collect()] == [56.0, 58.0]
    words = df.withColumn("t", F.format_string("%09d", "t"))  # of other types only the order counts
    m = model.fit(words.filter("t < '000000160'"), "y", "t", exog_cols=["x"], params=[2.0, 1.0])
    assert [r["yhat"] for r in model.forecast(m, 2, words.filter("t > '000000170'"), "t", ["x"]).orderBy("h").collect()] == [66.0, 68.0]


def test_probes_of_one_system_are_side_by_side(spark):
    from tidewright.functions.kernel import Spec
    from tidewright.operators import filter

    rows = [(i, [i / 100.0, 0.5 if i % 2 else 0.2, 2.0]) for i in range(128)]
    probes, spec = spark.createDataFrame(rows, "probe_id long, params array<double>").repartition(3), Spec(p=1, r=1)
    blocks = [[(r["probe_id"], r["params"][1]) for r in b["probes"]] for b in filter.dealt(probes, spec).collect()]
    assert sorted(len(b) for b in blocks) == [64, 64] and all(len({phi for _, phi in b}) == 1 for b in blocks)
    assert sorted(i for b in blocks for i, _ in b) == list(range(128))


def test_large_whole_time_keys_are_not_rounded(spark):
    rows = [(2**53 + i, float(v)) for i, v in enumerate([3, 1, 2, 5])]
    m = model.fit(spark.createDataFrame(rows[::-1], "t long, y double"), "y", "t", params=[1.0])
    assert [r["v"] for r in model.residuals(m, spark.createDataFrame(rows, "t long, y double"), "y", "t").orderBy("t").collect()] == [3, 1, 2, 5]


def test_exog_errors_name_column_and_times(spark):
    x = spark.createDataFrame([(t, 1, 1.0) for t in (1, 2, 4)], "t long, j int, x double")
    with pytest.raises(Exception, match="regressor 1 lacks times 3 to 5"):
        checks.validate_exog(x, 5).collect()
    twice = spark.createDataFrame([(t, j, float(t * j)) for t in range(1, 6) for j in (1, 2)], "t long, j int, x double")
    with pytest.raises(Exception, match="regressor 2 depends"):
        checks.rank_check(twice).collect()


def test_many_series_fit_as_each_alone(spark):
    rows = [(k, i, float((i * 7 * (k + 1)) % 11)) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t int, y double")
    every = {r["k"]: r["loglik"] for r in model.metrics(model.fit(df, "y", "t", p=1, keys=("k",)), ("k",)).collect()}
    for k in range(3):
        assert model.metrics(model.fit(df.filter(F.col("k") == k), "y", "t", p=1)).first()["loglik"] == every[k]


def test_products_are_hash_joins(spark):
    from tidewright.operators import matrices

    a = matrices.identity(spark, 4)
    plan = matrices.kronecker(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashJoin") + plan.count("SortMergeJoin") >= 2 and "CartesianProduct" not in plan


def test_fit_out_of_core_fails_if_not_converged(spark, monkeypatch):
    given = {}

    def ended_early(*args, **more):
        given.update(more)
        return spark.createDataFrame([("meta", "converged", 4, 0.0)], "kind string, name string, idx int, value double")

    monkeypatch.setattr(registry.chunked, "fit_stream", ended_early)
    with pytest.raises(Exception, match="has not converged"):
        registry.QUERIES["fit_out_of_core"](spark, SF).collect()
    assert "most" not in given


def test_a_stream_is_the_series(spark):
    """A streamed fit gives the model table that a fit in memory gives at the same parameters, forecasts with it."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal(400)
    y = np.cumsum(rng.standard_normal(400)) + 2 * x
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "t long, y double, x double").repartition(5)
    par = [1.9, 0.3, -0.2, 1.1]
    of = lambda **more: {(r["kind"], r["name"], r["idx"]): (r["value"], r["value_list"]) for r in model.fit(df, "y", "t", p=1, d=1, q=1, exog_cols=["x"], params=par, **more).collect()}
    plain, streamed = of(), of(out_of_core=True)
    assert plain.keys() == streamed.keys()
    for k, (v, values) in plain.items():
        assert streamed[k][0] == (v if v is None else pytest.approx(v, rel=1e-9)) and (values is None or np.allclose(values, streamed[k][1])), k
    with pytest.raises(ValueError, match="no keys"):
        model.fit(df, "y", "t", keys=("x",), out_of_core=True)


def test_a_stream_is_sorted_once(spark):
    from tidewright.functions.kernel import Spec
    from tidewright.streaming import chunked

    df = spark.range(200_000).selectExpr("200000 - id AS t", "cast(id % 7 AS double) AS y", "uuid() AS other")
    got = chunked.dense_index(df.withColumnRenamed("t", "k"), "k", 8)
    assert got.agg(F.countDistinct("t"), F.max("t")).first() == (200_000, 200_000)
    rows = chunked.Stream(df, "y", "t", [], Spec()).rows
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["block"], r["start"], len(r["y"])) for r in rows.collect())[:2] == [(0, 1, 1 << 15), (1, (1 << 15) + 1, 1 << 15)]


@pytest.mark.parametrize(
    "orders",
    [
        dict(p=1, q=1, trend="ct"),
        dict(d=1, q=1, sd=1, sq=1, s=4, r=2),
        dict(p=1, d=1, q=1, sd=1, sp=1, s=4, simple_differencing=False, trend="ct", concentrate=True),
        dict(p=2, d=1, r=1, trend="c", simple_differencing=False),
        dict(),
    ],
)
@pytest.mark.parametrize("size, fan", [(64, 3), (1 << 15, 256)])
def test_ranges_of_time_are_one_filter(spark, monkeypatch, orders, size, fan):
    """Likelihood, last state, residuals and start values of blocks against the filter and the regressions over the whole series."""
    import numpy as np

    from tidewright.functions import kernel as K
    from tidewright.operators.model import model_scale
    from tidewright.sources import series
    from tidewright.streaming import chunked

    monkeypatch.setattr(series, "BLOCK", size)
    monkeypatch.setattr(chunked, "FAN", fan)
    spec, rng, n = K.Spec(**orders), np.random.default_rng(7), 1501
    x = rng.standard_normal((n, spec.r))
    y = np.cumsum(rng.standard_normal(n)) * 0.2 + rng.standard_normal(n) + x.sum(axis=1)
    y[rng.integers(0, n, 60)] = y[700:790] = np.nan
    names = [f"x{i}" for i in range(spec.r)]
    rows = [(i * i, None if np.isnan(y[i]) else float(y[i]), *map(float, x[i])) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, ", ".join(["k long", "y double", *(f"{c} double" for c in names)])).repartition(3)
    w, z = model_scale(spec, y, x)
    u = K.start_values(spec, w, z)
    par = K.constrain(spec, np.stack([u, u * 0.8]))
    want = K.kalman(spec, w, z, par, trace=True)
    stream = chunked.Stream(df, "y", "k", names, spec)
    ll, scale = stream.evaluate(spec, par)
    assert np.allclose(ll, want.loglik, rtol=1e-10) and np.allclose(scale, want.scale, rtol=1e-10)
    for i, (a, b) in enumerate(zip(stream.end(par[0]), (want.a[0], want.p[0]), strict=True)):
        assert np.allclose(a, b, rtol=1e-7, atol=1e-8), i
    got = sorted(stream.residuals(par[0], 2.0).collect())
    assert [r["t"] for r in got] == list(range(1, len(w) + 1))
    v, f = (np.array([np.nan if r[c] is None else r[c] for r in got]) for c in ("v", "f"))
    assert np.allclose(v, want.v[:, 0], rtol=1e-6, atol=1e-7, equal_nan=True) and np.allclose(f, want.f[:, 0] * 2, rtol=1e-6)
    assert np.allclose(stream.start_values(), u, rtol=1e-6, atol=1e-8)


def test_out_of_core_residuals_and_what_they_refuse(spark):
    rows = [(i, None if i % 50 == 3 else float((i * 7) % 11), float(i % 3)) for i in range(400)]
    df = series(spark, rows).repartition(4)
    m = model.fit(df, "y", "t", p=1, d=1, exog_cols=["x"], params=[0.5, 0.3, 9.0])
    plain, ranged = (sorted(map(tuple, model.residuals(m, df, "y", "t", ["x"], out_of_core=o).collect())) for o in (False, True))
    assert [[v if v is None else round(v, 9) for v in r] for r in plain] == [[v if v is None else round(v, 9) for v in r] for r in ranged]
    assert model.evaluate(m, df, "y", "t", ["x"], out_of_core=True).first()["resid_finite_frac"] == 1
    with pytest.raises(ValueError, match="without keys"):
        model.residuals(m, df, "y", "t", ["x"], keys=("x",), out_of_core=True)
    with pytest.raises(ValueError, match="null or a repeated"):
        model.residuals(m, df.union(df.limit(1)), "y", "t", ["x"], out_of_core=True)
    with pytest.raises(ValueError, match="regressors are"):
        model.residuals(m, df, "y", "t", out_of_core=True)
    with pytest.raises(Exception, match="null values"):
        model.fit(df.withColumn("x", F.when(F.col("t") != 9, F.col("x"))), "y", "t", exog_cols=["x"], out_of_core=True)


def test_long_series_without_one_partition_windows(spark):
    """What looks back does so within blocks, for one series and for many."""
    from tidewright.operators import differencing, lags
    from tidewright.sources import series as S

    df = spark.range(100_000).selectExpr("id % 2 AS key", "(id * 7919) % 100003 AS k", "cast((id * id) % 17 AS double) AS y")
    for keys in ((), ("key",)):
        one = S.series_of(df, "y", "k", keys)
        lagged = differencing.difference(one, 1, 1, 12, keys)
        plan = lagged._jdf.queryExecution().executedPlan().toString().split("\n")
        below = [b for a, b in zip(plan, plan[1:], strict=False) if "Exchange SinglePartition" in a]
        assert all("HashAggregate(keys=[__part" in b for b in below)  # a row a range
        own = sorted(df.collect(), key=lambda r: ((r["key"] if keys else 0), r["k"]))
        want = {}
        for g in {r["key"] if keys else 0 for r in own}:
            y = [r["y"] for r in own if not keys or r["key"] == g]
            e = [b - a for a, b in zip(y, y[1:], strict=False)]
            want[g] = [b - a for a, b in zip(e, e[12:], strict=False)]
        got = {}
        for r in sorted(lagged.collect(), key=lambda r: r["t"]):
            got.setdefault(r["key"] if keys else 0, []).append(r["w"])
        assert got == want
        r = {(x["key"] if keys else 0, x["lag"]): x["acf"] for x in lags.acf(one, 40, keys).collect()}
        assert len(r) == 41 * len(want) and all(abs(r[g, 0] - 1) < 1e-12 for g in want)


def test_sql_functions_are_the_operators(spark):
    """Each table function gives what the DataFrame operator gives, series by series."""
    import math

    from tidewright import sqlapi

    sqlapi.register(registry.ship(spark))
    rows = [(k, i, None if i in (5, 11) and k == "b" else float((i * 7 + i * i % 5) % 11), float((i * 3) % 7)) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "series string, t long, y double, x double").repartition(3)
    df.createOrReplaceTempView("tw_data")
    df.drop("x").createOrReplaceTempView("tw_plain")
    call = lambda name, options, table="tw_plain": spark.sql(f"SELECT * FROM {name}(TABLE({table}) PARTITION BY series ORDER BY (t), '{options}')")

    def same(got, wanted):
        assert got.columns == wanted.columns
        got, wanted = (sorted(map(tuple, d.collect()), key=lambda r: [str(v) for v in r if not isinstance(v, float)]) for d in (got, wanted))
        assert len(got) == len(wanted) > 0
        for a, b in zip(got, wanted, strict=True):
            for u, v in zip(a, b, strict=True):
                assert math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-9) if isinstance(u, float) and isinstance(v, float) else u == v, (a, b)

    key = ("series",)
    m = model.fit(df, "y", "t", p=1, d=1, params=[0.3, 9.0], keys=key)
    of = '{"p": 1, "d": 1, "params": [0.3, 9.0]%s}'
    same(call("tw_fit", of % "").drop("value_list"), m.drop("value_list"))
    same(call("tw_summary", of % ""), model.summary(m, key))
    same(call("tw_residuals", of % ""), model.residuals(m, df, "y", "t", keys=key))
    same(call("tw_evaluate", of % ""), model.evaluate(m, df, "y", "t", keys=key))
    same(call("tw_ljungbox", of % ', "nlags": 7'), model.ljungbox(m, df, "y", "t", 7, keys=key))
    same(call("tw_forecast", of % ', "h": 5, "level": 0.8'), model.forecast(m, 5, level=0.8, keys=key))
    with_x = model.fit(df.filter("t < 56"), "y", "t", d=1, exog_cols=["x"], params=[0.5, 4.0], keys=key)
    same(call("tw_forecast", '{"d": 1, "params": [0.5, 4.0], "h": 4}', "tw_data"), model.forecast(with_x, 4, df.filter("t >= 56"), "t", ["x"], keys=key))
    saved, plain = registry.written(m, "model"), df.drop("x")
    sqlapi.with_model(saved, plain).createOrReplaceTempView("tw_both")
    sqlapi.with_model(saved).createOrReplaceTempView("tw_alone")
    same(call("tw_residuals", "{}", "tw_both"), model.residuals(m, df, "y", "t", keys=key))
    same(call("tw_evaluate", "{}", "tw_both"), model.evaluate(m, df, "y", "t", keys=key))
    same(call("tw_ljungbox", '{"nlags": 7}', "tw_both"), model.ljungbox(m, df, "y", "t", 7, keys=key))
    same(call("tw_summary", "{}", "tw_alone"), model.summary(m, key))
    same(call("tw_forecast", '{"h": 5, "level": 0.8}', "tw_alone"), model.forecast(m, 5, level=0.8, keys=key))
    sqlapi.with_model(registry.written(with_x, "model"), df.filter("t >= 56").drop("y")).createOrReplaceTempView("tw_future")
    same(call("tw_forecast", '{"h": 4}', "tw_future"), model.forecast(with_x, 4, df.filter("t >= 56"), "t", ["x"], keys=key))
    for name, options, table, error in (
        ("tw_fit", "{}", "tw_both", "takes no saved model"),
        ("tw_residuals", '{"p": 1}', "tw_both", "has its own p"),
        ("tw_forecast", '{"h": 9}', "tw_future", "lack steps 5 to 9"),
        ("tw_forecast", '{"h": 3}', "(SELECT * FROM tw_future WHERE t IS NULL OR t <> 57)", "lack times 57 to 57"),
    ):
        with pytest.raises(Exception, match=error):
            call(name, options, table).collect()
    sqlapi.with_model(saved.filter("series = 'a'"), plain).createOrReplaceTempView("tw_half")
    with pytest.raises(Exception, match="no model for b"):
        call("tw_residuals", "{}", "tw_half").collect()
    with pytest.raises(ValueError, match="columns value of the data"):
        sqlapi.with_model(saved, df.withColumnRenamed("x", "value"))
    orders = [(0, 0, 0, 0, 0, 0, 1), (1, 0, 0, 0, 0, 0, 1), (1, 0, 0, 2, 0, 0, 40)]
    same(call("tw_grid", f'{{"orders": {[list(o) for o in orders]}}}'), model.grid(df, "y", "t", orders, key))


def test_elimination_in_blocks(spark, monkeypatch):
    """Several block rows and rounds of picks, rows that must move, lacking cells, two right sides; and a singular matrix."""
    import numpy as np

    from tidewright.operators import elimination, matrices

    monkeypatch.setattr(elimination, "FAN", 2)
    rng = np.random.default_rng(5)
    a = rng.normal(size=(18, 18)) * (rng.random((18, 18)) < 0.7)
    a[0, 0], b = 0.0, rng.normal(size=(18, 2))
    table = lambda x: spark.createDataFrame([(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(x) if v], "i int, j int, v double")
    got = matrices.solve(table(a), table(b), block=5).collect()
    x = np.zeros((18, 2))
    for r in got:
        x[r["i"] - 1, r["j"] - 1] = r["v"]
    assert len(got) == 36 and all(r["ok"] for r in got)
    assert np.allclose(x, np.linalg.solve(a, b), rtol=1e-9, atol=1e-9)
    a[:, 3] = a[:, 7]
    bad = matrices.solve(table(a[:8, :8]), table(b[:8]), block=8).collect()
    assert not any(r["ok"] for r in bad) and bad[0]["pivmin"] < 1e-12
    sizes = [r["piv"] for r in elimination.pivots(table(np.array([[1.0, 2], [4, 2]]))).orderBy("j").collect()]
    assert sizes == [4.0, 1.5]


def test_rank_check_whatever_the_units(spark):
    """Independent regressors in very different units pass; dependent ones fail in any."""
    cells = lambda c: spark.createDataFrame([(t, j, float(v)) for t in range(40) for j, v in ((1, 1e7 * (t + 1)), (2, 1e-2 * ((t * 7) % 5 + c * t)))], "t long, j int, x double")
    assert all(r["ok"] for r in checks.rank_check(cells(1)).collect())
    same = cells(1).filter("j = 1").unionByName(cells(1).filter("j = 1").selectExpr("t", "2 AS j", "x / 1e9 AS x"))
    with pytest.raises(Exception, match="regressor 2 depends on the others"):
        checks.rank_check(same).collect()


def test_a_series_in_order_is_not_dealt_again(spark):
    """Ranges in order become runs as they are; repeats, nulls and disorder are seen, also at borders, and copies at blocks' borders are right."""
    from tidewright.sources import series as S

    df = spark.range(0, 100_000, 1, 5).selectExpr("id * 3 AS k", "cast(id % 11 AS double) AS y")
    of = S.Packed(df, "y", "k")
    assert (of.n, of.seen, of.bad) == (100_000, 100_000, False) and "rangepartitioning" not in of.runs._jdf.queryExecution().toString().lower()
    rows = of.runs.orderBy("t0").collect()
    assert rows[0]["t0"] == 1 and all(a["t0"] + len(a["y"]) == b["t0"] for a, b in zip(rows, rows[1:], strict=False))
    assert [v for r in rows for v in r["y"]] == [float(i % 11) for i in range(100_000)]
    for more in ("3 AS k", "cast(null AS long) AS k"):
        assert S.Packed(df.union(spark.range(1).selectExpr(more, "0.0 AS y")), "y", "k").bad
    assert not S.Packed(df.repartition(3), "y", "k").bad
    got = {}
    for r in S.cut(of.runs, 1000, 13).collect():
        got.setdefault(r["__block"], []).extend(range(r["t0"], r["t0"] + len(r["y"])))
    assert all(sorted(ts) == list(range(max(1, b * 1000 - 12), min(100_000, (b + 1) * 1000) + 1)) for b, ts in got.items() if b < 100)


def test_long_rows_are_read_a_few_at_a_time(spark):
    """Long arrays of few different values are small on disk, so groups are bounded by rows: a reader decodes a group at once. Pieces leave cut() a few blocks at a time."""
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewright.functions.kernel import Spec
    from tidewright.sources import series as S
    from tidewright.streaming import chunked

    df = spark.range(0, 80 * S.BLOCK, 1, 2).selectExpr("id AS k", "cast(id % 11 AS double) AS y")
    stream = chunked.Stream(df, "y", "k", [], Spec(p=1))
    for table, n in ((stream.packed.runs, 80), (stream.rows, 80)):
        metas = [pq.read_metadata(f.removeprefix("file://")) for f in table.inputFiles() if Path(f.removeprefix("file://")).suffix == ".parquet"]
        groups = [m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)]
        assert sum(groups) >= n and max(groups) <= 16
    assert stream.rows.count() == 80
    y = pa.array([[1.0] * S.BLOCK] * 40, pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([y, pa.array([[]] * 40, pa.list_(pa.float64()))], ["y", "x"]).slice(3)
    sizes = [b.num_rows for b in S._portions(iter([batch]))]
    assert sum(sizes) == 37 and max(sizes) <= 4


def test_packed_series_are_not_spread_into_rows(spark):
    """Differences and ACF of a packed series are those of its rows, without a row a time before the blocks; bad times fail by name."""
    from tidewright.operators import differencing, lags
    from tidewright.sources import series as S

    df = spark.range(70_000).selectExpr("id * 2 AS k", "CASE WHEN id % 97 > 2 THEN cast(id * id % 13 AS double) END AS y", "cast(id * id % 13 AS double) AS whole").repartition(3)
    of, rows = S.Packed(df, "y", "k"), S.series_of(df, "y", "k")
    got, want = (differencing.difference(x, 1, 1, 12) for x in (of, rows))
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    got, want = (sorted(lags.acf(x, 20).collect()) for x in (S.Packed(df, "whole", "k"), S.series_of(df, "whole", "k")))
    assert [r["lag"] for r in got] == list(range(21)) and all(abs(a["acf"] - b["acf"]) < 1e-12 for a, b in zip(got, want, strict=True))
    assert all(r["acf"] is None for r in lags.acf(of, 2).collect())
    with pytest.raises(ValueError, match="missing value"):
        differencing.difference(of, 1, 0, strict=True)
    bad = S.Packed(df.union(df.limit(1)), "y", "k")
    for f in (lambda: lags.acf(bad, 2), lambda: differencing.difference(bad, 1, 0)):
        with pytest.raises(ValueError, match="time column k has a null or a repeated value"):
            f()


def test_a_stream_is_packed_and_filtered_once(spark, monkeypatch):
    """Fit at given parameters, residuals, evaluate and Ljung-Box of one Stream: results as from the data, blocks' elements found once; another model's stream is refused."""
    from tidewright.functions.kernel import Spec
    from tidewright.sources import series as S
    from tidewright.streaming import chunked

    monkeypatch.setattr(S, "BLOCK", 64)
    calls, elements = [], chunked.Stream._elements
    monkeypatch.setattr(chunked.Stream, "_elements", lambda self, par: calls.append(1) or elements(self, par))
    df = spark.range(500).selectExpr("id AS k", "CASE WHEN id % 50 != 3 THEN cast((id * 7) % 11 - 5 AS double) END AS y")

    def results(data):
        m = model.fit(data, "y", "k", p=1, params=[0.5, 9.0], compute_bse=False, out_of_core=True)
        parts = [m, *(f(m, data, "y", "k", *more, out_of_core=True) for f, more in ((model.residuals, ()), (model.evaluate, ()), (model.ljungbox, (4,))))]
        return [sorted(map(str, p.collect())) for p in parts]

    stream = chunked.Stream(df, "y", "k", [], Spec(p=1))
    got = results(stream)
    assert len(calls) == 1 and got == results(df)
    with pytest.raises(ValueError, match="another model"):
        model.fit(stream, "y", "k", p=2, out_of_core=True)


def test_small_batches_give_the_setting_back(spark):
    """Long rows go to Python 8 MB at a time, and the session's own limit holds again after, also after an error."""
    from pyspark.sql import functions as F

    from tidewright import session

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 100, 1, 1).select(F.array_repeat(F.lit(1.0), 1 << 15).alias("y"))  # 256 KB each
    sizes = rows.mapInPandas(lambda bs: (b.iloc[:1].assign(n=len(b))[["n"]] for b in bs), "n long")
    got = [r["n"] for r in session.written(sizes, "sizes", long=True).collect()]
    assert sum(got) == 100 and max(got) <= 40 and spark.conf.get(key) == before
    with pytest.raises(RuntimeError), session.small_batches(spark):
        assert spark.conf.get(key) != before
        raise RuntimeError
    assert spark.conf.get(key) == before

"""The filter over a stream against the filter over all its rows."""

import numpy as np
import pytest

from tidewright.functions import kernel as K
from tidewright.operators import model
from tidewright.session import shared_path, written
from tidewright.streaming import live

ORDERS = [
    dict(p=1, q=1, trend="ct"),
    dict(d=1, q=1, sd=1, sq=1, s=4),
    dict(p=1, d=1, q=1, simple_differencing=False, trend="c", concentrate=True),
    dict(),
]


@pytest.mark.parametrize("orders", ORDERS)
@pytest.mark.parametrize("delay", [0, 9])
def test_parts_are_one_filter(orders, delay, monkeypatch):
    """State that is kept between parts of any size, rows in disorder within the delay, gaps, pieces."""
    monkeypatch.setattr(live, "PIECE", 50)
    spec, rng, n = K.Spec(**orders), np.random.default_rng(3), 400
    y = np.cumsum(rng.standard_normal(n)) * 0.3 + rng.standard_normal(n)
    y[rng.integers(0, n - 1, 30)] = y[150:290] = np.nan
    w = K.difference(y, spec.d, spec.sd, spec.s) if spec.simple_differencing else y
    par = K.constrain(spec, K.start_values(spec, w, np.zeros((len(w), 0)))[None])
    want = K.kalman(spec, w, np.zeros((len(w), 0)), par)
    t = np.arange(1, n + 1)
    given = np.flatnonzero(~np.isnan(y) | (rng.random(n) < 0.5))  # a missing one is a row without y or no row
    if delay:
        given = given[np.argsort(t[given] + rng.integers(0, delay, len(given)), kind="stable")]
    held = None
    for part in np.array_split(given, 13):
        one = live.Series(spec, par[0], held)
        one.take(t[part], y[part], delay)
        held = one.held()
    assert len(one.wait_t) <= delay
    if delay:
        one.take(np.array([n + delay]), np.array([np.nan]), delay)  # what waits is applied
    got = dict(zip([c.split()[0] for c in live.RESULT.split(", ")], one.row(), strict=True))
    assert got["late"] == 0 and got["n_seen"] == (~np.isnan(y)).sum()
    assert one.t == n
    if not delay:
        assert got["loglik"] == float(want.loglik[0]) and got["a"] == want.a[0].tolist() and got["p"] == want.p[0].ravel().tolist()
    assert np.isclose(got["loglik"], want.loglik[0], rtol=1e-12) and np.isclose(got["scale2"], want.scale[0], rtol=1e-12)


def test_late_rows_change_nothing():
    spec, par = K.Spec(p=1), np.array([0.5, 2.0])
    one = live.Series(spec, par, None)
    one.take(np.array([3, 1, 1, 0]), np.array([3.0, 7.0, 1.0, 5.0]), 0)  # position 0 is none; of two at 1 the smaller y counts
    assert (one.late, one.seen, one.t) == (2, 2, 3)
    before = one.held()
    again = live.Series(spec, par, before)
    again.take(np.array([2, 3]), np.array([9.0, 9.0]), 0)
    assert again.late == 4 and again.held()[6:] == before[6:]
    want = K.kalman(spec, np.array([1, np.nan, 3.0]), np.zeros((3, 0)), par[None])
    assert again.row()[5] == float(want.loglik[0])
    again.take(np.zeros(0, np.int64), np.zeros(0), 0)
    assert again.held()[6:] == before[6:]


def test_a_stream_without_models_or_with_regressors_fails(spark):
    rows = spark.createDataFrame([("a", i, float(i % 5), float(i * i % 7)) for i in range(1, 30)], "k string, t long, y double, x double")
    at = shared_path(spark, "stream")
    rows.write.parquet(at)
    stream = spark.readStream.schema(rows.schema).parquet(at)

    def run(m, keys=("k",)):
        out = live.follow(stream, written(m, "model"), "y", "t", keys).writeStream.format("noop").outputMode("append")
        out.option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    m = model.fit(rows, "y", "t", p=1, params=[0.5, 2.0], keys=("k",))
    run(m)
    with pytest.raises(Exception, match="no model for"):
        run(m.filter("k <> 'a'"))
    with pytest.raises(Exception, match="no regressors"):
        run(model.fit(rows, "y", "t", exog_cols=["x"], params=[0.5, 2.0], keys=("k",)))
    with pytest.raises(ValueError, match="delay"):
        live.follow(stream, m, "y", "t", ("k",), -1)
    with pytest.raises(ValueError, match="tell series apart"):
        live.follow(stream, m, "y", "t", ())

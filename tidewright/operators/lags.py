"""Lag matrices and autocorrelations of (keys.., t, y)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import bound, upto
from ..session import ship, written
from ..sources import series as S
from ..sources.series import in_blocks, over_time, own_rows


def lags(series: DataFrame, m: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., t, lag, value), lags 0..m, only where the earlier row exists."""
    rows, size = in_blocks(series.select(*keys, "t", "y"), m)
    w = over_time((*keys, "__block"))
    cells = [F.struct(F.lit(k).alias("lag"), (F.lag("y", k).over(w) if k else F.col("y")).alias("value"), (F.col("t") > k).alias("there")) for k in range(m + 1)]
    cells = own_rows(rows.withColumn("cells", F.array(*cells)), size)
    return cells.select(*keys, "t", F.explode("cells").alias("c")).filter("c.there").select(*keys, "t", F.col("c.lag").alias("lag"), F.col("c.value").alias("value"))


def lag_products(series: DataFrame | S.Packed, nlags: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., lag, product): sums of e_t * e_(t - lag), e being the deviations from the mean; t runs from 1 without gaps. A null y makes them null.

    Each block finds its rows' products with the rows before them; the blocks' sums are added. A packed series is never spread into rows."""
    if isinstance(series, S.Packed):
        return run_products(series.checked().runs, nlags, mean=series.mean)
    ship(series.sparkSession)
    mean = series.groupBy(*keys).agg(F.avg("y").alias("mean"))  # a row a series
    src = series.select(*keys, "t", "y")
    src = src.join(mean, list(keys)) if keys else src.crossJoin(F.broadcast(mean))
    runs = S.runs_of(src.select(*keys, "t", (F.col("y") - F.col("mean")).alias("e")), "e", keys)
    return run_products(runs, nlags, keys)


def run_products(runs: DataFrame, nlags: int, keys: tuple[str, ...] = (), mean: float = 0.0) -> DataFrame:
    """lag_products() of runs (keys.., t0, y, x), less the mean."""
    size = max(S.BLOCK, nlags)
    schema = T.StructType([runs.schema[k] for k in keys] + T.StructType.fromDDL("lag int, product double").fields)

    def run(table: pa.Table) -> pa.Table:
        t, y, _ = S.together(table)
        e = y.fill_null(float("nan")).to_numpy() - mean
        head = int(np.count_nonzero(t <= table.column("__block")[0].as_py() * size))
        own = e[head:]
        some = range(min(nlags, len(e) - 1) + 1) if len(own) else ()
        of = [float(own[max(k - head, 0) :] @ e[max(head, k) - k : len(e) - k]) for k in some]
        key = [pa.repeat(table.column(k)[0], len(of)) for k in keys]
        return pa.table([*key, pa.array(list(some), pa.int32()), pa.array(of, pa.float64())], [*keys, "lag", "product"])

    each = S.cut(runs, size, nlags, keys).groupBy(*keys, "__block").applyInArrow(run, schema)
    total = each.groupBy(*keys, "lag").agg(F.sum("product").alias("product"))
    return total.withColumn("product", F.when(~F.isnan("product"), F.col("product")))


def acf(series: DataFrame | S.Packed, nlags: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., lag, acf), lags 0..nlags: mean-corrected, all divided by the sum of squares of the whole series."""
    if isinstance(series, S.Packed):  # a row a lag, written so that its two readers don't both find it
        return acf_of(written(lag_products(series, nlags), "products"))
    return acf_of(lag_products(series.filter(F.col("t").isNotNull()), nlags, keys), keys)


def acf_of(each: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """acf() from lag_products()."""
    whole = each.filter("lag = 0").select(*keys, F.col("product").alias("whole"))  # a row a series
    each = each.join(whole, list(keys)) if keys else each.crossJoin(F.broadcast(whole))
    return each.select(*keys, "lag", F.try_divide("product", "whole").alias("acf"))


def pacf(series: DataFrame, nlags: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., lag, pacf) by Durbin-Levinson on the ACF."""
    packed = acf(series, nlags, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda r: r["acf"]).alias("r"))
    r = F.col("r")

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        at = lambda i: F.get(r, i)
        up = F.aggregate(upto(F.size(phi)), at(k), lambda s, i: s - F.get(phi, i) * at(k - 1 - i))
        down = F.aggregate(upto(F.size(phi)), F.lit(1.0), lambda s, i: s - F.get(phi, i) * at(i + 1))
        return bound(F.try_divide(up, down), lambda x: F.struct(F.array_append(F.zip_with(phi, F.reverse(phi), lambda a, b: a - x * b), x).alias("phi"), F.array_append(state["out"], x).alias("out")))

    none = F.array().cast("array<double>")
    got = F.aggregate(F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: k > 0), F.struct(none.alias("phi"), F.array(F.lit(1.0)).alias("out")), step)["out"]
    return packed.select(*keys, F.posexplode(got).alias("lag", "pacf"))

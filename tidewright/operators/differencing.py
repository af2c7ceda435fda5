"""Differencing and its inverse as window functions over (keys.., t, y).

What looks back does so within blocks of a series that hold copies of the d + s * D rows before them, so a long series is differenced in parallel.

Ordinary differences come first, then seasonal ones; a null spreads to every difference that touches it, unless `strict`,
which fails on it. Stages are kept on the original axis; anchors are the trailing values that undo them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..sources import series as S
from ..sources.series import in_blocks, over_time, own_rows

MAX_D, MAX_SD = 4, 3


def check_orders(d: int, sd: int, s: int) -> None:
    if not 0 <= d <= MAX_D or not 0 <= sd <= MAX_SD:
        raise ValueError(f"differencing orders must be 0..{MAX_D} and 0..{MAX_SD}; got d={d}, sd={sd}")
    if sd and s < 2:
        raise ValueError("seasonal differencing needs s of at least 2")


def stages(series: DataFrame, d: int, sd: int, s: int = 1, keys: tuple[str, ...] = (), strict: bool = False, value: str = "y") -> DataFrame:
    """(keys.., t, a0..a_d, b1..b_sd): a0 is the series, a_i its i-th difference, b_g the g-th seasonal one of a_d."""
    check_orders(d, sd, s)
    y = F.col(value).cast("double")
    if strict:
        y = F.when(y.isNull(), F.raise_error(F.lit("the series has a missing value")).cast("double")).otherwise(y)
    out, size = in_blocks(series.select(*keys, "t", y.alias("a0")), d + sd * s)
    w = over_time((*keys, "__block"))
    for i in range(1, d + 1):
        out = out.withColumn(f"a{i}", F.col(f"a{i - 1}") - F.lag(f"a{i - 1}").over(w))
    for g in range(1, sd + 1):
        of = f"b{g - 1}" if g > 1 else f"a{d}"
        out = out.withColumn(f"b{g}", F.col(of) - F.lag(of, s).over(w))
    return own_rows(out, size)


def difference(series: DataFrame | S.Packed, d: int, sd: int, s: int = 1, keys: tuple[str, ...] = (), strict: bool = False, value: str = "y") -> DataFrame:
    """(keys.., t, w): the differenced series, t again from 1. A packed series is taken as its runs, without spreading it into rows before."""
    check_orders(d, sd, s)
    lost = d + sd * s
    size = max(S.BLOCK, lost)
    if isinstance(series, S.Packed):
        if strict and series.seen < series.n:
            raise ValueError("the series has a missing value")
        runs, kind = series.checked().runs, T.LongType()
    else:
        ship(series.sparkSession)
        y = F.col(value).cast("double")
        if strict:
            y = F.when(y.isNull(), F.raise_error(F.lit("the series has a missing value")).cast("double")).otherwise(y)
        runs, kind = S.runs_of(series.select(*keys, "t", y.alias("__y")), "__y", keys), series.schema["t"].dataType
    schema = T.StructType([runs.schema[k] for k in keys] + T.StructType.fromDDL("t long, w double").fields)

    def run(table: pa.Table) -> pa.Table:
        t, w, _ = S.together(table)
        for gap, times in ((1, d), (s, sd)):
            for _ in range(times):
                w = pc.subtract(w[gap:], w[: max(len(w) - gap, 0)])
        w = pa.concat_arrays([pa.nulls(len(t) - len(w), pa.float64()), w])
        own = pa.array(np.flatnonzero((t > table.column("__block")[0].as_py() * size) & (t > lost)))
        key = [pa.repeat(table.column(k)[0], len(own)) for k in keys]
        return pa.Table.from_arrays([*key, pa.array(t - lost).take(own), w.take(own)], [*keys, "t", "w"])

    out = S.cut(runs, size, lost, keys).groupBy(*keys, "__block").applyInArrow(run, schema)
    return out.select(*keys, F.col("t").cast(kind).alias("t"), "w")


def difference_exog(exog: DataFrame, d: int, sd: int, s: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., t, j, x): each regressor differenced like the series."""
    return difference(exog, d, sd, s, (*keys, "j"), value="x").select(*keys, "t", "j", F.col("w").alias("x"))


def difference_poly(series: DataFrame, coefficients: list[float], keys: tuple[str, ...] = (), value: str = "y") -> DataFrame:
    """(keys.., t, w) by convolution with a lag polynomial, constant first."""
    lost = len(coefficients) - 1
    rows, size = in_blocks(series, lost)
    w = over_time((*keys, "__block"))
    total = sum((F.lag(value, k).over(w) * c if k else F.col(value) * c for k, c in enumerate(coefficients) if c), F.lit(0.0))
    return own_rows(rows.withColumn("w", total), size).select(*keys, "t", "w").filter(F.col("t") > lost).withColumn("t", F.col("t") - lost)


def anchors(series: DataFrame, d: int, sd: int, s: int = 1, keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """(keys.., stage, idx, value): for ordinary stage i the last value before it, for seasonal ones the last s, idx s newest."""
    st = stages(series, d, sd, s, keys, strict)
    last = series.groupBy(*keys).agg(F.max("t").alias("__n"))  # a row a series
    st = st.join(last, list(keys)) if keys else st.crossJoin(F.broadcast(last))
    st = st.withColumn("back", F.col("__n") - F.col("t") + 1).filter(F.col("back") <= max(1, s if sd else 1))
    before = [f"a{i}" for i in range(d)] + [f"a{d}" if g == 0 else f"b{g}" for g in range(sd)]
    if not before:
        return st.select(*keys, F.lit(0).alias("stage"), F.lit(0).alias("idx"), F.lit(0.0).alias("value")).limit(0)
    rows = [F.struct(F.lit(i + 1).alias("stage"), F.lit(1 if i < d else s).alias("size"), F.col(c).alias("value")) for i, c in enumerate(before)]
    return st.select(*keys, "back", F.explode(F.array(*rows)).alias("r")).filter(F.col("back") <= F.col("r.size")).select(*keys, F.col("r.stage").alias("stage"), (F.col("r.size") - F.col("back") + 1).cast("int").alias("idx"), F.col("r.value").alias("value"))


def integrate(forecast: DataFrame, held: DataFrame, d: int, sd: int, s: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., h, yhat) of (keys.., h, w): the stages undone, last first, as running sums; held: anchors()."""
    check_orders(d, sd, s)
    out = forecast.select(*keys, "h", F.col("w").alias("v"))
    for stage in range(d + sd, 0, -1):
        seasonal = stage > d
        phase = ((F.col("h") - 1) % s) if seasonal else F.lit(0)
        w = Window.partitionBy(*keys, "phase").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
        start = held.filter(F.col("stage") == stage).select(*keys, (F.col("idx") - 1 if seasonal else F.lit(0)).cast("long").alias("phase"), "value")
        out = out.withColumn("phase", phase.cast("long")).join(start, [*keys, "phase"], "left").select(*keys, "h", (F.col("value") + F.sum("v").over(w)).alias("v"))
    return out.select(*keys, "h", F.col("v").alias("yhat"))


def integration_weights(grid: DataFrame, d: int, sd: int, s: int = 1) -> DataFrame:
    """(h, l, c), l <= h: what a unit at step l adds at step h. grid: (h) from 1."""
    out = grid.select("h").crossJoin(grid.select(F.col("h").alias("l"))).withColumn("c", F.when(F.col("h") == F.col("l"), 1.0).otherwise(0.0))
    for gap, times in ((s, sd), (1, d)):
        for _ in range(times):
            w = Window.partitionBy("l", (F.col("h") - 1) % gap).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumn("c", F.sum("c").over(w))
    return out.filter(F.col("l") <= F.col("h"))



"""Checks of regressors: coverage, nulls, repeats, rank. They fail the query and name the column and the times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import elimination
from .matrices import gram


def exog_report(exog: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., j, n_rows, n_null, n_repeated, first_missing, last_missing, ok) of (keys.., t, j, x) against t = 1..n."""
    counts = exog.groupBy(*keys, "j").agg(F.count("*").alias("n_rows"), F.count_if(F.col("x").isNull()).alias("n_null"), (F.count("t") - F.countDistinct("t")).alias("n_repeated"))
    # gaps between the times that are there, whose ends are 0 and n + 1
    there = exog.filter(F.col("x").isNotNull() & F.col("t").between(1, n)).select(*keys, "j", "t").distinct()
    before = F.coalesce(F.lag("t").over(Window.partitionBy(*keys, "j").orderBy("t")), F.lit(0))
    gaps = there.withColumn("before", before).groupBy(*keys, "j").agg(F.min(F.when(F.col("t") > F.col("before") + 1, F.col("before") + 1)).alias("first"), F.max(F.when(F.col("t") > F.col("before") + 1, F.col("t") - 1)).alias("last"), F.max("t").alias("end"))
    got = counts.join(gaps, [*keys, "j"], "left").withColumn("end", F.coalesce("end", F.lit(0).cast("long")))
    open_end = F.col("end") < n
    first = F.coalesce("first", F.when(open_end, F.col("end") + 1)).cast("long")
    last = F.when(open_end, F.lit(n)).otherwise(F.col("last")).cast("long")
    return got.select(*keys, "j", "n_rows", "n_null", "n_repeated", first.alias("first_missing"), last.alias("last_missing"), (first.isNull() & (F.col("n_null") == 0) & (F.col("n_repeated") == 0)).alias("ok"))


def validate_exog(exog: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., j, n_rows, ok), or an error that names the regressor and the times it lacks."""
    r = exog_report(exog, n, keys)
    why = F.when(F.col("n_null") > 0, F.format_string("regressor %d has null values", "j")).when(F.col("n_repeated") > 0, F.format_string("regressor %d has repeated times", "j")).otherwise(F.format_string("regressor %d lacks times %d to %d", "j", "first_missing", "last_missing"))
    return r.select(*keys, "j", F.when(F.col("ok"), F.col("n_rows")).otherwise(F.raise_error(why).cast("long")).alias("n_rows"), "ok")


def rank_report(exog: DataFrame) -> DataFrame:
    """(j, piv, pivmin, trace, ok, low) of long regressors: elimination pivots of X'X; ok needs pivmin >= 1e-10 * trace, and a regressor below that is low.

    piv is on the columns' own scale. What ok, low, pivmin and trace say is found on columns brought to one norm, so that units don't decide: a sum of squares
    in large units would make any trace too large for a regressor in small ones."""
    g = written(gram(exog), "gram")
    norm = g.filter("i = j").select("j", F.when(F.col("v") > 0, F.sqrt("v")).otherwise(1.0).alias("norm"))  # a row a regressor
    at = lambda c, name: norm.select(F.col("j").alias(c), F.col("norm").alias(name))
    scaled = written(g.join(at("i", "a"), "i").join(at("j", "b"), "j").select("i", "j", (F.col("v") / F.col("a") / F.col("b")).alias("v")), "gram")
    each = elimination.pivots(g).join(elimination.pivots(scaled).withColumnRenamed("piv", "size"), "j")
    both = each.agg(F.min("size").alias("pivmin")).crossJoin(scaled.filter("i = j").agg(F.sum("v").alias("trace")))  # one row each
    least = 1e-10 * F.col("trace")
    return each.crossJoin(F.broadcast(both)).select("j", "piv", "pivmin", "trace", (F.col("pivmin") >= least).alias("ok"), (F.col("size") < least).alias("low"))


def rank_check(exog: DataFrame) -> DataFrame:
    """rank_report(), or an error that names the first dependent regressor."""
    r = rank_report(exog)
    return r.withColumn("ok", F.when(F.col("low"), F.raise_error(F.format_string("regressor %d depends on the others", "j")).cast("boolean")).otherwise(F.col("ok"))).drop("low")

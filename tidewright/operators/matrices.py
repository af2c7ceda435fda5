"""Matrices as tables (i, j, v), dense, from 1. Products are equi-joins and sums by key; sums of doubles run in index order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elimination


def _grid(spark: SparkSession, m: int, n: int) -> DataFrame:
    return spark.range(1, m + 1).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(1, n + 1).select(F.col("id").cast("int").alias("j")))


def zeros(spark: SparkSession, m: int, n: int) -> DataFrame:
    return _grid(spark, m, n).withColumn("v", F.lit(0.0))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return _grid(spark, n, n).withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(a: DataFrame, c: float) -> DataFrame:
    return a.select("i", "j", (F.col("v") * float(c)).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") + F.col("w")).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    terms = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    ordered = F.array_sort(F.collect_list(F.struct("k", (F.col("x") * F.col("y")).alias("z"))))
    return terms.groupBy("i", "j").agg(F.aggregate(ordered, F.lit(0.0), lambda s, t: s + t["z"]).alias("v"))


def kronecker(a: DataFrame, b: DataFrame) -> DataFrame:
    """Output cells first, then two equi-joins on their computed places in a and b: no cross product of the matrices."""
    spark = a.sparkSession
    (ma, na), (mb, nb) = (tuple(x.agg(F.max("i"), F.max("j")).first()) for x in (a, b))
    cells = _grid(spark, ma * mb, na * nb).select("i", "j", *[f.alias(n) for n, f in (("ia", F.expr(f"cast((i - 1) div {mb} + 1 as int)")), ("ja", F.expr(f"cast((j - 1) div {nb} + 1 as int)")), ("ib", F.expr(f"cast((i - 1) % {mb} + 1 as int)")), ("jb", F.expr(f"cast((j - 1) % {nb} + 1 as int)")))])
    left = cells.join(a.select(F.col("i").alias("ia"), F.col("j").alias("ja"), F.col("v").alias("x")), ["ia", "ja"])
    return left.join(b.select(F.col("i").alias("ib"), F.col("j").alias("jb"), F.col("v").alias("y")), ["ib", "jb"]).select("i", "j", (F.col("x") * F.col("y")).alias("v"))


def to_array(a: DataFrame) -> DataFrame:
    """(v array, m, n), row by row."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "v")))
    return a.agg(F.transform(cells, lambda c: c["v"]).alias("v"), F.max("i").alias("m"), F.max("j").alias("n"))


def from_array(df: DataFrame, column: str, n: int) -> DataFrame:
    """(i, j, v) of an array column with rows of n."""
    at = F.posexplode(column).alias("p", "v")
    return df.select(at).select(F.expr(f"cast(p div {n} + 1 as int)").alias("i"), F.expr(f"cast(p % {n} + 1 as int)").alias("j"), "v")


def solve(a: DataFrame, b: DataFrame, block: int = elimination.BLOCK) -> DataFrame:
    """(i, j, v, pivmin, ok): A X = B by elimination in blocks; what a singular system gives is said in operators.elimination."""
    return elimination.solve(a, b, block)


def gram(exog: DataFrame) -> DataFrame:
    """(i, j, v): X'X of long regressors (t, j, x), from the products of each time's cells: rows are moved once, by t."""
    cells = exog.filter(F.col("t").isNotNull()).groupBy("t").agg(F.collect_list(F.struct("j", "x")).alias("c"))  # at most the regressors of one time
    one = cells.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b"))
    return one.groupBy(F.col("a.j").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("v"))

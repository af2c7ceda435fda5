"""The queries: one for each operator, over the test tables, each with its twin in SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import distributions as D
from ..functions import polynomials as P
from ..functions.kernel import Spec
from ..operators import checks, differencing, estimation, filter, lags, matrices, model
from .. import sqlapi
from ..session import shared_path, ship, written
from ..sources import series as S
from ..streaming import chunked, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- series that the queries share, and their SQL

MONTHS = """m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT CAST(row_number() OVER (ORDER BY month) AS BIGINT) AS t, CAST(n AS DOUBLE) AS y FROM m WHERE month < (SELECT max(month) FROM m))"""
LINES = """lm AS (SELECT date_trunc('month', l_shipdate) AS month, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(sum(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) AS discount FROM lineitem GROUP BY 1),
l AS (SELECT CAST(row_number() OVER (ORDER BY month) AS BIGINT) AS t, quantity, discount FROM lm),
x AS (SELECT t, 1 AS j, quantity AS x FROM l UNION ALL SELECT t, 2, discount FROM l)"""
HOURS = """e AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1),
hs AS (SELECT unnest(generate_series((SELECT min(hour) FROM e), (SELECT max(hour) FROM e), INTERVAL 1 HOUR)) AS hour),
h AS (SELECT CAST(row_number() OVER (ORDER BY hour) AS BIGINT) AS t, CAST(n AS DOUBLE) AS y FROM hs LEFT JOIN e USING (hour))"""


def months(spark, sf_dir) -> DataFrame:
    return S.series_of(S.monthly_orders(spark, sf_dir), "n_orders", "month")


def hours(spark, sf_dir) -> DataFrame:
    return S.series_of(S.hourly_events(spark, sf_dir), "n", "hour")


def lines_long(spark, sf_dir) -> DataFrame:
    return S.exog_of(S.monthly_lines(spark, sf_dir), ["quantity", "discount"], "month")


def one(spark, **columns) -> DataFrame:
    return ship(spark).range(1).select(*[c.alias(n) for n, c in columns.items()])


def doubles(*values: float):
    return F.array(*[F.lit(float(v)) for v in values])


def r6(c):
    return F.round(c, 6)


def listed(df: DataFrame, **arrays_) -> DataFrame:
    """(id, name, idx, v) of array columns of rows with an id, rounded; one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), a.alias("vs")) for n, a in arrays_.items()])
    out = df.select("id", F.explode(cells).alias("c")).select("id", "c.name", F.posexplode("c.vs").alias("idx", "v"))
    return out.select("id", "name", (F.col("idx") + 1).alias("idx"), (r6(F.col("v")) + 0.0).alias("v"))


def listed_sql(source: str, **lists: str) -> str:
    """The same of lists in SQL over the rows of c: (id, ..)."""
    cells = ", ".join(f"{{'name': '{n}', 'vs': CAST([{vs}] AS DOUBLE[])}}" for n, vs in lists.items())
    return f"WITH {source}, u AS (SELECT id, unnest([{cells}]) AS u FROM c) SELECT id, u.name AS name, CAST(generate_subscripts(u.vs, 1) AS INTEGER) AS idx, round(unnest(u.vs), 6) + 0e0 AS v FROM u"


# small numbers of each customer or supplier, whole or in binary fractions: k from 0 to 14, n from 0 to 24
CUSTOMERS = "c AS (SELECT c_custkey AS id, CAST(c_custkey % 15 AS DOUBLE) AS k, CAST(c_nationkey AS DOUBLE) AS n FROM customer)"
SUPPLIERS = "c AS (SELECT s_suppkey AS id, CAST(s_suppkey % 15 AS DOUBLE) AS k, CAST(s_nationkey AS DOUBLE) AS n FROM supplier)"


def customers(spark, sf_dir) -> DataFrame:
    c = S.table(ship(spark), sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 15).cast("double").alias("k"), F.col("c_nationkey").cast("double").alias("n"))


def suppliers(spark, sf_dir) -> DataFrame:
    c = S.table(ship(spark), sf_dir, "supplier")
    return c.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 15).cast("double").alias("k"), F.col("s_nationkey").cast("double").alias("n"))



# ---- preparation


@query(f"WITH {MONTHS} SELECT t, y FROM s")
def series_monthly(spark, sf_dir):
    return months(spark, sf_dir)


@query(f"WITH {HOURS} SELECT t, y FROM h")
def series_hourly_gaps(spark, sf_dir):
    return hours(spark, sf_dir)


@query("WITH o AS (SELECT o_orderdate AS k, o_totalprice AS y, row_number() OVER (ORDER BY o_orderdate) AS t, count(*) OVER (PARTITION BY o_orderdate) AS c, row_number() OVER (PARTITION BY o_orderdate) AS r FROM orders) SELECT CAST(count(*) FILTER (r > 1) AS BIGINT) AS n_invalid, CAST(count(*) AS BIGINT) AS n FROM o")
def duplicate_time_check(spark, sf_dir):
    return S.time_report(S.table(spark, sf_dir, "orders"), "o_orderdate")


@query(f"WITH {MONTHS} SELECT t, y AS a0, y - lag(y) OVER (ORDER BY t) AS a1, (y - lag(y) OVER (ORDER BY t)) - lag(y - lag1) OVER (ORDER BY t) AS a2 FROM (SELECT t, y, lag(y) OVER (ORDER BY t) AS lag1 FROM s)")
def stage_all(spark, sf_dir):
    return differencing.stages(months(spark, sf_dir), 2, 0)



@query(f"WITH {MONTHS} SELECT t - 1 AS t, w FROM (SELECT t, y - lag(y) OVER (ORDER BY t) AS w FROM s) WHERE t > 1")
def diff_d1(spark, sf_dir):
    return differencing.difference(months(spark, sf_dir), 1, 0, strict=True)


@query(f"WITH {MONTHS} SELECT t - 2 AS t, w FROM (SELECT t, y - 2 * lag(y) OVER (ORDER BY t) + lag(y, 2) OVER (ORDER BY t) AS w FROM s) WHERE t > 2")
def diff_d2(spark, sf_dir):
    return differencing.difference(months(spark, sf_dir), 2, 0)


@query(f"WITH {MONTHS} SELECT t - 12 AS t, w FROM (SELECT t, y - lag(y, 12) OVER (ORDER BY t) AS w FROM s) WHERE t > 12")
def diff_s12(spark, sf_dir):
    return differencing.difference(months(spark, sf_dir), 0, 1, 12)


@query(f"WITH {MONTHS} SELECT t - 13 AS t, w FROM (SELECT t, y - lag(y) OVER (ORDER BY t) - lag(y, 12) OVER (ORDER BY t) + lag(y, 13) OVER (ORDER BY t) AS w FROM s) WHERE t > 13")
def diff_d1_s12(spark, sf_dir):
    return differencing.difference(months(spark, sf_dir), 1, 1, 12)


@query(f"WITH {MONTHS} SELECT t - 13 AS t, w FROM (SELECT t, y - lag(y) OVER (ORDER BY t) - lag(y, 12) OVER (ORDER BY t) + lag(y, 13) OVER (ORDER BY t) AS w FROM s) WHERE t > 13")
def diff_by_convolution(spark, sf_dir):
    return differencing.difference_poly(months(spark, sf_dir), P.difference_poly(1, 1, 12))


@query(f"WITH {HOURS} SELECT t - 1 AS t, w FROM (SELECT t, y - lag(y) OVER (ORDER BY t) AS w FROM h) WHERE t > 1")
def diff_null_propagation(spark, sf_dir):
    return differencing.difference(hours(spark, sf_dir), 1, 0)


@query(f"WITH {LINES} SELECT t, CAST(j AS INTEGER) AS j, round(x, 6) AS x FROM x")
def exog_long(spark, sf_dir):
    return lines_long(spark, sf_dir).withColumn("x", r6(F.col("x")))


@query(f"WITH {LINES} SELECT t - 1 AS t, CAST(j AS INTEGER) AS j, round(w, 6) AS x FROM (SELECT t, j, x - lag(x) OVER (PARTITION BY j ORDER BY t) AS w FROM x) WHERE t > 1")
def diff_exog(spark, sf_dir):
    return differencing.difference_exog(lines_long(spark, sf_dir), 1, 0).withColumn("x", r6(F.col("x")))


@query(f"WITH {LINES}, a AS (SELECT t, j, x - lag(x) OVER (PARTITION BY j ORDER BY t) AS x FROM x) SELECT t - 13 AS t, CAST(j AS INTEGER) AS j, round(w, 6) + 0e0 AS w FROM (SELECT t, j, x - lag(x, 12) OVER (PARTITION BY j ORDER BY t) AS w FROM a) WHERE t > 13")
def diff_exog_by_convolution(spark, sf_dir):
    got = differencing.difference_poly(lines_long(spark, sf_dir), P.difference_poly(1, 1, 12), ("j",), "x")
    return got.select("t", "j", (r6(F.col("w")) + 0.0).alias("w"))


@query(f"WITH {MONTHS}, n AS (SELECT max(t) AS n FROM s), w AS (SELECT t, y - lag(y) OVER (ORDER BY t) AS w FROM s) SELECT 1 AS stage, 1 AS idx, y AS value FROM s, n WHERE t = n UNION ALL SELECT 2, CAST(t - n + 12 AS INTEGER), w FROM w, n WHERE t > n - 12")
def anchors(spark, sf_dir):
    return differencing.anchors(months(spark, sf_dir), 1, 1, 12)


@query(f"WITH {HOURS}, s AS (SELECT t, CASE WHEN t % 3 > 0 THEN y END AS y FROM h), n AS (SELECT max(t) AS n FROM s), w AS (SELECT t, y - lag(y) OVER (ORDER BY t) AS w FROM s) SELECT 1 AS stage, 1 AS idx, y AS value FROM s, n WHERE t = n UNION ALL SELECT 2, CAST(t - n + 24 AS INTEGER), w FROM w, n WHERE t > n - 24")
def anchors_with_gaps(spark, sf_dir):
    """Anchors of a series with missing hours are null where a value before them is."""
    return differencing.anchors(hours(spark, sf_dir).withColumn("y", F.when(F.col("t") % 3 > 0, F.col("y"))), 1, 1, 24)


@query(f"WITH {MONTHS}, n AS (SELECT max(t) - 24 AS n FROM s) SELECT CAST(t - n AS BIGINT) AS h, y AS yhat FROM s, n WHERE t > n")
def undiff_roundtrip(spark, sf_dir):
    y = months(spark, sf_dir)
    cut = y.agg((F.max("t") - 24).alias("n"))
    early = y.crossJoin(cut).filter("t <= n").select("t", "y")
    w = differencing.difference(y, 1, 1, 12).crossJoin(cut).filter(F.col("t") + 13 > F.col("n")).select((F.col("t") + 13 - F.col("n")).alias("h"), "w")
    return differencing.integrate(w, differencing.anchors(early, 1, 1, 12), 1, 1, 12)


@query(f"WITH {MONTHS} SELECT a.t AS h, b.t AS l, CAST((a.t - b.t) // 12 + 1 AS DOUBLE) AS c FROM s a, s b WHERE b.t <= a.t")
def undiff_weights(spark, sf_dir):
    """Weights of every month's differences in the months after it."""
    return differencing.integration_weights(months(spark, sf_dir).select(F.col("t").alias("h")), 1, 1, 12)


@query(f"WITH {LINES}, k AS (SELECT t, j, CASE WHEN j = 2 AND t IN (5, 9) THEN NULL ELSE x END AS x FROM x WHERE NOT (j = 1 AND t = 3)), n AS (SELECT max(t) AS n FROM x) SELECT CAST(j AS INTEGER) AS j, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(x) AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_repeated, CAST(CASE WHEN j = 1 THEN 3 ELSE 5 END AS BIGINT) AS first_missing, CAST(CASE WHEN j = 1 THEN 3 ELSE 9 END AS BIGINT) AS last_missing, false AS ok FROM k GROUP BY j")
def validate_exog_report(spark, sf_dir):
    x = lines_long(spark, sf_dir)
    n = x.agg(F.max("t")).first()[0]
    holes = x.filter("not (j = 1 and t = 3)").withColumn("x", F.when(~((F.col("j") == 2) & F.col("t").isin(5, 9)), F.col("x")))
    return checks.exog_report(holes, n)


@query(f"WITH {LINES} SELECT CAST(j AS INTEGER) AS j, CAST(count(*) AS BIGINT) AS n_rows, true AS ok FROM x GROUP BY j")
def validate_exog(spark, sf_dir):
    x = lines_long(spark, sf_dir)
    return checks.validate_exog(x, x.agg(F.max("t")).first()[0])


@query(f"WITH {MONTHS}, k AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS lag) SELECT a.t, k.lag, b.y AS value FROM s a, k JOIN s b ON b.t = a.t - k.lag")
def lags_long(spark, sf_dir):
    return lags.lags(months(spark, sf_dir), 3)


_ACF = "c AS (SELECT t, y - (SELECT avg(y) FROM {s} ) AS e FROM {s}), k AS (SELECT CAST(unnest(range(0, {n} + 1)) AS INTEGER) AS lag), v AS (SELECT lag, sum(a.e * b.e) / (SELECT sum(e * e) FROM c) AS acf FROM k, c a JOIN c b ON b.t = a.t - lag GROUP BY lag)"


@query(f"WITH {MONTHS}, {_ACF.format(s='s', n=12)} SELECT lag, round(acf, 6) AS acf FROM v")
def acf(spark, sf_dir):
    return lags.acf(months(spark, sf_dir), 12).withColumn("acf", r6(F.col("acf")))


@query(f"WITH {MONTHS}, {_ACF.format(s='s', n=3)}, r AS (SELECT max(acf) FILTER (lag = 1) AS a, max(acf) FILTER (lag = 2) AS b, max(acf) FILTER (lag = 3) AS c FROM v) SELECT 0 AS lag, 1e0 AS pacf UNION ALL SELECT 1, round(a, 6) FROM r UNION ALL SELECT 2, round((b - a * a) / (1 - a * a), 6) FROM r UNION ALL SELECT 3, round((a * a * a - 2 * a * b + a * b * b + c * (1 - a * a)) / (1 - 2 * a * a + 2 * a * a * b - b * b), 6) FROM r")
def pacf(spark, sf_dir):
    return lags.pacf(months(spark, sf_dir), 3).withColumn("pacf", r6(F.col("pacf")))


# ---- matrices

SMALL = "a AS (SELECT CAST(r_regionkey + 1 AS INTEGER) AS i, CAST(k AS INTEGER) AS j, CAST((r_regionkey * 3 + k * k) % 7 AS DOUBLE) AS v FROM region, (SELECT unnest(range(1, 6)) AS k))"


def small(spark, sf_dir) -> DataFrame:
    """A 5 x 5 matrix of whole numbers from region."""
    r = S.table(spark, sf_dir, "region")
    return r.select((F.col("r_regionkey") + 1).cast("int").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j")).withColumn("v", (((F.col("i") - 1) * 3 + F.col("j") * F.col("j")) % 7).cast("double"))


@query(f"WITH {SMALL} SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN a b ON a.j = b.i GROUP BY 1, 2")
def rmul(spark, sf_dir):
    a = small(spark, sf_dir)
    return matrices.multiply(a, a)


@query(f"WITH {SMALL} SELECT a.i, a.j, a.v + b.v AS v FROM a JOIN a b ON a.i = b.j AND a.j = b.i")
def radd(spark, sf_dir):
    a = small(spark, sf_dir)
    return matrices.add(a, matrices.transpose(a))


@query(f"WITH {SMALL} SELECT i, j, v * 2.5e0 AS v FROM a")
def rscale(spark, sf_dir):
    return matrices.scale(small(spark, sf_dir), 2.5)


@query(f"WITH {SMALL} SELECT j AS i, i AS j, v FROM a")
def rtrans(spark, sf_dir):
    return matrices.transpose(small(spark, sf_dir))


@query(f"WITH {SMALL} SELECT CAST((a.i - 1) * 5 + b.i AS INTEGER) AS i, CAST((a.j - 1) * 5 + b.j AS INTEGER) AS j, a.v * b.v AS v FROM a, a b")
def rkron(spark, sf_dir):
    a = small(spark, sf_dir)
    return matrices.kronecker(a, a)


CROSS = "a AS (SELECT CAST(l_suppkey % 25 + 1 AS INTEGER) AS i, l_linenumber AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), g AS (SELECT max(i) AS m, max(j) AS n FROM a), gi AS (SELECT CAST(unnest(range(1, m + 1)) AS INTEGER) AS i FROM g)"


def crossed(spark, sf_dir) -> DataFrame:
    """Quantities of line items by supplier group and line number."""
    li = S.table(ship(spark), sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 25 + 1).cast("int").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {CROSS} SELECT i, j, 2 * v AS v FROM a")
def reye(spark, sf_dir):
    """2 I A: the identity has as many rows as the table's groups."""
    a = crossed(spark, sf_dir)
    m = a.agg(F.max("i")).first()[0]
    return matrices.multiply(matrices.scale(matrices.identity(spark, m), 2.0), a)


@query(f"WITH {CROSS}, gj AS (SELECT CAST(unnest(range(1, n + 1)) AS INTEGER) AS j FROM g) SELECT gi.i, gj.j, coalesce(a.v, 0) AS v FROM gi CROSS JOIN gj LEFT JOIN a ON a.i = gi.i AND a.j = gj.j")
def rzeros(spark, sf_dir):
    """A table's matrix over zeros: cells without a line item are 0."""
    a = crossed(spark, sf_dir)
    m, n = a.agg(F.max("i"), F.max("j")).first()
    return matrices.zeros(spark, m, n).unionByName(a).groupBy("i", "j").agg(F.sum("v").alias("v"))


@query(f"WITH {SMALL} SELECT array_to_string(list(CAST(v AS INTEGER) ORDER BY i, j), ',') AS v, max(i) AS m, max(j) AS n FROM a")
def mat_to_list(spark, sf_dir):
    return matrices.to_array(small(spark, sf_dir)).withColumn("v", F.concat_ws(",", F.transform("v", lambda x: x.cast("int").cast("string"))))


@query(f"WITH {SMALL} SELECT i, j, v FROM a")
def list_to_mat(spark, sf_dir):
    return matrices.from_array(matrices.to_array(small(spark, sf_dir)), "v", 5)


@query(f"WITH {LINES}, g AS (SELECT sum(quantity * quantity) AS a, sum(quantity * discount) AS b, sum(discount * discount) AS c, sum(quantity) AS u, sum(discount) AS v FROM l) SELECT 1 AS i, 1 AS j, round((c * u - b * v) / (a * c - b * b), 6) AS v, true AS ok FROM g UNION ALL SELECT 2, 1, round((a * v - b * u) / (a * c - b * b), 6), true FROM g")
def rsolve(spark, sf_dir):
    x = lines_long(spark, sf_dir)
    rhs = x.groupBy(F.col("j").alias("i")).agg(F.sum("x").alias("v")).select("i", F.lit(1).alias("j"), "v")
    return matrices.solve(matrices.gram(x), rhs).select("i", "j", r6(F.col("v")).alias("v"), "ok")


@query(f"WITH {LINES} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.x * b.x), 3) AS v FROM x a JOIN x b USING (t) GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    return matrices.gram(lines_long(spark, sf_dir)).withColumn("v", F.round("v", 3))


@query(f"WITH {LINES}, g AS (SELECT sum(quantity * quantity) AS a, sum(quantity * discount) AS b, sum(discount * discount) AS c FROM l) SELECT 1 AS j, round(a, 3) AS piv, true AS ok FROM g UNION ALL SELECT 2, round(c - b / a * b, 3), true FROM g")
def rank_pivots(spark, sf_dir):
    return checks.rank_check(lines_long(spark, sf_dir)).select("j", F.round("piv", 3).alias("piv"), "ok")


WIDE = """wl AS (SELECT l_orderkey AS o, unnest([l_quantity / 8, l_extendedprice / 4096, l_discount * 16, l_tax * 16, l_linenumber / 2, l_suppkey % 7, l_partkey % 11, 1]) AS x, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) AS j FROM lineitem),
wx AS (SELECT o, CAST(j AS INTEGER) AS j, sum(x) AS x FROM wl GROUP BY ALL), wg AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM wx a JOIN wx b USING (o) GROUP BY ALL)"""


def wide(spark, sf_dir) -> DataFrame:
    """(t, j, x): eight columns of line items, summed by order."""
    li = S.table(ship(spark), sf_dir, "lineitem")
    x = (F.col("l_quantity") / 8, F.col("l_extendedprice") / 4096, F.col("l_discount") * 16, F.col("l_tax") * 16, F.col("l_linenumber") / 2, F.col("l_suppkey") % 7, F.col("l_partkey") % 11, F.lit(1.0))
    rows = li.groupBy(F.col("l_orderkey").alias("t")).agg(*[F.sum(v.cast("double")).alias(f"x{i}") for i, v in enumerate(x)])
    return rows.select("t", F.posexplode(F.array(*[f"x{i}" for i in range(len(x))])).alias("j", "x")).withColumn("j", F.col("j") + 1)


# elimination by rows in SQL: each step divides by the pivot that is next; of a gram matrix no row has to be moved
_STEP = "e(s, i, j, v, f, r, p) AS (SELECT 0, i, j, CAST(v AS DOUBLE), 0e0, 0e0, 0e0 FROM wg UNION ALL SELECT s + 1, i, j, v - f * r / p, f, r, p FROM (SELECT s, i, j, v, max(CASE WHEN j = s + 1 THEN v END) OVER (PARTITION BY i) AS f, max(CASE WHEN i = s + 1 THEN v END) OVER (PARTITION BY j) AS r, max(CASE WHEN i = s + 1 AND j = s + 1 THEN v END) OVER () AS p FROM e) WHERE i > s + 1 AND j > s + 1)"


@query(f"WITH RECURSIVE {WIDE}, {_STEP} SELECT round(sum(ln(v)), 6) AS logdet, count(*) AS n FROM e WHERE i = s + 1 AND j = s + 1")
def rank_pivots_eight(spark, sf_dir):
    """The pivots' product is the determinant of the gram matrix, whatever rows they are."""
    got = checks.rank_check(wide(spark, sf_dir))
    return got.agg(F.round(F.sum(F.log("piv")), 6).alias("logdet"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey % 196 + 1 AS i, sum(o_totalprice) / 65536 AS y FROM orders GROUP BY 1), g AS (SELECT CAST(unnest(range(1, 197)) AS INTEGER) AS i), d AS (SELECT g.i, coalesce(y, 0) + 1e0 AS y FROM g LEFT JOIN c ON c.i = g.i)
SELECT i, CAST(1 AS INTEGER) AS j, round(y / 2 - (SELECT sum(y) FROM d) / (2 * (2 + 196)), 6) + 0e0 AS v, true AS ok FROM d""")
def rsolve_196(spark, sf_dir):
    """196 unknowns in blocks of 64: (2 I + 1 1') X = totals of groups of customers, whose answer has a closed form."""
    groups = S.table(ship(spark), sf_dir, "orders").groupBy((F.col("o_custkey") % 196 + 1).cast("int").alias("i")).agg((F.sum("o_totalprice") / 65536).alias("y"))
    every = spark.range(1, 197).select(F.col("id").cast("int").alias("i"))
    d = every.join(groups, "i", "left").select("i", F.lit(1).alias("j"), (F.coalesce("y", F.lit(0.0)) + 1.0).alias("v"))
    a = matrices.scale(matrices.identity(spark, 196), 2.0).withColumn("v", F.col("v") + 1.0)
    return matrices.solve(a, d, block=64).select("i", "j", (r6(F.col("v")) + 0.0).alias("v"), "ok")


_AB = CUSTOMERS.replace(" AS n FROM", " AS n, k + 1 AS a1, n - 3 AS a2, k - n AS a3, 2 AS a4, n AS b1, k AS b2, 1 AS b3, k - 4 AS b4 FROM")


@query(listed_sql(_AB, mmul="a1*b1+a2*b3, a1*b2+a2*b4, a3*b1+a4*b3, a3*b2+a4*b4", mtrans="a1, a3, a2, a4", msym="a1, (a2+a3)/2, (a2+a3)/2, a4", madd="a1+b1, a2+b2, a3+b3, a4+b4", msub="a1-b1, a2-b2, a3-b3, a4-b4", mscale="3*a1, 3*a2, 3*a3, 3*a4", mkron="a1*b1, a1*b2, a2*b1, a2*b2, a1*b3, a1*b4, a2*b3, a2*b4, a3*b1, a3*b2, a4*b1, a4*b2, a3*b3, a3*b4, a4*b3, a4*b4", mvec="a1, a3, a2, a4", munvec="a1, a3, a2, a4", meye="1, 0, 0, 1", mzeros="0, 0", maug="a1, a2, b1, b2, a3, a4, b3, b4", mget="a3"))
def array_algebra(spark, sf_dir):
    """Two 2 x 2 matrices of each customer."""
    k, n = F.col("k"), F.col("n")
    rows = customers(spark, sf_dir).select("id", F.array(k + 1, n - 3, k - n, F.lit(2.0)).alias("a"), F.array(n, k, F.lit(1.0), k - 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    return listed(rows, mmul=A.mmul(a, b, 2, 2, 2), mtrans=A.mtrans(a, 2, 2), msym=A.msym(a, 2), madd=A.madd(a, b), msub=A.msub(a, b), mscale=A.mscale(a, 3.0), mkron=A.mkron(a, b, 2, 2, 2, 2), mvec=A.mvec(a, 2, 2), munvec=A.munvec(a, 2, 2), meye=A.meye(2), mzeros=A.mzeros(1, 2), maug=A.maug(a, b, 2, 2), mget=F.array(A.mget(a, 2, 1, 2)))


@query(f"WITH {LINES}, g AS (SELECT sum(quantity * quantity) AS a, sum(quantity * discount) AS b, sum(discount * discount) AS c, sum(quantity) AS u, sum(discount) AS v FROM l) SELECT round((c * u - b * v) / (a * c - b * b), 6) AS x1, round((a * v - b * u) / (a * c - b * b), 6) AS x2, true AS ok FROM g")
def solve_2x2(spark, sf_dir):
    w = S.monthly_lines(spark, sf_dir)
    q, d = F.col("quantity"), F.col("discount")
    g = w.agg(F.array(F.sum(q * q), F.sum(q * d), F.sum(q * d), F.sum(d * d)).alias("a"), F.array(F.sum(q), F.sum(d)).alias("b"))
    s = g.select(A.solve(A.maug(F.col("a"), F.col("b"), 2, 1), 2, 1).alias("s"))
    return s.select(r6(F.get("s.x", F.lit(0))).alias("x1"), r6(F.get("s.x", F.lit(1))).alias("x2"), F.col("s.ok").alias("ok"))


_M3 = CUSTOMERS.replace(" AS n FROM", " AS n, k + 40 AS a, n AS c, n + 40 AS e, k AS g, 50 * (n + 40) + 3 AS ei FROM")


@query(listed_sql(_M3, x="ei, -50-c, 3-c*e, 3*g-100, 50*a-c*g, 2*c-3*a, -2-e*g, a+g, a*e-2", regular="CASE WHEN k = 0 THEN 0 ELSE 1 END"))
def inverse_3x3(spark, sf_dir):
    """Inverse times determinant of a matrix of each customer, cofactors in SQL, and a matrix that is singular for some of them."""
    k, n, c = F.col("k"), F.col("n"), lambda x: F.lit(float(x))
    m = F.array(k + 40, c(1), n, c(2), n + 40, c(3), k, c(-1), c(50))
    return listed(customers(spark, sf_dir), x=A.mscale(A.inverse(m, 3)["x"], (k + 40) * (50 * (n + 40) + 3) - (100 - 3 * k) + n * (-2 - k * (n + 40))), regular=F.array(A.inverse(F.array(k + 1, c(2), c(2), c(4)), 2)["ok"].cast("double")))


_LYAP = SUPPLIERS.replace(" AS n FROM", " AS n, (k - 7) / 8 AS f, (n - 12) / 16 AS h, (n % 4 + 1) / 2 AS s, (k - 7) / 16 AS f1, (n - 12) / 32 AS f2, s * (1 - f2) / ((1 + f2) * ((1 - f2) * (1 - f2) - f1 * f1)) AS g FROM")


@query(listed_sql(_LYAP, ar1="s/(1-f*f)", arma11="s*(1+h*h+2*f*h)/(1-f*f), s*h, s*h, s*h*h", ar2="g, f2*f1*g/(1-f2), f2*f1*g/(1-f2), f2*f2*g", ma2="s*(1+f*f+h*h), s*(f+f*h), s*h, s*(f+f*h), s*(f*f+h*h), s*f*h, s*h, s*f*h, s*h*h"))
def lyapunov(spark, sf_dir):
    """Stationary variances of four models of each supplier, up to three states."""
    k, n, z = F.col("k"), F.col("n"), F.lit(0.0)
    f, h, s, f1, f2 = (k - 7) / 8, (n - 12) / 16, (n % 4 + 1) / 2, (k - 7) / 16, (n - 12) / 32
    one_ = F.lit(1.0)
    q3 = P.build_rqr(F.array(one_, f, h), s, 3)
    return listed(suppliers(spark, sf_dir), ar1=A.lyapunov(F.array(f), F.array(s), 1), arma11=A.lyapunov(P.build_t(F.array(f), 2), P.build_rqr(F.array(one_, h), s, 2), 2), ar2=A.lyapunov(P.build_t(F.array(f1, f2), 2), F.array(s, z, z, z), 2), ma2=A.lyapunov(P.build_t(doubles(), 3), q3, 3))


@query(listed_sql(CUSTOMERS, p="1, k/8, n/8, 0, k-7, (k-7)*k/8, (k-7)*n/8"))
def polymul(spark, sf_dir):
    k, n, z = F.col("k"), F.col("n"), F.lit(0.0)
    return listed(customers(spark, sf_dir), p=P.polymul(F.array(F.lit(1.0), k / 8, n / 8), F.array(F.lit(1.0), z, z, z, k - 7)))


@query(listed_sql(CUSTOMERS, ar="k/16, -n/32, 0, (k-7)/16, -k/16*(k-7)/16, n/32*(k-7)/16", ma="n/32, 0, 0, (n-12)/16, n/32*(n-12)/16", poly="1, -1, 0, 0, -1, 1"))
def expand_polynomials(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    return listed(customers(spark, sf_dir), ar=P.expand_ar(F.array(k / 16, -n / 32), F.array((k - 7) / 16), 4), ma=P.expand_ma(F.array(n / 32), F.array((n - 12) / 16), 4), poly=doubles(*P.difference_poly(1, 1, 4)))


@query(listed_sql(CUSTOMERS, t="k/16, 1, -n/32, 0", r="1, (n-12)/16", z="1, 0", rqr="k+1, (k+1)*(n-12)/16, (k+1)*(n-12)/16, (k+1)*(n-12)/16*(n-12)/16"))
def ssm_matrices(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    r = P.build_r(F.array((n - 12) / 16), 2)
    return listed(customers(spark, sf_dir), t=P.build_t(F.array(k / 16, -n / 32), 2), r=r, z=P.build_z(2), rqr=P.build_rqr(r, k + 1, 2))


@query(listed_sql(CUSTOMERS, z="1, 0, 1, 1, 0", t="1, 0, 1, 1, 0, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, k/16, 1, 0, 0, 0, 0, 0", r="0, 0, 0, 1, (n-12)/16", k="3"))
def ssm_matrices_nodiff(spark, sf_dir):
    return listed(customers(spark, sf_dir), z=P.build_z(2, 1, 1, 2), t=P.build_t(F.array(F.col("k") / 16), 2, 1, 1, 2), r=P.build_r(F.array((F.col("n") - 12) / 16), 2, 3), k=doubles(P.kdiff(1, 1, 2)))


@query(listed_sql(CUSTOMERS, c=", ".join(f"n + {t}*k/8" for t in range(4, 10))))
def trend_values(spark, sf_dir):
    return listed(customers(spark, sf_dir), c=P.trend_values((0, 1), F.array(F.col("n"), F.col("k") / 8), 4, 6))


_FREE = CUSTOMERS.replace(" AS n FROM", " AS n, (k - 7) / 4 AS u1, (n - 12) / 8 AS u2, k / 8 - 1 AS u3, n / 8 + 5e-1 AS u4, u1 / sqrt(1 + u1 * u1) AS a, u2 / sqrt(1 + u2 * u2) AS b, u3 / sqrt(1 + u3 * u3) AS c FROM")


@query(listed_sql(_FREE, con="k, -(a+b*a), -b, c, u4*u4", back="k, u1, u2, u3, u4", concentrated="k, -(a+b*a), -b, c", concentrated_back="k, u1, u2, u3"))
def transform_params(spark, sf_dir):
    """Free parameters of each customer made valid, and back; without the variance where it is concentrated out."""
    k, n = F.col("k"), F.col("n")
    u = F.array(k, (k - 7) / 4, (n - 12) / 8, k / 8 - 1, n / 8 + 0.5)
    con, short = P.transform_params(u, 1, 2, 1, 0, 0), P.transform_params(u, 1, 2, 1, 0, 0, concentrate=True)
    return listed(customers(spark, sf_dir), con=con, back=P.transform_params(con, 1, 2, 1, 0, 0, back=True), concentrated=short, concentrated_back=P.transform_params(short, 1, 2, 1, 0, 0, concentrate=True, back=True))


@query(listed_sql(CUSTOMERS, beta="n", phi="k, k+n", theta="3*k", sphi="n-k", stheta="", sigma2="k+5"))
def split_params(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    s = P.split_params(F.array(n, k, k + n, 3 * k, n - k, k + 5), 1, 2, 1, 1, 0)
    return listed(customers(spark, sf_dir), beta=s["beta"], phi=s["phi"], theta=s["theta"], sphi=s["sphi"], stheta=s["stheta"], sigma2=F.array(s["sigma2"]))


@query(f"WITH {LINES} SELECT t, round(sum(x * CASE j WHEN 1 THEN 25e-2 ELSE -3e0 END), 6) AS d FROM x GROUP BY t")
def obs_intercept(spark, sf_dir):
    return filter.obs_intercept(lines_long(spark, sf_dir), [0.25, -3.0]).withColumn("d", r6(F.col("d")))


# ---- distributions

# the normal distribution by its series, the chi-square tail of an even number of degrees in closed form
_PHI = "5e-1 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda i: pow(z, 2 * i + 1) * sqrt(pi()) / (pow(2e0, i + 1) * gamma(i + 15e-1))))"
_TAIL = "exp(-x / 2) * list_sum(list_transform(range(0, h), lambda i: pow(x / 2, i) / gamma(i + 1e0)))"


@query(f"WITH {SUPPLIERS}, q AS (SELECT id, n + k / 8 AS x, CAST(k AS INTEGER) % 5 + 1 AS h, (k - 7) / 2 + (n - 12) / 64 AS z FROM c) SELECT id, 'chi2' AS kind, x, 2e0 * h AS df, round({_TAIL}, 6) AS v FROM q UNION ALL SELECT id, 'norm', z, 0e0, round({_PHI}, 6) FROM q UNION ALL SELECT id, 'ppf', z, 0e0, round(z, 6) FROM q")
def distributions(spark, sf_dir):
    """Tail and normal probabilities at points of each supplier; quantiles of the latter are the points again."""
    k, n = F.col("k"), F.col("n")
    x, df, z = n + k / 8, 2.0 * (k % 5 + 1), (k - 7) / 2 + (n - 12) / 64
    row = lambda kind, at, deg, v: F.struct(F.lit(kind).alias("kind"), at.alias("x"), deg.alias("df"), (r6(v) + 0.0).alias("v"))
    rows = F.array(row("chi2", x, df, D.chi2_sf(x, df)), row("norm", z, F.lit(0.0), D.norm_cdf(z)), row("ppf", z, F.lit(0.0), D.norm_ppf(D.norm_cdf(z))))
    return suppliers(spark, sf_dir).select("id", F.explode(rows).alias("r")).select("id", "r.*")


# ---- filter at fixed parameters: hours as scaled counts

SCALED = HOURS + ", z AS (SELECT t, (y - 10) / 5e0 AS y FROM h)"
AR1 = "f(t, a, p, v, f) AS (SELECT CAST(1 AS BIGINT), 0e0, {s} / (1 - {c} * {c}), (SELECT y FROM z WHERE t = 1), {s} / (1 - {c} * {c}) UNION ALL SELECT f.t + 1, {c} * (f.a + coalesce(f.v, 0)), CASE WHEN f.v IS NULL THEN {c} * {c} * f.p + {s} ELSE {s} END, z.y - {c} * (f.a + coalesce(f.v, 0)), CASE WHEN f.v IS NULL THEN {c} * {c} * f.p + {s} ELSE {s} END FROM f JOIN z ON z.t = f.t + 1)"
MA1 = "f(t, a, p, v, f) AS (SELECT CAST(1 AS BIGINT), 0e0, 0e0, (SELECT y FROM z WHERE t = 1), {s} * (1 + {c} * {c}) UNION ALL SELECT f.t + 1, CASE WHEN f.v IS NULL THEN 0e0 ELSE {c} * {s} * f.v / f.f END, 0e0, z.y - CASE WHEN f.v IS NULL THEN 0e0 ELSE {c} * {s} * f.v / f.f END, {s} * (1 + {c} * {c}) - CASE WHEN f.v IS NULL THEN 0e0 ELSE {c} * {c} * {s} * {s} / f.f END FROM f JOIN z ON z.t = f.t + 1)"


def scaled(spark, sf_dir) -> DataFrame:
    return hours(spark, sf_dir).withColumn("y", (F.col("y") - 10) / 5.0)


def probes(spark, *rows: list[float]) -> DataFrame:
    return ship(spark).createDataFrame([(i + 1, [float(x) for x in r]) for i, r in enumerate(rows)], "probe_id long, params array<double>")


@query(f"WITH RECURSIVE {SCALED}, {AR1.format(c='5e-1', s='2e0')} SELECT CAST(1 AS BIGINT) AS probe_id, t, round(v, 6) AS v, round(f, 6) AS f FROM f")
def kalman_trace_ar1(spark, sf_dir):
    return filter.trace(scaled(spark, sf_dir), probes(spark, [0.5, 2.0]), Spec(p=1)).withColumns({c: r6(F.col(c)) for c in ("v", "f")})


@query(f"WITH RECURSIVE {SCALED}, {MA1.format(c='4e-1', s='15e-1')} SELECT CAST(1 AS BIGINT) AS probe_id, t, round(v, 6) AS v, round(f, 6) AS f FROM f")
def kalman_trace_ma1(spark, sf_dir):
    return filter.trace(scaled(spark, sf_dir), probes(spark, [0.4, 1.5]), Spec(q=1)).withColumns({c: r6(F.col(c)) for c in ("v", "f")})


@query(f"WITH RECURSIVE {SCALED}, {MA1.format(c='4e-1', s='15e-1')} SELECT t, round(v, 6) AS v, round(f, 6) AS f FROM f")
def kalman_native_ma1(spark, sf_dir):
    y = scaled(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda r: r["y"]).alias("y"))
    t, r = P.build_t(doubles(), 2), P.build_r(doubles(0.4), 2)
    q = P.build_rqr(r, F.lit(1.5), 2)
    sys = y.withColumn("t", t).withColumn("q", q).withColumn("p", A.lyapunov(F.col("t"), F.col("q"), 2))
    return sys.select(F.posexplode(P.filter_array(F.col("y"), F.col("t"), F.col("q"), F.col("p"), 2)).alias("i", "o")).select((F.col("i") + 1).cast("long").alias("t"), r6(F.col("o.v")).alias("v"), r6(F.col("o.f")).alias("f"))


_LL = "SELECT CAST({i} AS BIGINT) AS probe_id, CAST(count(*) AS BIGINT) AS n_eff, round(-5e-1 * sum(CASE WHEN v IS NOT NULL THEN ln(2 * pi()) + ln(f) + v * v / f END), 4) AS loglik FROM f"


@query(f"SELECT * FROM (WITH RECURSIVE {SCALED}, {AR1.format(c='3e-1', s='1e0')} {_LL.format(i=1)}) UNION ALL SELECT * FROM (WITH RECURSIVE {SCALED}, {AR1.format(c='8e-1', s='4e0')} {_LL.format(i=2)})")
def loglik_probes(spark, sf_dir):
    got = filter.loglik(scaled(spark, sf_dir), probes(spark, [0.3, 1.0], [0.8, 4.0]), Spec(p=1))
    return got.select("probe_id", "n_eff", F.round("loglik", 4).alias("loglik"))


@query(f"WITH RECURSIVE {SCALED}, {AR1.format(c='5e-1', s='1e0')}, k AS (SELECT count(v) AS n, sum(v * v / f) AS q, sum(CASE WHEN v IS NOT NULL THEN ln(f) END) AS l FROM f) SELECT CAST(1 AS BIGINT) AS probe_id, round(-5e-1 * (n * ln(2 * pi()) + l + n * ln(q / n) + n), 4) AS loglik, round(q / n, 6) AS scale2 FROM k")
def loglik_concentrated(spark, sf_dir):
    got = filter.loglik(scaled(spark, sf_dir), probes(spark, [0.5]), Spec(p=1, concentrate=True))
    return got.select("probe_id", F.round("loglik", 4).alias("loglik"), r6(F.col("scale2")).alias("scale2"))


@query(f"WITH RECURSIVE {SCALED}, {AR1.format(c='5e-1', s='2e0')} {_LL.format(i=1)}")
def loglik_streamed(spark, sf_dir):
    e = S.hourly_events(spark, sf_dir).withColumn("y", (F.col("n") - 10) / 5.0)
    import numpy as np

    ll, _ = chunked.Stream(e, "y", "hour", [], Spec(p=1)).evaluate(Spec(p=1), np.array([[0.5, 2.0]]))
    n = e.count()
    return one(spark, probe_id=F.lit(1).cast("long"), n_eff=F.lit(n).cast("long"), loglik=F.round(F.lit(float(ll[0])), 4))


@query(f"WITH {LINES} SELECT CAST(p AS BIGINT) AS probe_id, t, round(quantity - discount * p, 6) AS yd, round(1e0 + p * t, 6) AS ct FROM l, (SELECT unnest([1, 2]) AS p)")
def obs_adj(spark, sf_dir):
    w = S.monthly_lines(spark, sf_dir)
    y, x = S.series_of(w, "quantity", "month"), S.exog_of(w, ["discount"], "month")
    got = filter.adjusted(y, x, probes(spark, [1, 1, 1, 1], [1, 2, 2, 1]), Spec(r=1, trend="ct"))
    return got.withColumns({c: r6(F.col(c)) for c in ("yd", "ct")})


_AR1_OF = f"{CUSTOMERS}, q AS (SELECT id, (k - 7) / 8 AS f, (n + 1) / 4 AS s FROM c)"


def probes_of(rows: DataFrame, *params) -> DataFrame:
    """A probe of each row."""
    return rows.select(F.col("id").cast("long").alias("probe_id"), F.array(*params).alias("params"))


@query(f"WITH {_AR1_OF} SELECT id AS probe_id, CAST(1 AS INTEGER) AS k, round(s / (1 - f * f), 6) AS p1, round(s, 6) AS rqr FROM q")
def systems(spark, sf_dir):
    """State spaces of one AR(1) with a regressor for each customer."""
    got = filter.systems(probes_of(customers(spark, sf_dir), F.col("id").cast("double"), (F.col("k") - 7) / 8, (F.col("n") + 1) / 4), Spec(p=1, r=1))
    return got.select("probe_id", "k", r6(F.get("p1", F.lit(0))).alias("p1"), r6(F.get("rqr", F.lit(0))).alias("rqr"))


_CELLS = {"transition": [(1, 1, 0), (0, "k/16", 1), (0, "-n/32", 0)], "selection": [(0,), (1,), ("(n-12)/16",)], "design": [(1, 1, 0)], "state_cov": [("k+1",)], "obs_cov": [(0,)]}


@query(f"WITH {CUSTOMERS}, u AS (SELECT id, unnest([" + ", ".join(f"{{'name': '{n}', 'i': {i + 1}, 'j': {j + 1}, 'v': CAST({v} AS DOUBLE)}}" for n, rows in _CELLS.items() for i, row in enumerate(rows) for j, v in enumerate(row)) + "]) AS u FROM c) SELECT id AS probe_id, u.name AS name, CAST(u.i AS INTEGER) AS i, CAST(u.j AS INTEGER) AS j, round(u.v, 6) + 0e0 AS v FROM u")
def system_cells(spark, sf_dir):
    """ARIMA(2,1,1) of each customer with the difference in the state and a trend: the state is the level and two of ARMA."""
    at = probes_of(customers(spark, sf_dir), F.lit(9.0), F.col("k") / 16, -F.col("n") / 32, (F.col("n") - 12) / 16, F.col("k") + 1)
    got = filter.system_tables(at, Spec(p=2, d=1, q=1, trend="c", simple_differencing=False))
    return got.withColumn("v", r6(F.col("v")) + 0.0)


@query(f"SELECT * FROM (WITH RECURSIVE {SCALED}, {AR1.format(c='5e-1', s='2e0')} {_LL.format(i=1)}) UNION ALL SELECT * FROM (WITH RECURSIVE {SCALED.replace('(y - 10) / 5e0', '(y - 10) / 5e0 - 1e-3 * t')}, {AR1.format(c='5e-1', s='2e0')} {_LL.format(i=2)}) UNION ALL SELECT * FROM (WITH RECURSIVE {SCALED.replace('(y - 10) / 5e0', '(y - 10) / 5e0 + 2e-3 * t')}, {AR1.format(c='5e-1', s='2e0')} {_LL.format(i=3)}) UNION ALL SELECT * FROM (WITH RECURSIVE {SCALED}, {AR1.format(c='2e-1', s='1e0')} {_LL.format(i=4)})")
def loglik_shared_gains(spark, sf_dir):
    """Probes that differ in the regression only share one covariance pass."""
    y = scaled(spark, sf_dir)
    x = y.select("t", F.lit(1).alias("j"), (F.col("t") / 1000.0).alias("x"))
    got = filter.loglik(y, probes(spark, [0.0, 0.5, 2.0], [1.0, 0.5, 2.0], [-2.0, 0.5, 2.0], [0.0, 0.2, 1.0]), Spec(p=1, r=1), x)
    return got.select("probe_id", "n_eff", F.round("loglik", 4).alias("loglik"))


@query(f"WITH {_AR1_OF} SELECT min(id) AS system_id, count(*) AS n_probes FROM q GROUP BY f, s")
def probe_system_dedup(spark, sf_dir):
    at = probes_of(customers(spark, sf_dir), F.col("id").cast("double"), (F.col("k") - 7) / 8, (F.col("n") + 1) / 4)
    return filter.distinct_systems(at, Spec(p=1, r=1)).select("system_id", "n_probes")


@query(f"WITH {HOURS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(y) AS BIGINT) AS n_seen, round(avg(y * y), 6) AS sigma2 FROM h")
def start_sigma2_ooc(spark, sf_dir):
    got = chunked.second_moment(S.hourly_events(spark, sf_dir), "n", "hour")
    return one(spark, n=F.lit(got["n"]).cast("long"), n_seen=F.lit(got["n_seen"]).cast("long"), sigma2=F.round(F.lit(got["sigma2"]), 6))


@query(f"WITH {HOURS} SELECT t, y FROM h")
def dense_index(spark, sf_dir):
    return chunked.dense_index(S.hourly_events(spark, sf_dir), "hour", 4).select(F.col("t").cast("long").alias("t"), F.col("n").alias("y"))


@query("""WITH k AS (SELECT (l_orderkey * 8 + l_linenumber) * 20 + c AS k FROM lineitem, range(20) AS r(c)), d AS (SELECT k, row_number() OVER (ORDER BY k) AS t FROM k)
SELECT count(*) AS n, count(DISTINCT t) AS n_t, max(t) AS max_t, CAST(sum(t * (k % 1009)) AS BIGINT) AS checksum FROM d""")
def dense_index_lines(spark, sf_dir):
    """Twenty rows for each line item, so that every range is sampled."""
    k = S.table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 20).cast("long").alias("k"), "l_quantity")
    k = k.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(19)))).select((F.col("k") + F.col("c")).alias("k"), "l_quantity")
    t = chunked.dense_index(k, "k")
    return t.agg(F.count("*").alias("n"), F.countDistinct("t").alias("n_t"), F.max("t").cast("long").alias("max_t"), F.sum(F.col("t") * (F.col("k") % 1009)).cast("long").alias("checksum"))


@query(f"WITH {HOURS}, q AS (SELECT y - 10 AS y FROM h WHERE y IS NOT NULL) SELECT round(avg(y * y), 3) AS sigma2, round(-5e-1 * count(*) * (ln(2 * pi()) + ln(avg(y * y)) + 1), 3) AS loglik, round(avg(y * y) * sqrt(2e0 / count(*)), 2) AS bse FROM q")
def fit_streamed_variance(spark, sf_dir):
    """A streamed fit with its standard error, where both have a closed form."""
    e = S.hourly_events(spark, sf_dir).withColumn("y", F.col("n") - 10)
    m = _converged(model.fit(e, "y", "hour", out_of_core=True))
    pick = lambda kind, name, digits, out: F.round(F.max(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("value"))), digits).alias(out)
    return m.agg(pick("param", "sigma2", 3, "sigma2"), pick("meta", "loglik", 3, "loglik"), pick("bse", "sigma2", 2, "bse"))


@query(f"WITH {MONTHS}, w AS (SELECT y, t, y - lag(y) OVER (ORDER BY t) AS w FROM s), v AS (SELECT avg(w * w) AS v FROM w), z AS (SELECT y FROM s WHERE t = (SELECT max(t) FROM s)) SELECT CAST(h AS INTEGER) AS h, z.y AS yhat, round(sqrt(h * v), 3) AS se FROM v, z, range(1, 5) AS r(h)")
def forecast_streamed_walk(spark, sf_dir):
    """A random walk fitted as a stream, forecast from its model table."""
    m = model.fit(S.monthly_orders(spark, sf_dir), "n_orders", "month", d=1, out_of_core=True, compute_bse=False)
    return model.forecast(_converged(m), 4).select("h", F.round("yhat", 6).alias("yhat"), F.round("se", 3).alias("se"))


# ---- one series of forty rows for each line of an order, with gaps: over a million rows at 60,000 line items

TICKS = """tl AS (SELECT l_orderkey * 8 + l_linenumber AS line, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1),
tk AS (SELECT line * 40 + c AS k, CAST((quantity * 7 + c * c) % 13 - 6 AS DOUBLE) AS y FROM tl, range(40) AS r(c)),
d AS (SELECT row_number() OVER (ORDER BY k) AS t, CASE WHEN k % 97 NOT IN (3, 4, 5) THEN y END AS y FROM tk)"""
_STEPS = f"""WITH {TICKS}, o AS (SELECT t, y, t - lag(t) OVER w AS g, lag(y) OVER w AS py FROM d WHERE y IS NOT NULL WINDOW w AS (ORDER BY t)),
v AS (SELECT t, y - coalesce(pow(5e-1, g) * py, 0) AS v, CASE WHEN g IS NULL THEN 1e0 ELSE 1e0 - pow(25e-2, g) END AS f FROM o)"""


def ticks(spark, sf_dir) -> DataFrame:
    """Lines are dealt in ranges and sorted, so that their rows, forty times as many, are in order of time."""
    sc = spark.sparkContext
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism)
    li = S.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_quantity").repartitionByRange(parts, "line")
    li = li.groupBy("line").agg(F.sum("l_quantity").cast("long").alias("quantity")).sortWithinPartitions("line")
    li = li.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(39))))
    k, y = F.col("line") * 40 + F.col("c"), (F.col("quantity") * 7 + F.col("c") * F.col("c")) % 13 - 6
    return li.select(k.cast("long").alias("k"), F.when(~(k % 97).isin(3, 4, 5), y.cast("double")).alias("y"), y.cast("double").alias("whole"))


@query(f"{_STEPS} SELECT count(*) AS n, round(-5e-1 * sum(ln(2 * pi()) + ln(f) + v * v / f), 1) AS loglik FROM v")
def loglik_in_ranges(spark, sf_dir):
    """An AR(1) likelihood in parallel over time, by its innovations over gaps in SQL."""
    import numpy as np

    e, spec = ticks(spark, sf_dir), Spec(p=1)
    stream = chunked.Stream(e, "y", "k", [], spec)
    ll, _ = stream.evaluate(spec, np.array([[0.5, 0.75]]))
    return one(spark, n=F.lit(stream.seen).cast("long"), loglik=F.round(F.lit(float(ll[0])), 1))


@query(f"{_STEPS} SELECT d.t, round(v, 6) AS v, round(v / sqrt(f), 5) AS std_resid FROM d LEFT JOIN v USING (t)")
def residuals_in_ranges(spark, sf_dir):
    """A row a time, each range replayed from the state that those before it lead to."""
    e = chunked.Stream(ticks(spark, sf_dir), "y", "k", [], Spec(p=1))
    m = model.fit(e, "y", "k", p=1, params=[0.5, 0.75], compute_bse=False, out_of_core=True)
    return model.residuals(m, e, "y", "k", out_of_core=True).select("t", F.round("v", 6).alias("v"), F.round("std_resid", 5).alias("std_resid"))


@query(f"""{_STEPS}, z AS (SELECT row_number() OVER (ORDER BY t) AS t, v / sqrt(f) AS e FROM v), c AS (SELECT t, e - (SELECT avg(e) FROM z) AS e FROM z), l AS (SELECT t, e, unnest(range(1, 5)) AS lag FROM c),
a AS (SELECT lag, sum(l.e * c.e) / (SELECT sum(e * e) FROM c) AS r FROM l JOIN c ON c.t = l.t - l.lag GROUP BY lag),
q AS (SELECT lag, n * (n + 2) * sum(r * r / (n - lag)) OVER (ORDER BY lag) AS stat FROM a, (SELECT count(*) AS n FROM z))
SELECT CAST(lag AS INTEGER) AS lag, round(stat, 3) AS stat, CASE WHEN lag % 2 = 0 THEN round(exp(-stat / 2) * (1 + CASE WHEN lag = 4 THEN stat / 2 ELSE 0 END), 6) END AS pvalue FROM q""")
def ljungbox_in_ranges(spark, sf_dir):
    """Ljung-Box of a streamed model's residuals; the chi-square tail has a closed form for even lags, and only these are shown."""
    e = chunked.Stream(ticks(spark, sf_dir), "y", "k", [], Spec(p=1))
    m = model.fit(e, "y", "k", p=1, params=[0.5, 0.75], compute_bse=False, out_of_core=True)
    got = model.ljungbox(m, e, "y", "k", 4, out_of_core=True)
    return got.select("lag", F.round("stat", 3).alias("stat"), F.when(F.col("lag") % 2 == 0, F.round("pvalue", 6)).alias("pvalue"))


@query(f"{_STEPS} SELECT round(-5e-1 * sum(ln(2 * pi()) + ln(f) + v * v / f), 1) AS loglik, 1e0 AS resid_finite_frac FROM v")
def evaluate_in_ranges(spark, sf_dir):
    e = chunked.Stream(ticks(spark, sf_dir), "y", "k", [], Spec(p=1))
    m = model.fit(e, "y", "k", p=1, params=[0.5, 0.75], compute_bse=False, out_of_core=True)
    return model.evaluate(m, e, "y", "k", out_of_core=True).select(F.round("loglik", 1).alias("loglik"), "resid_finite_frac")


@query(f"""WITH {TICKS}, w AS (SELECT avg(a.y * b.y) / avg(b.y * b.y) AS phi, avg(a.y * a.y) AS aa, avg(a.y * b.y) AS ab FROM d a JOIN d b ON b.t = a.t - 1 WHERE a.y IS NOT NULL AND b.y IS NOT NULL)
SELECT round(phi, 8) AS phi, round(aa - phi * ab, 6) AS sigma2 FROM w""")
def start_values_in_ranges(spark, sf_dir):
    """The start of a streamed fit, from sums of products over the blocks."""
    from ..functions import kernel as K

    spec = Spec(p=1)
    par = K.constrain(spec, chunked.Stream(ticks(spark, sf_dir), "y", "k", [], spec).start_values()[None])[0]
    return one(spark, phi=F.round(F.lit(float(par[0])), 8), sigma2=F.round(F.lit(float(par[1])), 6))


@query(f"WITH {TICKS}, a AS (SELECT t, y - lag(y) OVER (ORDER BY t) AS y FROM d), b AS (SELECT t - 13 AS t, y - lag(y, 12) OVER (ORDER BY t) AS w FROM a) SELECT t, w FROM b WHERE t > 0")
def diff_in_blocks(spark, sf_dir):
    """First and seasonal difference of one long series, whose blocks hold copies of the 13 rows before them."""
    return differencing.difference(S.Packed(ticks(spark, sf_dir), "y", "k"), 1, 1, 12)


@query(f"WITH {TICKS}, w AS (SELECT row_number() OVER (ORDER BY k) AS t, y FROM tk), c AS (SELECT t, y - (SELECT avg(y) FROM w) AS e FROM w), g AS (SELECT t, e, unnest(range(0, 51)) AS lag FROM c), v AS (SELECT lag, sum(g.e * c.e) AS p FROM g JOIN c ON c.t = g.t - g.lag GROUP BY lag) SELECT CAST(lag AS INTEGER) AS lag, round(p / (SELECT p FROM v WHERE lag = 0), 6) AS acf FROM v")
def acf_in_blocks(spark, sf_dir):
    """Fifty lags of one long series by sums of blocks' products."""
    return lags.acf(S.Packed(ticks(spark, sf_dir), "whole", "k"), 50).withColumn("acf", r6(F.col("acf")))


@query("""WITH e AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
z AS (SELECT event_type, CAST(date_diff('hour', (SELECT min(hour) FROM e), hour) AS BIGINT) + 1 AS t, (n - 2) / 2e0 AS y FROM e),
g AS (SELECT *, t - lag(t) OVER w AS g, lag(y) OVER w AS b FROM z WINDOW w AS (PARTITION BY event_type ORDER BY t)),
f AS (SELECT event_type, t, y, CASE WHEN g IS NULL THEN y ELSE y - pow(5e-1, g) * b END AS v, CASE WHEN g IS NULL THEN 2e0 / 75e-2 ELSE 2e0 * (1 - pow(25e-2, g)) / 75e-2 END AS f FROM g)
SELECT event_type, max(t) AS t, count(*) AS n_seen, CAST(0 AS BIGINT) AS late, round(sum(-5e-1 * (ln(2 * pi()) + ln(f) + v * v / f)), 4) AS loglik, round(max_by(y, t) / 2, 6) AS a, 2e0 AS p FROM f GROUP BY event_type""")
def live_filter(spark, sf_dir):
    """Hours of each event type as a stream in three parts, with a restart after each: the state ends as the filter over all of them."""
    keys = ("event_type",)
    hours = S.hourly_events(spark, sf_dir, by_type=True)
    seconds = F.unix_timestamp("hour")
    at = hours.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))  # one row
    hours = hours.filter("n IS NOT NULL").crossJoin(F.broadcast(at)).select("event_type", "hour", ((seconds - F.col("lo")) / 3600 + 1).cast("long").alias("t"), ((F.col("n") - 2) / 2).alias("y"), F.floor((seconds - F.col("lo")) * 3 / (F.col("hi") - F.col("lo") + 1)).alias("part"))
    hours = written(hours, "hours")
    m = written(model.fit(hours.filter("part = 0"), "y", "hour", p=1, params=[0.5, 2.0], compute_bse=False, keys=keys), "model")
    source, sink, checkpoint = (shared_path(spark, n) for n in ("stream", "states", "checkpoint"))
    for part in range(3):
        hours.filter(F.col("part") == part).select("event_type", "t", "y").write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_type string, t long, y double").parquet(source)
        run = live.follow(stream, m, "y", "t", keys).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(sink).groupBy("event_type").agg(F.max_by(F.struct("t", "n_seen", "late", "loglik", "a", "p"), "t").alias("s"))
    return last.select("event_type", "s.t", "s.n_seen", "s.late", F.round("s.loglik", 4).alias("loglik"), r6(F.col("s.a")[0]).alias("a"), r6(F.col("s.p")[0]).alias("p"))


# ---- fits with closed forms

_META = "SELECT '{n}' AS model, round({v}, 4) AS sigma2, round(-5e-1 * n * (ln(2 * pi()) + ln({v}) + 1), 4) AS loglik FROM k"


def _fitted(m: DataFrame, name: str) -> DataFrame:
    g = model.metrics(m)
    return g.select(F.lit(name).alias("model"), F.round("sigma2", 4).alias("sigma2"), F.round("loglik", 4).alias("loglik"))


def _orders(spark, sf_dir) -> DataFrame:
    return S.monthly_orders(spark, sf_dir).withColumn("y", F.col("n_orders") / 10.0)


_Y = MONTHS + ", q AS (SELECT t, y / 10 AS y FROM s)"


@query(f"WITH {_Y}, k AS (SELECT count(*) AS n, avg(y * y) AS v FROM q) {_META.format(n='white', v='v')}")
def fit_white_noise(spark, sf_dir):
    return _fitted(model.fit(_orders(spark, sf_dir), "y", "month"), "white")


@query(f"WITH {_Y}, k AS (SELECT count(*) AS n, avg(w * w) AS v FROM (SELECT t, y - lag(y) OVER (ORDER BY t) AS w FROM q) WHERE t > 1) {_META.format(n='walk', v='v')}")
def fit_random_walk(spark, sf_dir):
    return _fitted(model.fit(_orders(spark, sf_dir), "y", "month", d=1), "walk")


@query(f"WITH {_Y}, k AS (SELECT count(*) AS n, var_pop(y) AS v FROM q) {_META.format(n='mean', v='v')}")
def fit_mean(spark, sf_dir):
    return _fitted(model.fit(_orders(spark, sf_dir), "y", "month", trend="c"), "mean")


@query(f"WITH {_Y}, u AS (SELECT y, CAST(greatest(t - 1, 1) AS DOUBLE) AS g FROM q), k AS (SELECT count(*) AS n, var_pop(y) * (1 - corr(y, g) * corr(y, g)) AS v FROM u) {_META.format(n='line', v='v')}")
def fit_linear_trend(spark, sf_dir):
    return _fitted(model.fit(_orders(spark, sf_dir), "y", "month", trend="ct", concentrate=True), "line")


@query(f"WITH {LINES}, w AS (SELECT quantity / 1000 AS y, discount / 100 AS x FROM l), k AS (SELECT count(*) AS n, avg((y - b * x) * (y - b * x)) AS v FROM w, (SELECT sum(x * y) / sum(x * x) AS b FROM w)) {_META.format(n='ols', v='v')}")
def fit_one_regressor(spark, sf_dir):
    w = S.monthly_lines(spark, sf_dir).select("month", (F.col("quantity") / 1000).alias("y"), (F.col("discount") / 100).alias("x"))
    return _fitted(model.fit(w, "y", "month", exog_cols=["x"]), "ols")


@query("""WITH e AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
hs AS (SELECT unnest(generate_series((SELECT min(hour) FROM e), (SELECT max(hour) FROM e), INTERVAL 1 HOUR)) AS hour),
h AS (SELECT k.event_type, CAST(n AS DOUBLE) AS y FROM hs CROSS JOIN (SELECT DISTINCT event_type FROM e) k LEFT JOIN e ON e.hour = hs.hour AND e.event_type = k.event_type)
SELECT event_type, CAST(count(*) AS DOUBLE) AS n_eff, round(avg(y * y), 4) AS sigma2, round(-5e-1 * count(y) * (ln(2 * pi()) + ln(avg(y * y)) + 1), 3) AS loglik FROM h GROUP BY 1""")
def fit_per_event_type(spark, sf_dir):
    m = model.fit(S.hourly_events(spark, sf_dir, by_type=True), "n", "hour", keys=("event_type",))
    return model.metrics(m, ("event_type",)).select("event_type", "n_eff", F.round("sigma2", 4).alias("sigma2"), F.round("loglik", 3).alias("loglik"))


@query(f"WITH {_Y}, k AS (SELECT count(*) AS n, avg(y * y) AS v FROM q), l AS (SELECT n, v, -5e-1 * n * (ln(2 * pi()) + ln(v) + 1) AS ll FROM k) SELECT round(2 - 2 * ll, 3) AS aic, round(ln(n) - 2 * ll, 3) AS bic, 1e0 AS converged, CAST(n AS DOUBLE) AS n_eff, 1e0 AS resid_finite_frac FROM l")
def evaluate_white_noise(spark, sf_dir):
    y = _orders(spark, sf_dir)
    e = model.evaluate(model.fit(y, "y", "month"), y, "y", "month")
    return e.select(F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"), "converged", "n_eff", "resid_finite_frac")


@query(f"WITH {SUPPLIERS}, q AS (SELECT id, unnest([{{'idx': 1, 'name': 'ar.L1', 'c': (k - 7) / 8, 'b': (n + 4) / 16}}, {{'idx': 2, 'name': 'sigma2', 'c': k + 1, 'b': n + 2}}]) AS m FROM c), w AS (SELECT id, CAST(m.idx AS INTEGER) AS idx, m.name AS name, m.c AS coefficient, m.b AS std_error, abs(m.c / m.b) AS z FROM q) SELECT id, idx, name, coefficient, std_error, round(coefficient / std_error, 6) + 0e0 AS z_stat, round(2 * (1 - ({_PHI})), 6) AS p_value, round(coefficient - 1.959963984540054 * std_error, 6) AS ci_lo, round(coefficient + 1.959963984540054 * std_error, 6) AS ci_hi FROM w")
def summary_literal(spark, sf_dir):
    """Summaries of saved models, one of each supplier, with given coefficients and errors."""
    k, n = F.col("k"), F.col("n")
    row = lambda kind, name, idx, v: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(idx).alias("idx"), v.alias("value"), F.lit(None).cast("array<double>").alias("value_list"))
    rows = F.array(row("param", "ar.L1", 1, (k - 7) / 8), row("param", "sigma2", 2, k + 1), row("bse", "ar.L1", 1, (n + 4) / 16), row("bse", "sigma2", 2, n + 2))
    m = suppliers(spark, sf_dir).select("id", F.explode(rows).alias("r")).select("id", "r.*")
    return model.summary(m, ("id",)).withColumns({c: r6(F.col(c)) + 0.0 for c in ("z_stat", "p_value", "ci_lo", "ci_hi")})


@query(f"WITH {_Y}, r AS (SELECT t, y / sqrt((SELECT avg(y * y) FROM q)) AS y FROM q), {_ACF.format(s='r', n=6)} SELECT CAST(a.lag AS INTEGER) AS lag, round(n * (n + 2) * sum(b.acf * b.acf / (n - b.lag)), 4) AS stat FROM v a JOIN v b ON b.lag BETWEEN 1 AND a.lag, (SELECT CAST(count(*) AS DOUBLE) AS n FROM q) WHERE a.lag > 0 GROUP BY a.lag, n")
def ljungbox_white_noise(spark, sf_dir):
    y = _orders(spark, sf_dir)
    return model.ljungbox(model.fit(y, "y", "month"), y, "y", "month", 6).select("lag", F.round("stat", 4).alias("stat"))


@query(f"WITH {_Y}, {_ACF.format(s='q', n=6)}, x AS (SELECT a.lag, n * (n + 2) * sum(b.acf * b.acf / (n - b.lag)) AS x FROM v a JOIN v b ON b.lag BETWEEN 1 AND a.lag, (SELECT CAST(count(*) AS DOUBLE) AS n FROM q) WHERE a.lag IN (2, 4, 6) GROUP BY a.lag, n) SELECT CAST(lag AS INTEGER) AS lag, round(x, 4) AS stat, round(exp(-x / 2) * (1 + CASE WHEN lag > 2 THEN x / 2 ELSE 0 END + CASE WHEN lag > 4 THEN x * x / 8 ELSE 0 END), 6) AS pvalue FROM x")
def ljungbox_pvalues(spark, sf_dir):
    """The test's tail probabilities, which have a closed form at even lags."""
    y = _orders(spark, sf_dir)
    got = model.ljungbox(model.fit(y, "y", "month", params=[4.0]), y, "y", "month", 6).filter("lag % 2 = 0")
    return got.select("lag", F.round("stat", 4).alias("stat"), F.round("pvalue", 6).alias("pvalue"))


@query("WITH x AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) / 8 AS x FROM lineitem) SELECT x, CAST(a AS INTEGER) AS a, round(1 - exp(-x) * (1 + CASE WHEN a > 1 THEN x ELSE 0 END + CASE WHEN a > 2 THEN x * x / 2 ELSE 0 END), 8) AS p FROM x, (SELECT unnest([1, 2, 3]) AS a)")
def gamma_lower(spark, sf_dir):
    """The lower incomplete gamma function on both of its branches."""
    x = S.table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") / 8).alias("x")).distinct()
    rows = x.select("x", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("a"))
    return rows.select("x", "a", F.round(D.gammp(F.col("a").cast("double"), F.col("x")), 8).alias("p"))


@query(f"WITH {_Y} SELECT t, round(y, 6) AS v, 4e0 AS f, round(y / 2, 6) AS std_resid FROM q")
def residuals_fixed(spark, sf_dir):
    y = _orders(spark, sf_dir)
    m = model.fit(y, "y", "month", params=[4.0])
    return model.residuals(m, y, "y", "month").withColumns({c: r6(F.col(c)) for c in ("v", "std_resid")})


# ---- forecasts at fixed parameters

Z95 = "1.959963984540054"


@query(f"WITH {_Y}, n AS (SELECT y FROM q ORDER BY t DESC LIMIT 1), g AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h) SELECT h, round(y * pow(5e-1, h), 4) AS yhat, round(sqrt(2e0 * (1 - pow(25e-2, h)) / 75e-2), 4) AS se, round(y * pow(5e-1, h) - {Z95} * sqrt(2e0 * (1 - pow(25e-2, h)) / 75e-2), 4) AS lo FROM g, n")
def forecast_ar1_fixed(spark, sf_dir):
    m = model.fit(_orders(spark, sf_dir), "y", "month", p=1, params=[0.5, 2.0])
    return model.forecast(m, 12).select("h", *[F.round(c, 4).alias(c) for c in ("yhat", "se", "lo")])


@query(f"WITH {_Y}, n AS (SELECT y FROM q ORDER BY t DESC LIMIT 1), g AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h) SELECT h, round(y, 4) AS yhat, round(sqrt(2e0 * h), 4) AS se, 0e0 AS yhat_diff FROM g, n")
def forecast_rw_fixed(spark, sf_dir):
    m = model.fit(_orders(spark, sf_dir), "y", "month", d=1, params=[2.0])
    return model.forecast(m, 12).select("h", F.round("yhat", 4).alias("yhat"), F.round("se", 4).alias("se"), F.round("yhat_diff", 4).alias("yhat_diff"))


@query(f"WITH {_Y}, n AS (SELECT max(t) AS n FROM q), g AS (SELECT CAST(unnest(range(1, 25)) AS INTEGER) AS h) SELECT h, round(q.y, 4) AS yhat, round(sqrt(2e0 * ((h - 1) // 12 + 1)), 4) AS se FROM g, n JOIN q ON q.t = n - 12 + (h - 1) % 12 + 1")
def forecast_seasonal_rw(spark, sf_dir):
    m = model.fit(_orders(spark, sf_dir), "y", "month", sd=1, s=12, params=[2.0])
    return model.forecast(m, 24).select("h", F.round("yhat", 4).alias("yhat"), F.round("se", 4).alias("se"))


@query(f"WITH {LINES}, n AS (SELECT max(t) AS n FROM l) SELECT CAST(t - n + 6 AS INTEGER) AS h, round(3e0 * discount, 4) AS yhat, 2e0 AS se FROM l, n WHERE t > n - 6")
def forecast_exog_fixed(spark, sf_dir):
    w = S.monthly_lines(spark, sf_dir).withColumn("t", F.row_number().over(Window.orderBy("month")))
    n = w.count()
    m = model.fit(w.filter(F.col("t") <= n - 6), "quantity", "month", exog_cols=["discount"], params=[3.0, 4.0])
    f = model.forecast(m, 6, w.filter(F.col("t") > n - 6), "month", ["discount"])
    return f.select("h", F.round("yhat", 4).alias("yhat"), F.round("se", 4).alias("se"))


@query("SELECT * FROM (VALUES ('param', 2), ('param_unc', 2), ('bse', 2), ('spec', 14), ('meta', 8), ('anchor', 13), ('state', 3)) AS t(kind, n)")
def model_table_kinds(spark, sf_dir):
    m = model.fit(_orders(spark, sf_dir), "y", "month", d=1, sd=1, s=12, q=1, params=[-0.4, 2.0])
    return m.groupBy("kind").agg(F.count("*").cast("int").alias("n"))


# ---- the steps of a fit and of a forecast


@query(f"WITH {LINES}, w AS (SELECT quantity / 1000 AS y, discount / 100 AS x FROM l), b AS (SELECT sum(x * y) / sum(x * x) AS b FROM w) SELECT round(b, 6) AS beta, round((SELECT avg((y - b * x) * (y - b * x)) FROM w), 6) AS sigma2 FROM b")
def start_params(spark, sf_dir):
    w = S.monthly_lines(spark, sf_dir).select("month", (F.col("quantity") / 1000).alias("y"), (F.col("discount") / 100).alias("x"))
    got = estimation.start_params(S.series_of(w, "y", "month"), Spec(r=1), S.exog_of(w, ["x"], "month"))
    return got.select(r6(F.get("params0", F.lit(0))).alias("beta"), r6(F.get("params0", F.lit(1))).alias("sigma2"))


@query(f"WITH {_Y} SELECT round(avg(y * y), 4) AS sigma2, true AS converged, round(avg(y * y) * sqrt(2e0 / count(*)), 3) AS bse FROM q")
def optimum_and_errors(spark, sf_dir):
    y = S.series_of(_orders(spark, sf_dir), "y", "month")
    got = estimation.optimum(y, Spec()).select(F.get("params", F.lit(0)).alias("sigma2"), "converged")
    at = got.select(F.lit(1).cast("long").alias("probe_id"), F.array("sigma2").alias("params"))
    bse = estimation.standard_errors(y, at, Spec()).select(F.round(F.get("bse", F.lit(0)), 3).alias("bse"))
    return got.withColumn("sigma2", F.round("sigma2", 4)).crossJoin(bse)  # one row each


@query(f"WITH RECURSIVE {SCALED}, {AR1.format(c='6e-1', s='225e-2')} SELECT CAST(1 AS BIGINT) AS probe_id, round(-5e-1 * sum(CASE WHEN v IS NOT NULL THEN ln(2 * pi()) + ln(f) + v * v / f END), 4) AS loglik FROM f")
def loglik_free(spark, sf_dir):
    got = estimation.loglik_free(scaled(spark, sf_dir), probes(spark, [-0.75, 1.5]), Spec(p=1))
    return got.withColumn("loglik", F.round("loglik", 4))


@query(f"WITH RECURSIVE {SCALED}, {AR1.format(c='6e-1', s='1e0')}, k AS (SELECT count(v) AS n, sum(v * v / f) AS q, sum(CASE WHEN v IS NOT NULL THEN ln(f) END) AS l FROM f) SELECT CAST(1 AS BIGINT) AS probe_id, round(-5e-1 * (n * ln(2 * pi()) + l + n * ln(q / n) + n), 4) AS loglik FROM k")
def loglik_free_concentrated(spark, sf_dir):
    got = estimation.loglik_free(scaled(spark, sf_dir), probes(spark, [-0.75]), Spec(p=1, concentrate=True))
    return got.withColumn("loglik", F.round("loglik", 4))


_HOURS_X = HOURS.replace("AS y FROM hs", "AS y, hour FROM hs") + ", z AS (SELECT t, (y - 10) / 5e0 - 5e-1 * extract('hour' FROM hour) / 1e1 AS y FROM h)"


@query(f"WITH RECURSIVE {_HOURS_X}, {AR1.format(c='5e-1', s='2e0')} SELECT round(-5e-1 * sum(CASE WHEN v IS NOT NULL THEN ln(2 * pi()) + ln(f) + v * v / f END), 4) AS loglik FROM f")
def loglik_streamed_regressor(spark, sf_dir):
    """A streamed series with a regressor: the hour of the day."""
    e = S.hourly_events(spark, sf_dir).withColumns({"y": (F.col("n") - 10) / 5.0, "x": F.hour("hour") / 10.0})
    got = model.metrics(model.fit(e, "y", "hour", p=1, exog_cols=["x"], params=[0.5, 0.5, 2.0], compute_bse=False, out_of_core=True))
    return got.select(F.round("loglik", 4).alias("loglik"))


@query(f"WITH {_Y}, u AS (SELECT y, CAST(greatest(t - 1, 1) AS DOUBLE) AS g FROM q), k AS (SELECT regr_intercept(y, g) AS a, regr_slope(y, g) AS b, var_pop(y) * (1 - corr(y, g) * corr(y, g)) AS v FROM u) SELECT 1 AS idx, 'intercept' AS name, round(a, 3) AS value FROM k UNION ALL SELECT 2, 'drift', round(b, 3) FROM k UNION ALL SELECT 3, 'sigma2', round(v, 3) FROM k")
def fit_named_trend(spark, sf_dir):
    """Parameters by name: the terms of a linear trend are called intercept and drift. A trend in the state meets the next observation."""
    m = model.fit(_orders(spark, sf_dir), "y", "month", trend="ct", compute_bse=False)
    return m.filter("kind = 'param'").select("idx", "name", F.round("value", 3).alias("value"))


@query("WITH g AS (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS h) SELECT a.h, b.h AS j, round(pow(5e-1, a.h - b.h) * 2e0 * (1 - pow(25e-2, b.h)) / 75e-2, 6) AS omega FROM g a JOIN g b ON b.h <= a.h")
def forecast_covariances(spark, sf_dir):
    y, at = S.series_of(_orders(spark, sf_dir), "y", "month"), probes(spark, [0.5, 2.0])
    f = estimation.forecast_states(filter.final_state(y, at, Spec(p=1)), at, Spec(p=1), 6)
    return f.select("h", F.posexplode("omega").alias("j", "omega")).select("h", (F.col("j") + 1).alias("j"), r6(F.col("omega")).alias("omega"))


@query(f"WITH {_Y}, n AS (SELECT y FROM q ORDER BY t DESC LIMIT 1), g AS (SELECT CAST(unnest(range(1, 9)) AS BIGINT) AS h) SELECT CAST(1 AS BIGINT) AS probe_id, h, round(y, 4) AS mean_orig, round(2e0 * h, 6) AS var_orig FROM g, n")
def forecast_integrated(spark, sf_dir):
    y, at, spec = S.series_of(_orders(spark, sf_dir), "y", "month"), probes(spark, [2.0]), Spec(d=1)
    w = differencing.difference(y, 1, 0).withColumnRenamed("w", "y")
    f = estimation.forecast_states(filter.final_state(w, at, spec), at, spec, 8)
    got = estimation.forecast_original(f, differencing.anchors(y, 1, 0), 1, 0, 1, 8)
    return got.select("probe_id", "h", F.round("mean_orig", 4).alias("mean_orig"), r6(F.col("var_orig")).alias("var_orig"))


@query(f"WITH {LINES}, n AS (SELECT max(t) - 6 AS n FROM l), z AS (SELECT quantity / 1000 AS y, discount / 100 AS x FROM l, n WHERE t = n) SELECT CAST(b AS BIGINT) AS probe_id, CAST(l.t - n AS INTEGER) AS h, round(b * (l.discount - k.discount) / 100, 6) AS mean_diff, round(sqrt(b * 2e0), 6) AS se_diff, round(z.y + b * (l.discount / 100 - z.x), 6) AS mean_orig, round(sqrt(b * 2e0 * (l.t - n)), 6) AS se_orig FROM n, z, l JOIN l k ON k.t = l.t - 1, (SELECT unnest([1, 2]) AS b) WHERE l.t > n")
def forecast_chain(spark, sf_dir):
    """The whole chain for two random walks with a regressor."""
    w = S.monthly_lines(spark, sf_dir).select("month", (F.col("quantity") / 1000).alias("y"), (F.col("discount") / 100).alias("x"))
    y, x = S.series_of(w, "y", "month"), S.exog_of(w, ["x"], "month")
    past = y.crossJoin(F.broadcast(y.agg((F.max("t") - 6).alias("n")))).filter("t <= n").drop("n")  # one row
    got = estimation.forecast_run(past, probes(spark, [1.0, 2.0], [2.0, 4.0]), Spec(d=1, r=1), 6, x)
    return got.withColumns({c: r6(F.col(c)) for c in got.columns[2:]})


@query(f"WITH {_Y}, n AS (SELECT t AS n, y FROM q ORDER BY t DESC LIMIT 1), g AS (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS h) SELECT h, round(y + 3e0 * h, 4) AS yhat, round(sqrt(2e0 * h), 4) AS se FROM g, n")
def forecast_drift_in_state(spark, sf_dir):
    """A random walk with drift, its difference in the state."""
    m = model.fit(_orders(spark, sf_dir), "y", "month", d=1, trend="c", simple_differencing=False, params=[3.0, 2.0])
    return model.forecast(m, 8).select("h", F.round("yhat", 4).alias("yhat"), F.round("se", 4).alias("se"))


@query()
def sql_surface(spark, sf_dir):
    """fit() as a table function of SQL."""
    sqlapi.register(ship(spark))
    S.hourly_events(spark, sf_dir, by_type=True).createOrReplaceTempView("tw_hourly")
    return spark.sql("""SELECT series, kind, name, idx, value FROM tw_fit(TABLE(SELECT event_type AS series, CAST(unix_timestamp(hour) AS BIGINT) AS t, n AS y FROM tw_hourly) PARTITION BY series ORDER BY (t), '{"p": 1, "trend": "c"}')""")


@query(f"WITH {_Y}, n AS (SELECT y FROM q ORDER BY t DESC LIMIT 1), g AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h) SELECT 'all' AS series, h, round(y, 4) AS yhat, round(sqrt(2e0 * h), 4) AS se, round(y - {Z95} * sqrt(2e0 * h), 4) AS lo, round(y + {Z95} * sqrt(2e0 * h), 4) AS hi FROM g, n")
def sql_forecast_walk(spark, sf_dir):
    """A random walk's forecast as a table function of SQL."""
    sqlapi.register(ship(spark))
    S.series_of(_orders(spark, sf_dir), "y", "month").createOrReplaceTempView("tw_orders")
    return spark.sql("""SELECT series, h, round(yhat, 4) AS yhat, round(se, 4) AS se, round(lo, 4) AS lo, round(hi, 4) AS hi
FROM tw_forecast(TABLE(SELECT 'all' AS series, t, y FROM tw_orders) PARTITION BY series ORDER BY (t), '{"d": 1, "params": [2.0], "h": 12}')""")


@query(f"WITH {LINES}, n AS (SELECT max(t) AS n FROM l) SELECT 'all' AS series, CAST(t - n + 6 AS INTEGER) AS h, round(3e0 * discount, 4) AS yhat, 2e0 AS se FROM l, n WHERE t > n - 6")
def sql_forecast_saved(spark, sf_dir):
    """A forecast in SQL from a saved model's table and the regressors of the future: no fit."""
    sqlapi.register(ship(spark))
    w = S.monthly_lines(spark, sf_dir).withColumns({"t": F.row_number().over(Window.orderBy("month")).cast("long"), "series": F.lit("all")})
    n = w.count()  # months
    m = written(model.fit(w.filter(F.col("t") <= n - 6), "quantity", "t", exog_cols=["discount"], params=[3.0, 4.0], keys=("series",)), "model")
    sqlapi.with_model(m, w.filter(F.col("t") > n - 6).select("series", "t", "discount")).createOrReplaceTempView("tw_tagged")
    return spark.sql("SELECT series, h, round(yhat, 4) AS yhat, round(se, 4) AS se FROM tw_forecast(TABLE(tw_tagged) PARTITION BY series ORDER BY (t), '{\"h\": 6}')")


@query(f"WITH {_Y} SELECT 'all' AS series, t, round(y, 6) AS v, 4e0 AS f, round(y / 2, 6) AS std_resid FROM q")
def sql_residuals_saved(spark, sf_dir):
    """Residuals in SQL of a saved model."""
    sqlapi.register(ship(spark))
    y = _orders(spark, sf_dir).select(F.lit("all").alias("series"), F.unix_date(F.col("month").cast("date")).cast("long").alias("t"), "y")
    m = written(model.fit(y, "y", "t", params=[4.0], keys=("series",)), "model")
    sqlapi.with_model(m, y).createOrReplaceTempView("tw_tagged_orders")
    got = spark.sql("SELECT * FROM tw_residuals(TABLE(tw_tagged_orders) PARTITION BY series ORDER BY (t))")
    return got.withColumns({c: r6(F.col(c)) for c in ("v", "std_resid")})


# ---- general fits: no SQL twin; the queries fail if a fit is no good


def _converged(m: DataFrame) -> DataFrame:
    ok = (F.col("kind") == "meta") & (F.col("name") == "converged") & (F.col("value") != 1)
    return m.withColumn("value", F.when(ok, F.raise_error(F.lit("the fit has not converged")).cast("double")).otherwise(F.col("value")))


@query()
def forecast_orders(spark, sf_dir):
    """SARIMA(0,1,1)(0,1,1)12 of monthly orders, twelve months ahead."""
    return model.forecast(_converged(model.fit(_orders(spark, sf_dir), "y", "month", d=1, q=1, sd=1, sq=1, s=12)), 12)


@query()
def fit_sarimax_exog(spark, sf_dir):
    w = S.monthly_lines(spark, sf_dir).select("month", (F.col("quantity") / 1000).alias("y"), (F.col("discount") / 100).alias("x"))
    m = model.fit(w, "y", "month", p=1, q=1, sp=1, s=12, exog_cols=["x"], trend="c")
    return model.summary(m)


@query()
def fit_nodiff_ct_conc(spark, sf_dir):
    return _converged(model.fit(_orders(spark, sf_dir), "y", "month", p=1, d=1, q=1, trend="ct", concentrate=True, simple_differencing=False))


# exact likelihood of (seasonal) AR(1): m chains of each L-th value; the derivative has one zero in (-1, 1), found by halving
_LINE_MONTHS = """w AS (SELECT l_linenumber AS line, date_trunc('month', l_shipdate) AS month, sum(l_quantity) AS y FROM lineitem GROUP BY ALL),
z AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY month) AS t, (y - avg(y) OVER (PARTITION BY line)) / stddev_pop(y) OVER (PARTITION BY line) AS y FROM w)"""
_AR_ORDERS = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1)]
_EXACT = f"""{_LINE_MONTHS},
o(p, d, sp) AS (VALUES {", ".join(map(str, _AR_ORDERS))}),
zd AS (SELECT line, t, y, y - lag(y) OVER (PARTITION BY line ORDER BY t) AS w FROM z),
x AS (SELECT p, d, sp, line, t, CASE d WHEN 0 THEN y ELSE w END AS y, CASE sp WHEN 1 THEN 12 ELSE 1 END AS l FROM zd, o WHERE t > d),
g AS (SELECT x.p, x.d, x.sp, x.line, count(*) AS n, max(x.l) AS m, sum(x.y * x.y) AS s0, sum(x.y * b.y) AS s1, sum(CASE WHEN b.y IS NOT NULL AND a.y IS NOT NULL THEN x.y * x.y ELSE 0 END) AS s2
  FROM x LEFT JOIN x b ON (b.p, b.d, b.sp, b.line, b.t) = (x.p, x.d, x.sp, x.line, x.t - x.l) LEFT JOIN x a ON (a.p, a.d, a.sp, a.line, a.t) = (x.p, x.d, x.sp, x.line, x.t + x.l) GROUP BY ALL),
h AS (SELECT *, 0 AS i, -1e0 AS lo, 1e0 AS hi FROM g UNION ALL
  SELECT p, d, sp, line, n, m, s0, s1, s2, i + 1, CASE WHEN up THEN c ELSE lo END, CASE WHEN up THEN hi ELSE c END
  FROM (SELECT *, (lo + hi) / 2 AS c, n * (s1 - (lo + hi) / 2 * s2) / (s0 - (lo + hi) * s1 + (lo + hi) * (lo + hi) / 4 * s2) > m * (lo + hi) / 2 / (1 - (lo + hi) * (lo + hi) / 4) AS up FROM h WHERE i < 55)),
r AS (SELECT p, d, sp, line, n, m, CASE WHEN p + sp > 0 THEN (lo + hi) / 2 ELSE 0 END AS f, s0, s1, s2 FROM h WHERE i = 55),
e AS (SELECT *, (s0 - 2 * f * s1 + f * f * s2) / n AS v, -5e-1 * n * (ln(2 * pi()) + 1 + ln((s0 - 2 * f * s1 + f * f * s2) / n)) + 5e-1 * m * ln(1 - f * f) AS ll FROM r)"""


def line_months(spark, sf_dir) -> DataFrame:
    """(line, month, y): monthly quantities of each line number, standardised."""
    w = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("line"), F.date_trunc("month", "l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("y"))
    each_ = w.groupBy("line").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread"))
    return w.join(each_, "line").select("line", "month", ((F.col("y") - F.col("mean")) / F.col("spread")).alias("y"))


@query(f"WITH RECURSIVE {_EXACT} SELECT line, sp, round(f, 3) + 0e0 AS coefficient, round(v, 4) AS sigma2, round(ll, 3) AS loglik FROM e WHERE p + sp = 1 AND d = 0")
def fit_ar_exact(spark, sf_dir):
    """AR(1) and seasonal AR(1) of seven series against the zero of the exact likelihood's derivative."""
    y = written(line_months(spark, sf_dir), "lines")

    def fitted(seasonal: int, **orders):
        m = model.fit(y, "y", "month", compute_bse=False, keys=("line",), **orders)
        first = m.filter("kind = 'param' AND idx = 1").select("line", (F.round("value", 3) + 0.0).alias("coefficient"))
        return first.join(model.metrics(m, ("line",)), "line").select("line", F.lit(seasonal).alias("sp"), "coefficient", F.round("sigma2", 4).alias("sigma2"), F.round("loglik", 3).alias("loglik"))

    return fitted(0, p=1).unionByName(fitted(1, sp=1, s=12))


@query(f"WITH RECURSIVE {_EXACT} SELECT line, p, d, sp, round(ll, 3) AS loglik, round(2 * (p + sp + 1) - 2 * ll, 2) AS aic FROM e")
def grid_ar_exact(spark, sf_dir):
    """Five orders of seven series, each against its exact optimum."""
    got = model.grid(line_months(spark, sf_dir), "y", "month", [(p, d, 0, sp, 0, 0, 12 if sp else 1) for p, d, sp in _AR_ORDERS], ("line",))
    return got.select("line", "p", "d", "sp", F.round("loglik", 3).alias("loglik"), F.round("aic", 2).alias("aic"))


@query()
def fit_hourly_missing(spark, sf_dir):
    return _converged(model.fit(S.hourly_events(spark, sf_dir), "n", "hour", p=1, q=1, trend="c"))


@query()
def grid_orders(spark, sf_dir):
    orders = [(p, d, q, 0, sd, 0, 12) for p in (0, 1) for d in (0, 1) for q in (0, 1) for sd in (0, 1)]
    return model.grid(_orders(spark, sf_dir), "y", "month", orders)


@query()
def forecast_per_event_type(spark, sf_dir):
    y = S.hourly_events(spark, sf_dir, by_type=True)
    m = model.fit(y, "n", "hour", p=1, sp=1, s=24, trend="c", keys=("event_type",), compute_bse=False)
    return model.forecast(m, 24, keys=("event_type",))


@query()
def fit_out_of_core(spark, sf_dir):
    return _converged(chunked.fit_stream(S.hourly_events(spark, sf_dir).withColumn("y", F.col("n") - 10), "y", "hour", Spec(p=1)))


@query()
def final_state(spark, sf_dir):
    return filter.final_state(scaled(spark, sf_dir), probes(spark, [0.5, 0.2, 2.0], [0.1, 0.3, 1.0]), Spec(p=1, q=1))

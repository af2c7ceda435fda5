"""Series and regressors from tables.

A series is (keys.., t, y): t runs from 1 in the order of a time column of any sortable type; y may be null (missing). Regressors
are long: (keys.., t, j, x). With `keys` every function works on many series at once, each in its own window partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, written

MAX_REGRESSORS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def over_time(keys: tuple[str, ...] = (), order: str = "t"):
    return Window.partitionBy(*keys).orderBy(order)


#: Rows of a block, and more where a look back is longer.
BLOCK = 1 << 15


def in_blocks(series: DataFrame, halo: int) -> tuple[DataFrame, int]:
    """series (.., t from 1) with __block, and the rows of a block: a block has its own rows and, as copies, the `halo` rows before them, so that
    what looks back that far is done inside blocks."""
    size = max(BLOCK, halo)
    own = F.floor((F.col("t") - 1) / size).cast("long")
    both = F.when((F.col("t") - 1) % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return series.withColumn("__block", F.explode(both)), size


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, a few blocks' values at a time and one row at least."""
    for b in batches:
        ends, at = b.column("y").offsets.to_numpy().astype(np.int64) + b.column("x").offsets.to_numpy(), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + 4 * BLOCK, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def cut(runs: DataFrame, size: int, halo: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., __block, t0, y, x): runs (keys.., t0, y, x) of consecutive times cut at the borders of in_blocks(), with its copies; x holds the rows' regressors one after another."""
    names = [*keys, "__block", "t0", "y", "x"]
    schema = T.StructType([runs.schema[k] for k in keys] + T.StructType.fromDDL("__block long, t0 long, y array<double>, x array<double>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches):
            at, ys, xs = b.column("t0").to_numpy(), b.column("y"), b.column("x")
            ends_y, ends_x = ys.offsets.to_numpy(), xs.offsets.to_numpy()
            n = np.diff(ends_y)
            some = np.flatnonzero(n)
            first, last = (at - 1) // size, np.where((at + n - 2) % size >= size - halo, 1, 0) + (at + n - 2) // size
            if not len(some):
                continue
            row = np.repeat(some, (last - first + 1)[some])  # a row a piece, pieces of a run in order
            block = np.concatenate([np.arange(first[i], last[i] + 1) for i in some]) if len(row) > len(some) else first[some]
            lo, hi = np.maximum(at[row], block * size + 1 - halo), np.minimum((at + n - 1)[row], (block + 1) * size)
            width = np.diff(ends_x)[row] // n[row]
            take = lambda values, start, count: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), values.take(pa.array(np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()))))
            off = lo - at[row]
            cells = [take(ys.values, ends_y[row] + off, hi - lo + 1), take(xs.values, ends_x[row] + off * width, (hi - lo + 1) * width)]
            key = [b.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays([*key, pa.array(block), pa.array(lo), *cells], names)

    return runs.select(*keys, "t0", "y", "x").mapInArrow(run, schema)


def together(t: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Times, values and regressors of one block's pieces."""
    t = t.sort_by("t0")
    flat = lambda c: pa.concat_arrays([x.flatten() for x in t.column(c).chunks])
    y = flat("y")
    n = np.concatenate([np.diff(c.offsets.to_numpy()) for c in t.column("y").chunks])
    return np.repeat(t.column("t0").to_numpy() - np.cumsum(n) + n, n) + np.arange(len(y)), y, flat("x")


def runs_of(series: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., t0, y, x) of rows (keys.., t, value): what comes one after another in time as one row; x is empty."""
    src = series.filter(F.col("t").isNotNull()).select(*keys, F.col("t").cast("long").alias("t"), F.col(value).cast("double").alias("y"))
    schema = T.StructType([src.schema[k] for k in keys] + T.StructType.fromDDL("t0 long, y array<double>, x array<double>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column("t").to_numpy()
            new = np.diff(t) != 1
            for k in keys:
                c = b.column(k)
                same = pc.fill_null(pc.equal(c[1:], c[:-1]), False) if c.null_count < len(c) else pa.array(np.ones(len(c) - 1, bool))
                new |= ~same.to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.flatnonzero(new) + 1])
            at = pa.array(start)
            y = pa.ListArray.from_arrays(pa.array(np.append(start, len(t)).astype(np.int32)), b.column("y"))
            x = pa.ListArray.from_arrays(pa.array(np.zeros(len(start) + 1, np.int32)), pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], pa.array(t[start]), y, x], [*keys, "t0", "y", "x"])

    return src.mapInArrow(run, schema)


def _packed(src: DataFrame, name: str, sorted_: bool) -> tuple[DataFrame, pa.Table]:
    """src (__t, y[, x]) as written pieces of at most BLOCK rows and a row a partition of what they hold; a partition that isn't in order ends at once, with state 2,
    unless the rows were sorted before: then what isn't later than the row before is a repeated time, state 1."""
    most = BLOCK
    kind = src.schema["__t"].dataType
    schema = T.StructType([T.StructField("__part", T.IntegerType()), *T.StructType.fromDDL("at long, n long, seen long, total double, state int").fields, T.StructField("first", kind), T.StructField("last", kind), *T.StructType.fromDDL("y array<double>, x array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before = TaskContext.get().partitionId(), 0, None
        held: list[pa.RecordBatch] = []

        def row(state: int) -> pa.RecordBatch:
            t, y = (pa.concat_arrays([h.column(c) for h in held]) for c in ("__t", "y"))
            x = pa.concat_arrays([h.column("x").flatten() for h in held]) if "x" in held[0].schema.names else y[:0]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (y, x)]
            total = pc.sum(y, min_count=0).cast(pa.float64())
            cells = [pa.array([part], pa.int32()), *[pa.array([v], pa.int64()) for v in (at, len(y), len(y) - y.null_count)], pa.array([total]), pa.array([state], pa.int32())]
            return pa.RecordBatch.from_arrays([*cells, t[:1], t[-1:], *lists], schema.names)

        state, n = 0, 0
        for some in batches:
            for i in range(0, some.num_rows, most):
                b = some.slice(i, most)
                t = b.column("__t")
                up = not t.null_count and (before is None or pc.less(before, t[0]).as_py()) and pc.all(pc.less(t[:-1], t[1:]), min_count=0).as_py()
                if not up and not (t.null_count or sorted_):
                    held = [b.slice(0, 1)]
                    yield row(2)
                    return
                state = state if up else 1
                if n + b.num_rows > most:
                    rest = most - n
                    held.append(b.slice(0, rest))
                    yield row(state)
                    held, at, n, b = [], at + most, 0, b.slice(rest)
                before = t[-1] if t[-1].is_valid else None
                held.append(b)
                n += b.num_rows
        if n:
            yield row(state)

    got = written(src.mapInArrow(run, schema), name, long=True)
    each = got.groupBy("__part").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("total").alias("total"), F.max("state").alias("state"), F.min("first").alias("first"), F.max("last").alias("last"))
    return got, each.orderBy("first", "__part").toArrow()


#: Types of times that Arrow compares as Spark does.
_COMPARED = ("byte", "short", "integer", "long", "date", "timestamp", "timestamp_ntz", "string")


class Packed:
    """One series as runs of its values in order of time, for what would be too much as rows.

    Partitions that are in order and whose times don't overlap are taken as they are; otherwise rows are dealt in ranges of time and sorted. `runs` is (t0, y, x); `bad`: a time is null or repeated;
    `mean` is that of the values that aren't null. The driver sees a row a partition. Operators that take one long series take this in place of its rows."""

    def __init__(self, df: DataFrame, y_col: str, t_col: str, exog_cols: list[str] | tuple[str, ...] = ()):
        spark = ship(df.sparkSession)
        xs = [F.array(*[F.col(c).cast("double") for c in exog_cols]).alias("x")] if exog_cols else []
        src = df.select(F.col(t_col).alias("__t"), F.col(y_col).cast("double").alias("y"), *xs)
        self.t_col, self.kind = t_col, (kind := src.schema["__t"].dataType)
        self.compared = kind.typeName() in _COMPARED or isinstance(kind, T.DecimalType)
        if not self.compared:
            at = F.when(F.col("__t").isNotNull() & ~F.col("__again"), F.col("t"))
            src = numbered(src, "__t").select(at.alias("__t"), *src.columns[1:])
        pieces, each = _packed(src, "runs", False)
        state, first, last = (each.column(c).to_pylist() for c in ("state", "first", "last"))
        if max(state, default=0) or any(not a < b for a, b in zip(last, first[1:], strict=False)):
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            pieces, each = _packed(src.repartitionByRange(parts, "__t").sortWithinPartitions("__t"), "runs", True)
        size = each.column("n").to_numpy()
        self.n, self.seen = int(size.sum()), int(each.column("seen").to_numpy().sum())
        self.mean = float(each.column("total").to_numpy().sum()) / max(self.seen, 1)
        self.bad = max(each.column("state").to_pylist(), default=0) > 0
        self.ends = pa.concat_arrays([c for t in (each.column("first").slice(0, 1), each.column("last").slice(max(len(size) - 1, 0))) for c in t.chunks]) if self.n else None
        ahead = spark.createDataFrame(pa.table({"__part": each.column("__part"), "__ahead": pa.array(np.cumsum(size) - size, pa.int64())}))
        self.runs = pieces.join(F.broadcast(ahead), "__part").select((F.col("__ahead") + F.col("at") + 1).alias("t0"), "y", "x")

    def checked(self) -> Packed:
        if self.bad:
            raise ValueError(f"time column {self.t_col} has a null or a repeated value")
        return self


def own_rows(df: DataFrame, size: int) -> DataFrame:
    """Without the copies."""
    return df.filter(F.col("__block") == F.floor((F.col("t") - 1) / size)).drop("__block")


def numbered(df: DataFrame, t_col: str, keys: tuple[str, ...] = (), parts: int | None = None, again: bool = True) -> DataFrame:
    """df with a long column t from 1 in each series' order of t_col, and, if asked, __again where an earlier row has the same time.

    Rows are dealt in ranges of (keys, t_col), sorted and numbered within each, and what a series has in earlier ranges is added: one shuffle, and no window holds
    a whole series. The ranges are written first: borders come from a sample, so planning them twice could deal the rows in two ways."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy(*keys, t_col).orderBy(t_col)  # the ranges hold equal times together: no further shuffle
    dealt = df.repartitionByRange(n, *keys, t_col)
    dealt = dealt.withColumn("__again", F.row_number().over(same) > 1) if again else dealt
    dealt = dealt.sortWithinPartitions(*keys, t_col).withColumn("__id", F.monotonically_increasing_id())  # a partition's number, then a row's in it
    dealt = written(dealt.withColumn("__part", F.shiftright("__id", 33).cast("int")), "ranges")
    sizes = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))  # a row a range and series
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("__part", *keys, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__ahead"))
    if keys:  # series may be many, and a null key is a key
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        both = dealt.alias("l").join(ahead.alias("r"), [F.col("l.__part") == F.col("r.__part"), *same]).select("l.*", "r.__ahead")
    else:
        both = dealt.join(F.broadcast(ahead), "__part")  # a row a range
    return both.withColumn("t", (F.col("__ahead") + F.col("__id")).cast("long")).drop("__part", "__id", "__ahead")


def series_checked(df: DataFrame, y_col: str, t_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., t, y, invalid_time): invalid_time marks a null or repeated time key."""
    src = df.select(*keys, F.col(t_col).alias("__t"), F.col(y_col).cast("double").alias("y"))
    return numbered(src, "__t", keys).select(*keys, "t", "y", (F.col("__t").isNull() | F.col("__again")).alias("invalid_time"))


def series_of(df: DataFrame, y_col: str, t_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., t, y); a null or repeated time key fails the query by name."""
    fails = F.raise_error(F.lit(f"time column {t_col} has a null or a repeated value")).cast("long")
    if not keys:
        of = Packed(df, y_col, t_col)
        at = fails if of.bad else F.col("t0") + F.col("at")
        return of.runs.select("t0", F.posexplode("y").alias("at", "y")).select(at.alias("t"), "y")
    checked = series_checked(df, y_col, t_col, keys)
    return checked.select(*keys, F.when(F.col("invalid_time"), fails).otherwise(F.col("t")).alias("t"), "y")


def time_report(df: DataFrame, t_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """([keys..,] n_invalid, n): rows with a null time or one that an earlier row has, by sums for each time instead of one ordered window."""
    each = df.groupBy(*keys, t_col).agg(F.count("*").alias("c"))
    bad = F.sum(F.when(F.col(t_col).isNull(), F.col("c")).otherwise(F.col("c") - 1))
    return each.groupBy(*keys).agg(F.coalesce(bad, F.lit(0)).cast("long").alias("n_invalid"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def exog_of(df: DataFrame, exog_cols: list[str], t_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., t, j, x) from wide columns; j is the column's place from 1."""
    if len(exog_cols) > MAX_REGRESSORS:
        raise ValueError(f"at most {MAX_REGRESSORS} regressors; got {len(exog_cols)}")
    wide = numbered(df.select(*keys, F.col(t_col).alias("__t"), F.array(*[F.col(c).cast("double") for c in exog_cols]).alias("xs")), "__t", keys, again=False)
    return wide.select(*keys, "t", F.posexplode("xs").alias("j", "x")).withColumn("j", F.col("j") + 1)


def trend_name(degree: int) -> str:
    return {0: "intercept", 1: "drift"}[degree]


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, n_orders, total) of whole months: the last one of the table is cut short and left out."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return o.join(o.agg(F.max("month").alias("last")), F.col("month") < F.col("last")).drop("last")


def monthly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, quantity, discount, n): line items by month of shipping."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.date_trunc("month", "l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_discount").cast("decimal(12,2)")).cast("double").alias("discount"), F.count("*").alias("n"))


def hourly_events(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """([event_type,] hour, n): n is null where an hour within the table's range has no event."""
    e = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"))
    keys = ["event_type", "hour"] if by_type else ["hour"]
    n = e.groupBy(*keys).agg(F.count("*").alias("n"))
    spine = e.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    if by_type:
        spine = spine.join(e.select("event_type").distinct(), how="cross")  # a row a type: five
    return spine.join(n, keys, "left").select(*keys, F.col("n").cast("double").alias("n"))

"""Elimination of a matrix held in blocks: systems and pivots of a matrix that no task holds.

A matrix is a table of dense blocks (rb, cb, data, owner). A panel of columns is eliminated at a time: every block row offers the rows that partial pivoting picks among
its own, offers are joined sixteen at a time and picked from again, and the last pick gives the panel's pivot rows and the inverse of their block.
Two equi-joins, by block row and by block column, then update all blocks to the right, and the table is written, so lineage stays short and a
lost executor costs a panel at most. Rows aren't moved: `owner` tells which unknown a row was the pivot of.

The driver sees sizes only; what is broadcast is one row of 8 * block**2 bytes. A matrix of one block is picked from once, which is plain partial pivoting.
Cells that lack are 0, repeated ones are summed. A singular matrix gives null values, not an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

BLOCK = 256
FAN = 16
TINY = 1e-300
_BLOCKS = "rb int, cb int, data binary, owner binary"


def picked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x that elimination with partial pivoting takes, in order, and the sizes of its pivots."""
    x, rows, sizes = x.copy(), np.arange(len(x)), np.zeros(min(x.shape))
    for c in range(len(sizes)):
        at = c + int(np.argmax(np.abs(x[c:, c])))
        if at != c:
            x[[c, at]], rows[[c, at]] = x[[at, c]], rows[[at, c]]
        sizes[c] = abs(x[c, c])
        if sizes[c] >= TINY:
            x[c + 1 :, c:] -= np.outer(x[c + 1 :, c] / x[c, c], x[c, c:])
    return rows[: len(sizes)], sizes


def _doubles(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _owners(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _blocks(cells: DataFrame, sizes: tuple[list[int], list[int]], block: int) -> DataFrame:
    """Dense blocks of (rb, cb, r, c, v); every block is there."""
    heights, widths = sizes
    across = len(widths)
    every = cells.sparkSession.range(len(heights) * across).select(F.expr(f"cast(id div {across} as int)").alias("rb"), F.expr(f"cast(id % {across} as int)").alias("cb"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("v"))

    def pack(t: pa.Table) -> pa.Table:
        rb, cb = t.column("rb")[0].as_py(), t.column("cb")[0].as_py()
        x = np.zeros((heights[rb], widths[cb]))
        np.add.at(x, (t.column("r").to_numpy(), t.column("c").to_numpy()), t.column("v").to_numpy())
        return pa.table({"rb": pa.array([rb], pa.int32()), "cb": pa.array([cb], pa.int32()), "data": pa.array([x.tobytes()], pa.binary()), "owner": pa.array([np.full(heights[rb], -1).tobytes()], pa.binary())})

    return cells.unionByName(every).groupBy("rb", "cb").applyInArrow(pack, _BLOCKS)


def _offers(panel: DataFrame, width: int, height: int) -> DataFrame:
    """(rbs, rs, inv, sizes) in one row: the panel's pivot rows, the inverse of their block and the pivots' sizes."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rb, data, owner in zip(*(b.column(c).to_pylist() for c in ("rb", "data", "owner")), strict=True):
                x, free = _doubles(data, width), np.flatnonzero(_owners(owner) < 0)
                take = free[picked(x[free])[0]]
                yield pa.RecordBatch.from_arrays([pa.array([rb] * len(take), pa.int32()), pa.array(take, pa.int32()), pa.array([x[r].tobytes() for r in take], pa.binary())], ["rb", "r", "x"])

    def joined(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        t = t.sort_by([("rb", "ascending"), ("r", "ascending")])
        return t, np.array([np.frombuffer(v, np.float64) for v in t.column("x").to_pylist()])

    def again(t: pa.Table) -> pa.Table:
        t, x = joined(t)
        return t.select(["rb", "r", "x"]).take(picked(x)[0])

    def last(t: pa.Table) -> pa.Table:
        t, x = joined(t)
        rows, sizes = picked(x)
        inv = np.linalg.inv(x[rows]) if sizes.min() >= TINY else np.full((width, width), np.nan)
        at = lambda c: pa.array([t.column(c).to_numpy()[rows].tolist()], pa.list_(pa.int32()))
        return pa.table({"rbs": at("rb"), "rs": at("r"), "inv": pa.array([inv.tobytes()], pa.binary()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.float64()))})

    rows, lot = panel.mapInArrow(own, "rb int, r int, x binary"), 1
    while height > lot * FAN:
        lot *= FAN
        rows = rows.withColumn("lot", F.floor(F.col("rb") / lot)).groupBy("lot").applyInArrow(again, "rb int, r int, x binary")
    return rows.withColumn("lot", F.lit(0)).groupBy("lot").applyInArrow(last, "rbs array<int>, rs array<int>, inv binary, sizes array<double>")  # at most FAN * block rows


def _factors(panel: DataFrame, pivot: DataFrame, width: int, first: int) -> DataFrame:
    """(rb, h, pivots, owner): a block row's new rows are its old ones (0 at pivots) and h times the pivot rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rb, data, owner, rbs, rs, inv in zip(*(b.column(c).to_pylist() for c in ("rb", "data", "owner", "rbs", "rs", "inv")), strict=True):
                inv = _doubles(inv, width)
                at = np.flatnonzero(np.array(rbs) == rb)
                rows, own = np.array(rs)[at], _owners(owner).copy()
                h = -(_doubles(data, width) @ inv)
                h[rows], own[rows] = inv[at], first + at
                yield pa.RecordBatch.from_arrays([pa.array([rb], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([rows.tolist()], pa.list_(pa.int32())), pa.array([own.tobytes()], pa.binary())], ["rb", "h", "pivots", "owner"])

    one = F.broadcast(pivot.select("rbs", "rs", "inv"))
    return panel.crossJoin(one).mapInArrow(run, "rb int, h binary, pivots array<int>, owner binary")


def _strips(right: DataFrame, pivot: DataFrame, widths: list[int], width: int) -> DataFrame:
    """(cb, strip): the pivot rows' cells in every block column to the right."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rb, cb, data, rbs, rs in zip(*(b.column(c).to_pylist() for c in ("rb", "cb", "data", "rbs", "rs")), strict=True):
                at = np.flatnonzero(np.array(rbs) == rb)
                if len(at):
                    x = _doubles(data, widths[cb])[np.array(rs)[at]]
                    yield pa.RecordBatch.from_arrays([pa.array([cb], pa.int32()), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([x.tobytes()], pa.binary())], ["cb", "at", "x"])

    def strip(t: pa.Table) -> pa.Table:
        cb = t.column("cb")[0].as_py()
        out = np.zeros((width, widths[cb]))
        for at, x in zip(t.column("at").to_pylist(), t.column("x").to_pylist(), strict=True):
            out[at] = _doubles(x, widths[cb])
        return pa.table({"cb": pa.array([cb], pa.int32()), "strip": pa.array([out.tobytes()], pa.binary())})

    one = F.broadcast(pivot.select("rbs", "rs"))
    return right.crossJoin(one).mapInArrow(rows, "cb int, at array<int>, x binary").groupBy("cb").applyInArrow(strip, "cb int, strip binary")


def _updated(joined: DataFrame, widths: list[int], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rb, cb, data, h, pivots, owner, strip in zip(*(b.column(c).to_pylist() for c in ("rb", "cb", "data", "h", "pivots", "owner", "strip")), strict=True):
                x = _doubles(data, widths[cb]).copy()
                x[pivots] = 0.0
                x += _doubles(h, width) @ _doubles(strip, widths[cb])
                yield pa.RecordBatch.from_arrays([pa.array([rb], pa.int32()), pa.array([cb], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([owner], pa.binary())], ["rb", "cb", "data", "owner"])

    return joined.mapInArrow(run, _BLOCKS)


def _cut(n: int, block: int) -> list[int]:
    return [min(block, n - at) for at in range(0, n, block)]


def _eliminated(a: DataFrame, b: DataFrame | None, n: int, m: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of the blocks of b, and one table of pivots for each panel."""
    ship(a.sparkSession)
    heights, widths = _cut(n, block), _cut(n, block) + _cut(m, block)
    place = lambda c: F.floor((F.col(c) - 1) / block).cast("int")
    inside = lambda c: ((F.col(c) - 1) % block).cast("int")
    cells = lambda x, skip: x.select(place("i").alias("rb"), (place("j") + skip).alias("cb"), inside("i").alias("r"), inside("j").alias("c"), F.col("v").cast("double").alias("v"))
    both = cells(a, 0) if b is None else cells(a, 0).unionByName(cells(b, len(heights)))
    state, pivots = written(_blocks(both, (heights, widths), block), "blocks"), []
    for k, width in enumerate(heights):
        panel, right = state.filter(F.col("cb") == k), state.filter(F.col("cb") > k)
        pivot = written(_offers(panel, width, len(heights)), "pivot")
        pivots.append(pivot.select(F.posexplode("sizes").alias("j", "piv")).withColumn("j", (F.col("j") + k * block + 1).cast("int")))
        if k + 1 < len(widths):
            factors, strips = _factors(panel, pivot, width, k * block), _strips(right, pivot, widths, width)
            state = written(_updated(right.drop("owner").join(factors, "rb").join(strips, "cb"), widths, width), "blocks")
    return state, pivots


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pivots(a: DataFrame, block: int = BLOCK) -> DataFrame:
    """(j, piv): sizes of the pivots of a square matrix (i, j, v), in order."""
    n = a.agg(F.max("i")).first()[0]
    return _together(_eliminated(a, None, n, 0, block)[1])


def solve(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, v, pivmin, ok) of A X = B; ok is false, and v may be null, where a pivot is at most 1e-12."""
    n, m = a.agg(F.max("i")).first()[0], b.agg(F.max("j")).first()[0]
    left, steps = _eliminated(a, b, n, m, block)
    skip, widths = len(_cut(n, block)), _cut(m, block)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for cb, data, owner in zip(*(t.column(c).to_pylist() for c in ("cb", "data", "owner")), strict=True):
                x = _doubles(data, widths[cb - skip])
                i, j = np.repeat(_owners(owner) + 1, x.shape[1]), np.tile(np.arange(x.shape[1]) + (cb - skip) * block + 1, len(x))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(x.ravel(), pa.float64(), from_pandas=True)], ["i", "j", "v"])

    low = _together(steps).agg(F.min("piv").alias("pivmin"))
    return left.mapInArrow(cells, "i int, j int, v double").crossJoin(F.broadcast(low)).withColumn("ok", F.col("pivmin") > 1e-12)

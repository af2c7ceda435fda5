"""What the text operators share: the shared folder, written tables, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that a Python worker handles at once; working arrays take about 60 times as much.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without a setting only a local master gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: it cuts the lineage, survives lost executors and gives the next join two plain sides."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes saved() tables that nothing reads any more. The driver is asked to collect its garbage, as shuffle files stay until their plans go."""
    for t in tables:
        for at in {f.rpartition("/")[0] for f in t.inputFiles()}:
            drop_path(spark, at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; from then on Arrow batches hold few rows, as one of long texts is held whole on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Gives memory that a task has freed back to the system, as a worker lives on with other stages' tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of a binary column, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to


def named(name: str) -> Column:
    """A column by its whole name, whatever stands in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def filtered(docs: DataFrame, text: str, keep: Callable[[pa.RecordBatch], list[bool]], size: int = CHUNK) -> DataFrame:
    """The rows that `keep` tells of slices of (.., text as bytes), with all columns under their own names."""
    names = docs.columns
    src = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)], named(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", size):
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(keep(b), pa.bool_()))
        tidy()

    return src.mapInArrow(run, src.drop("text").schema).toDF(*names)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary array (null: empty) as its bytes and n+1 offsets."""
    column = pc.fill_null(column, b"") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, (off - off[0]).astype(np.int64)


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def words(raw: np.ndarray, off: np.ndarray, ink: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes outside [space, tab..CR], or of those that `ink` marks, and each run's row. Runs end with their row."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[raw] if ink is None else ink
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:n]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def distinct_words(low: np.ndarray, off: np.ndarray, ink: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, told apart by their bytes; for every word which one it is, and its row. ink: as in words()."""
    ink = ~_SPACE[low] if ink is None else ink
    s, e, row = words(low, off, ink)
    if not len(s):
        return [], row, row
    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(s), [None, ends, pa.py_buffer(low[ink])]).dictionary_encode()
    _, ends, data = coded.dictionary.buffers()
    ends, data = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], coded.indices.to_numpy().astype(np.int64), row


def word_keys(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash (xxh3) of every word, and its row."""
    found, word, row = distinct_words(low, off)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))[word], row


#: Odd bases of the two rolling hashes and of the finishers; fixed values.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any substring of `raw` modulo 2**64, from prefix sums of byte * base**-i. For grams and windows of some hundred bytes
    at most: from 1,024 bytes on there are pairs of strings that such hashes never tell apart."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, which: int = 0):
        n = len(raw) + 1
        up, down = self._powers.get(which, (np.zeros(0, np.uint64),) * 2)
        if len(up) < n:
            size = max(n, CHUNK + 1)
            base = BASES[which]
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if size <= 4 * CHUNK:
                self._powers[which] = (up, down)
        self.up = up
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal strings get equal values wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

"""What every session needs: the package on the Python workers, which may run where it isn't installed, and written tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="tidewright-")) / "tidewright.zip"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(at))
        _sent.add(sc.applicationId)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share; it goes when the driver ends. Without the setting only a local
    master gets a folder of its own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


#: Rows of a row group where rows hold long arrays: a reader decodes whole groups, at most 4,096 rows at once, and such arrays take a small part of their size on disk.
LONG_ROWS = {"parquet.block.row.count.limit": "16", "parquet.page.row.count.limit": "16"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within send Python at most 8 MB at once: a task holds a batch several times outside the heap. The session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "8m")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, path: str | None = None, long: bool = False) -> DataFrame:
    """df as a written table: what it holds is decided once, whatever is asked of it later. long: its rows hold long arrays."""
    path = path or shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession) if long else nullcontext():
        df.write.mode("overwrite").options(**LONG_ROWS if long else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

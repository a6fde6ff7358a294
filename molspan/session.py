"""Session helpers: shared folder, lineage cuts, Arrow batches, shipping the package."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch, at most: texts and sequences are long, and a batch is held whole in the JVM and in Python.
BATCH_ROWS = 2_000
#: Bytes of a row group of intermediate tables.
ROW_GROUP = 16 << 20

_workspaces: set[str] = set()


def use_shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all machines share.

    A cluster names it in ``spark.checkpoint.dir``. Only on one machine (a local master), and
    only where nothing is set, a temporary folder is used; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="molspan-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def workspace(spark: SparkSession) -> str:
    """This application's folder under the shared one; it goes when the driver's process ends."""
    path = f"{use_shared_folder(spark).rstrip('/')}/molspan-{spark.sparkContext.applicationId}"
    if path not in _workspaces:
        _workspaces.add(path)
        where, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()

        def clean() -> None:  # also after the session was stopped, as long as there is a JVM
            with contextlib.suppress(Exception):
                where.getFileSystem(conf).delete(where, True)

        atexit.register(clean)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, as Parquet, and go on from the files.

    Results of Python functions and of row ranks are then fixed: a task that is run
    again after an executor is lost reads the same rows.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)  # a task holds a row group in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands freed memory back to the system, as Python workers live on beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow as every operator here uses it: at most BATCH_ROWS rows a batch, give_back() after each.

    The limit is a setting of the session, lowered at the first call and left so: plans are
    lazy, so it can't be put back before they run.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(setting, "10000"))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(each())

    return df.mapInArrow(wrapped, schema)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, where it isn't installed."""
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="molspan-ship-")) / "molspan.zip"
    with zipfile.ZipFile(out, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))

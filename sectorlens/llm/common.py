"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a batch that goes to a Python worker. Rows are whole documents here, so Spark's 10,000 would hold tens of megabytes on both sides.
BATCH_ROWS = 1_000


def ready(spark: SparkSession) -> None:
    """Ships the package to the workers and, unless the session has a setting of its own, bounds the batches that go to them."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir is the shared folder. Where none is set, a local one serves local sessions; a cluster must name one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "sectorlens-checkpoints")
    context.setCheckpointDir(folder)


_written: list[DataFrame] = []


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder. Lineage ends there, a lost executor loses nothing of it, and the shuffle files of the plan behind it can go."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark removes shuffle files once the driver has collected the plan that wrote them
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    _written.append(table)
    return table


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: what came of them is itself written."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written[:] = [t for t in _written if t is not table]


@contextlib.contextmanager
def tables_dropped() -> Iterator[None]:
    """Drops at the end the tables that operators wrote within, and left for their results to read; so write the results before."""
    before = list(_written)
    yield
    drop(*(t for t in list(_written) if not any(t is b for b in before)))


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give a worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value evaluated once: the optimizer would copy a plain column into every lambda that uses it."""
    return F.transform(F.array(value), then)[0]


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))

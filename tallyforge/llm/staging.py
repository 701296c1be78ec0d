"""Shared-folder staging and small helpers used by every operator of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space every contract names: space and \t \n \v \f \r.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and the master is local (tests), a folder is set once."""
    context = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
    return context._jsc.sc().getCheckpointDir().get()


_WORKSPACE: ContextVar[str | None] = ContextVar("workspace", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing uses, in the workspace if there is one."""
    return f"{_WORKSPACE.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is staged within, which goes at the end: results have to be written elsewhere by then."""
    path = fresh_path(spark, "workspace")
    token = _WORKSPACE.set(path)
    try:
        yield path
    finally:
        _WORKSPACE.reset(token)
        drop_path(spark, path)


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution drops its shuffle files when it has ended, and batches of long texts stay small."""
    wanted = {
        "spark.sql.parquet.columnarReaderBatchSize": "512",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stage(df: DataFrame, label: str, *, files: int | None = None, **options) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts the lineage.

    ``files`` bounds the number of files of a table that is known to be small for it.
    """
    spark, schema, path = df.sparkSession, df.schema, fresh_path(df.sparkSession, label)
    with frugal(spark):
        (df if files is None else df.coalesce(files)).write.options(**{"parquet.block.size": str(32 << 20)} | options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def if_small(df: DataFrame, limit: int) -> DataFrame:
    """A staged table marked for broadcast when its counted rows are within the limit; else as it is,
    and the join that it goes to shuffles both sides."""
    return F.broadcast(df) if df.count() <= limit else df


def merge_tiny(df: DataFrame) -> DataFrame:
    """The rows in no more partitions than eight a core, or one for each 128 MB if that is more.

    Many tiny input files would otherwise give as many tiny tasks, staged files and Python workers.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(8 * df.sparkSession.sparkContext.defaultParallelism, min(size >> 27, 1 << 30)))


def scanned_bytes(df: DataFrame) -> int:
    """The bytes that a plan reads, as far as known from its files; more than they are where a plan widens them."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 60)


def files_for(rows: int, rows_a_file: int, least: int = 4) -> int:
    """A number of files that grows with the rows; few files are quicker to create and to list."""
    return max(least, -(-rows // rows_a_file))


def lean(run):
    """A function over Arrow batches that gives its unused memory back when a task ends.

    Python workers outlive their tasks, and what they keep counts against the executor.
    """

    def held(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return held


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever extra columns the caller brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str):
    """A column by its exact name, also where the name holds dots."""
    return F.col(f"`{name}`")

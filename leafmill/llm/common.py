"""Shared helpers: the cluster's shared folder, staged tables and Arrow stages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import SCHEMES

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: spark.checkpoint.dir.

    Only where the session names none (tests, local mode) a temporary one is
    made on this machine and removed at exit.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return "file://" + _own_dir


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage, so what follows survives the loss of executors
    without a second run of an expensive stage. The shuffle files behind the
    table go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_in = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._staged_in)
        path.getFileSystem(conf).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches, so that long documents stay in memory."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches.

    The options count when a plan runs, which is after the operator has
    returned it, so they are not set back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def open_shared(path: str, mode: str):
    """Open a file of the shared folder, on any file system that pyarrow knows."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, mode)
    if path.startswith("file:"):
        return open(local_path(path), mode)
    system, inner = store(path)
    if mode == "rb":
        return system.open_input_file(inner)
    return system.open_output_stream(inner)


def store(path: str):
    """Arrow's file system of a path and the path in it; the schemes that Hadoop has for stores are known too."""
    from pyarrow import fs

    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def make_shared(path: str) -> str:
    """Create a folder of the shared file system."""
    if path.startswith("file:") or "://" not in path:
        os.makedirs(local_path(path), exist_ok=True)
    else:
        system, inner = store(path)
        system.create_dir(inner, recursive=True)
    return path


def local_path(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path


def named(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

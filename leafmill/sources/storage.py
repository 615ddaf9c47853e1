"""Small files and folders on any file system that Spark knows, from the driver; and spreading of small inputs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing if there is no such folder."""
    system, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, where = _at(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or not at all if there is one of that name."""
    system, where = _at(spark, path)
    own = f"{path}.{uuid.uuid4().hex}.part"
    write_text(spark, own, text)
    if system.getUri().getScheme() == "file":
        source, target = (system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(p)).toUri().getPath() for p in (own, path))
        try:
            os.link(source, target)
            done = True
        except FileExistsError:
            done = False
        remove(spark, own)
        return done
    done = not system.exists(where) and system.rename(spark._jvm.org.apache.hadoop.fs.Path(own), where)
    if not done:
        remove(spark, own)
    return done


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as can run at once, where the input has fewer parts.

    A large table has more parts than that and is not moved.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def open_file(path: str):
    """A file for reading, on this machine or on a file system that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    system, inner = _arrow(path)
    return system.open_input_file(inner)


def make_folder(path: str) -> None:
    """A folder and those above it, from a task; it may be there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
        return
    system, inner = _arrow(path)
    system.create_dir(inner, recursive=True)


def new_file(path: str):
    """A file for writing from a task, as open_file() for reading."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "wb")
    system, inner = _arrow(path)
    return system.open_output_stream(inner)


def _arrow(path: str):
    """Arrow's file system of a path and the path in it; other names of a store's scheme are known too."""
    from pyarrow import fs

    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


#: Names that Hadoop has for stores that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def files_in(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder that are not hidden, in order."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = _arrow(path) if "://" in path else (fs.LocalFileSystem(), path)
    head = path.removesuffix(inner)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    else:
        found = [info] if info.type == fs.FileType.File else []
    return sorted((head + x.path, x.size) for x in found)

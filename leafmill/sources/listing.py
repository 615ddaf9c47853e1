"""Files of folders by listing: a data source that lists in many tasks, and the reading of what it lists.

    spark.read.format("listing").option("links", True).load(folder)

gives (uri, size, mtime, error), a row for each file below the folder. Names
with a leading dot are left out; those with an underscore, which Spark's own
file sources hide, are not. Links are followed only with `links`, and never into
a folder that is above them. An empty file, one of MAX_FILE bytes or more, a
folder that cannot be listed, and what is neither file nor folder are rows with
`error`. A folder that is not there is one such row, a folder without files none.

The driver walks down, keeping folders only, until it has `tasks` of them; each
is then listed with all below it by a task, and those passed on the way without.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import MAX_FILE, Config
from . import files
from .storage import _arrow, make_folder, new_file, open_file, write_text

SCHEMA = "uri string, size long, mtime long, error string"
_TYPES = pa.schema([("uri", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("error", pa.string())])
#: Rows of a batch, and bytes of contents that a task holds.
ROWS, HELD = 4096, 16 << 20


class _Folder(InputPartition):
    """A folder, with all below it or without."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _entries(path: str, links: bool) -> tuple[list[str], list[tuple]]:
    """The folders of a folder, and rows for all else in it; in order of names."""
    here, folders, rows = _local(path), [], []
    try:
        if here is None:
            from pyarrow import fs

            system, inner = _arrow(path)
            head = path.removesuffix(inner)
            for x in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path):
                if x.base_name.startswith("."):
                    continue
                if x.type == fs.FileType.Directory:
                    folders.append(head + x.path)
                else:
                    rows.append(_row(head + x.path, x.size, int(x.mtime.timestamp()) if x.mtime else 0))
            return folders, rows
        with os.scandir(here) as found:
            names = sorted(e.name for e in found if not e.name.startswith("."))
    except (OSError, ValueError) as e:
        return [], [(path, None, None, f"cannot be listed: {type(e).__name__}")]
    for name in names:
        full = os.path.join(here, name)
        try:
            if os.path.islink(full) and (not links or os.path.isdir(full) and _above(full)):
                continue
            info = os.stat(full)
            if stat.S_ISDIR(info.st_mode):
                folders.append(full)
            elif stat.S_ISREG(info.st_mode):
                rows.append(_row(full, info.st_size, int(info.st_mtime)))
            else:
                rows.append((full, None, None, "neither a file nor a folder"))
        except OSError as e:
            rows.append((full, None, None, f"cannot be read: {type(e).__name__}"))
    return folders, rows


def _folders(path: str, links: bool) -> list[str]:
    """The folders of a folder as _entries() gives them, without asking for each file."""
    here = _local(path)
    if here is None:
        return _entries(path, links)[0]
    try:
        with os.scandir(here) as found:
            names = sorted(e.name for e in found if not e.name.startswith(".") and (e.is_symlink() or e.is_dir()))
    except (OSError, ValueError):
        return []
    full = [os.path.join(here, name) for name in names]
    return [f for f in full if os.path.isdir(f) and not (os.path.islink(f) and (not links or _above(f)))]


def _above(link: str) -> bool:
    """Whether a link leads to a folder that it lies in."""
    to, here = os.path.realpath(link), os.path.realpath(os.path.dirname(link))
    return here == to or here.startswith(to.rstrip("/") + "/")


def _row(uri: str, size: int, mtime: int) -> tuple:
    return uri, size, mtime, "empty" if size == 0 else f"{MAX_FILE} bytes or more" if size >= MAX_FILE else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_TYPES.names, r, strict=True)) for r in rows], _TYPES)


class ListingReader(DataSourceReader):
    def __init__(self, path: str, links: bool, deep: bool, tasks: int):
        self.path, self.links, self.deep, self.tasks = path, links, deep, tasks

    def partitions(self):
        passed, level = [], [self.path]
        while self.deep and level and len(level) < self.tasks:
            passed += level
            level = [f for path in level for f in _folders(path, self.links)]
        return [_Folder(p, False) for p in passed] + [_Folder(p, self.deep) for p in level]

    def read(self, partition):
        todo, held = [partition.path], []
        while todo:
            folders, rows = _entries(todo.pop(), self.links)
            if partition.deep:
                todo += reversed(folders)
            held += rows
            while len(held) >= ROWS:
                yield _batch(held[:ROWS])
                held = held[ROWS:]
        if held:
            yield _batch(held)


class Listing(DataSource):
    """Options: `links` follows links, `recursive` goes into folders (the default), `tasks` is the number of folders to deal out."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        on = lambda name, default: str(self.options.get(name, default)).lower() in ("true", "1", "yes")
        return ListingReader(self.options.get("path", ""), on("links", False), on("recursive", True), int(self.options.get("tasks", 256)))


def listed(spark: SparkSession, path: str, links: bool = False, recursive: bool = True, tasks: int = 256) -> DataFrame:
    """(uri, size, mtime, error) of the files of a folder."""
    spark.dataSource.register(Listing)
    return spark.read.format("listing").options(links=links, recursive=recursive, tasks=tasks).load(path)


def write_each(rows: DataFrame, folder: str) -> None:
    """A file for each row (within, content): tasks put them into the folder `within` below `folder`, then comes an empty mark.

    Names are of a task's number and the row's in it, so a task that runs again writes the same files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for within, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = f"{folder}/{within}"
                if place not in made:
                    make_folder(place)
                    made.add(place)
                with new_file(f"{place}/part-{task:05d}-{n}.txt") as f:
                    f.write(content.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select("within", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    write_text(rows.sparkSession, f"{folder}/_SUCCESS", "")


def read_listed(listing: DataFrame, config: Config | None = None) -> DataFrame:
    """The documents of a listing: (uri, content, mtime, size, error, ext, is_gzipped, mime, parser).

    Rows with an error keep it and have no content; so has a file that is gone or
    cannot be read, and a compressed one that is too large inside or broken.
    """
    names = ["uri", "size", "mtime", "error", "content"]
    types = [*_TYPES.types, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for uri, size, mtime, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = None
                if error is None:
                    try:
                        with open_file(uri) as f:
                            content = f.read()
                    except OSError as e:
                        error = f"cannot be read: {type(e).__name__}"
                held.append((uri, size, mtime, error, content))
                n += len(content or b"")
                if n >= HELD or len(held) >= ROWS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    # a folder is listed by one task, its files are read by many
    parts = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = listing.select("uri", "size", "mtime", "error").repartition(parts, "uri").mapInArrow(run, f"{SCHEMA}, content binary")
    rows = files.with_docinfo(rows, config)
    inside = F.when(F.col("is_gzipped"), files.gunzip(F.when(F.col("is_gzipped"), F.col("content")))).otherwise(F.col("content"))
    rows = rows.withColumn("_inside", inside)
    fault = F.when(F.col("content").isNotNull() & F.col("_inside").isNull(), F.lit("broken or too large inside"))
    return rows.withColumns({"error": F.coalesce("error", fault), "content": F.col("_inside")}).drop("_inside")

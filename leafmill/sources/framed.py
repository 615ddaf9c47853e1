"""Header-framed document streams: headers, a blank line, as many bytes as they say, and again.

What does not keep to the framing is a row of its own, without uri and content
and with the fault in `error`; the rest of its file is not read, as no later
frame can be found, and other files are.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.words import to_int
from .storage import files_in, open_file

SCHEMA = "uri string, content binary, size long, mtime long, mime string, parser string, encoding string, action string, error string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

# Header names and what they set; the last four are older or shorter spellings.
HEADERS = {
    "content-length": "size",
    "last-modified": "mtime",
    "content-location": "uri",
    "parser-type": "parser",
    "content-type": "mime",
    "encoding": "encoding",
    "action": "action",
    "charset": "encoding",
    "last-mtime": "mtime",
    "path-name": "uri",
    "document-type": "parser",
}
MIN_HEADERS = 2


class FrameError(ValueError):
    """A stream that does not keep to the framing."""


def parse_head(lines: list[str]) -> tuple[dict, list[str]]:
    """Values by column, and warnings; a missing Last-Modified is 0."""
    out, warnings = {"mtime": 0}, []
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon:
            raise FrameError(f"bad header line: {line}")
        name = HEADERS.get(key.strip().lower())
        if name is None:
            warnings.append(f"unknown header line: {line}")
            continue
        value = value.strip()
        if name == "mime":
            kind, _, rest = value.partition(";")
            value = kind.strip()
            m = re.search(r"charset=[\"']?([\w.-]+)", rest)
            if m:
                out.setdefault("encoding", m[1])
        try:
            out[name] = to_int(value) if name in ("size", "mtime") else value
        except ValueError as e:
            raise FrameError(str(e)) from None
    if not out.get("uri"):
        raise FrameError("no Content-Location")
    if out.get("size", 0) < 1:
        raise FrameError(f"no size for {out['uri']}")
    return out, warnings


def read_frames(stream, strict: bool = True) -> Iterator[tuple[dict, int]]:
    """(document, bytes read so far) of a binary stream.

    Without strict, a document that is not all there yet ends the reading.
    """
    head, done = [], 0
    while True:
        line = stream.readline()
        if not line:
            break
        if not line.endswith(b"\n") and not strict:
            return
        text = line.decode("utf-8", "replace").strip()
        if text:
            head.append(text)
            continue
        if len(head) < MIN_HEADERS:
            raise FrameError("not enough header lines")
        doc, _ = parse_head(head)
        body = stream.read(doc["size"])
        if len(body) < doc["size"]:
            if strict:
                raise FrameError(f"{doc['uri']} ends early")
            return
        done = stream.tell()
        yield {**dict.fromkeys(NAMES), **doc, "content": body}, done
        head = []
    if head and strict:
        raise FrameError("unparsed header lines remain")


def _fault(where: str, error: FrameError) -> dict:
    return {**dict.fromkeys(NAMES), "error": f"{where}: {error}"}


def _readable(stream, where: str, until: int | None = None) -> Iterator[dict]:
    """The documents of a stream, those that end by `until`, and a row for the first fault."""
    try:
        for doc, done in read_frames(stream, strict=until is None):
            if until is not None and done > until:
                return
            yield doc
            if done == until:
                return
    except FrameError as e:
        yield _fault(where, e)


def parse_buffer(buffer: bytes | str) -> dict:
    """The one document of a buffer."""
    data = buffer.encode() if isinstance(buffer, str) else buffer
    return next(read_frames(io.BytesIO(data)))[0]


def frames(df: DataFrame, col: str) -> DataFrame:
    """The documents of a column of framed buffers; each value may hold several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    yield from _batches(_readable(io.BytesIO(value), "buffer"))

    return df.select(F.col(col).cast("binary").alias("value")).mapInArrow(run, SCHEMA)


_TYPES = [pa.string(), pa.binary(), pa.int64(), pa.int64(), *[pa.string()] * 5]


def _batches(docs: Iterator[dict], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d["content"] or b"")
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in zip(NAMES, _TYPES, strict=True)], names=NAMES)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in zip(NAMES, _TYPES, strict=True)], names=NAMES)


def framed(uri: Column, content: Column, mtime: Column | None = None, parser: Column | None = None, mime: Column | None = None, action: Column | None = None) -> Column:
    """The framed form of a document as one string column; null parts have no header line."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) if c is not None else F.lit(None).cast("string")
    body = F.coalesce(content.cast("string"), F.lit(""))
    head = F.concat_ws(
        "\n", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")), line("Action", action), line("Content-Type", mime),
        line("Last-Modified", mtime if mtime is not None else F.lit(0)), line("Parser-Type", parser), line("Content-Location", uri),
    )
    return F.concat(head, F.lit("\n\n"), body)


class _Range(InputPartition):
    """Bytes of a file; to its end without `until`."""

    def __init__(self, path: str, at: int = 0, until: int | None = None):
        self.path, self.at, self.until = path, at, until


def _read_range(part: _Range) -> Iterator[pa.RecordBatch]:
    with open_file(part.path) as f:
        f.seek(part.at)
        yield from _batches(_readable(f, part.path, part.until))


def _heads(path: str, at: int, size: int) -> Iterator[int]:
    """Where each whole document ends, in order; only header lines are read. A FrameError says where a head is bad."""
    with open_file(path) as f:
        while at < size:
            f.seek(at)
            head = []
            while (line := f.readline()).endswith(b"\n"):
                if text := line.decode("utf-8", "replace").strip():
                    head.append(text)
                else:
                    break
            if not line.endswith(b"\n"):
                return
            if len(head) < MIN_HEADERS:
                raise FrameError("not enough header lines")
            at = f.tell() + parse_head(head)[0]["size"]
            if at > size:
                return
            yield at


#: Bytes of a file that one row of the offsets stands for, about.
SPLIT_BYTES = 64 << 20


def frame_offsets(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, at, until): ranges of whole documents of the files of a folder, of `split` bytes or one document.

    A task goes from head to head of a file without reading bodies. The last
    range of a file that ends badly has no `until`: its reader finds the fault.
    Stored as a table, the ranges need not be found again.
    """
    files = files_in(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, at, end = [], 0, 0
                try:
                    for end in _heads(r["path"], 0, r["size"]):
                        if end - at >= split:
                            rows.append((r["path"], at, end))
                            at = end
                except FrameError:
                    pass
                if end < r["size"]:
                    rows.append((r["path"], at, None))
                elif end > at:
                    rows.append((r["path"], at, end))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "at", "until"])

    listed = spark.createDataFrame(files, "path string, size long")
    return listed.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "path string, at long, until long")


def read_split(offsets: DataFrame) -> DataFrame:
    """The documents of ranges that frame_offsets() has found, each range in any task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _read_range(_Range(r["path"], r["at"], r["until"]))

    return offsets.select("path", "at", "until").repartition("path", "at").mapInArrow(run, SCHEMA)


def _complete(path: str, at: int, size: int) -> int:
    """Where the last whole document ends; the end of the file behind a bad head, as nothing can follow that."""
    try:
        for at in _heads(path, at, size):
            pass
    except FrameError:
        return size
    return at


class FramedReader(DataSourceReader):
    """One partition for each file; a file is read as a stream."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Range(p) for p, _ in files_in(self.path)]

    def read(self, partition):
        yield from _read_range(partition)


class FramedStreamReader(DataSourceStreamReader):
    """Files that grow, and new files of a folder: documents come when they are complete.

    The offset is the end of the last whole document of each file, the driver
    reads header lines only, and each file's new bytes are a partition.
    """

    def __init__(self, path: str):
        self.path, self.seen = path, {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        for path, size in files_in(self.path):
            self.seen[path] = _complete(path, self.seen.get(path, 0), size)
        return {p: n for p, n in self.seen.items() if n}

    def partitions(self, start, end):
        return [_Range(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def read(self, partition):
        yield from _read_range(partition)


class FramedSource(DataSource):
    """spark.read.format("framed").load(path): documents of framed files, or of all files of a folder."""

    @classmethod
    def name(cls):
        return "framed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FramedReader(self.options.get("path", ""))

    def streamReader(self, schema):
        return FramedStreamReader(self.options.get("path", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedSource)

"""Documents from files: folders, lists, compressed files, encodings, checks."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..config import MAX_FILE, Config
from ..functions import columns as C
from . import mime


@F.pandas_udf(BinaryType())
def gunzip(content: pd.Series) -> pd.Series:
    """The bytes inside a gzip stream; null for null, for what is none and for MAX_FILE bytes or more."""
    def one(b):
        out, rest = [], b
        try:
            while rest:  # a stream may have several members
                member = zlib.decompressobj(wbits=31)
                out.append(member.decompress(rest, MAX_FILE - sum(map(len, out))))
                if not member.eof or sum(map(len, out)) >= MAX_FILE:
                    return None
                rest = member.unused_data.lstrip(b"\0")
            return b"".join(out)
        except zlib.error:
            return None

    return content.map(one, na_action="ignore")


def no_nulls(text: Column) -> Column:
    """NUL characters, and with them the gap marks, as line ends; text without NUL as it is."""
    return F.when(F.instr(text, "\x00") > 0, F.translate(text, "\x00\x03", "\n\n")).otherwise(text)


def with_docinfo(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Add ext, is_gzipped, mime and parser to rows with a uri; given values stay."""
    config = config or Config()
    ext = F.coalesce(C.real_ext("uri"), F.lit("none"))
    given = lambda name, value: F.coalesce(name, value) if name in df.columns else value
    out = df.withColumn("ext", given("ext", ext)).withColumn("is_gzipped", F.coalesce(C.looks_like_gz("uri"), F.lit(False)))
    out = out.withColumn("mime", given("mime", mime.mime_type(F.col("ext"), config.mimes)))
    return out.withColumn("parser", given("parser", mime.parser_of(F.col("mime"), config.parsers)))


def checked(df: DataFrame) -> DataFrame:
    """Rows that can be documents: a uri, and a size above zero and below the limit."""
    return df.where(F.col("uri").isNotNull() & (F.col("size") > 0) & (F.col("size") < MAX_FILE))


def read_files(spark: SparkSession, paths: str | list[str], config: Config | None = None, recursive: bool = True) -> DataFrame:
    """(uri, content, mtime, size, ext, is_gzipped, mime, parser) of files; hidden ones are left out.

    The size limit is checked before any content is read; refused_files() tells what it leaves out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    raw = raw.where((F.col("length") > 0) & (F.col("length") < MAX_FILE))
    rows = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("uri"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    rows = with_docinfo(rows, config)
    inside = gunzip(F.when(F.col("is_gzipped"), F.col("content")))
    return rows.withColumn("content", F.when(F.col("is_gzipped"), inside).otherwise(F.col("content")))


def refused_files(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """(uri, size) of the files that read_files() leaves out as too large; no content is read. Empty files are no part of any scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).select("path", "length")
    return raw.where(F.col("length") >= MAX_FILE).select(F.regexp_replace("path", "^file:/*", "/").alias("uri"), F.col("length").alias("size"))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(uri) of the lines of a list; blank lines and comments are left out."""
    lines = spark.read.text(path)
    return lines.where(~F.col("value").rlike("^\\s*(#.*)?$")).select(F.trim("value").alias("uri"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a list that name something."""
    return file_list(spark, path).count()


def read_listed(spark: SparkSession, path: str, config: Config | None = None) -> DataFrame:
    """The files that a list names."""
    names = [r["uri"] for r in file_list(spark, path).toLocalIterator()]
    if not names:
        return read_files(spark, path, config).limit(0)
    return read_files(spark, names, config, recursive=False)


def decoded(content: Column, fallback: str = "ISO-8859-1") -> Column:
    """A binary column as text: UTF-8 where it is valid, else the fallback; without Python."""
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, fallback))

"""Documents from tables, and made-up ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip_markup
from .files import with_docinfo


def rows_as_documents(df: DataFrame, uri: Column, title: str | None, columns: list[str], where: Column | None = None) -> DataFrame:
    """Each row as an XML document with an element for each column; nulls are left out.

    `title` names the column of the title. Markup characters are escaped.
    """
    def clean(c: str) -> Column:
        text = F.col(c).cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{n}>"), clean(c), F.lit(f"</{n}>"))) for c, n in [*([(title, "title")] if title else []), *((c, c) for c in columns)]]
    body = F.concat(F.lit("<row>"), F.concat_ws("", *parts), F.lit("</row>"))
    rows = (df.where(where) if where is not None else df).select(uri.cast("string").alias("uri"), body.alias("content"), F.lit("application/xml").alias("mime"), F.lit("XML").alias("parser"))
    return rows.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))


def text_documents(df: DataFrame, uri: str, text: str) -> DataFrame:
    """A text column as plain text documents."""
    rows = df.select(F.col(uri).cast("string").alias("uri"), F.col(text).alias("content"), F.lit("text/plain").alias("mime"), F.lit("TXT").alias("parser"))
    return rows.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))


def html_documents(df: DataFrame, uri: str, html: str) -> DataFrame:
    rows = df.select(F.col(uri).cast("string").alias("uri"), F.col(html).alias("content"), F.lit("text/html").alias("mime"), F.lit("HTML").alias("parser"))
    return rows.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))


def normalized(docs: DataFrame, *keep: str) -> DataFrame:
    """(uri, *keep, words): html, sgml, xml and txt documents without markup, split at white space. Rows stay apart whatever their uris."""
    rows = with_docinfo(docs).where(F.col("ext").isin("html", "sgml", "xml", "txt"))
    return rows.select("uri", *keep, F.filter(F.split(strip_markup("content"), "\\s+"), lambda w: w != "").alias("words"))


def random_documents(spark: SparkSession, n: int, vocabulary: list[str], low: int = 3, high: int = 9999, seed: int = 0, shift_every: int = 0, shift: int = 30_000) -> DataFrame:
    """Made-up documents (uri, content) of random words; every so many words one is moved up by code points."""
    words = F.array(*map(F.lit, vocabulary))
    size = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high - low + 1)) + low

    def word(i: Column) -> Column:
        w = F.get(words, F.pmod(F.xxhash64("id", i, F.lit(seed + 1)), F.lit(len(vocabulary))).cast("int"))
        if not shift_every:
            return w
        moved = F.translate(w, "".join(map(chr, range(97, 123))), "".join(chr(c + shift) for c in range(97, 123)))
        return F.when(i % shift_every == shift_every - 1, moved).otherwise(w)

    text = F.array_join(F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), word), " ")
    return spark.range(n).select(F.concat(F.lit("doc"), F.col("id").cast("string"), F.lit(".txt")).alias("uri"), text.alias("content"))

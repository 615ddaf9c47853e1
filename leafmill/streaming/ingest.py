"""Streams of documents into an index, and running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index


def upsert_stream(docs: DataFrame, index: Index, checkpoint: str, skip_known: bool = False, seq: str | None = None, once: bool = False) -> StreamingQuery:
    """Each micro-batch of documents becomes a segment of the index.

    A column `action` of `delete` deletes the document; anything else indexes
    it. The index keeps the number of the stream's last batch, so one that is
    run again after a failure is committed once; the stream goes by its
    checkpoint's folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        if "action" in batch.columns:
            gone = batch.where(F.lower("action") == "delete").select("uri")
            batch = batch.where(F.coalesce(F.lower("action") != "delete", F.lit(True)))
            index.delete(gone, batch=(f"{checkpoint}#delete", number))
        index.add(batch, skip_known, seq, batch=(checkpoint, number))

    return _start(docs, write, checkpoint, once)


def totals_stream(docs: DataFrame, count_words: Callable, name: str) -> StreamingQuery:
    """Running numbers of files and words, as the table `name`."""
    rows = docs.select(count_words(F.col("content")).alias("n"))
    totals = rows.agg(F.count("*").alias("files"), F.sum("n").alias("words"))
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).start()


def handle_stream(docs: DataFrame, handler: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Give each micro-batch of documents to a handler."""
    return _start(docs, lambda batch, _: handler(batch), checkpoint, once)


def _start(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

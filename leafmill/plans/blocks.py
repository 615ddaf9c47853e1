"""Stored postings: blocks of documents by term, a term dictionary, and bitmaps of dead documents.

A document of a segment has a number (`doc`); CHUNK consecutive numbers are a
chunk. A block is one row: a term's documents of one field and chunk as arrays,
in order of their numbers, with counts, lengths, ascending positions (which
Parquet stores as differences) and paths, and with the greatest count and the
least length in it, which bound the relevance that it can give. A frequent
term's blocks are spread over chunks, so no row or task holds all its documents.
Words come from the JVM as arrays; they are sorted into blocks a million at a time.
New blocks of the title also tell how many of their documents have the term in
the text (`shared`), so that the dictionary need not compare documents.

The dictionary has (meta, term, df, cf) of each segment. The empty field stands
for an unfielded term, whose documents may have it in the text or the title.
Corrections for documents that a later commit replaced or deleted are rows of
their own, with negative counts and the segment they belong to.

Dead documents are 64 words of 64 bits for each chunk that has some.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GAP

#: Documents of a chunk are 1 << CHUNK_BITS.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
#: The field that stands for text and title together.
BOTH = ""


#: Documents that a join may send to all tasks, at most. Compressed columns look small to Spark, which would collect millions in the driver.
SENT_DOCS = 1 << 17


def by_shuffle(rows: DataFrame, n: int) -> DataFrame:
    """Rows of n documents, to be joined: they and the other side are shuffled if there are many."""
    return rows.hint("merge") if n > SENT_DOCS else rows


#: Chunks whose bits and numbers a join may send to all tasks, at most; each has under 1 KB.
SENT_CHUNKS = 1 << 14


def sent(chunks: DataFrame, n: int) -> DataFrame:
    """Rows of n chunks, to be joined: they go to all tasks, or are shuffled if there are many; the other side is never sent."""
    return chunks.hint("broadcast" if n <= SENT_CHUNKS else "merge")


def chunk_of(doc: Column) -> Column:
    return F.shiftright(doc, CHUNK_BITS)


# ---- postings

SCHEMA = (
    "term string, meta string, chunk long, n int, cf long, max_tf int, min_words long, docs array<long>, tfs array<int>, lengths array<long>, "
    "positions array<array<int>>, paths array<string>, path_at array<array<int>>, shared int, part int"
)
#: Words that a task holds before it writes blocks; a document and a piece count as one each.
HELD_WORDS = 1 << 20
#: Documents that are counted at a time.
HELD_ROWS = 64
#: What goes to a Python worker at a time, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of what runs meanwhile are small: a worker still holds the last one while it reads the next.

    With Spark's own bounds a worker's memory would grow with the rows of a task until it has 10,000.
    """
    names = {f"spark.sql.execution.arrow.max{k}PerBatch": str(v) for k, v in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES))}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def blocks(analyzed: DataFrame, stem: Callable[[str], str] | None = None, both: list[str] | None = None, bounds: list[str] | None = None) -> DataFrame:
    """Blocks of documents (doc, nwords, words); numbers rise within a task, so a chunk lies in one and nothing is shuffled.

    A chunk with very many words gives several blocks of a term. `both` are the
    fields of unfielded terms; `bounds` part the terms into ranges, and `part` is
    that of a block. A term that is a bound several times has several parts.
    """
    bits, both, bounds = CHUNK_BITS, both or [], bounds or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            # a batch may have many times the words that are held at once
            for at in range(0, batch.num_rows, HELD_ROWS):
                held.append(batch.slice(at, HELD_ROWS))
                pieces = held[-1].column(2).flatten()
                # documents and pieces take room even if they have no words
                n += held[-1].num_rows + len(pieces) + len(pieces.field("words").flatten())
                del pieces
                if n >= HELD_WORDS:
                    yield from _built(held, stem, bits, both, bounds)
                    n = 0
                    # what the allocator keeps would add up over a worker's tasks
                    pa.default_memory_pool().release_unused()
        if held:
            yield from _built(held, stem, bits, both, bounds)

    return analyzed.select("doc", "nwords", "words").mapInArrow(run, SCHEMA)


#: One word of so many is looked at to find the ranges of terms, and so many for each range.
STEP, LOOKED_AT = 64, 200


def some_words(words: str, key: str) -> Column:
    """One of STEP words of each piece."""
    at = F.pmod(F.xxhash64(key), F.lit(STEP)).cast("int")

    def own(p: Column) -> Column:
        size = F.size(p["words"])
        return F.when(size > at, F.transform(F.sequence(at, size - 1, F.lit(STEP)), lambda i: F.get(p["words"], i))).otherwise(F.array().cast("array<string>"))

    return F.filter(F.flatten(F.transform(words, own)), lambda w: w != GAP)


def term_bounds(some: DataFrame, parts: int, stem: Callable[[str], str] | None = None) -> list[str]:
    """Terms between `parts` ranges with about as many words each, from a column of some words; they only decide which file a block is in."""
    n = some.agg(F.sum(F.size("some"))).first()[0] or 0
    words = some.select(F.explode("some").alias("term"))
    if n > LOOKED_AT * parts:
        words = words.sample(LOOKED_AT * parts / n, seed=1)
    found = sorted(stem(r[0]) if stem else r[0] for r in words.collect())
    return [found[len(found) * i // parts] for i in range(1, parts)] if found else []


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of values that begin at the cuts."""
    return pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), values)


def _ordered(term: np.ndarray, meta: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Places by term, field and chunk; what is equal stays in order. One sort by one number, where the three fit into it."""
    # few chunks are held at once, mostly one
    known = np.unique(chunks)
    width = len(known) * (int(meta.max()) + 1)
    key = term.astype(np.int64) * width + meta.astype(np.int64) * len(known)
    if len(known) > 1:
        key += np.searchsorted(known, chunks)
    # the place itself in the low digits makes all keys different, so the fastest sort is stable too
    n = len(key)
    if (int(term.max()) + 1) * width * n < 1 << 63:
        key *= n
        key += np.arange(n)
        key.sort()
        key %= n
        return key
    return np.argsort(key, kind="stable")


def _built(batches: list[pa.RecordBatch], stem: Callable[[str], str] | None, bits: int, both: list[str], bounds: list[str]) -> list[pa.RecordBatch]:
    """A batch of blocks, or none if there are no words; the given list is empty then, and no words are held while the blocks are written."""
    table = pa.Table.from_batches(batches).combine_chunks()
    batches.clear()
    if not table.num_rows:
        return []
    docs, sizes, pieces = (table.column(i).chunk(0) for i in range(3))
    docs, sizes = docs.to_numpy(), sizes.to_numpy()
    of_piece = np.repeat(np.arange(len(docs), dtype=np.int32), pc.list_value_length(pieces).fill_null(0).to_numpy())
    pieces = pieces.flatten()
    lists = pieces.field("words")
    per_piece = pc.list_value_length(lists).fill_null(0).to_numpy()
    words = lists.flatten()
    row = np.repeat(of_piece, per_piece)
    # positions count words and gaps from 1 in each document
    first = np.searchsorted(row, np.arange(len(docs)))
    pos = np.arange(1, len(row) + 1, dtype=np.int32) - first.astype(np.int32)[row]
    keep = np.flatnonzero(pc.not_equal(words, GAP).to_numpy(zero_copy_only=False))
    if not len(keep):
        return []

    def coded(values: pa.Array, change=None) -> tuple[np.ndarray, pa.Array]:
        """Codes in the order of the values."""
        d = values.dictionary_encode()
        names = d.dictionary
        again = pa.array(list(map(change, names.to_pylist())), pa.string()).dictionary_encode() if change else None
        if change:
            names = again.dictionary
        order = pc.sort_indices(names)
        code = np.empty(len(names), np.int32)
        code[order.to_numpy()] = np.arange(len(names), dtype=np.int32)
        if change:
            code = code[again.indices.to_numpy()]
        return code[d.indices.to_numpy()], names.take(order)

    term, terms = coded(words.take(pa.array(keep)), stem)
    meta, metas = coded(pieces.field("meta"))
    path, paths = coded(pieces.field("context"))
    meta, path = np.repeat(meta, per_piece)[keep], np.repeat(path, per_piece)[keep].astype(np.int32)
    row, pos = row[keep], pos[keep]
    # columns of a million numbers are let go as soon as they have been used
    del keep, of_piece, first, pieces, lists, per_piece, words, table
    # a bound's place in the terms tells which of them lie before it
    low, high = (np.sort([find(range(len(terms)), b, key=lambda i: terms[i].as_py()) for b in bounds]) for find in (bisect_right, bisect_left))
    chunks = (docs >> bits)[row]
    order = _ordered(term, meta, chunks)
    term = term[order]
    meta = meta[order]
    path = path[order]
    row = row[order]
    pos = pos[order]
    chunks = chunks[order]
    del order
    new_block = np.r_[True, (term[1:] != term[:-1]) | (meta[1:] != meta[:-1]) | (chunks[1:] != chunks[:-1])]
    new_doc = new_block | np.r_[True, row[1:] != row[:-1]]
    doc_at, block_at = np.flatnonzero(new_doc), np.flatnonzero(new_block)
    tfs = np.diff(np.append(doc_at, len(row))).astype(np.int32)
    own = np.searchsorted(doc_at, block_at)  # where a block's documents begin
    # of documents and blocks from here on; only positions and paths are still those of words
    term, meta, row, chunks = term[doc_at], meta[doc_at], row[doc_at], chunks[block_at]
    of, fields = term[own], meta[own]
    lengths = sizes[row]
    # the paths of a block, and a place's number among them; none where the block has one path
    single = np.minimum.reduceat(path, block_at) == np.maximum.reduceat(path, block_at)
    block_of = None if single.all() else np.cumsum(new_block) - 1
    del new_block, new_doc
    pairs = np.stack((np.arange(len(block_at)), path[block_at]), 1) if block_of is None else np.unique(np.stack((block_of, path), 1), axis=0)
    path_cuts = np.searchsorted(pairs[:, 0], np.arange(len(block_at)))
    if block_of is None:
        path_at = pa.nulls(len(block_at), pa.list_(pa.list_(pa.int32())))
    else:
        width = len(paths)
        number = (np.searchsorted(pairs[:, 0] * width + pairs[:, 1], block_of.astype(np.int64) * width + path) - path_cuts[block_of]).astype(np.int32)
        inner = _lists(doc_at, pa.array(number))
        path_at = pc.if_else(pa.array(single), pa.scalar(None, pa.list_(pa.list_(pa.int32()))), _lists(own, inner))
    # which documents of the second field have the term in the first
    shared = np.zeros(len(doc_at), np.int32)
    if len(both) == 2:
        one, two = (np.flatnonzero(meta == metas.index(m).as_py()) for m in both)
        # rows in the order of their chunks, as places are; a task may read files in any order
        nth = np.empty(len(docs), np.int64)
        nth[np.argsort(docs >> bits, kind="stable")] = np.arange(len(docs))
        place = lambda these: term[these].astype(np.int64) * len(docs) + nth[row[these]]
        if len(one) and len(two):
            first, second = place(one), place(two)
            shared[two] = first[np.minimum(np.searchsorted(first, second), len(one) - 1)] == second
            del first, second
        del one, two
    first_part, last_part = (np.searchsorted(x, of, "right") for x in (low, high))
    spread = chunks + (chunks >> max(0, 33 - bits))
    part = (first_part + spread % (last_part - first_part + 1)).astype(np.int32)
    return [pa.RecordBatch.from_arrays([
        terms.take(pa.array(of)), metas.take(pa.array(fields)), pa.array(chunks),
        pa.array(np.diff(np.append(own, len(doc_at))).astype(np.int32)), pa.array(np.add.reduceat(tfs, own, dtype=np.int64)),
        pa.array(np.maximum.reduceat(tfs, own)), pa.array(np.minimum.reduceat(lengths, own)),
        _lists(own, pa.array(docs[row])), _lists(own, pa.array(tfs)), _lists(own, pa.array(lengths)),
        _lists(own, _lists(doc_at, pa.array(pos))), _lists(path_cuts, paths.take(pa.array(pairs[:, 1]))), path_at,
        pa.array(np.add.reduceat(shared, own, dtype=np.int32)), pa.array(part),
    ], names=[x.split()[0] for x in SCHEMA.split(", ")])]


def ranged(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks in files by their ranges of terms, so that a term lies in few files, a very frequent one in several."""
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("term", "meta", "chunk").drop("part")


def postings(rows: DataFrame) -> DataFrame:
    """One row for each document of a block: (segment, chunk, term, meta, doc, tf, nwords, positions)."""
    out = rows.select("segment", "chunk", "term", "meta", F.explode(F.arrays_zip("docs", "tfs", "lengths", "positions")).alias("x"))
    return out.select("segment", "chunk", "term", "meta", F.col("x.docs").alias("doc"), F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("nwords"), F.col("x.positions").alias("positions"))


def paths(rows: DataFrame) -> DataFrame:
    """(segment, doc, meta, term, pos, context): one row for each place."""
    out = rows.select("segment", "meta", "term", "paths", "path_at", F.posexplode(F.arrays_zip("docs", "positions")).alias("i", "x"))
    at = F.coalesce(F.get("path_at", F.col("i")), F.array_repeat(F.lit(0), F.size("x.positions")))
    out = out.select("segment", F.col("x.docs").alias("doc"), "meta", "term", "paths", F.explode(F.arrays_zip(F.col("x.positions").alias("pos"), at.alias("at"))).alias("y"))
    return out.select("segment", "doc", "meta", "term", F.col("y.pos").alias("pos"), F.get("paths", F.col("y.at")).alias("context"))


# ---- compaction

#: Documents whose chunks are numbered by one task, about.
NUMBERED = 1 << 20


def live_chunks(live: DataFrame, docs: int) -> DataFrame:
    """(segment, chunk, bits, before, n, bucket) of live documents (segment, doc): before has how many lie before each word of the bits.

    Buckets are runs of chunks with about NUMBERED documents.
    """
    ones = lambda i: F.aggregate(F.slice("bits", F.lit(1), i), F.lit(0), lambda n, w: n + F.bit_count(w).cast("int"))
    rows = bitmaps(live).withColumn("before", F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 64)), ones)).withColumn("n", F.get("before", F.lit(CHUNK // 64)))
    return rows.repartitionByRange(1 + docs // NUMBERED, "segment", "chunk").withColumn("bucket", F.spark_partition_id())


def renumbering(chunks: DataFrame) -> DataFrame:
    """(segment, chunk, bits, before, base, alone): a chunk's live documents get the numbers from `base` on, in their order.

    Chunks that are more than half full stay alone; smaller ones are put together, and stay within one chunk as
    each begins in its first half. Documents are neither sorted nor joined for it.
    """
    half = 1 << CHUNK_BITS >> 1
    small = F.col("n") <= half
    each = Window.partitionBy("bucket").orderBy("segment", "chunk")
    rows = chunks.withColumn("row", F.row_number().over(each).cast("long"))
    rows = rows.withColumn("start", F.sum(F.when(small, F.col("n")).otherwise(0)).over(each) - F.when(small, F.col("n")).otherwise(0))
    rows = rows.withColumn("set", F.when(small, F.floor(F.col("start") / half)).otherwise(-F.col("row")))
    together = Window.partitionBy("bucket", "set")
    new = F.shiftleft(F.col("bucket").cast("long"), 32) + F.min("row").over(together)
    rows = rows.withColumn("base", F.shiftleft(new, CHUNK_BITS) + F.col("start") - F.min("start").over(together))
    return rows.select("segment", "chunk", "bits", "before", "base", (F.count("*").over(together) == 1).alias("alone"))


def _new_number(doc: Column) -> Column:
    """The number of a live document, from its chunk's row of the numbering."""
    inside = doc.bitwiseAND(F.lit(CHUNK - 1).cast("long")).cast("int")
    at, bit = F.shiftright(inside, 6), inside.bitwiseAND(63)
    below = F.get("bits", at).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit)))
    return F.col("base") + F.get("before", at) + F.bit_count(below)


def renumbered(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (segment, doc, ...) of live documents with their new numbers."""
    own = rows.withColumn("chunk", chunk_of(F.col("doc"))).join(numbers, ["segment", "chunk"]).where(is_dead(F.col("doc"), F.col("bits")))
    return own.withColumn("doc", _new_number(F.col("doc"))).select(*(c for c in rows.columns if c != "segment"))


#: Arrays of a block that have an entry for each document.
_ARRAYS = ("docs", "tfs", "lengths", "positions")


def rechunked(rows: DataFrame, numbers: DataFrame, parts: int) -> DataFrame:
    """Blocks of live documents with their new numbers, range-partitioned and sorted. Blocks are neither unpacked nor put together but where small chunks are."""
    own = rows.select("segment", "chunk", "term", "meta", *_ARRAYS, "paths", "path_at").join(numbers, ["segment", "chunk"])
    # the bit of a live document is set
    own = own.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("docs") - 1), lambda i: is_dead(F.get("docs", i), F.col("bits")))).where(F.size("at") > 0)
    whole = F.size("at") == F.size("docs")
    # a function of one argument: with two the second would be an index
    picked = lambda x: F.when(whole, F.col(x)).otherwise(F.transform("at", lambda i: F.get(x, i)))
    some = F.when(F.col("path_at").isNotNull(), picked("path_at"))
    docs = F.transform("at", lambda i: _new_number(F.get("docs", i)))
    own = own.select("term", "meta", chunk_of(F.col("base")).alias("chunk"), docs.alias("docs"), *(picked(x).alias(x) for x in _ARRAYS[1:]), "paths", some.alias("path_at"), "alone")
    block = F.struct(*_ARRAYS, "paths", "path_at")
    d = own.where(~F.col("alone")).groupBy("term", "meta", "chunk").agg(F.sort_array(F.collect_list(block)).alias("d"))
    d = d.withColumn("all", F.array_sort(F.array_distinct(F.flatten("d.paths"))))
    # a place's number among all paths, from that among its block's
    number = lambda x, i, t: F.transform(F.coalesce(F.get(x["path_at"], i), F.array_repeat(F.lit(0), t)), lambda k: (F.array_position("all", F.get(x["paths"], k)) - 1).cast("int"))
    path_at = F.when(F.size("all") > 1, F.flatten(F.transform("d", lambda x: F.transform(x["tfs"], lambda t, i: number(x, i, t)))))
    d = d.select("term", "meta", "chunk", *(F.flatten(f"d.{x}").alias(x) for x in _ARRAYS), F.col("all").alias("paths"), path_at.alias("path_at"))
    out = own.where("alone").drop("alone").unionByName(d)
    figures = F.size("docs").alias("n"), F.aggregate("tfs", F.lit(0).cast("long"), lambda n, t: n + t).alias("cf"), F.array_max("tfs").alias("max_tf"), F.array_min("lengths").alias("min_words")
    out = out.select("term", "meta", "chunk", *figures, *_ARRAYS, "paths", "path_at")
    return out.repartitionByRange(parts, "term", "meta", "chunk").sortWithinPartitions("term", "meta", "chunk")


# ---- dictionary

def dictionary(rows: DataFrame, both: list[str]) -> DataFrame:
    """(meta, term, df, cf, max_tf) of blocks; `both` are the fields of unfielded terms."""
    sums = {"df": F.sum("n"), "cf": F.sum("cf"), "max_tf": F.max("max_tf")}
    if "shared" in rows.columns:
        # a block counts for its own field and, if that is one of both, for the empty one; blocks are read and shuffled once
        of = F.when(F.col("meta").isin(both), F.array(F.struct(F.col("meta"), F.col("n")), F.struct(F.lit(BOTH).alias("meta"), (F.col("n") - F.col("shared")).alias("n"))))
        each = rows.select("term", "cf", "max_tf", F.col("meta").alias("field"), F.inline(of.otherwise(F.array(F.struct(F.col("meta"), F.col("n"))))))
        most = [F.max(F.when(F.col("field") == m, F.col("max_tf"))) for m in both]
        either = F.when(F.col("meta") == BOTH, reduce(Column.__add__, (F.coalesce(m, F.lit(0)).cast("long") for m in most), F.lit(0).cast("long")))
        return each.groupBy("meta", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.coalesce(either, F.max("max_tf")).alias("max_tf"))
    own = rows.groupBy("meta", "term").agg(*(c.alias(n) for n, c in sums.items()))
    either = rows.where(F.col("meta").isin(both)).groupBy("term", "chunk")
    either = either.agg(F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("n"), F.sum("cf").alias("cf"), F.sum("max_tf").alias("max_tf"))
    either = either.groupBy("term").agg(*(c.alias(n) for n, c in sums.items()))
    return own.unionByName(either.withColumn("meta", F.lit(BOTH)))


def corrections(rows: DataFrame, dead: DataFrame, both: list[str]) -> DataFrame:
    """(of, meta, term, df, cf): what dead documents take from the dictionary of their segments. Only chunks that have some are unpacked."""
    gone = rows.join(dead, ["segment", "chunk"]).select("segment", "term", "meta", "bits", F.explode(F.arrays_zip("docs", "tfs")).alias("x"))
    gone = gone.select("segment", "term", "meta", F.col("x.docs").alias("doc"), F.col("x.tfs").alias("tf"), "bits").where(is_dead(F.col("doc"), F.col("bits")))
    own = gone.groupBy(F.col("segment").alias("of"), "meta", "term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).cast("long").alias("cf"))
    either = gone.where(F.col("meta").isin(both)).groupBy("segment", "term", "doc").agg(F.sum("tf").alias("tf"))
    either = either.groupBy(F.col("segment").alias("of"), "term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).cast("long").alias("cf"))
    return own.unionByName(either.withColumn("meta", F.lit(BOTH)))


# ---- dead documents

def is_dead(doc: Column, bits: Column) -> Column:
    """Whether a document's bit is set; bits are null where a chunk has no dead documents."""
    inside = doc.bitwiseAND(F.lit(CHUNK - 1).cast("long")).cast("int")
    return F.coalesce(F.getbit(F.get(bits, F.shiftright(inside, 6)), inside.bitwiseAND(63)) == 1, F.lit(False))


def bitmaps(dead: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(segment, chunk, bits) of dead documents (segment, doc) and of those that were dead before."""
    inside = F.col("doc").bitwiseAND(F.lit(CHUNK - 1).cast("long")).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), inside.bitwiseAND(63))
    words = dead.select("segment", chunk_of(F.col("doc")).alias("chunk"), F.shiftright(inside, 6).alias("at"), one.alias("word"))
    if before is not None:
        words = words.unionByName(before.select("segment", "chunk", F.posexplode("bits").alias("at", "word")))
    words = words.groupBy("segment", "chunk", "at").agg(F.bit_or("word").alias("word"))
    by_place = words.groupBy("segment", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))
    return by_place.select("segment", "chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """Rows (segment, doc, ...) of documents that are not dead: a join by chunk, no aggregation."""
    if dead is None:
        return rows
    marked = rows.withColumn("_chunk", chunk_of(F.col("doc")))
    by = dead.select(F.col("segment").alias("_segment"), F.col("chunk").alias("_of"), F.col("bits").alias("_bits"))
    marked = marked.join(by, (F.col("segment") == F.col("_segment")) & (F.col("_chunk") == F.col("_of")), "left")
    return marked.where(~is_dead(F.col("doc"), F.col("_bits"))).select(*rows.columns)

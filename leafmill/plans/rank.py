"""Relevance: BM25 (Robertson et al.) over the counts of a query's leaves, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import by_shuffle
from .query import Node, Phrase, Tables, Term, Wild, leaves, parse, truth, with_limits

K1, B = 1.2, 0.75


def ranked(tables: Tables, query: str | Node | None, limits: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(uri, score) of the documents that match.

    A leaf's documents are counted among all documents, not only the matches.
    `docs` must have nwords. The corpus figures are one row, joined to all.
    """
    tree = parse(query, tables.config) if isinstance(query, str) else query
    tree = with_limits(tree, limits or [])
    found = leaves(tree)
    bit = {x: i for i, x in enumerate(found)}
    counted = [x for x in found if isinstance(x, (Term, Wild, Phrase))]
    hits = tables.hits(tree)
    if not counted:
        return tables.with_uri(hits).select("uri", F.lit(0.0).alias("score"))
    # a leaf's documents are counted among all, whatever the query leaves out
    df = tables.document_counts({x: bit[x] for x in counted})
    lengths = tables.docs.select(*dict.fromkeys((*tables.keys, "uri", "nwords")))
    rows = hits.join(by_shuffle(lengths, getattr(tables, "n_docs", 0)), list(tables.keys)).crossJoin(F.broadcast(df)).crossJoin(F.broadcast(tables.corpus()))
    score = F.lit(0.0)
    for x in counted:
        score = score + _part(F.col(f"tf{bit[x]}"), F.col(f"df{bit[x]}"), F.col("n_docs"), F.col("nwords") / F.col("avg_words"), k1, b)
    return rows.select("uri", score.alias("score"))


def _part(tf: Column, df: Column, n_docs: Column, length: Column, k1: float, b: float) -> Column:
    """A term's share of a score; it grows with tf and shrinks with the length."""
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))


#: Chunks that are scored first, those that could have the best documents.
FIRST_CHUNKS = 8


def top(tables: Tables, query: str, size: int, limits: list[str] | None = None, begin: int = 0, k1: float = K1, b: float = B, first: int = FIRST_CHUNKS) -> DataFrame:
    """(uri, score): a page of the best documents, ties by uri, as sorted_hits(ranked()) gives it.

    A stored index need not score all matches: the greatest count and least
    length of a block bound what its documents can score. The chunks with the
    greatest bounds are scored first; of the others those whose bound is below
    the last score of the page cannot enter it, and their blocks are not
    unpacked. Queries with other leaves than terms, or that match documents
    without any of their terms, are scored whole.
    """
    chunks = promising(tables, query, size + begin, limits, k1, b, first)
    if chunks is not None:
        tables = tables.within(chunks)
    return ranked(tables, query, limits, k1, b).orderBy(F.col("score").desc(), F.col("uri").asc()).offset(begin).limit(size)


def promising(tables: Tables, query: str, size: int, limits: list[str] | None = None, k1: float = K1, b: float = B, first: int = FIRST_CHUNKS) -> DataFrame | None:
    """(segment, chunk) of the chunks that can hold one of the best documents; none where all must be scored."""
    tree = with_limits(parse(query, tables.config), limits or [])
    found = leaves(tree)
    stored = hasattr(tables, "bounds")
    if not stored or not found or not all(isinstance(x, Term) for x in found) or truth(tree, lambda _: False, False, lambda v: not v):
        return None
    counted = {x: i for i, x in enumerate(found)}
    figures = tables.document_counts(counted).crossJoin(tables.corpus()).first()
    bounds = tables.bounds(counted)
    # what is denied may be there or not; the rest of the query must be possible
    possible = truth(tree, lambda x: F.col(f"tf{counted[x]}") > 0, F.lit(False), lambda _: F.lit(True))
    most = F.lit(0.0)
    for x, i in counted.items():
        part = _part(F.col(f"tf{i}"), F.lit(figures[f"df{i}"]), F.lit(figures["n_docs"]), F.coalesce(F.col(f"words{i}"), F.lit(0)) / F.lit(figures["avg_words"] or 1.0), k1, b)
        most = most + F.when(F.col(f"tf{i}") > 0, part).otherwise(0.0)
    bounds = bounds.where(possible).select("segment", "chunk", most.alias("most"))
    best = bounds.orderBy(F.col("most").desc()).limit(first)
    scores = ranked(tables.within(best.select("segment", "chunk")), query, limits, k1, b).select("score").orderBy(F.col("score").desc()).limit(size).collect()
    if len(scores) < size:
        return bounds.select("segment", "chunk")
    # sums may differ in their last digits
    return bounds.where(F.col("most") >= scores[-1]["score"] * (1 - 1e-9)).select("segment", "chunk")


def with_percent(rows: DataFrame) -> DataFrame:
    """Add rank: the share of the best score in percent, times ten."""
    best = rows.agg(F.max("score").alias("best"))
    share = F.floor(F.when(F.col("best") > 0, 100 * F.col("score") / F.col("best")).otherwise(100))
    return rows.crossJoin(F.broadcast(best)).withColumn("rank", (share * 10).cast("long")).drop("best")

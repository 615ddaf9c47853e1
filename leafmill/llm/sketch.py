"""Document fingerprints: bottom-k sketches of shingle hashes, JVM-side only.

A document's sketch is its k least distinct 64-bit hashes of five-word
shingles. Sketches of parts merge by keeping the k least of their union, and
two sketches estimate resemblance, containment and distinct shingle counts.
Everything here is a column expression; the next document in id order comes
from a range partitioning of the table, never from one global window.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

K = 128
WORDS = 5
#: Ranges of ids for each partition of a shuffle, so that partitions come out even.
BUCKETS = 4
#: Equal rows that are written at one step.
REPEATS = 10_000
SPACE = "[\\x20\\x09-\\x0D]+"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of a text; fewer words than that give one of the whole sequence, none give none."""
    w = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")
    h = F.transform(w, lambda x: F.xxhash64(x))
    n = F.size(h)

    def all_shingles(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))

    # one element, so that the word hashes are made once and not for each use
    return F.flatten(F.transform(F.array(h), lambda h: F.when(F.size(h) >= words, all_shingles(h)).when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))
                                 .otherwise(F.array().cast("array<bigint>"))))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k least distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles, 0 to 1; two texts without shingles are alike."""
    both = F.array_intersect(a, b)
    least = merge(a, b, k)
    return F.when(F.size(least) == 0, 1.0).otherwise(F.size(F.array_intersect(least, both)) / F.size(least))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has as well, 0 to 1."""
    union, n = distinct_count(merge(a, b, k), k), distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / n))


def encoded(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, 8 big-endian bytes each."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\r\n", "")


def decoded(text: Column) -> Column:
    """The sketch of its text form."""
    digits = F.hex(F.unbase64(text))
    half = lambda i, at: F.conv(F.substr(digits, i * 16 + at, F.lit(8)), 16, 10).cast("bigint")
    n = (F.length(digits) / 16).cast("int")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(half(i, 1), 32).bitwiseOR(half(i, 9))))


def group_sketch(df: DataFrame, by: list[str], text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """One sketch for each group of documents: the k least hashes of all members.

    Shingles are made distinct before they are ranked, and ranked by parts
    first, so a group with most of the rows does not meet in one task.
    """
    h = df.select(*by, F.explode(sketch(F.col(text_col), k, words)).alias("h")).distinct()
    part = Window.partitionBy(*by, "p").orderBy("h")
    h = h.withColumn("p", F.pmod(F.hash("h"), F.lit(64))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    return h.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias("sketch"))


def _not_above(bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda x: x <= F.col("doc_id")))


def in_order_with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, h, n, bucket, own): each bucket holds a range of ids and, as
    a row that is not its own, the first document of the next one.

    So the document that follows in the order of (doc_id, h, text) is always in
    the same bucket. After the last document comes the first. `h` is 0 but for
    ids, null among them, that fill more than a bucket: those are split by the hash
    of their texts, and their equal rows are one row with its number `n`.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = BUCKETS * parts(df.sparkSession)
    at = F.percentile_approx("doc_id", [i / n for i in range(1, n)] if n > 1 else [0.5], max(10_000, 10 * n))
    first = rows.agg(at.alias("at"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("all")).first()
    points = Counter(x for x in first["at"] or [] if x is not None)
    # an id that is several quantiles is in more rows than a bucket should have
    hot = {x: c + 1 for x, c in points.items() if c > 1}
    if first["nulls"] > 2 * first["all"] / n:
        hot[None] = -(-first["nulls"] * n // first["all"])
    low = None if first["nulls"] else first["low"]
    pieces: dict[int | None, list[int]] = {}
    rows = rows.withColumns({"h": F.lit(0).cast("bigint"), "n": F.lit(1).cast("bigint")})
    if hot:
        is_hot = F.when(F.col("doc_id").isNull(), F.lit(None in hot)).otherwise(F.col("doc_id").isin([x for x in hot if x is not None]))
        same = rows.where(is_hot).groupBy("doc_id", "text").agg(F.count("*").alias("n")).select("doc_id", "text", F.xxhash64("text").alias("h"), "n")
        share = F.element_at(_of_id({x: [k] for x, k in hot.items()}), 1)
        piece = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * share)
        for r in same.groupBy("doc_id", piece.alias("piece")).agg(F.min("h").alias("h")).collect():
            pieces.setdefault(r["doc_id"], []).append(r["h"])
        rows = rows.where(~is_hot).unionByName(same)
    # the least row of all begins no range
    begins = {x: sorted(hs) for x, hs in pieces.items()}
    lowest = begins[low].pop(0) if low in begins else 0
    bounds = sorted([x for x in points if x not in hot and x != low] + [x for x, hs in begins.items() if x is not None for _ in hs])
    before = len(begins.get(None, []))
    bucket = F.lit(0)
    if bounds:
        # two short searches instead of one over all bounds
        step = math.isqrt(len(bounds)) + 1
        coarse = _not_above(F.array(*(F.lit(x) for x in bounds[step - 1 :: step])).cast("array<bigint>"))
        fine = _not_above(F.slice(F.array(*(F.lit(x) for x in bounds)).cast("array<bigint>"), coarse * step + 1, step))
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(coarse * step + fine)
    starts = F.col("doc_id").isin([x for x in bounds if x not in hot])
    if hot:
        own = _of_id(begins)
        later = F.size(F.filter(own, lambda x: x > F.col("h")))
        bucket = F.when(is_hot, bucket + before - F.coalesce(later, F.lit(0))).when(F.col("doc_id").isNull(), 0).otherwise(bucket + before)
        starts = F.when(is_hot, F.coalesce(F.array_contains(own, F.col("h")), F.lit(False))).otherwise(starts)
    follows = F.when(starts, bucket - 1)
    is_low = F.col("doc_id").eqNullSafe(F.lit(low)) & (F.col("h") == lowest)
    follows = F.when(is_low, len(bounds) + before).otherwise(follows)
    places = F.array(F.struct(bucket.cast("int").alias("bucket"), F.lit(True).alias("own")), F.struct(follows.cast("int").alias("bucket"), F.lit(False).alias("own")))
    return rows.select("*", F.inline(F.filter(places, lambda p: p["bucket"].isNotNull())))


def _of_id(lists: dict[int | None, list[int]]) -> Column:
    """The list of a row's id; null for other ids."""
    out = F.lit(None).cast("array<bigint>")
    for x, values in lists.items():
        out = F.when(F.col("doc_id").eqNullSafe(F.lit(x)), F.array(*(F.lit(v) for v in values)).cast("array<bigint>")).otherwise(out)
    return out


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has the last half of the code points replaced by the first
    as many of the next document. A null text is empty; equal ids are ordered
    by text, those of an id in very many rows by a hash of the text first; a
    single document follows itself; an empty table gives no rows.
    """
    rows = in_order_with_next(df, id_col, text_col)
    # rows that are not its own close a bucket; the first of them by text is the one that follows
    order = Window.partitionBy("bucket").orderBy(F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "h", "text")
    # texts are dealt out first, so that their sketches need not be
    rows = rows.repartition(parts(df.sparkSession), "bucket").withColumn("sk", sketch(F.col("text"), k))
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_sk": F.lead("sk").over(order)}).where("own")
    # of equal rows the last is followed by another text, the others by their own
    last = F.struct(F.lit(1).cast("bigint").alias("times"), "next_text", "next_sk")
    others = F.struct((F.col("n") - 1).alias("times"), F.col("text").alias("next_text"), F.col("sk").alias("next_sk"))
    rows = rows.select("doc_id", "text", "sk", F.inline(F.when(F.col("n") > 1, F.array(last, others)).otherwise(F.array(last))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "times", n.cast("long").alias("n_chars"), "sk", "next_sk", edited.alias("edited")).withColumn("esk", sketch(F.col("edited"), k))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encoded(F.col("sk")).alias("fingerprint"), encoded(F.col("esk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("esk"), k).alias("near_edited"), resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
        containment(F.col("sk"), F.col("esk"), k).alias("contained_edited"), distinct_count(F.col("sk"), k).alias("shingles"), "times",
    )
    # many equal rows come apart by steps, so that no array has them all
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1, F.lit(REPEATS).cast("bigint"))
    rows = rows.select("*", F.explode(steps).alias("done"))
    return rows.select("*", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(REPEATS), F.col("times") - F.col("done")).cast("int"))).alias("_")).drop("times", "done", "_")

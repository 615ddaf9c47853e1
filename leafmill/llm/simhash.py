"""SimHash near-duplicates by a byte-position index with count filtering.

Fingerprints of 64 bits that differ in at most 3 bits share at least 5 of
their 8 bytes at the same positions. The index posts every distinct
fingerprint under byte positions and values; a posting of one position alone
would hold one fingerprint in 256, so positions are posted three at a time:
of 5 shared positions, 3 lie in the same half of the fingerprint, and the 8
triples within the halves therefore meet every pair that reaches the count.
Within a posting the shared bytes of a pair are tallied, pairs with fewer than
5 are dropped and the rest verified by their differing bits. A posting yields
a star for each linked group in it instead of all its pairs, which keeps all
links of the components and as many rows as members.

A posting is a mask and the fingerprint's bits under it. One with more than
POSTING members is posted anew under the masks that its linked pairs can also
share: two more bytes (the count asks for them), then one in four of the bits
that are left (three differing bits miss one of four parts), twice. What is
left then differs in 14 bits at most, so no posting has more members than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, parts, staged
from .common import named as column
from .components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
MIN_BYTES = 5
#: Members of a posting that a task compares; a larger one is posted under longer masks.
POSTING = 1 << 12


def _bytes_mask(positions) -> int:
    return sum(255 << 8 * p for p in positions)


#: Masks of the index: byte positions posted together.
MASKS = [_bytes_mask(c) for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def longer_masks(mask: int) -> list[int]:
    """Masks of which a linked pair that agrees under this one agrees under one at least; none for the last."""
    left = [b for b in range(64) if not mask >> b & 1]
    if len(left) == 40:
        return [mask | _bytes_mask(c) for c in combinations([p for p in range(8) if not mask >> 8 * p & 255], MIN_BYTES - 3)]
    if len(left) < 18:
        return []
    return [mask | sum(1 << b for b in left[i * len(left) // (MAX_BITS + 1) : (i + 1) * len(left) // (MAX_BITS + 1)]) for i in range(MAX_BITS + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a whole text as an unsigned integer; 0 without a word."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [digest(b" ".join(w), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.array(hashes[at : at + (1 << 14)], "<u8")
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp): a digest of the text and the fingerprint's 64 bits as a signed long. A null text counts as empty."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "digest", "fp"])

    return map_batches(rows, run, "doc_id long, digest long, fp long")


def linked(x: np.ndarray, y) -> np.ndarray:
    """Which pairs reach the count of shared bytes and then differ in few enough bits."""
    differ = np.ascontiguousarray(x ^ y)
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    found = tally >= MIN_BYTES
    found[found] = np.bitwise_count(differ[found]) <= MAX_BITS
    return found


def _within(values: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(members, root) of each linked group of a posting with more than one member."""
    rest = np.arange(len(values))
    while len(rest) > 1:
        root, rest, group, queue = rest[0], rest[1:], [], [rest[0]]
        while queue and len(rest):
            near = linked(values[rest], values[queue.pop()])
            found, rest = rest[near], rest[~near]
            queue += found.tolist()
            group += found.tolist()
        if group:
            yield np.array(group), root


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the postings in rows sorted by mask and value."""
    held: list[tuple[np.ndarray, ...]] = []

    def stars(mask, value, fp) -> pa.RecordBatch | None:
        if len(fp) < 2:
            return None
        bits = fp.view(np.uint64)
        start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        size = np.diff(np.r_[start, len(fp)])
        a, b = [], []
        two = start[size == 2]
        if len(two):
            near = linked(bits[two], bits[two + 1])
            a.append(fp[two[near]])
            b.append(fp[two[near] + 1])
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for group, root in _within(bits[s : s + n]):
                a.append(fp[s + group])
                b.append(np.full(len(group), fp[s + root]))
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def joined():
        return tuple(np.concatenate(c) for c in zip(*held, strict=True))

    for batch in batches:
        rows = tuple(batch.column(i).to_numpy() for i in range(3))
        if not len(rows[0]):
            continue
        held.append(rows)
        mask, value, fp = joined()
        last = int(np.flatnonzero((mask == mask[-1]) & (value == value[-1]))[0])
        if not last:
            continue  # still the same posting
        held = [(mask[last:], value[last:], fp[last:])]
        if (out := stars(mask[:last], value[:last], fp[:last])) is not None:
            yield out
    if held and (out := stars(*joined())) is not None:
        yield out


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) between distinct fingerprints; enough of them to connect every linked group."""
    spark, masks, found = distinct.sparkSession, MASKS, []
    table = F.explode(F.array(*(F.lit(_signed(m)) for m in masks)))
    posted = distinct.select(table.alias("mask"), F.col(fp).alias("fp")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    while True:
        more = sorted({(m, x) for m in masks for x in longer_masks(m)})
        small, large = posted, None
        if more:
            large = staged(posted.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > POSTING).drop("n"), "simhash-large")
            if large.isEmpty():
                large = None
            else:
                small = posted.join(large, ["mask", "value"], "left_anti")
        dealt = small.repartition(parts(spark), "mask", "value").sortWithinPartitions("mask", "value", "fp")
        found.append(map_batches(dealt, _links, "a long, b long"))
        if large is None:
            break
        # a table of the masks, a few hundred rows whatever the documents are
        wider = F.broadcast(spark.createDataFrame([(_signed(m), _signed(x)) for m, x in more], "mask long, wider long"))
        posted = posted.join(large, ["mask", "value"]).join(wider, "mask").select(F.col("wider").alias("mask"), F.col("wider").bitwiseAND(F.col("fp")).alias("value"), "fp").distinct()
        posted, masks = staged(posted, "simhash-postings"), sorted({x for _, x in more})
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, fp) of each row, and (fp, component, component_id); a component is named by its least fingerprint."""
    fps = staged(fingerprints(df, id_col, text_col), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    named = nodes.join(components(links(nodes)), nodes["fp"] == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = staged(named, "simhash-components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps, named.drop("least").join(least, "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    The component is the least doc_id reachable over links, the row itself
    included. Links are between fingerprints, so rows without an id link others
    too; a component in which no row has an id has a null component_id. Texts
    without a word have fingerprint zero and are linked like any other. Repeated
    rows give a row each, repeated ids with different texts belong to the
    components of their texts. An empty table gives no rows.
    """
    fps, named = _grouped(df, id_col, text_col)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component; all columns stay, whatever their names.

    The row with the least id stays, of several with that id the one whose text
    has the least digest, and one of rows alike in both. Rows without an id come
    last: one stays where no row of the component has an id.
    """
    fps, named = _grouped(docs, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest", "n")
    alike = fps.join(named, "fp").groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    stay = staged(alike.groupBy("component").agg(F.min(rank).alias("k")).select("k.none", "k.id", "k.digest", "k.n"), "simhash-stay")
    # all columns in one, so that no name meets another
    packed = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("digest"))
    packed = packed.select("row", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    # the rows that stay grow with the documents: never broadcast, whatever their size is now
    kept = packed.join(stay.hint("merge"), ["none", "id", "digest"])
    once = kept.where("n = 1")
    if not stay.where("n > 1").isEmpty():
        once = once.unionByName(kept.where("n > 1").dropDuplicates(["none", "id", "digest"]))
    return once.select("row.*")

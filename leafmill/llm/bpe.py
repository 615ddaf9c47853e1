"""Byte-level BPE by a file of ranks: overlapping chunk encoding, and decoding to raw bytes.

Texts of more than CHUNK code points are cut into chunks that reach OVERLAP code
points into the next one. Chunks are dealt out and split into pre-tokens in
parallel, each from its own start. In the overlap of two chunks both have
boundaries; from the first that they have in common on they agree, as a
pre-token depends on nothing before it. There the chunks are stitched, and each
chunk's own pre-tokens between its two stitches are encoded.
Boundaries within GUARD code points of a cut end do not count, as the cut may
have moved them. A document with chunks that have no boundary in common (a run
without a boundary that is longer than the overlap) is split and encoded whole.
A text of one chunk needs no stitch.

Pre-tokens are found by the pattern of the rank file and encoded once for each
worker that meets them. Chunks are gathered by document, which is a row of the
result anyhow, to be stitched. A null text counts as an empty one and has no ids;
repeated rows, null ids and empty tables need nothing special. All columns of
the documents are carried along; a column with the name of the result is
replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, small_batches, staged

#: Code points of a chunk, and of the next chunk that it reaches over.
CHUNK, OVERLAP = 16384, 512
#: Code points before a cut in which boundaries are not sure: the longest piece that looks ahead has three.
GUARD = 4
#: Pre-tokens kept by a worker; the store is emptied when it is full, so memory is bounded.
CACHE_PIECES = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Ranks:
    """Pre-tokens, ids and bytes of one rank file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.table[i] = piece
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.disputed = _disputed(public_tokenizers.PATTERN)
        own = "".join(sorted(self.disputed))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # the same pattern where a text has characters that only one of the two libraries takes for letters or numbers
        exact = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{own}])+") if own else ""
        for kind in ("L", "N"):
            exact = exact.replace(rf" ?\p{{{kind}}}+", rf" ?[\p{{{kind}}}--[{own}]]+")
        self.exact = regex.compile("(?V1)" + exact).findall if own else self.split
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens from the start of a text on."""
        plain = text.isascii() or self.disputed.isdisjoint(text)
        return self.split(text) if plain else self.exact(text)

    def ids(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens as 32-bit integers."""
        try:
            return b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            for p in pieces:
                if p not in self.cache:
                    self.cache[p] = np.array(self.encoding.encode_ordinary(p), np.int32).tobytes()
            return b"".join(map(self.cache.__getitem__, pieces))

    def bytes_of(self, ids: list[int | None]) -> bytes:
        table, n = self.table, len(self.table)
        try:
            if min(ids, default=0) >= 0:
                return b"".join(map(table.__getitem__, ids))
        except (TypeError, IndexError):
            pass
        return b"".join(table[i] for i in ids if i is not None and 0 <= i < n)


def _disputed(pattern: str) -> frozenset[str]:
    """Characters that `regex` takes for letters or numbers and the library does not, as its Unicode tables are older.

    Only characters that Python's own, older tables do not know can be so. Each
    is put behind a letter and a number: where it is of that class the two are
    one pre-token, which shows in the ids of a small vocabulary that merges a
    letter or number with the byte behind it.
    """
    import unicodedata

    import regex
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for first in b"a1":
        for b in range(128, 256):
            ranks[bytes([first, b])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    new = (c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    return frozenset(c for c in new if all(len(probe(first + c)) > len(c.encode()) for first in "a1"))


@lru_cache(4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _lists(values: list[bytes]) -> pa.Array:
    """Runs of 32-bit integers as an Arrow array of lists."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) // 4 for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), np.int32)))


def stitches(texts: list[str], ends: list[np.ndarray], chunk: int, overlap: int) -> list[int] | None:
    """How far behind the start of each next chunk a document's chunks are stitched; none if two have no boundary in common."""
    out = []
    for i in range(len(texts) - 1):
        sure = chunk + overlap - (GUARD if len(texts[i]) == chunk + overlap else 0)
        left = ends[i][(ends[i] >= chunk) & (ends[i] <= sure)] - chunk
        common = np.intersect1d(left, np.concatenate(([0], ends[i + 1][ends[i + 1] <= overlap])))
        if not len(common):
            return None
        out.append(int(common[0]))
    return out


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All rows and columns of docs, and the ids of their texts as an array column.

    Long texts are staged in the shared folder as chunks.
    """
    if not GUARD < overlap <= chunk:
        raise ValueError(f"the overlap must be over {GUARD} and at most the length of a chunk")
    path = path or default_path()
    small_batches(docs.sparkSession)
    docs = docs.drop(ids) if ids != text else docs
    kept = [c for c in docs.columns if c != ids]

    @F.arrow_udf("array<int>")
    def whole(texts: pa.Array) -> pa.Array:
        r = ranks(path)
        return _lists([r.ids(r.pieces(t)) if t else b"" for t in texts.to_pylist()])

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([[t[i : i + chunk + overlap] for i in range(0, len(t), chunk)] for t in texts.to_pylist()], pa.list_(pa.string()))

    lengths = "<u2" if chunk + overlap < 1 << 16 else "<u4"

    @F.arrow_udf("binary")
    def split(texts: pa.Array) -> pa.Array:
        r = ranks(path)
        return pa.array([np.fromiter(map(len, r.pieces(t)), lengths).tobytes() for t in texts.to_pylist()], pa.binary())

    @F.arrow_udf("array<int>")
    def stitch(documents: pa.Array) -> pa.Array:
        r, out = ranks(path), []
        for parts in documents.to_pylist():
            texts = [p["text"] for p in parts]
            ends = [np.cumsum(np.frombuffer(p["lengths"], lengths), dtype=np.int64) for p in parts]
            at = stitches(texts, ends, chunk, overlap)
            if at is None:
                out.append(r.ids(r.pieces("".join(t[:chunk] for t in texts))))
                continue
            coded = []
            for t, e, start, stop in zip(texts, ends, [0, *at], [*(chunk + x for x in at), len(texts[-1])], strict=True):
                inner = [start, *e[(e > start) & (e <= stop)].tolist()]
                coded.append(r.ids([t[i:j] for i, j in zip(inner, inner[1:])]))
            out.append(b"".join(coded))
        return _lists(out)

    # plans repeat a deterministic function for each use of its result
    whole, stitch = whole.asNondeterministic(), stitch.asNondeterministic()
    long = F.char_length(named(text)) > chunk
    others = F.struct(F.lit(True).alias("here"), *(named(c) for c in kept if c != text))
    # a staged table, as rows must keep their numbers when a task runs again
    rows = docs.where(long).select(F.monotonically_increasing_id().alias("row"), others.alias("doc"), cut(named(text)).alias("cut"))
    rows = rows.select("row", "doc", F.posexplode("cut").alias("chunk", "text")).withColumn("doc", F.when(F.col("chunk") == 0, F.col("doc")))
    chunks = staged(rows.repartition("row", "chunk").withColumn("lengths", split("text")), "chunks")
    whole_docs = chunks.groupBy("row").agg(F.first("doc", True).alias("doc"), F.sort_array(F.collect_list(F.struct("chunk", "text", "lengths"))).alias("parts"))
    again = F.array_join(F.transform("parts", lambda x: F.left(x["text"], F.lit(chunk))), "")
    columns = {c: (again if c == text else F.col("doc").getField(c)).alias(c) for c in kept}
    stitched = whole_docs.select(*columns.values(), stitch("parts").alias(ids))
    short = docs.where(~F.coalesce(long, F.lit(False))).select(*(named(c) for c in kept))
    return short.withColumn(ids, whole(named(text))).unionAll(stitched)


def decode(rows: DataFrame, ids: str = "ids", data: str = "data", path: str | None = None) -> DataFrame:
    """All rows and columns, and the raw bytes of an array of ids.

    Null ids and ids that the vocabulary does not have give no bytes; a null array gives null.
    """
    path = path or default_path()
    small_batches(rows.sparkSession)

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        r = ranks(path)
        return pa.array([None if x is None else r.bytes_of(x) for x in lists.to_pylist()], pa.binary())

    return rows.withColumn(data, raw(named(ids)))

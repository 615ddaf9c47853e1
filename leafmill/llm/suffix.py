"""Removal of long repeated substrings by threshold-bounded interval expansion.

A byte goes if a string of `length` bytes that covers it starts at any other
place too. Equal strings of that length have the same anchor: the k-gram with
the least hash among those inside them, the leftmost of equal ones. So only
places that share an anchor's k-gram need comparing. The surroundings of an
anchor - all strings of the length that have it as theirs - are dealt out by
k-gram, and a task takes whole k-grams, a block of them at a time. Bytes at
their ends that no other place of the k-gram continues with are cut off.

The surroundings of a block are one text, each closed by an end mark. Its
Burrows-Wheeler transform has a wavelet matrix that gives the rank of each
byte. Breadth-first backward extension starts with the interval of all
suffixes; each round prepends every byte that stands before an interval, so
that the intervals of round v + 1 are those of strings of v + 1 bytes. Where
an interval's end has no common prefix yet, it is v, and the interval goes on.
Common prefixes are thus found by increasing value, and rounds stop at
`length`: neighbours without one share at least that many bytes. Suffixes are
sorted no deeper than that.

An interval with more than GROUP surroundings is no task's work: it is shuffled
again by what it can be extended to: so many of the missing bytes behind it and
so many before it, in WAYS ways of which each string that it may hold meets one,
until it has fewer places or is `length` bytes long.

Surroundings that are equal by 96 bits of BLAKE2b are extended once; they are
repeated wherever they stand. Equal texts are extended once too.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, open_shared, parts, staged

LENGTH = 200
#: Bytes hashed at a time; windows reach over the cuts.
CHUNK = 1 << 23
#: Surroundings in one transform, as whole intervals: about a megabyte of text.
BLOCK = 1 << 12
#: Surroundings of one interval that a task takes, as many as a transform; an interval of more is extended by a shuffle first.
GROUP = BLOCK
#: Extensions of an interval that is too large.
WAYS = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_AT_BITS = 24


def gram_bytes(length: int) -> int:
    """Bytes of an anchor's k-gram: the greatest power of two up to a quarter of the length."""
    return 1 << (max(1, length // 4).bit_length() - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _byte_codes() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_CODES = _byte_codes()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling; k is a power of two."""
    h, base = _CODES[data], int(_BASE)
    n = 1
    while n < k:
        h = h[:-n] * np.uint64(base) + h[n:]
        base = base * base & (1 << 64) - 1
        n *= 2
    return _mix(h)


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of the length, ascending, and where the first string of each starts."""
    k = gram_bytes(length)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    window = length - k + 1
    places, found, starts = [], [], []
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at : at + CHUNK + length - 1]
        h = gram_hashes(part, k)
        key = h >> np.uint64(_AT_BITS) << np.uint64(_AT_BITS) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= window:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if n < window:
            key = np.minimum(key[: n - window], key[window - n :])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        here = (key[first] & np.uint64((1 << _AT_BITS) - 1)).astype(np.int64)
        places.append(here + at)
        found.append(h[here])
        starts.append(first + at)
    places, found, starts = map(np.concatenate, (places, found, starts))
    places, one = np.unique(places, return_index=True)
    return places, found[one], starts[one]


def _digest(data: bytes, left: int, right: int) -> bytes:
    """96 bits of a string and of the bytes that it reaches to both sides."""
    return hashlib.blake2b(data, digest_size=12, salt=struct.pack("<QQ", left, right)).digest()


def surroundings(data: bytes, places: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """How far the strings of each anchor reach before it and from it on, and a digest of these bytes as a long and an int."""
    ends = np.r_[starts[1:] - 1 + length, [len(data)] * min(1, len(starts))].astype(np.int64)
    before, after = places - starts, ends - places
    out = b"".join(_digest(data[a:b], x, y) for a, b, x, y in zip(starts.tolist(), ends.tolist(), before.tolist(), after.tolist(), strict=True))
    digests = np.frombuffer(out, [("reach", "<i8"), ("proof", "<i4")])
    return before, after, digests["reach"], digests["proof"]


# ---- the transform of a block

def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least, by doubling; the end counts as 0."""
    n, bits = len(codes), max(1, int(codes.max()).bit_length())
    digits = n.bit_length()
    packed = 3 * digits <= 63
    # two ranks and the place fit in one number up to two million symbols: sorting numbers is faster than sorting places
    width = min(((63 - digits) if packed else 63) // bits, depth)
    key, padded = np.zeros(n, np.int64), np.r_[codes.astype(np.int64), np.zeros(width, np.int64)]
    for i in range(width):
        key = key << bits | padded[i : i + n]
    while True:
        if packed:
            key = np.sort(key << digits | np.arange(n))
            order, key = key & (1 << digits) - 1, key >> digits
        else:
            order = np.argsort(key)
            key = key[order]
        number = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        if width >= depth or number[-1] == n - 1:
            return order
        rank, behind = np.empty(n, np.int64), np.zeros(n, np.int64)
        rank[order] = number
        behind[: n - width] = rank[width:] + 1
        key, width = rank << digits | behind if packed else rank * (n + 1) + behind, 2 * width


class Transform:
    """The Burrows-Wheeler transform of a text of codes from 1 on, 0 at ends, with ranks of all symbols.

    The wavelet matrix takes bits from the least one up, so that its last order
    is the stable one by symbol: the place of an interval that has gone through
    all levels is its place among the suffixes one symbol longer.
    """

    def __init__(self, codes: np.ndarray, depth: int):
        self.order = suffix_order(codes, depth)
        self.ends = int(np.count_nonzero(codes == 0))
        column = codes[self.order - 1]
        self.levels = []
        for bit in range(max(1, int(codes.max()).bit_length())):
            one = (column >> bit & 1).astype(bool)
            zeros = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append(zeros)
            column = np.concatenate([column[~one], column[one]])

    def extend(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all strings one symbol longer to the left; none goes over an end mark."""
        for zeros in self.levels:
            a, b, n = zeros[low], zeros[high], zeros[-1]
            low, high = np.concatenate([a, n + low - a]), np.concatenate([b, n + high - b])
            some = high > low
            low, high = low[some], high[some]
        inside = low >= self.ends
        return low[inside], high[inside]

    def common_prefixes(self, length: int) -> np.ndarray:
        """Of each suffix with the one before it in order; -1 where they share `length` symbols at least.

        Suffixes that meet an end mark within the length stand first among those
        that begin alike, and may stay joined to each other.
        """
        common = np.full(len(self.order) + 1, -1, np.int32)
        common[0] = 0
        low, high = np.zeros(1, np.int32), np.full(1, len(self.order), np.int32)
        for value in range(length):
            low, high = self.extend(low, high)
            new = common[high] < 0
            low, high = low[new], high[new]
            if not len(low):
                break
            common[high] = value
        return common[:-1]


def shared_ends(around: list[bytes], at: np.ndarray, interval: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before each anchor, and from it on, any other place of its interval has too."""

    def longest(sides: list[bytes]) -> np.ndarray:
        size = np.array([len(x) for x in sides], np.int64)
        width = max(1, int(size.max()))
        rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sides), np.uint8).reshape(-1, width)
        # the place that shares most is next to it in order, the shorter of equal ones first
        order = np.lexsort((size, rows.view(f"S{width}").ravel(), interval))
        rows, size, of = rows[order], size[order], interval[order]
        same = rows[1:] == rows[:-1]
        common = np.where(same.all(axis=1), width, same.argmin(axis=1))
        common = np.where(of[1:] == of[:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), 0)
        out = np.empty(len(order), np.int64)
        out[order] = np.maximum(np.r_[common, 0], np.r_[0, common])
        return out

    return longest([x[:n][::-1] for x, n in zip(around, at.tolist(), strict=True)]), longest([x[n:] for x, n in zip(around, at.tolist(), strict=True)])


def expand(around: list[bytes], at: np.ndarray, interval: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated strings reach around each anchor: bytes before it and bytes from it on; (-1, -1) without one.

    `around` has the bytes around each anchor, which stands at `at` in them. A
    string counts as repeated if it also stands around another anchor of the
    same interval, as many bytes before it: neighbouring anchors of a text have
    bytes in common, but never at the same distance.
    """
    left, right = np.full(len(around), -1), np.full(len(around), -1)
    if len(around) < 2:
        return left, right
    before, after = shared_ends(around, at, interval, length)
    live = np.flatnonzero(before + after >= length)
    if not len(live):
        return left, right
    around = [around[i][at[i] - before[i] : at[i] + after[i]] for i in live.tolist()]
    at, interval, m = before[live], interval[live], len(live)
    size = at + after[live]
    raw = np.frombuffer(b"".join(around), np.uint8)
    seen = np.bincount(raw, minlength=256) > 0
    codes = np.zeros(len(raw) + m, np.uint16)
    codes[np.arange(len(raw)) + np.repeat(np.arange(m), size)] = np.cumsum(seen).astype(np.uint16)[raw]
    transform = Transform(codes, length)
    run = np.cumsum(transform.common_prefixes(length) >= 0)
    # starts with enough bytes up to their end mark, and at most at the anchor
    owner = np.repeat(np.arange(m), size + 1)[transform.order]
    start = transform.order - (np.cumsum(size + 1) - size - 1)[owner]
    back = at[owner] - start
    whole = (start + length <= size[owner]) & (back >= 0)
    owner, back, run = owner[whole], back[whole], run[whole]
    order = np.lexsort((interval[owner], back, run))
    owner, back, run = owner[order], back[order], run[order]
    same = (run[1:] == run[:-1]) & (back[1:] == back[:-1]) & (interval[owner][1:] == interval[owner][:-1])
    hit = np.r_[same, False] | np.r_[False, same] if len(owner) else np.zeros(0, bool)
    np.maximum.at(left, live[owner[hit]], back[hit])
    np.maximum.at(right, live[owner[hit]], length - back[hit])
    return left, right


# ---- tables

def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=_names(schema))


def _store(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Texts with their anchors, k-gram hashes and digests of surroundings, as a table in the shared folder."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, body binary, pos array<int>, before array<short>, after array<short>, gram array<long>, reach array<long>, proof array<int>"
    kinds = (np.int32, *[np.int16 if length < 1 << 15 else np.int32] * 2, np.int64, np.int64, np.int32)
    if length >= 1 << 15:
        schema = schema.replace("short", "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, lists = [], []
            for text in batch.column(1).to_pylist():
                data = text or b""
                places, grams, starts = anchors(data, length)
                bodies.append(data)
                lists.append((places, *surroundings(data, places, starts, length)))
                lists[-1] = (*lists[-1][:3], grams.view(np.int64), *lists[-1][3:])
            if not bodies:
                continue
            offsets = pa.array(np.r_[0, np.cumsum([len(x[0]) for x in lists])].astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(kind))) for x, kind in zip(zip(*lists, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), *columns], names=_names(schema))

    return staged(map_batches(rows, run, schema), "suffix", compression="zstd")


def _file_rows(path: str, columns: list[str]) -> Iterator[dict]:
    """The rows of one file of the stored table, in their order; its path comes as Spark writes it, with escapes."""
    with open_shared(unquote(path), "rb") as file:
        for batch in pq.ParquetFile(file).iter_batches(batch_size=128, columns=columns):
            yield from batch.to_pylist()


def _by_file(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (file, place, ...) in order behind a head row with the path of their file; all of a file in one task."""
    heads = stored.select(F.col("_metadata.file_path").alias("path")).distinct().select("path", F.xxhash64("path").alias("file"), F.lit(-1).cast("long").alias("place"))
    every = rows.unionByName(heads, allowMissingColumns=True)
    return every.repartition(parts(rows.sparkSession), "file").sortWithinPartitions("file", "place")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[int, int, dict]]]]:
    """Paths of files, each with its places as (row of the file, place in its text, rest)."""

    def places(rows: Iterator[dict]) -> Iterator[tuple[int, int, dict]]:
        for r in rows:
            if r["place"] < 0:
                raise RuntimeError("two files of the stored table have the same hash of their paths; run it again")
            yield r["place"] >> 32, r["place"] & 0xFFFFFFFF, r

    for _, rows in groupby((row for b in batches for row in b.to_pylist()), key=lambda r: r["file"]):
        yield next(rows)["path"], places(rows)


_CONTEXT = "key binary, reach long, proof int, n long, before int, after int, at int, around binary"


def _contexts(frontier: DataFrame, stored: DataFrame, length: int) -> DataFrame:
    """The bytes around each place, read from the stored table's files: each file goes to one task, no text is shuffled."""
    k = gram_bytes(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for path, places in _runs(batches):
            texts, at = enumerate(_file_rows(path, ["body"])), -1
            for row, pos, p in places:
                while at < row:
                    at, here = next(texts)
                out.append((struct.pack("<q", p["gram"]), p["reach"], p["proof"], p["n"], 0, k, p["before"], here["body"][pos - p["before"] : pos + p["after"]]))
                if len(out) == 4096:
                    yield _batch(out, _CONTEXT)
                    out = []
        if out:
            yield _batch(out, _CONTEXT)

    return map_batches(_by_file(frontier, stored), run, _CONTEXT)


_VERDICT = "reach long, proof int, before int, after int"


def _resolve(contexts: DataFrame, length: int) -> DataFrame:
    """Verdicts of surroundings that stand once: how far repeated strings reach around them."""

    def verdicts(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        interval = np.array([numbers.setdefault(r["key"], len(numbers)) for r in rows], np.int64)
        left, right = expand([r["around"] for r in rows], np.array([r["at"] for r in rows], np.int64), interval, length)
        found = [(r["reach"], r["proof"], a, b) for r, a, b in zip(rows, left.tolist(), right.tolist(), strict=True) if a >= 0 and r["n"] == 1]
        if found:
            yield _batch(found, _VERDICT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) > BLOCK:
                last = held[BLOCK]["key"]
                cut = next((i for i in range(BLOCK, 0, -1) if held[i - 1]["key"] != last), None)
                if cut is None:
                    break
                yield from verdicts(held[:cut])
                held = held[cut:]
        if held:
            yield from verdicts(held)

    dealt = contexts.repartition(parts(contexts.sparkSession), "key").sortWithinPartitions("key")
    return map_batches(dealt, run, _VERDICT)


def extended(row: dict, length: int) -> Iterator[tuple]:
    """A place of a too large interval in the longer intervals that its strings can be in.

    `before` and `after` are the bytes of the interval's string before the
    anchor and from it on. Of its missing bytes a string has so many behind it:
    the way is the range that this number is in. Bytes out of reach of the
    longer string are cut off.
    """
    at, around = row["at"], row["around"]
    missing = length - row["before"] - row["after"]
    bounds = [(missing + 1) * i // WAYS for i in range(WAYS + 1)]
    for least, over in zip(bounds, bounds[1:], strict=False):
        before, after = row["before"] + missing - over + 1, row["after"] + least
        if least < over and before <= at and at + after <= len(around):
            low = max(0, at - (length - after))
            key = _digest(around[at - before : at + after], before, after)
            yield key, row["reach"], row["proof"], row["n"], before, after, at - low, around[low : at + length - before]


def _split(contexts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in extended(row, length)]
            if out:
                yield _batch(out, _CONTEXT)

    return map_batches(contexts, run, _CONTEXT)


def _resolve_large(contexts: DataFrame, length: int) -> list[DataFrame]:
    """The same for intervals of more than GROUP places. A round leaves a quarter of the bytes that they miss."""
    out, whole = [], F.col("before") + F.col("after") == length
    while True:
        rows = staged(_split(contexts, length), "suffix-split")
        sizes = staged(rows.groupBy("key").agg(F.count("*").alias("m"), F.first(whole).alias("whole")).where("m > 1"), "suffix-sizes")
        rows = rows.join(sizes, "key")
        out.append(rows.where("whole AND n = 1").select(*_names(_VERDICT)))
        out.append(_resolve(rows.where(~F.col("whole") & (F.col("m") <= GROUP)).drop("m", "whole"), length))
        if sizes.where(~F.col("whole") & (F.col("m") > GROUP)).isEmpty():
            return out
        contexts = rows.where(~F.col("whole") & (F.col("m") > GROUP)).drop("m", "whole")


def repeated_spans(stored: DataFrame, length: int = LENGTH) -> DataFrame:
    """(file, place, before, after): byte ranges around places that repeated strings cover; they may overlap.

    A file is a hash of its path, a place the row in its file above 32 bits with the place in the text.
    """
    columns, pair = ["gram", "reach", "proof"], ["reach", "proof"]
    lists = stored.select(F.xxhash64("_metadata.file_path").alias("file"), F.shiftleft(F.col("_metadata.row_index"), 32).alias("row"), F.inline(F.arrays_zip("pos", "before", "after", *columns)))
    places = lists.select("file", (F.col("row") + F.col("pos")).alias("place"), "before", "after", *columns)
    # what is the same in all places with one digest is taken from any of them
    around = places.groupBy(*pair).agg(
        F.max("gram").alias("gram"), F.count("*").alias("n"), F.min("file").alias("file"), F.min_by("place", "file").alias("place"), F.max("before").cast("int").alias("before"), F.max("after").cast("int").alias("after"),
    )
    grams = around.groupBy("gram").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("single"))
    around = around.join(grams.where("m > single OR m > 1"), "gram").where("n > 1 OR m > 1").select(*columns, "n", "m", (F.col("single") > 0).alias("single"), "file", "place", "before", "after")
    around = staged(around, "suffix-around")
    frontier = around.where("m > 1 AND single").drop("single")
    found = [_resolve(_contexts(frontier.where(F.col("m") <= GROUP).drop("m"), stored, length), length)]
    large = frontier.where(F.col("m") > GROUP).drop("m")
    if not large.isEmpty():
        found += _resolve_large(_contexts(large, stored, length), length)
    # surroundings that stand twice are repeated as a whole
    found.append(around.where("n > 1").select(*pair, "before", "after"))
    verdicts = found[0].select(*pair, "before", "after")
    for x in found[1:]:
        verdicts = verdicts.unionByName(x.select(*pair, "before", "after"))
    verdicts = staged(verdicts.groupBy(*pair).agg(F.max("before").alias("before"), F.max("after").alias("after")), "suffix-verdicts")
    dropped(around)
    return places.select("file", "place", *pair).join(verdicts, pair).select("file", "place", "before", "after")


class Cut:
    """What is left of a text without its ranges, which come by ascending start."""

    def __init__(self, data: bytes):
        self.data, self.kept, self.end, self.removed, self.n_spans = data, [], 0, 0, 0

    def remove(self, start: int, until: int) -> None:
        if not self.n_spans or start > self.end:
            self.kept.append(self.data[self.end : start])
            self.end, self.n_spans = start, self.n_spans + 1
        if until > self.end:
            self.removed, self.end = self.removed + until - self.end, until

    def rest(self) -> bytes:
        return b"".join([*self.kept, self.data[self.end :]])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes.

    Bytes are those of the UTF-8 text; a null text is empty. Texts shorter than
    the length keep all. Equal texts, repeated rows among them, lose all bytes
    from that length on. An empty table gives no rows. The length is from 8 on.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    stored = _store(df, id_col, text_col, length)
    spans = staged(repeated_spans(stored, length), "suffix-spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for path, ranges in _runs(batches):
            pending = next(ranges, None)
            for at, row in enumerate(_file_rows(path, ["doc_id", "body"])):
                cut = Cut(row["body"])
                while pending is not None and pending[0] == at:
                    cut.remove(pending[1] - pending[2]["before"], pending[1] + pending[2]["after"])
                    pending = next(ranges, None)
                kept = cut.rest()
                out.append((row["doc_id"], len(cut.data), cut.removed, cut.n_spans, hashlib.sha256(kept).hexdigest(), *((kept,) if with_text else ())))
                held += len(kept) * with_text
                if len(out) == 2000 or held > 1 << 23:
                    yield _batch(out, schema)
                    out, held = [], 0
        if out:
            yield _batch(out, schema)

    return map_batches(_by_file(spans, stored), run, schema)

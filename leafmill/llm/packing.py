"""Harmonic packing of token documents into sequences of a fixed capacity.

A document of n tokens that fits in a sequence belongs to class
k = capacity // n, and a bin of class k takes k documents, whole. Documents of
CLASSES or more to a sequence share one class, whose bins take what fits. What
is left open in a full bin is closed with a whole document that comes later and
fits, or with pieces of documents that are cut: those longer than a sequence,
and another one only when WAITING bins wait for something to close them.

Every worker fills the bins of each class on its own; no worker needs another's
rows. What stands in unfilled bins at a worker's end is laid out anew, whole
documents first, and its last tokens go to sequences of powers of two, so that
they need no padding either. A worker holds at most one bin for each class,
WAITING full ones and SPARE sequences of pieces to close them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .tokens import default_path, encoder

CAPACITY = 2048
#: Documents a sequence from which on the classes are one.
CLASSES = 16
#: Full bins that may wait for something to close them, and sequences of pieces kept for that.
WAITING, SPARE = 64, 16
END_ID = 1
#: Sequence ids of a worker start at its number times this.
WORKER_STEP = 1 << 36

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
TYPES = [pa.binary() if x.endswith(" binary") else pa.int64() for x in SCHEMA.split(", ")]
#: Rows and bytes of ids in one Arrow batch that a worker returns.
OUT_ROWS = 20_000
OUT_BYTES = 8 << 20


class Piece:
    """A part of a document's ids, or all of them."""

    __slots__ = ("doc", "start", "ids", "total", "size")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total, self.size = doc, start, ids, total, len(ids) // 4

    def cut(self, n: int) -> Piece:
        """The first n ids; this piece keeps the rest."""
        first = Piece(self.doc, self.start, self.ids[: 4 * n], self.total)
        self.start, self.ids, self.size = self.start + n, self.ids[4 * n :], self.size - n
        return first


class Packer:
    """The bins of one worker. add() and finish() yield rows of SCHEMA."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, worker * WORKER_STEP
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[tuple[int, list[Piece]]] = []
        self.spare: deque[Piece] = deque()
        self.spare_size = 0

    def _row(self, pieces: list[Piece]) -> Iterator[tuple]:
        seq, at = self.next_id, 0
        self.next_id += 1
        for p in pieces:
            yield p.doc, p.start, p.size, p.ids, p.total, seq, at
            at += p.size

    def _full(self, pieces: list[Piece]) -> Iterator[tuple]:
        """A bin that takes no more of its class."""
        room = self.capacity - sum(p.size for p in pieces)
        if room:
            self.waiting.append((room, pieces))
        else:
            yield from self._row(pieces)

    def _from_spare(self, room: int) -> list[Piece]:
        out = []
        while room and self.spare:
            first = self.spare[0]
            out.append(self.spare.popleft() if first.size <= room else first.cut(room))
            room -= out[-1].size
            self.spare_size -= out[-1].size
        return out

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        piece = Piece(doc, 0, ids, len(ids) // 4)
        if piece.size > self.capacity or len(self.waiting) >= WAITING:
            self.spare.append(piece)
            self.spare_size += piece.size
        else:
            fits = [(room, i) for i, (room, _) in enumerate(self.waiting) if room >= piece.size]
            if fits:
                room, i = min(fits)
                pieces = self.waiting.pop(i)[1]
                yield from self._full([*pieces, piece])
            else:
                yield from self._place(piece)
        while self.waiting and self.spare_size >= self.waiting[0][0]:
            room, pieces = self.waiting.pop(0)
            yield from self._row(pieces + self._from_spare(room))
        while self.spare_size > SPARE * self.capacity:
            yield from self._row(self._from_spare(self.capacity))

    def _place(self, piece: Piece) -> Iterator[tuple]:
        k = min(CLASSES, self.capacity // piece.size)
        pieces = self.open.setdefault(k, [])
        if k == CLASSES and sum(p.size for p in pieces) + piece.size > self.capacity:
            self.open[k] = [piece]
            yield from self._full(pieces)
            return
        pieces.append(piece)
        if len(pieces) == k and k < CLASSES:
            yield from self._full(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        pool = sorted([*self.spare, *(p for _, x in self.waiting for p in x), *(p for x in self.open.values() for p in x)], key=lambda p: p.size)
        left = sum(p.size for p in pool)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left, row = left - room, []
            while room:
                i = bisect_right(pool, room, key=lambda p: p.size)
                if i:  # the largest that fits
                    row.append(pool.pop(i - 1))
                else:  # one that is cut already, or else the largest
                    i = next((i for i, p in enumerate(pool) if p.size < p.total), len(pool) - 1)
                    rest = pool.pop(i)
                    row.append(rest.cut(room))
                    pool.insert(bisect_right(pool, rest.size, key=lambda p: p.size), rest)
                room -= row[-1].size
            yield from self._row(row)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its token ids, where it stands in its document and in its sequence, and their CRC-32.

    `ids` are unsigned 32-bit numbers, least byte first. A sequence is the ids
    of its pieces in the order of `offset`. A null text is empty and still has
    its end id.

    Repeated rows are packed each; an empty table gives no row. The capacity
    must be a power of two.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    path = tokenizer or default_path()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId(), capacity)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=names)

        def placed() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from packer.add(doc, encode(text) + end)
            yield from packer.finish()

        out, held = [], 0
        for row in placed():
            out.append(row)
            held += len(row[3])
            if held >= OUT_BYTES or len(out) >= OUT_ROWS:
                yield batch_of(out)
                out, held = [], 0
        if out:
            yield batch_of(out)

    packed = map_batches(rows, run, SCHEMA)
    return packed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

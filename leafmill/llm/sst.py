"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    block*    records: varint shared key bytes, varint own key bytes, varint
              value bytes, key rest, value; the first record of a block shares
              nothing. Blocks are compressed with Zstandard.
    index     per block: first key, last key, offset, stored size, records
    bloom     bits of a Bloom filter over all keys
    footer    fixed size: offsets and sizes of index and bloom, records, ids,
              hash count, CRC-32 of index and bloom, magic

A key is one byte (0 for a null id, else 1) and the id as 8 big-endian bytes
with the sign bit flipped, so byte order is id order. A value is the ids as
little-endian unsigned 16-bit integers where all fit, else 32-bit, behind one
byte with that width. A lookup reads the footer, asks the Bloom filter, finds
the block by binary search in the index and scans one block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_shared, map_batches, open_shared, parts, shared_dir
from .tokens import default_path, encoder

MAGIC = b"LMSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQII8s")
#: Uncompressed bytes after which a block ends.
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    if not len(ids) or int(ids.max()) < 1 << 16:
        return b"\2" + ids.astype("<u2").tobytes()
    return b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _bloom_bits(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b & (1 << 64) - 1) % bits for i in range(BLOOM_HASHES)]


def write_shard(file, records: Iterable[tuple[int | None, np.ndarray]], block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Write records, which must come in ascending key order; (records, ids)."""
    squeeze = zstandard.ZstdCompressor(level=1)
    index, keys = [], []
    block, in_block, first, last, offset, n_ids = bytearray(), 0, b"", b"", 0, 0

    def flush() -> None:
        nonlocal block, in_block, offset
        if in_block:
            stored = squeeze.compress(bytes(block))
            file.write(stored)
            index.append((first, last, offset, len(stored), in_block))
            offset += len(stored)
            block, in_block = bytearray(), 0

    for doc_id, ids in records:
        key, value = key_of(doc_id), pack_ids(ids)
        if keys and key < keys[-1]:
            raise ValueError("records must be in ascending order")
        shared = 0
        if in_block:
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        else:
            first = key
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        in_block, last, n_ids = in_block + 1, key, n_ids + len(ids)
        keys.append(key)
        if len(block) >= block_bytes:
            flush()
    flush()
    body = b"".join(_varint(len(a)) + a + _varint(len(b)) + b + _varint(o) + _varint(n) + _varint(r) for a, b, o, n, r in index)
    bits = max(64, BLOOM_BITS_PER_KEY * len(keys))
    bloom = np.zeros(bits, np.uint8)
    for key in keys:
        bloom[_bloom_bits(key, bits)] = 1
    packed = np.packbits(bloom, bitorder="little").tobytes()
    file.write(body)
    file.write(packed)
    file.write(FOOTER.pack(offset, len(body), offset + len(body), bits, len(keys), n_ids, BLOOM_HASHES, zlib.crc32(body + packed), MAGIC))
    return len(keys), n_ids


class Shard:
    """A reader of one shard over a seekable file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        if end < FOOTER.size:
            raise ValueError("not a shard: too short")
        file.seek(end - FOOTER.size)
        at, size, bloom_at, self.bits, self.records, self.n_ids, _, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        file.seek(at)
        body, self.bloom = file.read(size), file.read((self.bits + 7) // 8)
        if zlib.crc32(body + self.bloom) != crc:
            raise ValueError("damaged shard: index or filter checksum differs")
        self.index: list[tuple[bytes, bytes, int, int, int]] = []
        i = 0
        while i < len(body):
            n, i = _read_varint(body, i)
            first, i = body[i : i + n], i + n
            n, i = _read_varint(body, i)
            last, i = body[i : i + n], i + n
            offset, i = _read_varint(body, i)
            stored, i = _read_varint(body, i)
            count, i = _read_varint(body, i)
            self.index.append((first, last, offset, stored, count))
        self.lasts = [x[1] for x in self.index]

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, _, offset, stored, count = self.index[k]
        self.file.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(stored))
        at, key = 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + size]
            at += own + size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._block(k):
                yield id_of(key), unpack_ids(value)

    def may_contain(self, doc_id: int | None) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of all records with this key."""
        if not self.may_contain(doc_id):
            return []
        key, out = key_of(doc_id), []
        k = bisect_left(self.lasts, key)
        while k < len(self.index) and self.index[k][0] <= key:
            out += [unpack_ids(v) for found, v in self._block(k) if found == key]
            k += 1
        return out


MANIFEST = "shard int, path string, first_id long, last_id long, n_docs long, n_ids long"


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write shards in ascending id order, in parallel; a row of MANIFEST for each.

    Rows are range-partitioned and sorted by id (null ids first, equal ids by
    text), then encoded and written as a stream. A repeated task writes a file
    of its own and only the manifest's files count, so a lost executor leaves
    no half-written shard behind. The manifest is written to `folder` as well.
    """
    path = tokenizer or default_path()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(shards or parts(df.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    make_shared(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, seen = encoder(path).encode, end_id.to_bytes(4, "little"), []

        def records():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen[:] = [seen[0] if seen else doc, doc]
                    yield doc, np.frombuffer(encode(text) + end, "<u4")

        stream = records()
        first = next(stream, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"

        def all_records():
            yield first
            yield from stream

        with open_shared(name, "wb") as file:
            n_docs, n_ids = write_shard(file, all_records())
        values = [shard, name, seen[0], seen[1], n_docs, n_ids]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    manifest = map_batches(rows, run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    The start of a shard is the sum of the ids of the shards before it; the
    manifest has a row for each shard, not for each document.
    """
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    todo = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("start"))
    todo = todo.repartition(parts(manifest.sparkSession), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                with open_shared(row["path"], "rb") as file:
                    for doc, ids in Shard(file):
                        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    return map_batches(todo, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The id arrays of one document, by its shard's filter and index."""
    inside = F.col("first_id").isNull() if doc_id is None else (F.coalesce("first_id", F.lit(-(1 << 63))) <= doc_id) & (F.col("last_id") >= doc_id)
    out = []
    for row in manifest.where(inside).orderBy("shard").collect():
        with open_shared(row["path"], "rb") as file:
            out += Shard(file).get(doc_id)
    return out


def token_table(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents to new shards in the shared folder and read them back."""
    folder = f"{shared_dir(df.sparkSession)}/leafmill-sst-{uuid.uuid4().hex}"
    return read_shards(write_shards(df, folder, tokenizer=tokenizer))

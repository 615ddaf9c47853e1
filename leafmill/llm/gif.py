"""Media columns: GIF streams decoded to timed, composed frames.

decode() reads any GIF87a or GIF89a stream: LZW code streams of every code
size (deferred clear codes too), global and local palettes, interlacing,
transparency, the four disposal methods and delays. encode() stores bytes as
8-bit samples of a grey palette without loss. Code positions within a table's
life follow from the code number alone, so codes are cut out of the bit stream
many at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

WIDTH = 64
#: Rows of a frame; longer payloads take several frames.
FRAME_ROWS = 1024
DELAY_CS = 10
HISTOGRAM_BINS = 8
MAX_CODES = 4096
#: A stream that claims more pixels than this in a frame is refused.
MAX_PIXELS = 1 << 26
#: Bytes of canvases in one Arrow batch that a worker returns.
OUT_BYTES = 8 << 20


@lru_cache(16)
def _schedule(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Widths of the first n codes after a clear code, their bit offsets, and the offset after each."""
    free = (1 << min_size) + 2
    # the decoder's table grows with every code but the first
    size = np.minimum(free + np.maximum(np.arange(n) - 1, 0), MAX_CODES - 1)
    width = np.maximum(min_size + 1, np.floor(np.log2(np.maximum(size, 1))).astype(int) + 1)
    # a table of exactly 2**k entries still takes its next code in k + 1 bits
    width = np.minimum(width, 12)
    ends = np.cumsum(width)
    return width, ends - width, ends


def _cut_codes(bits: np.ndarray, width: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Codes of these widths at these offsets of a padded byte array."""
    byte = offset >> 3
    word = bits[byte].astype(np.uint32) | bits[byte + 1].astype(np.uint32) << 8 | bits[byte + 2].astype(np.uint32) << 16
    return (word >> (offset & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)


def _join_codes(codes: np.ndarray, width: np.ndarray) -> bytes:
    """Codes of these widths one after the other, least bit first."""
    ends = np.cumsum(width)
    start = ends - width
    byte, value = start >> 3, codes.astype(np.int64) << (start & 7)
    n = int(ends[-1] + 7) // 8
    out = np.zeros(n + 3, np.float64)
    for k in range(3):  # a code touches at most three bytes; no bit is set twice, so sums are unions
        out += np.bincount(byte + k, (value >> 8 * k) & 255, n + 3)
    return out[:n].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """The code stream of samples; the table is cleared when it is full."""
    clear, stop = 1 << min_size, (1 << min_size) + 1
    full = MAX_CODES - 1
    lives: list[list[int]] = []
    if data:
        # by code, the codes of its continuations; a dictionary of small integers is the quickest store here
        fresh = lambda: [{} for _ in range(clear)] + [{}, {}]
        after, free, samples = fresh(), clear + 2, iter(data)
        code, life = next(samples), []
        emit, grow, here = life.append, after.append, after[code]
        for b in samples:
            found = here.get(b)
            if found is not None:
                code, here = found, after[found]
                continue
            emit(code)
            if free == full:
                lives.append(life)
                life, after, free = [], fresh(), clear + 2
                emit, grow = life.append, after.append
            else:
                here[b] = free
                free += 1
                grow({})
            code, here = b, after[b]
        emit(code)
        lives.append(life)
    schedule, _, _ = _schedule(min_size, MAX_CODES - clear)
    codes, widths, next_width = [], [], min_size + 1
    for life in lives:
        codes += [np.array([clear]), np.array(life)]
        widths += [np.array([next_width]), schedule[: len(life)]]
        next_width = int(schedule[len(life)])
    tail = [stop] if lives else [clear, stop]
    codes.append(np.array(tail))
    widths.append(np.full(len(tail), next_width))
    return _join_codes(np.concatenate(codes), np.concatenate(widths))


def lzw_decode(data: bytes, min_size: int, limit: int) -> bytes:
    """The samples of a code stream, at most `limit`; a damaged stream raises ValueError."""
    clear, stop = 1 << min_size, (1 << min_size) + 1
    bits = np.frombuffer(data + b"\0\0\0", np.uint8)
    n_bits, per_table = 8 * len(data), MAX_CODES - clear
    width, offset, ends = _schedule(min_size, per_table)
    base, out, made = 0, [], 0
    while made < limit:
        # the codes of one table's life: up to a clear or stop code, at full width once the table is full
        n = int(np.searchsorted(ends, n_bits - base, "right"))
        codes = _cut_codes(bits, width[:n], base + offset[:n])
        used = int(ends[n - 1]) if n else 0
        lives = [codes]
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        while n == per_table and not len(marks):
            m = min((n_bits - base - used) // 12, 1 << 14)
            if not m:
                break
            codes = _cut_codes(bits, np.full(m, 12), base + used + 12 * np.arange(m))
            marks = np.flatnonzero((codes == clear) | (codes == stop))
            used += 12 * m
            lives.append(codes)
        codes = np.concatenate(lives).astype(np.int32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(marks[0]) if len(marks) else len(codes)
        out.append(_expand(codes[:upto], clear, limit - made))
        made += len(out[-1])
        if not len(marks) or codes[upto] == stop:
            break
        base += int(ends[upto]) if upto < per_table else int(ends[-1]) + 12 * (upto + 1 - per_table)
    return b"".join(out)


def _expand(codes: np.ndarray, clear: int, limit: int) -> bytes:
    """The samples of the codes of one table's life.

    Entry j of the table is what code j wrote and the first sample of code
    j + 1, so an entry's samples stand in the output itself, from where code j
    began. Lengths and samples follow from these links by pointer doubling.
    """
    n = len(codes)
    if not n:
        return b""
    here = np.arange(n, dtype=np.int32)
    root = codes < clear
    link = np.where(root, here, codes - (clear + 2))
    if ((link >= here) & ~root).any() or (link < 0).any():
        raise ValueError("damaged code stream")
    hops, to = (~root).astype(np.int32), link
    while not root[to].all():
        hops, to = hops + hops[to], to[to]
    length = hops.astype(np.int64) + 1
    pos = np.cumsum(length) - length
    keep = int(np.searchsorted(pos, limit))
    if keep < n:  # more than is wanted: the rest need not be written
        codes, root, link, length, pos = codes[:keep], root[:keep], link[:keep], length[:keep], pos[:keep]
        n = keep
    total = int(pos[-1] + length[-1]) if n else 0
    start, length = pos.astype(np.int32), length.astype(np.int32)
    shift = np.repeat(np.where(root, 0, start - start[np.where(root, 0, link)]).astype(np.int32), length)
    source = np.arange(total, dtype=np.int32) - shift
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    samples = np.zeros(total, np.uint8)
    samples[start[root]] = codes[root]
    return samples[source].tobytes()[:limit]


@dataclass
class Frame:
    """One image of a stream: its place, timing, colour indices and the composed canvas it leaves."""

    left: int
    top: int
    delay_cs: int
    disposal: int
    transparent: int | None
    samples: np.ndarray
    canvas: np.ndarray

    def histogram(self, bins: int = HISTOGRAM_BINS) -> list[int]:
        """Pixel counts of the canvas by red, then green, then blue bin; clear pixels are left out."""
        shown = self.canvas[..., 3] > 0
        seen = self.canvas.reshape(-1, 4) if shown.all() else self.canvas[shown]
        step = 256 // bins
        return [int(x) for c in range(3) for x in np.bincount(seen[:, c] // step, minlength=bins)[:bins]]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The data of sub-blocks from here, and the place behind their end."""
    out = []
    while True:
        if at >= len(data):
            raise ValueError("stream ends within a block")
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
    return colours, at + 3 * n


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a stream in order. ValueError if it is not one or is damaged."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF stream")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > MAX_PIXELS:
        raise ValueError("canvas too large")
    at, shared = 13, None
    if flags & 128:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        if w * h > MAX_PIXELS or left + w > width or top + h > height:
            raise ValueError("frame outside the canvas")
        colours = shared
        if flags & 128:
            colours, at = _palette(data, at, flags)
        if colours is None:
            raise ValueError("no palette")
        min_size = data[at] if at < len(data) else 0
        if not 1 <= min_size <= 8:
            raise ValueError("impossible code size")
        body, at = _blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(body, min_size, w * h), np.uint8)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(flat)] = flat
        drawn = np.zeros(w * h, bool)
        drawn[: len(flat)] = True
        samples, drawn = samples.reshape(h, w), drawn.reshape(h, w)
        if flags & 64:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            woven, was = np.empty_like(samples), np.empty_like(drawn)
            woven[order], was[order] = samples, drawn
            samples, drawn = woven, was
        if transparent is not None:
            drawn &= samples != transparent
        prior = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        if drawn.all():
            region[..., :3], region[..., 3] = colours[samples], 255
        else:
            region[drawn, :3] = colours[samples[drawn]]
            region[drawn, 3] = 255
        yield Frame(left, top, delay, disposal, transparent, samples, canvas.copy())
        if disposal == 2:
            region[:] = 0
        elif prior is not None:
            canvas = prior
        delay, disposal, transparent = 0, 0, None


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """The payload with zero bytes up to a positive multiple of the unit."""
    return payload.ljust(max(unit, -(-len(payload) // unit) * unit), b"\0")


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A stream that holds the samples, a multiple of the width, as frames of a grey palette."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill rows")
    rows = min(frame_rows, len(samples) // width)
    grey = bytes(c for i in range(256) for c in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", width, rows, 0xF7, 0, 0), grey]
    for at in range(0, len(samples), width * frame_rows):
        part = samples[at : at + width * frame_rows]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        body = lzw_encode(part)
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def stored_samples(media: bytes) -> tuple[bytes, list[int], int, int]:
    """Read back: the composed samples (red values of the frames' places), histogram, frames, hundredths of a second."""
    out, total, frames, time = [], np.zeros(3 * HISTOGRAM_BINS, np.int64), 0, 0
    for f in decode(media):
        h, w = f.samples.shape
        out.append(f.canvas[f.top : f.top + h, f.left : f.left + w, 0].tobytes())
        total += f.histogram()
        frames, time = frames + 1, time + f.delay_cs
    return b"".join(out), total.tolist(), frames, time


def frames(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Timed frames of a binary column: a row for each with its place, time, composed canvas, digest and colour histogram.

    `canvas` has the red, green, blue and alpha samples of the whole picture as
    it is shown, row by row, `canvas_width` times `canvas_height`; the frame's
    own part of it is `width` by `height` at `left` and `top`. A null or
    damaged stream gives one row with the error and no frame.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    schema = "id long, frame int, at_cs long, delay_cs int, disposal int, width int, height int, sha256 string, histogram array<long>, error string, left int, top int, canvas_width int, canvas_height int, canvas binary"
    types = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.string(), pa.list_(pa.int64()), pa.string(), *[pa.int32()] * 4, pa.binary()]

    def of(key, media) -> Iterator[tuple]:
        time = 0
        try:
            for n, f in enumerate(decode(media or b"")):
                h, w = f.samples.shape
                canvas = f.canvas.tobytes()
                yield key, n, time, f.delay_cs, f.disposal, w, h, hashlib.sha256(canvas).hexdigest(), f.histogram(), None, f.left, f.top, f.canvas.shape[1], f.canvas.shape[0], canvas
                time += f.delay_cs
        except ValueError as e:
            yield key, *[None] * 8, str(e), *[None] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            out, held = [], 0
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in of(key, media):
                    out.append(row)
                    held += len(row[-1] or b"")
                    if held >= OUT_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)

    return map_batches(rows, run, schema)


def media_of_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: texts as samples of GIF streams, one row for each input row.

    A null text is empty: 64 zero samples. The samples are padded with zeros,
    n_bytes says how many of them are the text's.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [p or b"" for p in batch.column(1).to_pylist()]
            media = pa.array([encode(padded(p)) for p in payloads], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, payloads), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return map_batches(rows, run, "doc_id long, n_bytes long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """Digests of the samples read back from a table of media_of_texts(); one row for each of its rows."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media in batch.column(2).to_pylist():
                back, histogram, n, time = stored_samples(media)
                feature = f"frames={n};time_cs={time};red={'/'.join(map(str, histogram[:HISTOGRAM_BINS]))}"
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return map_batches(stored.select("doc_id", "n_bytes", "media"), run, schema)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as a media column of GIF samples, read back from it and described; one row for each input row.

    A null text is empty: 64 zero samples. Equal texts have equal values.
    """
    return describe(staged(media_of_texts(df, id_col, text_col), "gif"))

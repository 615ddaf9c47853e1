"""Secret scans: keyword prefilter, anchored expressions near hits, checksums.

Every whole text is projected to ASCII code point by code point (other
characters become '?', which no rule contains), so offsets stay code-point
offsets. An Aho-Corasick automaton finds rule keywords in the lower-cased
projection; a rule's expression is tried only at such a hit. Runs of
hexadecimal digits have no keyword, so their prefilter is a search for the
shortest acceptable run in a class-mapped copy. Tokens with an embedded
checksum are kept only if the checksum holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "codehost", "package", "jwt")
BASE_KINDS = KINDS[:3]

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CODEHOST = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
PACKAGE = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_CLASS = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(".") for i in range(256))


def crc_base62(payload: str) -> str:
    """Six base-62 digits of the CRC-32, as such tokens carry at their end."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _crc_ok(body: str) -> bool:
    return crc_base62(body[:-6]) == body[-6:]


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    rules: dict[str, list[str]] = {}
    for word in ASSIGN_WORDS:
        rules.setdefault(word, []).append("assign")
    rules["akia"] = ["access"]
    for c in "pousr":
        rules[f"gh{c}_"] = ["codehost"]
    rules["npm_"] = ["package"]
    rules["eyj"] = ["jwt"]
    for word, kinds in rules.items():
        found.add_word(word, (len(word), kinds[0]))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start, then by kind as listed."""
    if not text:
        return []
    raw = text.encode("ascii", "replace")
    lower = raw.lower().decode("ascii")
    plain = None
    ends = dict.fromkeys(KINDS, 0)
    spans: list[tuple[int, int, int]] = []
    # iter() gives ends in ascending order; per kind the starts must ascend too
    hits = sorted((end - n + 1, kind) for end, (n, kind) in _automaton().iter(lower))
    for start, kind in hits:
        if start < ends[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(lower, start)
            if not m:
                continue
            ends[kind] = m.end()
            keep = len(m[2]) >= MIN_ASSIGN
        else:
            if plain is None:
                plain = raw.decode("ascii")
            m = {"access": ACCESS, "codehost": CODEHOST, "package": PACKAGE, "jwt": JWT}[kind].match(plain, start)
            if not m:
                continue
            ends[kind] = m.end()
            if kind == "access":
                keep = m.end() - start >= MIN_ACCESS
            elif kind == "jwt":
                keep = _json_part(m[1]) and _json_part(m[2])
            else:
                keep = _crc_ok(m[1])
        if keep:
            spans.append((start, KINDS.index(kind), m.end()))
    mapped, at = raw.translate(_HEX_CLASS), 0
    while (at := mapped.find(b"h" * MIN_HEX, at)) >= 0:
        end = mapped.find(b".", at)
        end = len(mapped) if end < 0 else end
        spans.append((at, 2, end))
        at = end
    spans.sort()
    return [(KINDS[k], s, e) for s, k, e in spans]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[{kind}]") -> str | None:
    """The text with each span replaced by its mark; overlapping spans merge."""
    if not text or not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], mark.format(kind=kind)]
        at = end
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts per kind, digest and all spans.

    A null or empty text has no spans. Repeated rows and null ids give a row
    each; further columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("na", "nk", "nh", "nx", "sha", "spans")}
            for text in batch.column(1).to_pylist():
                spans = find_spans(text)
                kinds = [k for k, _, _ in spans]
                out["na"].append(kinds.count("assign"))
                out["nk"].append(kinds.count("access"))
                out["nh"].append(kinds.count("hex"))
                out["nx"].append(sum(k not in BASE_KINDS for k in kinds))
                base = spans_text([s for s in spans if s[0] in BASE_KINDS])
                out["sha"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(spans_text(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("na", "nk", "nh")), pa.array(out["sha"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["nx"], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"],
            )

    return map_batches(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")


def redact_documents(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced and the length renewed; a null text stays null."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t, find_spans(t)) if t is not None else None)

    out = df.withColumn(text_col, clean(F.col(text_col)))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return out

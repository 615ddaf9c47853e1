"""Token ids of whole texts with a public tokenizer file.

The tokenizer's own rule splits a text into pieces that are encoded
independently of each other, so each worker keeps the ids of pieces that it
has met and only new pieces go through the tokenizers library. A text that holds
an added token of the vocabulary, such as an end mark, goes through it whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from functools import lru_cache

#: Pieces kept by a worker; the store is emptied when it is full, so memory is bounded.
CACHE_PIECES = 1_000_000

# The White_Space code points of the Basic Multilingual Plane.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(letter: str) -> str:
    out, first = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and unicodedata.category(chr(c))[0] == letter
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\u{first:04x}-\\u{c - 1:04x}")
            first = None
    return "".join(out)


@lru_cache(1)
def _splitter() -> re.Pattern:
    """The byte-level splitting rule for texts without astral characters."""
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@lru_cache(1)
def _alphabet() -> dict[int, str]:
    """Byte to character as byte-level vocabularies spell it: visible Latin-1 stays, the rest follows U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        self.split = _splitter().findall if self._byte_level(spec) else None
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or () if t["content"]]
        self.added = re.compile("|".join(added)).search if added else None

    @staticmethod
    def _byte_level(spec: dict) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    def _plain(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces by the tokenizer's own merge model."""
        alphabet, merge = _alphabet(), self.tokenizer.model.tokenize
        for p in pieces:
            mapped = p.encode("utf-8").decode("latin-1").translate(alphabet)
            self.cache[p] = _pack([t.id for t in merge(mapped)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is None or (self.added and self.added(text)) or len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text):
            return self._plain(text)
        pieces = self.split(text)
        try:
            return b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            self._learn([p for p in dict.fromkeys(pieces) if p not in self.cache])
            return b"".join(map(self.cache.__getitem__, pieces))


def _pack(ids: list[int]) -> bytes:
    from array import array

    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)

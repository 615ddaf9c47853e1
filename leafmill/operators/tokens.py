"""Tokens with positions as column expressions.

A word is a run of alphabetic characters and decimal digits, with apostrophes
and underscores inside; it is lower-cased, one code point for each, and those
two are stripped from its ends. A longer word than `max_word` bytes is cut: a
token is full at that size, and a character that would go beyond it is left out.
Positions count words from 1 over all pieces of a document; each GAP
character leaves out one position, so phrases do not match across it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GAP, MAX_WORD, MIN_WORD
from ..functions import columns as C

#: Letters as Java knows them; marks that are alphabetic count.
LETTERS = "\\p{IsAlphabetic}"
#: Letters in a spelling that other engines know too.
PLAIN_LETTERS = "\\p{L}"
#: The replaceable pattern of the other tokenizer.
WORD_PATTERN = "(?U)\\w+(?:[’']\\w+)*"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is found once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Marks that no word holds: what a character takes beyond one byte, and the end of a piece.
_MORE, _END = "\x04", "\x05"


def _full(size: int) -> str:
    """A piece of just `size` bytes of a padded word, and characters that are too wide for what is left of it; groups are what stays."""
    one = f"[^{_MORE}]"
    last = f"(?:{one}{_MORE}++)*+({one}?+)"
    last_two = f"(?:{one}{_MORE}{{2,}}+)*+(?:({one}{_MORE})|({one}){last})?+"
    last_three = f"(?:{one}{_MORE}{{3}})*+(?:({one}{_MORE}{{2}})|({one}{_MORE}){last}|({one}){last_two})?+"
    heads = [f"(.{{{size - left}}})(?!{_MORE}){rest}" for left, rest in enumerate(("", last, last_two, last_three)) if left <= size]
    return f"(?s)(?=.)(?:{'|'.join(heads)})"


def cut_word(word: Column, size: int) -> Column:
    """Pieces of a word of at most `size` bytes of UTF-8; a character that does not fit into what is left of a piece is dropped.

    Each character is padded to as many characters as it has bytes, so one expression
    finds the pieces and drops what does not fit, in time linear in the word.
    """
    padded = word
    for wide, n in (("[\\x{80}-\\x{7FF}]", 1), ("[\\x{800}-\\x{FFFF}]", 2), ("[\\x{10000}-\\x{10FFFF}]", 3)):
        padded = F.regexp_replace(padded, wide, "$0" + _MORE * n)
    pattern = _full(size)
    kept = "".join(f"${i + 1}" for i in range(re.compile(pattern).groups))
    folded = F.split(F.translate(F.regexp_replace(padded, pattern, kept + _END), _MORE, ""), _END)
    plain = F.regexp_extract_all(word, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.octet_length(word) == F.char_length(word), plain).otherwise(folded)


def _marks(text: Column, letters: str, min_word: int, max_word: int) -> Column:
    """Words of a text and a GAP for each gap, in order."""
    # plain letters first, as the pattern tries what a class names in order
    one = f"a-z0-9{letters}\\p{{Nd}}"
    lower, gaps = C.lower(text), F.contains(text, F.lit(GAP))

    def found(pattern: str) -> Column:
        every = lambda p: F.regexp_extract_all(lower, F.lit(p), F.lit(0))
        return F.when(gaps, every(f"{pattern}|{GAP}")).otherwise(every(pattern))

    # runs without the apostrophes and underscores at their ends
    words = found(f"[{one}]+(?:['_]+[{one}]+)*+")
    if max_word < 1 << 20:
        long = lambda w: F.octet_length(w) > max_word

        def cut() -> Column:
            runs = F.flatten(F.transform(found(f"[{one}'_]+"), lambda w: F.when(long(w), cut_word(w, max_word)).otherwise(F.array(w))))
            return F.filter(F.transform(runs, lambda w: F.btrim(w, F.lit("'_"))), lambda w: w != "")

        # a run is cut before its ends are taken off; one that is too long has a long word, or much at its ends
        some = max(1, max_word // 4)
        pairs = reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in ("''", "'_", "_'", "__"))) if some > 1 else F.lit(True)
        words = F.when(pairs & text.rlike(f"['_]{{{some}}}"), cut()).otherwise(_let(words, lambda ws: F.when(F.exists(ws, lambda w: F.octet_length(w) > max_word - 2 * some), cut()).otherwise(ws)))
    if min_word > 2:
        # the length counts the byte behind the word as well
        words = F.filter(words, lambda w: (w == GAP) | (F.octet_length(w) + 1 >= min_word))
    return words


def tokens(text: Column, letters: str = LETTERS, min_word: int = MIN_WORD, max_word: int = MAX_WORD) -> Column:
    """The words of a text as an array."""
    return F.array_remove(_marks(text, letters, min_word, max_word), GAP)


def pattern_tokens(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """Matches of a pattern, as they are written; gaps have no meaning here."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_count(text: Column, letters: str = LETTERS) -> Column:
    return F.size(tokens(text, letters)).cast("long")


def _hooked(text: Column, tokenizer: Callable[[Column], Column]) -> Column:
    """What a replaced tokenizer finds between gaps, and the gaps."""
    gap = lambda i: F.when(i > 0, F.array(F.lit(GAP))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.split(text, GAP), lambda t, i: F.concat(gap(i), tokenizer(t))))


def marked_pieces(pieces: str, letters: str = LETTERS, min_word: int = MIN_WORD, max_word: int = MAX_WORD, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """(meta, context, term) for each word and gap of all pieces, in order.

    `tokenizer` replaces the splitting of words: from a text column to an array of
    words, by column functions.
    """
    words = (lambda t: _hooked(t, tokenizer)) if tokenizer else lambda t: _marks(t, letters, min_word, max_word)
    return F.flatten(F.transform(pieces, lambda p: F.transform(words(p["text"]), lambda w: F.struct(p["meta"].alias("meta"), p["context"].alias("context"), w.alias("term")))))


def piece_words(pieces: str, letters: str = LETTERS, min_word: int = MIN_WORD, max_word: int = MAX_WORD) -> Column:
    """(meta, context, words) for each piece, in order; words with a GAP for each gap."""
    return F.transform(pieces, lambda p: F.struct(p["meta"].alias("meta"), p["context"].alias("context"), _marks(p["text"], letters, min_word, max_word).alias("words")))


def word_total(words: str) -> Column:
    """How many words the pieces have together."""
    one = lambda p: F.size(F.array_remove(p["words"], GAP))
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, p: n + one(p))


def postings(df: DataFrame, uri: str = "uri", pieces: str = "pieces", letters: str = LETTERS, stem: Callable[[Column], Column] | None = None, min_word: int = MIN_WORD, max_word: int = MAX_WORD, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """(uri, meta, context, term, pos, len) from an array of (meta, context, text) for each document.

    All array work is in one generator in the JVM; rows are made last.
    """
    marked = marked_pieces(pieces, letters, min_word, max_word, tokenizer)
    rows = df.select(F.col(uri).alias("uri"), F.posexplode(marked).alias("at", "t"))
    rows = rows.select("uri", "t.meta", "t.context", "t.term", (F.col("at") + 1).alias("pos")).where(F.col("term") != GAP)
    rows = rows.withColumn("len", F.octet_length("term"))
    return rows.withColumn("term", stem(F.col("term"))) if stem else rows


def text_postings(df: DataFrame, uri: str, text: str, meta: str, letters: str = LETTERS) -> DataFrame:
    """Postings of a plain text column in one field."""
    piece = F.array(F.struct(F.lit(meta).alias("meta"), F.lit(meta).alias("context"), F.col(text).alias("text")))
    return postings(df.select(F.col(uri).alias("uri"), piece.alias("pieces")), letters=letters)

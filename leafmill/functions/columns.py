"""Scalar functions as column expressions; all run in the JVM but for quoted lists and C escapes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import words

#: White space of trimming, as a set of characters.
SPACES = " \t\n\x0b\x0c\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c):
    """False for the empty string as well."""
    c = _col(c)
    return (F.length(c) > 0) & c.rlike("^[\\x00-\\x7f]*$")


def char_bytes(c):
    """UTF-8 bytes of the first character."""
    return F.octet_length(F.substring(_col(c), 1, 1))


def code_point(c):
    """Code point of the first character."""
    return F.ascii(_col(c))


def num_chars(c):
    return F.char_length(_col(c))


def lower(c):
    """Lower case with one code point for each of the text's."""
    return F.lower(F.replace(F.replace(_col(c), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def skip_space(c):
    return F.regexp_replace(_col(c), "^[ \\t\\n\\x0b\\f\\r]+", "")


def trim_space(c):
    """Without white space at both ends."""
    return F.regexp_replace(_col(c), "^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$", "")


def all_space(c):
    return _col(c).rlike("^[ \\t\\n\\x0b\\f\\r]*$")


def ctrl_to_space(c):
    """Control characters to spaces, in ASCII strings only."""
    c = _col(c)
    return F.when(is_ascii(c), F.regexp_replace(c, "[\\x00-\\x1f]", " ")).otherwise(c)


def string_to_int(c):
    """The number at the start of a string, 0 without one, null where it is out of range."""
    digits = F.regexp_extract(_col(c), "^\\s*([+-]?[0-9]+)", 1)
    return F.when(digits == "", 0).otherwise(digits.try_cast("int"))


def string_to_bool(c):
    c = _col(c)
    return F.coalesce(c.rlike("^[yY1]") | c.isin("on", "ON"), F.lit(False))


def int_to_string(c):
    return _col(c).cast("string")


def double_to_string(c):
    return F.format_string("%f", _col(c).cast("double"))


def date_to_string(y, m, d):
    """YYYYMMDD with parts held within 0-9999, 1-12 and 1-31."""
    held = lambda c, low, high: F.least(F.greatest(_col(c), F.lit(low)), F.lit(high)).cast("int")
    return F.format_string("%04d%02d%02d", held(y, 0, 9999), held(m, 1, 12), held(d, 1, 31))


def path_join(parts, joiner="."):
    return F.array_join(_col(parts), joiner)


def sorted_chars(c):
    """The distinct characters of a string in code-point order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(_col(c), ""), lambda x: x != ""))), "")


def reverse(c):
    return F.reverse(_col(c))


def is_valid_utf8(c):
    return F.is_valid_utf8(_col(c))


def char_index(c, char: str):
    """0-based place of a character, -1 without it."""
    return F.instr(_col(c), char) - 1


def last_char_index(c, char: str):
    """0-based last place of a character, -1 without it."""
    c = _col(c)
    return F.when(F.instr(c, char) > 0, F.char_length(c) - F.instr(F.reverse(c), char)).when(c.isNotNull(), F.lit(-1))


def byte_offset(c, n):
    """Where the n-th character (from 0) starts in the UTF-8 bytes; their number beyond the last one."""
    c = _col(c)
    return F.octet_length(F.substring(c, F.lit(1), F.lit(n).cast("int")))


def char_offset(c, n):
    """The number (from 0) of the character whose UTF-8 bytes hold byte n; the number of characters beyond."""
    c, n = _col(c), F.lit(n).cast("int")
    # a character starts at each byte that does not go on with one: all but 80-BF
    hexes = F.hex(F.substring(F.to_binary(c, F.lit("utf-8")), F.lit(1), n + 1))
    starts = F.size(F.filter(F.regexp_extract_all(hexes, F.lit(".."), F.lit(0)), lambda b: ~b.rlike("^[89AB]")))
    return F.when(n >= F.octet_length(c), F.char_length(c)).otherwise(starts - 1)


def char_at(c, n):
    """The n-th character (from 0), null beyond the last one."""
    found = F.substring(_col(c), F.lit(n).cast("int") + 1, F.lit(1))
    return F.when(found != "", found)


def file_ext(c):
    """Lower-cased text after the last dot if no slash follows it, else null."""
    c = _col(c)
    return F.when(c.rlike("\\.[^./]*$"), F.lower(F.regexp_extract(c, "\\.([^./]*)$", 1)))


def file_path(c):
    """The folder part with its slash; null for names without one and at the root."""
    c = _col(c)
    return F.when(c.rlike("^.+/[^/]*$"), F.regexp_extract(c, "^(.+/)[^/]*$", 1))


def looks_like_gz(c):
    return file_ext(c) == "gz"


def real_ext(c):
    """The extension; behind .gz that of the file inside."""
    c = _col(c)
    return F.when(looks_like_gz(c), file_ext(F.regexp_replace(c, "(?i)\\.gz$", ""))).otherwise(file_ext(c))


def time_format(c):
    """Epoch seconds as local time of the session's zone."""
    return F.date_format(F.timestamp_seconds(_col(c)), "yyyy-MM-dd HH:mm:ss z")


def time_print(c):
    """Seconds as HH:MM:SS, rounded."""
    s = F.round(_col(c)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def time_print_fine(c):
    """Seconds with five decimals, 9.99999 at most."""
    return F.format_string("%.5f", F.least(_col(c).cast("double"), F.lit(9.99999)))


def int_to_bytes(c):
    """Four big-endian bytes of an integer."""
    return F.unhex(F.lpad(F.hex(_col(c).cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))


def bytes_to_int(c):
    n = F.conv(F.hex(_col(c)), 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def char_class(c):
    """Names of the character classes of the first character, in a fixed order."""
    c = F.substring(_col(c), 1, 1)
    classes = {
        "alnum": "[\\p{IsAlphabetic}\\p{Nd}]", "alpha": "\\p{IsAlphabetic}", "ascii": "[\\x00-\\x7f]", "blank": "[\\p{Zs}\\t]", "cntrl": "[\\p{Cc}\\p{Zl}\\p{Zp}]",
        "digit": "[0-9]", "graph": "[^\\p{IsWhite_Space}\\p{Cc}\\p{Cs}\\p{Cn}]", "lower": "\\p{IsLowercase}", "print": "[\\p{Zs}[^\\p{IsWhite_Space}\\p{Cc}\\p{Cs}\\p{Cn}]]",
        "punct": "[^\\p{IsAlphabetic}\\p{Nd}\\p{IsWhite_Space}\\p{Cc}\\p{Cs}\\p{Cn}]", "space": "\\p{IsWhite_Space}", "title": "\\p{Lt}", "upper": "\\p{IsUppercase}", "word": "[\\p{IsAlphabetic}\\p{Nd}_]", "xdigit": "[0-9A-Fa-f]",
    }
    return F.filter(F.array(*(F.when(c.rlike(f"^{p}$"), k) for k, p in classes.items())), lambda x: x.isNotNull())


def strip_markup(c):
    return F.regexp_replace(_col(c), "(?s)<.+?>", "")


def snippet(text, term, width: int = 60):
    """The text around the first place of a term, with the term between asterisks; the start if it is absent."""
    text, term = _col(text), term if isinstance(term, Column) else F.lit(term)
    at = F.call_function("locate", F.lower(term), F.lower(text))
    start = F.greatest(F.lit(1), at - width)
    n = F.char_length(term)
    found = F.concat(F.substr(text, start, at - start), F.lit("*"), F.substr(text, at, n), F.lit("*"), F.substr(text, at + n, F.lit(width)))
    return F.when(at > 0, found).otherwise(F.substr(text, F.lit(1), F.lit(2 * width)))


_LETTERS, _CONTROLS = "abtnvfr", "\a\b\t\n\v\f\r"


def escape_utf8(c):
    """ASCII spelling of a text, as words.escape_text()."""
    def one(p: Column) -> Column:
        n = F.ascii(p)
        digits = lambda size: F.lpad(F.hex(n), size, "0")
        plain = F.when((n >= 32) & (n < 127) & (n != 92), p).when(n == 92, F.lit("\\\\")).when(n.between(7, 13), F.concat(F.lit("\\"), F.translate(p, _CONTROLS, _LETTERS)))
        return plain.when(n < 128, F.concat(F.lit("\\x"), digits(2))).when(n < 1 << 16, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))

    return F.array_join(F.transform(F.regexp_extract_all(_col(c), F.lit("[ -\\[\\]-~]+|(?s:.)"), F.lit(0)), one), "")


def unescape_utf8(c):
    """The text of an ASCII spelling, as words.unescape_text(); numbers of no character give U+FFFD."""
    def char(digits: Column, base: int) -> Column:
        n = F.conv(digits, base, 10).cast("long")
        n = F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(n)
        return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def one(p: Column) -> Column:
        behind = F.substr(p, F.lit(2))
        number = F.when(p.rlike("^.[xuU][0-9A-Fa-f]"), char(F.substr(p, F.lit(3)), 16)).when(p.rlike("^.[0-7]"), char(behind, 8))
        return F.when(~p.startswith("\\") | (p == "\\"), p).otherwise(number.otherwise(F.translate(behind, _LETTERS, _CONTROLS)))

    escapes = "x[0-9A-Fa-f]{1,2}|u[0-9A-Fa-f]{1,4}|U[0-9A-Fa-f]{1,8}|[0-7]{1,3}|(?s:.)"
    return F.array_join(F.transform(F.regexp_extract_all(_col(c), F.lit(f"[^\\\\]+|\\\\(?:{escapes})?"), F.lit(0)), one), "")


@F.pandas_udf(ArrayType(StringType()))
def split_words(s: pd.Series) -> pd.Series:
    """Words of the first line, with quotes and backslashes as words.split_words(); null for null."""
    return s.map(words.split_words, na_action="ignore")


def merge_words(first, second):
    """The second list with the first one's words behind it; repeats stay."""
    return F.concat(_col(second), _col(first))


@F.pandas_udf(StringType())
def unescape_c(s: pd.Series) -> pd.Series:
    return s.map(words.unescape_c, na_action="ignore")


def to_int(c):
    """The decimal number at the start of a text, 0 if there is none; null where it is out of range."""
    digits = F.regexp_extract(F.coalesce(_col(c), F.lit("")), "^\\s*([+-]?\\d+)", 1)
    return F.when(digits == "", 0).otherwise(digits.try_cast("int"))


def to_bool(c):
    """True for what starts with y, Y or 1, and for on and ON."""
    return F.coalesce(_col(c).rlike("^[yY1]|^(?:on|ON)$"), F.lit(False))

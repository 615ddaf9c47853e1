"""Driver-side string helpers: quoted word lists and escapes."""

from __future__ import annotations

import re

_C_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_ESCAPED = {v: f"\\{k}" for k, v in _C_ESCAPES.items()} | {"\\": "\\\\"}


def split_words(line: str | None) -> list[str]:
    """Words of one line; quotes keep spaces together, a backslash escapes inside quotes only."""
    if line is None:
        return []
    line, out, at = line.split("\n", 1)[0], [], 0
    while True:
        while at < len(line) and line[at].isspace():
            at += 1
        if at == len(line):
            return out
        quote = line[at] if line[at] in "\"'" else ""
        at += bool(quote)
        word, escaped = "", False
        while at < len(line):
            c = line[at]
            at += 1
            if c == "\\" and quote and not escaped:
                escaped = True
                continue
            if c == "\r" or not escaped and (c == quote or not quote and c.isspace()):
                break
            word, escaped = word + c, False
        word += "\\" if escaped else ""
        if not word:
            return out
        out.append(word)


def merge_words(first: list[str], second: list[str]) -> list[str]:
    """The second list with the first one's words behind it; repeats stay."""
    return [*second, *first]


def fold_case(text: str) -> str:
    """Lower case with one code point for each of the text's, as columns.lower()."""
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def unescape_c(text: str) -> str:
    """Control sequences of C: letters, \\xHH, \\0oct; any other escaped character is itself."""
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16) & 255)
        if m[2]:
            return chr(int(m[2], 8) & 255)
        return _C_ESCAPES.get(m[3], m[3]) if m[3] else "\\"

    return re.sub(r"\\(?:x([0-9A-Fa-f]+)|(0[0-7]*)|(.)|$)", one, text, flags=re.DOTALL)


def escape_text(text: str | None) -> str | None:
    """ASCII spelling of a text: C escapes, \\xHH for other controls, \\uXXXX and \\UXXXXXXXX beyond ASCII."""
    if text is None:
        return None

    def one(c: str) -> str:
        n = ord(c)
        if c in _ESCAPED:
            return _ESCAPED[c]
        if n < 32 or n == 127:
            return f"\\x{n:02X}"
        return c if n < 128 else f"\\u{n:04X}" if n < 1 << 16 else f"\\U{n:08X}"

    return "".join(map(one, text))


def unescape_text(text: str | None) -> str | None:
    """The text of an ASCII spelling; octal escapes have up to three digits."""
    if text is None:
        return None

    def one(m: re.Match) -> str:
        if m[1]:
            n = int(m[1][1:], 16)
            return chr(n) if n < 0x110000 else "\ufffd"
        if m[2]:
            return chr(int(m[2], 8))
        return _C_ESCAPES.get(m[3], m[3])

    return re.sub(r"\\(?:(x[0-9A-Fa-f]{1,2}|u[0-9A-Fa-f]{1,4}|U[0-9A-Fa-f]{1,8})|([0-7]{1,3})|(.))", one, text, flags=re.DOTALL)


def to_int(text: str | None) -> int:
    """The decimal number at the start of a text, 0 if there is none; what follows it is ignored."""
    m = re.match(r"\s*([+-]?\d+)", text or "")
    n = int(m[1]) if m else 0
    if not -(1 << 31) <= n < 1 << 31:
        raise ValueError(f"number out of range: {text}")
    return n


def to_bool(text: str | None) -> bool:
    """True for what starts with y, Y or 1, and for on and ON."""
    return bool(text) and (text[0] in "yY1" or text in ("on", "ON"))

"""Character references: the longest named reference that a text begins with, numeric ones, and whole texts."""

from __future__ import annotations

import re
from html.entities import html5 as NAMED

#: Names that count without a semicolon, and the length of the longest.
BARE = {n for n in NAMED if not n.endswith(";")}
_BARE_MOST = max(map(len, BARE))
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([a-zA-Z][a-zA-Z0-9]*;?))")


def numeric(code: int) -> str:
    """The character of a numeric reference: 128-159 are read as Windows-1252, what is no character as U+FFFD."""
    if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "�"
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    return chr(code)


def lookup(name: str) -> tuple[str, str] | None:
    """(characters, rest) for the longest reference name that name (without &) begins with; None if there is none."""
    if name in NAMED:
        return NAMED[name], ""
    semicolon = name.find(";") + 1
    if semicolon and name[:semicolon] in NAMED:
        return NAMED[name[:semicolon]], name[semicolon:]
    for n in range(min(_BARE_MOST, len(name)), 1, -1):
        if name[:n] in BARE:
            return NAMED[name[:n]], name[n:]
    return None


def unescape(text: str, attribute: bool = False) -> str:
    """text with its references decoded; in attribute values a name without semicolon before = or a letter or digit stays."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            digits = (m[1] or m[2]).lstrip("0") or "0"
            return numeric(int(digits, 16 if m[1] else 10) if len(digits) < 9 else 0x110000)
        found = lookup(m[3])
        if found is None:
            return m[0]
        value, rest = found
        if attribute and not m[3][:len(m[3]) - len(rest)].endswith(";"):
            after = (rest + m.string[m.end():m.end() + 1])[:1]
            if after == "=" or after.isascii() and after.isalnum():
                return m[0]
        return value + rest

    return _REFERENCE.sub(one, text)

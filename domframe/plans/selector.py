"""CSS selectors: text to chains of compound selectors, and those to predicates over node rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What splits a class attribute: breaking Unicode white space.
CLASS_BREAK = "[\\t\\n\\x0B\\f\\r \\x85\\u1680\\u2000-\\u2006\\u2008-\\u200A\\u2028\\u2029\\u205F\\u3000]+"
OPERATORS = {"=": "equal", "^=": "prefix", "$=": "suffix", "*=": "substring"}
COMBINATORS = {">": "child", "+": "adjacent_sibling", "~": "general_sibling"}
_BLANK = " \t\n\r\f"
_IDENT = re.compile(r"[A-Za-z0-9_-]+")
_BARE = re.compile(r"[A-Za-z0-9_.-][A-Za-z0-9_.:/-]*")


@dataclass(frozen=True)
class Attribute:
    name: str
    value: str | None = None
    match: str = "exists"


@dataclass(frozen=True)
class Compound:
    type: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attributes: tuple[Attribute, ...] = ()


@dataclass
class _Part:
    type: str | None = None
    id: str | None = None
    classes: list[str] = field(default_factory=list)
    attributes: list[Attribute] = field(default_factory=list)

    def done(self) -> Compound:
        return Compound(self.type, self.id, tuple(self.classes), tuple(self.attributes))


def lex(text: str) -> list[tuple[str, str | None]]:
    """Tokens (kind, value): ident, star, class, id, whitespace, comma, child and the like, [, ], operators, string.

    Raises ValueError for anything selectors don't have.
    """
    text, at, out, bracket = text.strip(), 0, [], False
    while at < len(text):
        c = text[at]
        if c in _BLANK:
            while at < len(text) and text[at] in _BLANK:
                at += 1
            if not bracket:
                out.append(("whitespace", None))
        elif c in COMBINATORS and not bracket:
            out.append((COMBINATORS[c], None))
            at += 1
        elif text[at:at + 2] in OPERATORS:
            out.append((OPERATORS[text[at:at + 2]], None))
            at += 2
        elif c == "=":
            out.append(("equal", None))
            at += 1
        elif c == "*":
            out.append(("star", None))
            at += 1
        elif c in ".#" and not bracket:
            m = _IDENT.match(text, at + 1)
            if m is None:
                raise ValueError(f"Expected identifier after {c!r}")
            out.append(("class" if c == "." else "id", m[0]))
            at = m.end()
        elif c == ",":
            out.append(("comma", None))
            at += 1
        elif c in "[]":
            bracket = c == "["
            out.append((c, None))
            at += 1
        elif c in "\"'":
            value, at = [], at + 1
            while at < len(text) and text[at] != c:
                if text[at] == "\\" and at + 1 < len(text):
                    at += 1
                value.append(text[at])
                at += 1
            if at >= len(text):
                raise ValueError("Unterminated string in selector")
            out.append(("string", "".join(value)))
            at += 1
        elif m := (_BARE if bracket else _IDENT).match(text, at):
            out.append(("ident", m[0]))
            at = m.end()
        else:
            raise ValueError(f"Unexpected character in selector: {c!r}")
    return out


def compile_selector(text: str) -> list[list[tuple[str | None, Compound]]]:
    """Chains in the order of the list: (combinator, compound), None before the first.

    A missing compound matches any element; a trailing comma is ignored; an empty chain raises ValueError.
    """
    tokens = lex(text)
    chains, chain, part, joint, at = [], [], None, None, 0

    def close_part() -> None:
        nonlocal part, joint
        if part is not None:
            chain.append((joint if chain else None, part.done()))
            part = joint = None

    while at < len(tokens):
        kind, value = tokens[at]
        at += 1
        if kind == "comma":
            if joint not in (None, "descendant") and part is None:
                part = _Part()
            close_part()
            if not chain:
                raise ValueError("Empty selector in list")
            chains.append(chain)
            chain, joint = [], None
        elif kind == "whitespace":
            close_part()
            if chain and joint is None:
                joint = "descendant"
        elif kind in COMBINATORS.values():
            if part is None and (not chain or joint not in (None, "descendant")):
                part = _Part()
            close_part()
            joint = kind
        elif kind == "[":
            part = part or _Part()
            name = tokens[at] if at < len(tokens) else (None, None)
            if name[0] != "ident":
                raise ValueError("Expected attribute name")
            at += 1
            if at < len(tokens) and tokens[at][0] == "]":
                part.attributes.append(Attribute(name[1]))
                at += 1
                continue
            how = tokens[at][0] if at < len(tokens) else None
            if how not in OPERATORS.values():
                raise ValueError("Expected attribute operator or ']'")
            told = tokens[at + 1] if at + 1 < len(tokens) else (None, None)
            if told[0] not in ("ident", "string"):
                raise ValueError("Expected attribute value")
            if at + 2 >= len(tokens) or tokens[at + 2][0] != "]":
                raise ValueError("Expected ']'")
            part.attributes.append(Attribute(name[1], told[1], how))
            at += 3
        elif kind in ("ident", "star"):
            part = part or _Part()
            part.type = value if kind == "ident" else "*"
        elif kind == "class":
            part = part or _Part()
            part.classes.append(value)
        elif kind == "id":
            part = part or _Part()
            part.id = value
        else:
            raise ValueError(f"Unexpected token: {kind}")
    if joint not in (None, "descendant") and part is None:
        part = _Part()
    close_part()
    if chain:
        chains.append(chain)
    return chains


def attr(name: str, attrs: Column | str = "attrs") -> Column:
    """The value of an attribute without namespace; null if there is none."""
    return F.get(F.filter(F.col(attrs) if isinstance(attrs, str) else attrs, lambda a: a.ns.isNull() & (a["name"] == name)), F.lit(0)).value


def predicate(compound: Compound) -> Column:
    """Whether a node row matches; only elements outside templates can."""
    tests = [F.col("kind") == "element", ~F.col("in_content")]
    if compound.type not in (None, "*"):
        tests.append(F.col("tag") == compound.type)
    if compound.id is not None:
        tests.append(attr("id") == compound.id)
    if compound.classes:
        held = F.split(attr("class"), CLASS_BREAK)
        tests += [F.array_contains(held, c) for c in compound.classes]
    for a in compound.attributes:
        value = attr(a.name)
        tests.append({"exists": lambda v=value: v.isNotNull(), "equal": lambda v=value, a=a: v == a.value, "prefix": lambda v=value, a=a: F.startswith(v, F.lit(a.value)),
                      "suffix": lambda v=value, a=a: F.endswith(v, F.lit(a.value)), "substring": lambda v=value, a=a: F.contains(v, F.lit(a.value))}[a.match]())
    return reduce(lambda x, y: x & y, (F.coalesce(t, F.lit(False)) if k > 1 else t for k, t in enumerate(tests)))

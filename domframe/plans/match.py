"""Selectors, text and HTML of one page's node rows in Python: what the SQL functions evaluate next to the parse, without a join.

Rows are those of flatten.rows; results are those of the plans in operators, with their default options.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..operators.serialize import RAW_TEXT, VOID
from .selector import CLASS_BREAK, Compound

NODE, PARENT, END, DEPTH, ELEM, KIND, NS, TAG, ATTRS, TEXT, DOCTYPE, CONTENT, SCRIPT, STYLE, PARENT_TAG, HASH, CANON_PARENT, CANON_ELEM = 0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18
_BARE = re.compile("[^ \t\n\r\f\"'=>`]+")
_HOW = {"exists": lambda v, w: True, "equal": lambda v, w: v == w, "prefix": lambda v, w: v.startswith(w), "suffix": lambda v, w: v.endswith(w), "substring": lambda v, w: w in v}


def attr(row: tuple, name: str) -> str | None:
    return next((v for ns, n, v in row[ATTRS] if ns is None and n == name), None)


def matches(row: tuple, c: Compound) -> bool:
    if row[KIND] != "element" or row[CONTENT] or c.type not in (None, "*", row[TAG]) or c.id is not None and attr(row, "id") != c.id:
        return False
    if c.classes and not set(c.classes) <= set(re.split(CLASS_BREAK, attr(row, "class") or "")):
        return False
    return all((v := attr(row, a.name)) is not None and _HOW[a.match](v, a.value) for a in c.attributes)


def find(rows: list[tuple], chains: list) -> list[tuple]:
    """The rows that a compiled selector finds, in order, equal subtrees once."""
    order: dict[int, tuple] = {}
    for k, chain in enumerate(chains):
        now = {r[NODE]: (r[NODE],) for r in rows if matches(r, chain[0][1])}
        for how, compound in chain[1:]:
            right, ahead = [r for r in rows if matches(r, compound)], {}
            children: dict[int, list[tuple]] = {}
            if how != "descendant":
                for r in right:
                    children.setdefault(-1 if r[PARENT] is None else r[PARENT], []).append(r)
            for n, path in now.items():
                left = rows[n]
                if how == "descendant":
                    met = (r for r in right if n < r[NODE] <= left[END])
                elif how == "child":
                    met = iter(children.get(n, ()))
                else:
                    near = left[CANON_ELEM] + 1
                    met = (r for r in children.get(left[CANON_PARENT], ()) if r[ELEM] == near or how == "general_sibling" and r[ELEM] > near)
                for r in met:
                    to = (*path, r[NODE])
                    if r[NODE] not in ahead or to < ahead[r[NODE]]:
                        ahead[r[NODE]] = to
            now = ahead
        for n, path in now.items():
            order.setdefault(n, (k, *path))
    seen: set[str] = set()
    return [rows[n] for n in sorted(order, key=order.__getitem__) if rows[n][HASH] not in seen and not seen.add(rows[n][HASH])]


def text(rows: list[tuple], root: tuple | None = None) -> str:
    inside = rows if root is None else rows[root[NODE]:root[END] + 1]
    return "".join(r[TEXT] for r in inside if r[KIND] == "text" and not (r[CONTENT] or r[SCRIPT] or r[STYLE]))


def _start(row: tuple) -> Iterator[str]:
    yield f"<{row[TAG]}"
    for ns, name, value in row[ATTRS]:
        named = name if ns is None or name == "xmlns" else f"{ns}:{name}"
        if value in ("", name):
            yield f" {named}"
        elif _BARE.fullmatch(value):
            yield f" {named}={value}"
        else:
            escaped = value.replace("&", "&amp;")
            yield f" {named}='{escaped}'" if '"' in value and "'" not in value else f' {named}="{escaped.replace(chr(34), "&quot;")}"'
    yield ">"


def to_html(rows: list[tuple], root: tuple | None = None) -> str:
    out, ends = [], []  # (last node below, end tag)
    for r in rows if root is None else rows[root[NODE]:root[END] + 1]:
        while ends and ends[-1][0] < r[NODE]:
            out.append(ends.pop()[1])
        if r[PARENT_TAG] in VOID:
            continue
        if r[KIND] == "element":
            out.extend(_start(r))
            if r[TAG] not in VOID:
                ends.append((r[END], f"</{r[TAG]}>"))
        elif r[KIND] == "text":
            out.append(r[TEXT] if r[PARENT_TAG] in RAW_TEXT else r[TEXT].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif r[KIND] == "comment":
            out.append(f"<!--{r[TEXT]}-->")
        elif r[KIND] == "doctype":
            name, public, system = (x or "" for x in r[DOCTYPE])
            ids = f' PUBLIC "{public}" "{system}"' if public and system else f' PUBLIC "{public}"' if public else f' SYSTEM "{system}"' if system else ""
            out.append(f"<!DOCTYPE {name}{ids}>")
    return "".join(out) + "".join(tag for _, tag in reversed(ends))

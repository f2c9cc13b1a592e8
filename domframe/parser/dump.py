"""The indented dump of a tree in which golden cases are written."""

from __future__ import annotations

from .builder import Node


def dump(nodes: list[Node]) -> str:
    out, stack = [], [(n, 0) for n in reversed(nodes)]
    while stack:
        n, depth = stack.pop()
        pad = "| " + "  " * depth
        if n.kind == "text":
            out.append(f'{pad}"{n.text}"')
        elif n.kind == "comment":
            out.append(f"{pad}<!-- {n.text} -->")
        elif n.kind == "doctype":
            name, public, system = n.text
            ids = f' "{public or ""}" "{system or ""}"' if public or system else ""
            out.append(f"{pad}<!DOCTYPE {name or ''}{ids}>")
        elif n.kind == "content":
            out.append(f"{pad}content")
        else:
            out.append(f"{pad}<{n.ns + ' ' if n.ns else ''}{n.tag}>")
            named = sorted((" ".join(k) if isinstance(k, tuple) and k[0] != k[1] else k if isinstance(k, str) else k[1], v) for k, v in n.attrs.items())
            out += [f'{pad}  {k}="{v}"' for k, v in named]
        stack += [(c, depth + 1) for c in reversed(n.children)]
    return "\n".join(out)

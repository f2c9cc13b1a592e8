"""Trees to node rows, without recursion: nesting can be as deep as a page is long."""

from __future__ import annotations

import hashlib

from .builder import Node


def attributes(node: Node) -> list[tuple[str | None, str, str]]:
    """(namespace, name, value), namespaced ones first, then by name."""
    pairs = [(k[0], k[1], v) if isinstance(k, tuple) else (None, k, v) for k, v in node.attrs.items()]
    return sorted(pairs, key=lambda a: (a[0] is None, a[0] or "", a[1].encode("utf-8", "surrogatepass")))


def rows(roots: list[Node], hashed: bool = True) -> list[tuple]:
    """A tuple in the order of NODE_FIELDS for each node, in page order; without hashed, the last three fields are null."""
    order: list[Node] = []
    place: list[list] = []  # parent, depth, child_idx, elem_idx, in_content, in_script, in_style
    todo: list[tuple] = []

    def push(nodes: list[Node], parent: int | None, depth: int, flags: tuple[bool, bool, bool]) -> None:
        elements = sum(n.kind == "element" for n in nodes)
        for k in range(len(nodes) - 1, -1, -1):
            n = nodes[k]
            if n.kind == "element":
                elements -= 1
            todo.append((n, parent, depth, k, elements if n.kind == "element" else None, flags))

    push(roots, None, 0, (False, False, False))
    while todo:
        n, parent, depth, k, element, (content, script, style) = todo.pop()
        me = len(order)
        order.append(n)
        own = n.kind == "element" and n.ns is None
        script, style = script or own and n.tag == "script", style or own and n.tag == "style"
        place.append([parent, depth, k, element, content, script, style])
        if n.children:
            push(n.children, me, depth + 1, (content or n.kind == "content", script, style))
    ends = list(range(len(order)))
    below: list[list[bytes]] = [[] for _ in order]
    digests: list[bytes] = [b""] * len(order)
    lists = [attributes(n) for n in order]
    for me in range(len(order) - 1, -1, -1):
        parent = place[me][0]
        if parent is not None:
            ends[parent] = max(ends[parent], ends[me])
        if not hashed:
            continue
        n = order[me]
        h = hashlib.blake2b(repr((n.kind, n.ns, n.tag, lists[me], n.text)).encode("utf-8", "surrogatepass"), digest_size=16)
        for child in reversed(below[me]):
            h.update(child)
        digests[me] = h.digest()
        if parent is not None:
            below[parent].append(digests[me])
        below[me] = []
    first: dict[bytes, int] = {}
    for me in sorted(range(len(order)) if hashed else (), key=lambda k: (-1 if place[k][0] is None else place[k][0], place[k][2])):
        if not place[me][4] and order[me].kind != "content":
            first.setdefault(digests[me], me)
    out = []
    for me, n in enumerate(order):
        parent, depth, k, element, content, script, style = place[me]
        canon = place[first.get(digests[me], me)] if hashed else None
        out.append((me, parent, ends[me], depth, k, element, n.kind, n.ns, n.tag, lists[me] if n.kind == "element" else None, n.text if n.kind in ("text", "comment") else None,
                    n.text if n.kind == "doctype" else None, content, script, style, order[parent].tag if parent is not None else None, *((digests[me].hex(), -1 if canon[0] is None else canon[0], canon[3]) if hashed else (None, None, None))))
    return out

"""Tree construction by the WHATWG rules: tokens to a tree of nodes.

Names of insertion modes are methods; each takes a token and returns True if the token is to be handled again in
the mode it has switched to.  Scripting counts as on.  Deliberate differences from the rules are named in the README.
"""

from __future__ import annotations

import re

from .tokenizer import DATA, PLAINTEXT, RAWTEXT, RCDATA, SCRIPT, Tokenizer

# -- fixed values ---------------------------------------------------------------------------------------------------

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input keygen link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title".split())
SPECIAL = frozenset("""address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed
fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav
noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul
wbr xmp""".split())
SPECIAL_FOREIGN = frozenset((("math", "mi"), ("math", "mo"), ("math", "mn"), ("math", "ms"), ("math", "mtext"), ("math", "annotation-xml"), ("svg", "foreignObject"), ("svg", "desc"), ("svg", "title")))
BLOCK_STARTS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
BLOCK_ENDS = BLOCK_STARTS - {"p"} | {"button", "listing", "pre"}
IMPLIED_ENDS = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
THOROUGH_ENDS = IMPLIED_ENDS | frozenset("caption colgroup tbody td tfoot th thead tr".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE_SECTIONS = frozenset(("tbody", "tfoot", "thead"))
FOSTERING = TABLE_SECTIONS | {"table", "tr"}
BREAKOUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong
strike sub sup table tt u ul var""".split())
SVG_TAGS = {t.lower(): t for t in """altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite
feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology
feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath""".split()}
SVG_ATTRS = {t.lower(): t for t in """attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform
gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits
numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount
repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues
targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan""".split()}
NAMESPACED_ATTRS = {f"{p}:{n}": (p, n) for p, names in (("xlink", "actuate arcrole href role show title type"), ("xml", "lang space")) for n in names.split()} | {"xmlns": ("xmlns", "xmlns"), "xmlns:xlink": ("xmlns", "xlink")}
NOT_QUIRKY = ("-//W3C//DTD XHTML 1.0 Frameset//", "-//W3C//DTD XHTML 1.0 Transitional//", "-//W3C//DTD HTML 4.01 Frameset//", "-//W3C//DTD HTML 4.01 Transitional//")
#: Unicode White_Space, for the places where a text counts as blank.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0       " + "".join(map(chr, range(0x2000, 0x200B)))
_SPACES = re.compile(r"[\t\n\f\r ]*")
MARKER = None


class Node:
    __slots__ = ("attrs", "children", "kind", "ns", "parent", "tag", "text")

    def __init__(self, kind: str, tag: str | None = None, ns: str | None = None, attrs: dict | None = None, text: str | tuple | None = None):
        self.kind, self.tag, self.ns, self.attrs, self.text = kind, tag, ns, attrs if attrs is not None else {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def insert(self, node: Node, at: int | None = None) -> None:
        node.parent = self
        self.children.insert(len(self.children) if at is None else at, node)

    def detach(self) -> None:
        if self.parent is not None:
            siblings = self.parent.children
            del siblings[next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is self)]
            self.parent = None

    def is_html(self, *tags: str) -> bool:
        return self.ns is None and self.tag in tags


class Stack(list):
    """The open elements, which knows how many there are of each tag, so that deep nesting costs no search."""

    def __init__(self):
        super().__init__()
        self.tags: dict[str, int] = {}
        self.ids: set[int] = set()

    def _add(self, node: Node) -> None:
        self.tags[node.tag] = self.tags.get(node.tag, 0) + 1
        self.ids.add(id(node))

    def _drop(self, node: Node) -> None:
        self.tags[node.tag] -= 1
        self.ids.discard(id(node))

    def append(self, node: Node) -> None:
        self._add(node)
        super().append(node)

    def insert(self, at: int, node: Node) -> None:
        self._add(node)
        super().insert(at, node)

    def pop(self) -> Node:
        node = super().pop()
        self._drop(node)
        return node

    def __delitem__(self, at) -> None:
        for node in self[at] if isinstance(at, slice) else (self[at],):
            self._drop(node)
        super().__delitem__(at)

    def __setitem__(self, at: int, node: Node) -> None:
        self._drop(self[at])
        self._add(node)
        super().__setitem__(at, node)

    def has(self, tag: str) -> bool:
        """Whether an HTML element with that tag is open."""
        return bool(self.tags.get(tag)) and any(n.is_html(tag) for n in self)


def blank(text: str) -> bool:
    return not text.strip(BLANKS)


class Builder:
    def __init__(self, html: str, context: str | None = None):
        self.doc, self.open, self.active = Node("document"), Stack(), []
        self.head = self.form = None
        self.frameset_ok, self.fostering, self.quirks, self.skip_newline = True, False, False, False
        self.mode, self.back, self.template_modes, self.table_text = "initial", "in_body", [], []
        self.doctype: Node | None = None
        self.context: Node | None = None
        self.tokens = Tokenizer(html)
        self.tokens.foreign = lambda: bool(self.open) and self._current().ns is not None
        if context is not None:
            self._fragment(context)

    def build(self) -> list[Node]:
        while (token := self.tokens.next()) is not None:
            self._feed(token)
        return self._finish()

    # -- driver ---------------------------------------------------------------------------------------------------

    def _fragment(self, context: str) -> None:
        ns, _, tag = context.rpartition(" ")
        self.context = Node("element", tag, ns or None)
        root = Node("element", "html")
        self.doc.insert(root)
        self.open.append(root)
        if not ns:
            if tag in ("title", "textarea"):
                self.tokens.state = RCDATA
            elif tag in ("style", "xmp", "iframe", "noembed", "noframes", "noscript"):
                self.tokens.state = RAWTEXT
            elif tag in ("script", "plaintext"):
                self.tokens.state = SCRIPT if tag == "script" else PLAINTEXT
            self.tokens.last_start = tag if self.tokens.state != DATA else None
            if tag == "template":
                self.template_modes.append("in_template")
        self._reset_mode()

    def _current(self) -> Node:
        """The adjusted current node."""
        return self.context if self.context is not None and len(self.open) == 1 else self.open[-1]

    def _feed(self, token: tuple) -> None:
        kind = token[0]
        if kind == "doctype":
            if self.mode == "initial":
                _, name, public, system, quirks = token
                self.doctype = Node("doctype", text=(name, public, system))
                self.quirks = self._quirky(name, public, system, quirks)
                self.mode = "before_html"
            return
        if kind == "chars" and self.skip_newline:
            token = ("chars", token[1].removeprefix("\n"))
            self.skip_newline = False
            if not token[1]:
                return
        self.skip_newline = False
        while True:
            if self.mode == "in_table_text" and kind != "chars":
                self._flush_table_text()
                self.mode = self.back
            if self._foreign(token):
                if self._in_foreign(token) is not True:
                    break
            elif getattr(self, self.mode)(token) is not True:
                break

    @staticmethod
    def _quirky(name: str | None, public: str | None, system: str | None, forced: bool) -> bool:
        if forced or (name or "").lower() != "html":
            return True
        if public:
            return not (system and public.startswith(NOT_QUIRKY))
        return bool(system) and system != "about:legacy-compat"

    def _foreign(self, token: tuple) -> bool:
        if not self.open:
            return False
        at = self._current()
        if at.ns is None:
            return False
        kind = token[0]
        if at.ns == "math" and at.tag in ("mi", "mo", "mn", "ms", "mtext"):
            if kind == "chars" or kind == "start" and token[1] not in ("mglyph", "malignmark"):
                return False
        if at.ns == "math" and at.tag == "annotation-xml":
            if kind == "start" and token[1] == "svg":
                return False
        html = at.ns == "svg" and at.tag in ("foreignObject", "desc", "title") or at.ns == "math" and at.tag == "annotation-xml" and at.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")
        return not (html and kind in ("chars", "start"))

    # -- places and insertion -------------------------------------------------------------------------------------

    @staticmethod
    def _inside(node: Node) -> Node:
        """Where children of a node go: a template's into its content."""
        if node.is_html("template") and node.children and node.children[0].kind == "content":
            return node.children[0]
        return node

    def _place(self, target: Node | None = None) -> tuple[Node, int | None]:
        target = target or self.open[-1]
        if self.fostering and target.ns is None and target.tag in FOSTERING:
            for k in range(len(self.open) - 1, -1, -1):
                node = self.open[k]
                if node.is_html("template"):
                    return self._inside(node), None
                if node.is_html("table"):
                    if node.parent is not None:
                        siblings = node.parent.children
                        return node.parent, next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is node)
                    return self._inside(self.open[k - 1]), None
            return self.open[0], None
        return self._inside(target), None

    def _text(self, data: str) -> None:
        parent, at = self._place()
        if parent is self.doc:
            return
        before = parent.children[-1 if at is None else at - 1] if parent.children and at != 0 else None
        if before is not None and before.kind == "text":
            before.text += data
        else:
            parent.insert(Node("text", text=data), at)

    def _comment(self, data: str, parent: Node | None = None) -> None:
        parent, at = (parent, None) if parent is not None else self._place()
        parent.insert(Node("comment", text=data), at)

    def _element(self, name: str, attrs: dict, ns: str | None = None, keep: bool = True) -> Node:
        node = Node("element", name, ns, dict(attrs))
        if ns is None and name == "template":
            node.insert(Node("content"))
        parent, at = self._place() if self.open else (self.doc, None)
        parent.insert(node, at)
        if keep:
            self.open.append(node)
        return node

    def _raw(self, token: tuple) -> None:
        """An element whose text the tokenizer reads on its own."""
        self._element(token[1], token[2])
        self.tokens.switch(token[1], token[3], False)
        self.back, self.mode = self.mode, "text"

    # -- scopes and ends ------------------------------------------------------------------------------------------

    def _in_scope(self, tags, extra=frozenset(), only=None) -> bool:
        if not any(self.open.tags.get(t) for t in tags):
            return False
        for node in reversed(self.open):
            if node.ns is None:
                if node.tag in tags:
                    return True
                if only is not None and node.tag in only or only is None and (node.tag in SCOPE or node.tag in extra):
                    return False
            elif only is None and (node.ns, node.tag) in SPECIAL_FOREIGN:
                return False
        return False

    def _scope(self, *tags: str) -> bool:
        return self._in_scope(tags)

    def _button_scope(self, *tags: str) -> bool:
        return self._in_scope(tags, frozenset(("button",)))

    def _table_scope(self, *tags: str) -> bool:
        return self._in_scope(tags, only=frozenset(("html", "table", "template")))

    def _select_scope(self) -> bool:
        return self.open.has("select")

    def _imply(self, but: str | None = None, tags=IMPLIED_ENDS) -> None:
        while self.open and self.open[-1].ns is None and self.open[-1].tag in tags and self.open[-1].tag != but:
            self.open.pop()

    def _pop_to(self, *tags: str) -> None:
        """Pops up to and including the nearest HTML element of those."""
        while self.open:
            if self.open.pop().is_html(*tags):
                return

    def _close_p(self) -> None:
        if self._button_scope("p"):
            self._imply("p")
            self._pop_to("p")

    def _clear_to(self, *tags: str) -> None:
        while self.open and not self.open[-1].is_html(*tags, "template", "html"):
            self.open.pop()

    # -- active formatting elements -------------------------------------------------------------------------------

    def _remember(self, node: Node) -> None:
        same = 0
        for k in range(len(self.active) - 1, -1, -1):
            other = self.active[k]
            if other is MARKER:
                break
            if other.tag == node.tag and other.ns == node.ns and other.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[k]
                    break
        self.active.append(node)

    def _to_marker(self) -> None:
        while self.active and self.active.pop() is not MARKER:
            pass

    def _is_open(self, node: Node) -> bool:
        return id(node) in self.open.ids

    def _place_of(self, where: list, node: Node) -> int:
        return next((k for k in range(len(where) - 1, -1, -1) if where[k] is node), -1)

    def _reconstruct(self) -> None:
        k = len(self.active)
        while k and self.active[k - 1] is not MARKER and not self._is_open(self.active[k - 1]):
            k -= 1
        for i in range(k, len(self.active)):
            self.active[i] = self._element(self.active[i].tag, self.active[i].attrs)

    def _adopt(self, tag: str) -> None:
        """The adoption agency: ends a formatting element across blocks."""
        if self.open[-1].is_html(tag) and self._place_of(self.active, self.open[-1]) < 0:
            self.open.pop()
            return
        for _ in range(8):
            found = None
            for node in reversed(self.active):
                if node is MARKER:
                    break
                if node.tag == tag:
                    found = node
                    break
            if found is None:
                self._any_end(tag)
                return
            where = self._place_of(self.open, found)
            if where < 0:
                del self.active[self._place_of(self.active, found)]
                return
            if not self._in_scope_node(found):
                return
            block = next((n for n in self.open[where + 1:] if self._special(n)), None)
            if block is None:
                del self.open[where:]
                del self.active[self._place_of(self.active, found)]
                return
            ancestor, mark = self.open[where - 1], self._place_of(self.active, found)
            last, at, count = block, self._place_of(self.open, block), 0
            while True:
                count += 1
                at -= 1
                node = self.open[at]
                if node is found:
                    break
                listed = self._place_of(self.active, node)
                if count > 3 and listed >= 0:
                    del self.active[listed]
                    if listed < mark:
                        mark -= 1
                    listed = -1
                if listed < 0:
                    del self.open[at]
                    continue
                copy = Node("element", node.tag, node.ns, dict(node.attrs))
                self.active[listed] = self.open[at] = copy
                if last is block:
                    mark = listed + 1
                last.detach()
                copy.insert(last)
                last = copy
            last.detach()
            kept, self.fostering = self.fostering, True
            parent, place = self._place(ancestor)
            self.fostering = kept
            parent.insert(last, place)
            copy, into = Node("element", found.tag, found.ns, dict(found.attrs)), self._inside(block)
            for child in into.children:
                copy.insert(child)
            into.children = []
            into.insert(copy)
            old = self._place_of(self.active, found)
            del self.active[old]
            self.active.insert(mark - 1 if old < mark else mark, copy)
            del self.open[self._place_of(self.open, found)]
            self.open.insert(self._place_of(self.open, block) + 1, copy)

    def _in_scope_node(self, target: Node) -> bool:
        for node in reversed(self.open):
            if node is target:
                return True
            if node.ns is None and node.tag in SCOPE or (node.ns, node.tag) in SPECIAL_FOREIGN:
                return False
        return False

    @staticmethod
    def _special(node: Node) -> bool:
        return node.tag in SPECIAL if node.ns is None else (node.ns, node.tag) in SPECIAL_FOREIGN

    def _any_end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            node = self.open[k]
            if node.is_html(tag):
                self._imply(tag)
                k = self._place_of(self.open, node)
                if k >= 0:
                    del self.open[k:]
                return
            if self._special(node):
                return

    # -- modes ----------------------------------------------------------------------------------------------------

    def _reset_mode(self) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            node = self.context if k == 0 and self.context is not None else self.open[k]
            tag = node.tag if node.ns is None else None
            if tag == "select":
                inside = any(n.is_html("table") for n in self.open[:k]) and k > 0
                self.mode = "in_select_in_table" if inside else "in_select"
            elif tag in ("td", "th") and k > 0:
                self.mode = "in_cell"
            elif tag == "tr":
                self.mode = "in_row"
            elif tag in TABLE_SECTIONS:
                self.mode = "in_table_body"
            elif tag == "caption":
                self.mode = "in_caption"
            elif tag == "colgroup":
                self.mode = "in_column_group"
            elif tag == "table":
                self.mode = "in_table"
            elif tag == "template":
                self.mode = self.template_modes[-1] if self.template_modes else "in_body"
            elif tag == "head" and k > 0:
                self.mode = "in_head"
            elif tag == "body":
                self.mode = "in_body"
            elif tag == "frameset":
                self.mode = "in_frameset"
            elif tag == "html":
                self.mode = "before_head" if self.head is None else "after_head"
            elif k == 0:
                self.mode = "in_body"
            else:
                continue
            return
        self.mode = "in_body"

    def _lead(self, t: tuple) -> tuple[str, tuple | None]:
        """The blanks a text begins with, and a token of the rest."""
        n = _SPACES.match(t[1]).end()
        return t[1][:n], ("chars", t[1][n:]) if n < len(t[1]) else None

    def _rest(self, mode: str, rest: tuple) -> None:
        self.mode = mode
        self._feed(rest)

    def initial(self, t):
        if t[0] == "comment":
            self._comment(t[1], self.doc)
            return None
        if t[0] == "chars":
            if blank(t[1]):
                return None
            _, t = self._lead(t)
            self.quirks = True
            self._rest("before_html", t)
            return None
        self.quirks, self.mode = True, "before_html"
        return True

    def before_html(self, t):
        kind = t[0]
        if kind == "comment":
            self._comment(t[1], self.doc)
            return None
        if kind == "chars":
            _, rest = self._lead(t)
            if rest is None:
                return None
            self._element("html", {})
            self._rest("before_head", rest)
            return None
        if kind == "start" and t[1] == "html":
            self._element("html", t[2])
            self.mode = "before_head"
            return None
        if kind == "end" and t[1] not in ("head", "body", "html", "br"):
            return None
        self._element("html", {})
        self.mode = "before_head"
        return True

    def before_head(self, t):
        kind = t[0]
        if kind == "comment":
            self._comment(t[1])
            return None
        if kind == "chars":
            _, rest = self._lead(t)
            if rest is None:
                return None
            self.head = self._element("head", {})
            self._rest("in_head", rest)
            return None
        if kind == "start" and t[1] == "html":
            return self.in_body(t)
        if kind == "start" and t[1] == "head":
            self.head = self._element("head", t[2])
            self.mode = "in_head"
            return None
        if kind == "end" and t[1] not in ("head", "body", "html", "br"):
            return None
        self.head = self._element("head", {})
        self.mode = "in_head"
        return True

    def in_head(self, t):
        kind = t[0]
        if kind == "comment":
            self._comment(t[1])
            return None
        if kind == "chars":
            lead, rest = self._lead(t)
            if lead:
                self._text(lead)
            if rest is not None:
                self.open.pop()
                self._rest("after_head", rest)
            return None
        name = t[1]
        if kind == "start":
            if name == "html":
                return self.in_body(t)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self._element(name, t[2], keep=False)
                return None
            if name in ("title", "noscript", "noframes", "style", "script"):
                self._raw(t)
                return None
            if name == "template":
                self._element(name, t[2])
                self.active.append(MARKER)
                self.frameset_ok, self.mode = False, "in_template"
                self.template_modes.append("in_template")
                return None
            if name == "head":
                return None
        else:
            if name == "head":
                self.open.pop()
                self.mode = "after_head"
                return None
            if name == "template":
                self._end_template()
                return None
            if name not in ("body", "html", "br"):
                return None
        self.open.pop()
        self.mode = "after_head"
        return True

    def _end_template(self) -> None:
        if self.open.has("template"):
            self._imply(tags=THOROUGH_ENDS)
            self._pop_to("template")
            self._to_marker()
            if self.template_modes:
                self.template_modes.pop()
            self._reset_mode()

    def after_head(self, t):
        kind = t[0]
        if kind == "comment":
            self._comment(t[1])
            return None
        if kind == "chars":
            lead, rest = self._lead(t)
            if lead:
                self._text(lead)
            if rest is not None:
                self._element("body", {})
                self._rest("in_body", rest)
            return None
        name = t[1]
        if kind == "start":
            if name == "html":
                return self.in_body(t)
            if name == "body":
                self._element("body", t[2])
                self.frameset_ok, self.mode = False, "in_body"
                return None
            if name == "frameset":
                self._element("frameset", t[2])
                self.mode = "in_frameset"
                return None
            if name in HEAD_TAGS:
                self.open.append(self.head)
                again = self.in_head(t)
                at = self._place_of(self.open, self.head)
                if at >= 0:
                    del self.open[at]
                return again
            if name == "head":
                return None
        elif name == "template":
            self._end_template()
            return None
        elif name not in ("body", "html", "br"):
            return None
        self._element("body", {})
        self.mode = "in_body"
        return True

    def text(self, t):
        if t[0] == "chars":
            self._text(t[1])
            return None
        # After a self-closing raw element its content comes as markup, of which only text counts.
        if t[0] == "end" and self.open[-1].tag == t[1]:
            self.open.pop()
            self.mode = self.back
        return None

    def in_body(self, t):
        kind = t[0]
        if kind == "chars":
            self._reconstruct()
            self._text(t[1])
            if self.frameset_ok and not blank(t[1]):
                self.frameset_ok = False
            return None
        if kind == "comment":
            self._comment(t[1])
            return None
        if kind == "start":
            return self._body_start(t)
        return self._body_end(t)

    def _merge(self, node: Node, attrs: dict) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    def _body_start(self, t):
        _, name, attrs, closing = t
        if name == "html":
            if not self.open.has("template"):
                self._merge(self.open[0], attrs)
        elif name in HEAD_TAGS:
            return self.in_head(t)
        elif name == "body":
            if len(self.open) > 1 and self.open[1].is_html("body") and not self.open.has("template"):
                self.frameset_ok = False
                self._merge(self.open[1], attrs)
        elif name == "frameset":
            if len(self.open) > 1 and self.open[1].is_html("body") and self.frameset_ok:
                self.open[1].detach()
                del self.open[1:]
                self._element("frameset", attrs)
                self.mode = "in_frameset"
        elif name in BLOCK_STARTS:
            self._close_p()
            self._element(name, attrs)
        elif name in HEADINGS:
            self._close_p()
            if self.open[-1].is_html(*HEADINGS):
                self.open.pop()
            self._element(name, attrs)
        elif name in ("pre", "listing"):
            self._close_p()
            self._element(name, attrs)
            self.skip_newline, self.frameset_ok = True, False
        elif name == "form":
            template = self.open.has("template")
            if self.form is None or template:
                self._close_p()
                form = self._element(name, attrs)
                if not template:
                    self.form = form
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            same = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.is_html(*same):
                    self._imply(node.tag)
                    self._pop_to(node.tag)
                    break
                if self._special(node) and not node.is_html("address", "div", "p"):
                    break
            self._close_p()
            self._element(name, attrs)
        elif name == "plaintext":
            self._close_p()
            self._element(name, attrs)
            self.tokens.state = PLAINTEXT
        elif name == "button":
            if self._scope("button"):
                self._imply()
                self._pop_to("button")
            self._reconstruct()
            self._element(name, attrs)
            self.frameset_ok = False
        elif name == "a":
            for node in reversed(self.active):
                if node is MARKER:
                    break
                if node.tag == "a":
                    self._adopt("a")
                    for where in (self.active, self.open):
                        if (at := self._place_of(where, node)) >= 0:
                            del where[at]
                    break
            self._reconstruct()
            self._remember(self._element(name, attrs))
        elif name == "nobr":
            self._reconstruct()
            if self._scope("nobr"):
                self._adopt("nobr")
                self._reconstruct()
            self._remember(self._element(name, attrs))
        elif name in FORMATTING:
            self._reconstruct()
            self._remember(self._element(name, attrs))
        elif name in ("applet", "marquee", "object"):
            self._reconstruct()
            self._element(name, attrs)
            self.active.append(MARKER)
            self.frameset_ok = False
        elif name == "table":
            if not self.quirks:
                self._close_p()
            self._element(name, attrs)
            self.frameset_ok, self.mode = False, "in_table"
        elif name in ("area", "br", "embed", "img", "keygen", "wbr", "image"):
            self._reconstruct()
            self._element("img" if name == "image" else name, attrs, keep=False)
            self.frameset_ok = False
        elif name == "input":
            self._reconstruct()
            self._element(name, attrs, keep=False)
            if attrs.get("type", "").lower() != "hidden":
                self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self._element(name, attrs, keep=False)
        elif name == "hr":
            self._close_p()
            self._element(name, attrs, keep=False)
            self.frameset_ok = False
        elif name == "textarea":
            self._raw(t)
            self.skip_newline, self.frameset_ok = True, False
        elif name == "xmp":
            self._close_p()
            self._reconstruct()
            self.frameset_ok = False
            self._raw(t)
        elif name == "iframe":
            self.frameset_ok = False
            self._raw(t)
        elif name in ("noembed", "noscript"):
            self._raw(t)
        elif name == "select":
            self._reconstruct()
            self._element(name, attrs)
            self.frameset_ok = False
            self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"
        elif name in ("optgroup", "option"):
            if self.open[-1].is_html("option"):
                self.open.pop()
            self._reconstruct()
            self._element(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self._scope("ruby"):
                self._imply("rtc" if name in ("rp", "rt") else None)
            self._element(name, attrs)
        elif name in ("math", "svg"):
            self._reconstruct()
            self._foreign_element(name, name, attrs, closing)
        elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            pass
        else:
            self._reconstruct()
            self._element(name, attrs)
        return None

    def _body_end(self, t):
        name = t[1]
        if name == "template":
            self._end_template()
        elif name in ("body", "html"):
            if self._scope("body"):
                self.mode = "after_body"
                return name == "html" or None
        elif name in BLOCK_ENDS:
            if self._scope(name):
                self._imply()
                self._pop_to(name)
        elif name == "form":
            if self.open.has("template"):
                if self._scope("form"):
                    self._imply()
                    self._pop_to("form")
            else:
                form, self.form = self.form, None
                if form is not None and self._is_open(form) and self._in_scope_node(form):
                    self._imply()
                    del self.open[self._place_of(self.open, form)]
        elif name == "p":
            if not self._button_scope("p"):
                self._element("p", {})
            self._close_p()
        elif name == "li":
            if self._in_scope(("li",), frozenset(("ol", "ul"))):
                self._imply("li")
                self._pop_to("li")
        elif name in ("dd", "dt"):
            if self._scope(name):
                self._imply(name)
                self._pop_to(name)
        elif name in HEADINGS:
            if self._scope(*HEADINGS):
                self._imply()
                self._pop_to(*HEADINGS)
        elif name in FORMATTING:
            self._adopt(name)
        elif name in ("applet", "marquee", "object"):
            if self._scope(name):
                self._imply()
                self._pop_to(name)
                self._to_marker()
        elif name == "br":
            self._reconstruct()
            self._element("br", {}, keep=False)
            self.frameset_ok = False
        elif name in ("svg", "math") and (root := next((n for n in reversed(self.open) if n.ns == name and n.tag in ("svg", "math")), None)):
            del self.open[self._place_of(self.open, root):]  # through whatever is open inside
        else:
            self._any_end(name)
        return None

    # -- tables ---------------------------------------------------------------------------------------------------

    def _fostered(self, t):
        self.fostering = True
        again = self.in_body(t)
        self.fostering = False
        return again

    def in_table(self, t):
        kind = t[0]
        if kind == "chars":
            if self.open[-1].is_html("table", "tbody", "template", "tfoot", "thead", "tr"):
                self.table_text, self.back, self.mode = [], self.mode, "in_table_text"
                return True
            return self._fostered(t)
        if kind == "comment":
            self._comment(t[1])
            return None
        name = t[1]
        if kind == "start":
            if name == "caption":
                self._clear_to("table")
                self.active.append(MARKER)
                self._element(name, t[2])
                self.mode = "in_caption"
                return None
            if name in ("colgroup", "col"):
                self._clear_to("table")
                self._element("colgroup", t[2] if name == "colgroup" else {})
                self.mode = "in_column_group"
                return name == "col" or None
            if name in TABLE_SECTIONS or name in ("td", "th", "tr"):
                self._clear_to("table")
                section = name in TABLE_SECTIONS
                self._element(name if section else "tbody", t[2] if section else {})
                self.mode = "in_table_body"
                return not section or None
            if name == "table":
                if self._table_scope("table"):
                    self._pop_to("table")
                    self._reset_mode()
                    return True
                return None
            if name in ("style", "script", "template"):
                return self.in_head(t)
            if name == "input" and t[2].get("type", "").lower() == "hidden":
                self._element(name, t[2], keep=False)
                return None
            if name == "form":
                if self.form is None and not self.open.has("template"):
                    self.form = self._element(name, t[2], keep=False)
                return None
        else:
            if name == "table":
                if self._table_scope("table"):
                    self._pop_to("table")
                    self._reset_mode()
                return None
            if name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return None
            if name == "template":
                return self.in_head(t)
        return self._fostered(t)

    def in_table_text(self, t):
        self.table_text.append(t[1])
        return None

    def _flush_table_text(self) -> None:
        data, self.table_text = "".join(self.table_text), []
        if data:
            if blank(data):
                self._text(data)
            else:
                self._fostered(("chars", data))

    def in_caption(self, t):
        kind, name = t[0], t[1]
        closing = kind == "start" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr") or kind == "end" and name in ("caption", "table")
        if closing:
            if self._table_scope("caption"):
                self._imply()
                self._pop_to("caption")
                self._to_marker()
                self.mode = "in_table"
                return not (kind == "end" and name == "caption") or None
            return None
        if kind == "end" and name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return None
        return self.in_body(t)

    def in_column_group(self, t):
        kind = t[0]
        if kind == "comment":
            self._comment(t[1])
            return None
        if kind == "chars":
            lead, rest = self._lead(t)
            if lead:
                self._text(lead)
            if rest is not None and self.open[-1].is_html("colgroup"):
                self.open.pop()
                self._rest("in_table", rest)
            return None
        name = t[1]
        if kind == "start" and name == "html":
            return self.in_body(t)
        if kind == "start" and name == "col":
            self._element(name, t[2], keep=False)
            return None
        if name == "template":
            return self.in_head(t)
        if kind == "end" and name == "col":
            return None
        if self.open[-1].is_html("colgroup"):
            self.open.pop()
            self.mode = "in_table"
            return not (kind == "end" and name == "colgroup") or None
        return None

    def in_table_body(self, t):
        kind, name = t[0], t[1]
        if kind == "start" and name in ("tr", "td", "th"):
            self._clear_to(*TABLE_SECTIONS)
            self._element("tr", t[2] if name == "tr" else {})
            self.mode = "in_row"
            return name != "tr" or None
        if kind == "end" and name in TABLE_SECTIONS:
            if self._table_scope(name):
                self._clear_to(*TABLE_SECTIONS)
                self.open.pop()
                self.mode = "in_table"
            return None
        if kind == "start" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead") or kind == "end" and name == "table":
            if self._table_scope(*TABLE_SECTIONS):
                self._clear_to(*TABLE_SECTIONS)
                self.open.pop()
                self.mode = "in_table"
                return True
            return None
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return None
        return self.in_table(t)

    def in_row(self, t):
        kind, name = t[0], t[1]
        if kind == "start" and name in ("td", "th"):
            self._clear_to("tr")
            self._element(name, t[2])
            self.mode = "in_cell"
            self.active.append(MARKER)
            return None
        ends_row = kind == "end" and name in ("tr", "table") or kind == "start" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")
        if ends_row or kind == "end" and name in TABLE_SECTIONS:
            if kind == "end" and name in TABLE_SECTIONS and not self._table_scope(name):
                return None
            if self._table_scope("tr"):
                self._clear_to("tr")
                self.open.pop()
                self.mode = "in_table_body"
                return not (kind == "end" and name == "tr") or None
            return None
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return None
        return self.in_table(t)

    def in_cell(self, t):
        kind, name = t[0], t[1]
        if kind == "end" and name in ("td", "th"):
            if self._table_scope(name):
                self._imply()
                self._pop_to(name)
                self._to_marker()
                self.mode = "in_row"
            return None
        if kind == "start" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self._table_scope("td", "th"):
                self._close_cell()
                return True
            return None
        if kind == "end" and name in ("body", "caption", "col", "colgroup", "html"):
            return None
        if kind == "end" and name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self._table_scope(name):
                self._close_cell()
                return True
            return None
        return self.in_body(t)

    def _close_cell(self) -> None:
        self._imply()
        self._pop_to("td", "th")
        self._to_marker()
        self.mode = "in_row"

    # -- select: elements that are not its own are kept inside it ---------------------------------------------------

    def _inside_select(self) -> list[Node]:
        """The open elements below the select."""
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].is_html("select")), -1)
        return self.open[at + 1:]

    def _close_select(self) -> None:
        self._pop_to("select")
        self._reset_mode()

    def _reconstruct_in_select(self) -> None:
        """Formatting elements that aren't open, wherever they began since the last marker, each once."""
        since = []
        for node in reversed(self.active):
            if node is MARKER:
                break
            since.append(node)
        for node in reversed(since):
            if not self._is_open(node):
                copy = self._element(node.tag, node.attrs)
                self.active = [n for n in self.active if n is MARKER or n.tag != copy.tag or n.attrs != copy.attrs]
                self.active.append(copy)

    def in_select(self, t):
        kind = t[0]
        if kind == "chars":
            self._reconstruct_in_select()
            self._text(t[1])
            return None
        if kind == "comment":
            self._comment(t[1])
            return None
        name = t[1]
        return self._select_start(t, name) if kind == "start" else self._select_end(t, name)

    def _select_start(self, t, name):
        attrs, closing = t[2], t[3]
        if name == "html":
            return self.in_body(t)
        if name in ("option", "optgroup", "hr"):
            if self.open[-1].is_html("option"):
                self.open.pop()
            if name != "option" and self.open[-1].is_html("optgroup"):
                self.open.pop()
            self._element(name, attrs, keep=name != "hr")
        elif name == "select":
            if self._select_scope():
                self._close_select()
        elif name in ("input", "textarea"):
            if self._select_scope():
                self._close_select()
                return True
        elif name == "keygen":
            self._element(name, attrs, keep=False)
        elif name in ("script", "template"):
            return self.in_head(t)
        elif name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            pass
        elif name in ("svg", "math"):
            self._element(name, attrs, name, keep=not closing)
        else:
            node = self._element(name, attrs, keep=not (closing or name in VOID))
            if node is self.open[-1] and name in FORMATTING:
                self.active.append(node)
        return None

    def _select_end(self, t, name):
        if name == "optgroup":
            if self.open[-1].is_html("option") and len(self.open) > 1 and self.open[-2].is_html("optgroup"):
                self.open.pop()
            if self.open[-1].is_html("optgroup"):
                self.open.pop()
        elif name == "option":
            if self.open[-1].is_html("option"):
                self.open.pop()
        elif name == "select":
            if self._select_scope():
                self._close_select()
        elif name == "template":
            return self.in_head(t)
        elif name in FORMATTING:
            if any(n.is_html(name) for n in self._inside_select()):
                self._adopt(name)
        else:
            inside = self._inside_select()
            at = next((k for k in range(len(inside) - 1, -1, -1) if inside[k].is_html(name)), None)
            if at is not None and len(inside) < len(self.open):
                del self.open[len(self.open) - len(inside) + at:]
                self._reconstruct_in_select()
        return None

    def in_select_in_table(self, t):
        if t[0] in ("start", "end") and t[1] in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if t[0] == "start" or self._table_scope(t[1]):
                self._close_select()
                return True
            return None
        return self.in_select(t)

    # -- templates, ends and framesets ----------------------------------------------------------------------------

    def in_template(self, t):
        kind, name = t[0], t[1]
        if kind in ("chars", "comment"):
            return self.in_body(t)
        if kind == "start":
            if name in HEAD_TAGS:
                return self.in_head(t)
            mode = {"caption": "in_table", "colgroup": "in_table", "tbody": "in_table", "tfoot": "in_table", "thead": "in_table", "col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(name, "in_body")
            if self.template_modes:
                self.template_modes.pop()
            self.template_modes.append(mode)
            self.mode = mode
            return True
        if name == "template":
            self._end_template()
        return None

    def after_body(self, t):
        kind = t[0]
        if kind == "comment":
            self._comment(t[1], self.open[0])
            return None
        if kind == "chars":
            if not t[1].strip("\t\n\f\r "):
                return self.in_body(t)
        elif kind == "start" and t[1] == "html":
            return self.in_body(t)
        elif kind == "end" and t[1] == "html":
            if self.context is None:
                self.mode = "after_after_body"
            return None
        self.mode = "in_body"
        return True

    def after_after_body(self, t):
        kind = t[0]
        if kind == "comment":
            self._comment(t[1], self.doc)
            return None
        if kind == "chars" and not t[1].strip("\t\n\f\r ") or kind == "start" and t[1] == "html":
            return self.in_body(t)
        self.mode = "in_body"
        return True

    @staticmethod
    def _blanks_of(text: str) -> str:
        return "".join(c for c in text if c in "\t\n\f\r ")

    def in_frameset(self, t):
        kind, name = t[0], t[1]
        if kind == "chars":
            if data := self._blanks_of(t[1]):
                self._text(data)
        elif kind == "comment":
            self._comment(t[1])
        elif kind == "start":
            if name == "html":
                return self.in_body(t)
            if name == "frameset":
                self._element(name, t[2])
            elif name == "frame":
                self._element(name, t[2], keep=False)
            elif name == "noframes":
                return self.in_head(t)
        elif name == "frameset" and len(self.open) > 1:
            self.open.pop()
            if self.context is None and not self.open[-1].is_html("frameset"):
                self.mode = "after_frameset"
        return None

    def after_frameset(self, t):
        kind, name = t[0], t[1]
        if kind == "chars":
            if data := self._blanks_of(t[1]):
                self._text(data)
        elif kind == "comment":
            self._comment(t[1])
        elif kind == "start" and name == "html":
            return self.in_body(t)
        elif kind == "start" and name == "noframes":
            return self.in_head(t)
        elif kind == "end" and name == "html":
            self.mode = "after_after_frameset"
        return None

    def after_after_frameset(self, t):
        kind, name = t[0], t[1]
        if kind == "comment":
            self._comment(t[1], self.doc)
        elif kind == "chars":
            if data := self._blanks_of(t[1]):
                self._text(data)
        elif kind == "start" and name == "html":
            return self.in_body(t)
        elif kind == "start" and name == "noframes":
            return self.in_head(t)
        return None

    # -- foreign content ------------------------------------------------------------------------------------------

    def _foreign_element(self, name: str, ns: str, attrs: dict, closing: bool) -> None:
        own = {}
        for k, v in attrs.items():
            key = NAMESPACED_ATTRS.get(k) or (SVG_ATTRS.get(k, k) if ns == "svg" else "definitionURL" if k == "definitionurl" else k)
            own[key] = v
        self._element(SVG_TAGS.get(name, name) if ns == "svg" else name, own, ns, keep=not closing)

    def _in_foreign(self, t):
        kind = t[0]
        if kind == "chars":
            self._text(t[1].replace("\0", "�"))
            if not blank(t[1].replace("\0", "")):
                self.frameset_ok = False
            return None
        if kind == "comment":
            self._comment(t[1])
            return None
        name = t[1]
        if kind == "start" and (name in BREAKOUT or name == "font" and not {"color", "face", "size"}.isdisjoint(t[2])) or kind == "end" and name in ("br", "p"):
            while len(self.open) > 1:
                at = self.open[-1]
                if at.ns is None or at.ns == "math" and at.tag in ("mi", "mo", "mn", "ms", "mtext") or at.ns == "svg" and at.tag in ("foreignObject", "desc", "title") or at.ns == "math" and at.tag == "annotation-xml" and at.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml"):
                    break
                self.open.pop()
            # In a fragment whose context is foreign the HTML rules take it even so.
            return getattr(self, self.mode)(t)
        if kind == "start":
            self._foreign_element(name, self._current().ns, t[2], t[3])
            return None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].ns is None:
                return getattr(self, self.mode)(t)
            if self.open[k].tag.lower() == name:
                del self.open[k:]
                break
        return None

    # -- the finished tree ----------------------------------------------------------------------------------------

    def _finish(self) -> list[Node]:
        if self.mode == "in_table_text":
            self._flush_table_text()
        root = next((n for n in self.doc.children if n.kind == "element"), None)
        if self.context is None or self.context.is_html("html"):
            if root is None:
                root = Node("element", "html")
                self.doc.insert(root)
            if not any(n.is_html("head") for n in root.children):
                at = next((k for k, n in enumerate(root.children) if n.kind != "comment"), len(root.children))
                root.insert(Node("element", "head"), at)
            if not any(n.is_html("body", "frameset") for n in root.children):
                root.insert(Node("element", "body"))
        if self.context is not None:
            for n in root.children:
                n.parent = None
            return root.children
        self._fill_selected(root)
        return [*([self.doctype] if self.doctype else []), *self.doc.children]

    @staticmethod
    def _fill_selected(root: Node) -> None:
        """selectedcontent, a child of select or of its button, shows what the selected (or first) option holds."""
        stack, selects = [root], []
        while stack:
            node = stack.pop()
            if node.is_html("select"):
                selects.append(node)
            stack += node.children
        for select in reversed(selects):
            slot = next((n if n.is_html("selectedcontent") else b for n in select.children for b in ([n] if n.is_html("selectedcontent") else n.children if n.is_html("button") else ()) if b.is_html("selectedcontent")), None)
            options = [n for n in select.children if n.is_html("option")]
            if slot is None or not options:
                continue
            shown = next((n for n in options if "selected" in n.attrs), options[0])
            slot.children = []
            todo = [(n, slot) for n in shown.children]
            while todo:
                n, parent = todo.pop(0)
                copy = Node(n.kind, n.tag, n.ns, dict(n.attrs), n.text)
                parent.insert(copy)
                todo = [(c, copy) for c in n.children] + todo


def parse(html: str, context: str | None = None) -> list[Node]:
    """The nodes of a document, or with context (like "div" or "svg path") those of a fragment in that element."""
    return Builder(html, context).build()

"""HTML tokens from text, following the WHATWG tokenization rules with one scan per construct.

A token is a tuple: ("doctype", name, public, system, quirks), ("start", name, attrs, self_closing), ("end", name),
("comment", data) or ("chars", data).  The tree builder sets state and last_start between tokens and tells
through foreign whether CDATA sections are allowed.  A tag that the end of input cuts off gives no token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..functions.entities import unescape

DATA, RCDATA, RAWTEXT, SCRIPT, PLAINTEXT, CDATA = "data", "rcdata", "rawtext", "script_data", "plaintext", "cdata_section"
#: What a start tag switches the tokenizer to (fixed values).
RAWTEXT_TAGS = frozenset(("style", "xmp", "iframe", "noembed", "noframes", "noscript"))
RCDATA_TAGS = frozenset(("textarea", "title"))
#: A self-closing <script/>, <style/> or <title/> leaves the tokenizer in the data state.
SELF_CLOSING_SWITCHES = False

_NAME = re.compile(r"[^\t\n\f />]*")
_BLANK = re.compile(r"[\t\n\f ]*")
_ATTR = re.compile(r"=?[^\t\n\f />=]*")
_BARE = re.compile(r"[^\t\n\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_CUT_COMMENT = re.compile(r"(?:--!|--?)\Z")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.I)
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """text with A-Z lower-cased."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


class Tokenizer:
    def __init__(self, html: str, state: str = DATA, last_start: str | None = None, xml_violations: bool = False):
        self.src = html.replace("\r\n", "\n").replace("\r", "\n") if "\r" in html else html
        self.pos, self.state, self.last_start, self.xml = 0, state, last_start, xml_violations
        self.foreign: Callable[[], bool] = lambda: False
        self._ready: list[tuple] = []

    def __iter__(self) -> Iterator[tuple]:
        while (t := self.next()) is not None:
            yield t

    def next(self) -> tuple | None:
        """The next token; characters in a row are one token."""
        if self._ready:
            return self._ready.pop()
        text: list[str] = []
        while self.pos < len(self.src):
            token = self._step(text)
            if token is not None:
                if token[0] == "comment" and self.xml:
                    token = ("comment", token[1].replace("--", "- -"))
                if text:
                    self._ready.append(token)
                    break
                return token
        data = "".join(text)
        if self.xml:
            data = data.replace("￿", "�").replace("\f", " ")
        return ("chars", data) if data else (self._ready.pop() if self._ready else None)

    def switch(self, name: str, self_closing: bool, foreign: bool) -> None:
        """The state for what follows a start tag."""
        self.last_start = name
        if self_closing and not SELF_CLOSING_SWITCHES:
            return
        if name == "script":
            self.state = SCRIPT
        elif name in RAWTEXT_TAGS:
            self.state = RAWTEXT
        elif not foreign and name in RCDATA_TAGS:
            self.state = RCDATA
        elif not foreign and name == "plaintext":
            self.state = PLAINTEXT

    # -- states --------------------------------------------------------------------------------------------------

    def _step(self, text: list[str]) -> tuple | None:
        if self.state == DATA:
            return self._data(text)
        src, at = self.src, self.pos
        if self.state == CDATA:
            end = src.find("]]>", at)
            text.append(src[at:end if end >= 0 else len(src)])
            self.pos, self.state = (end + 3 if end >= 0 else len(src)), DATA
            return None
        end = len(src) if self.state == PLAINTEXT else self._raw_end(at)
        data = src[at:end].replace("\0", "�")
        text.append(unescape(data) if self.state == RCDATA else data)
        self.pos = end
        if end < len(src):
            self.state = DATA
            return self._tag(end + 2, True)
        return None

    def _raw_end(self, at: int) -> int:
        """Where the end tag stands that ends the raw text from at on."""
        src, name = self.src, self.last_start or ""
        if self.state != SCRIPT:
            m = re.compile(rf"</{re.escape(name)}(?=[\t\n\f />])", re.I).search(src, at) if name else None
            return m.start() if m else len(src)
        escaped = double = False
        while m := _SCRIPT.search(src, at):
            at = m.end()
            what = m[0]
            if what == "<!--":
                if not escaped:
                    escaped, at = True, m.start() + 2  # its dashes can be those of an end
            elif what == "-->":
                escaped = double = False
            elif m[1]:
                if not double:
                    if lower(name or "script") == "script":
                        return m.start()
                double = False
            elif escaped:
                double = True
        return len(src)

    def _data(self, text: list[str]) -> tuple | None:
        src, at = self.src, self.pos
        less = src.find("<", at)
        if less < 0:
            less = len(src)
        if less > at:
            text.append(unescape(src[at:less]))
            self.pos = less
            return None
        c = src[at + 1:at + 2]
        if c.isascii() and c.isalpha():
            return self._tag(at + 1, False)
        if c == "/":
            d = src[at + 2:at + 3]
            if d.isascii() and d.isalpha():
                return self._tag(at + 2, True)
            if d == ">":
                self.pos = at + 3
                return None
            if not d:
                text.append("</")
                self.pos = at + 2
                return None
            return self._bogus(at + 2)
        if c == "!":
            return self._markup(at + 2)
        if c == "?":
            return self._bogus(at + 1)
        text.append("<")
        self.pos = at + 1
        return None

    def _tag(self, at: int, end: bool) -> tuple | None:
        src, size = self.src, len(self.src)
        m = _NAME.match(src, at)
        name, at, attrs = lower(m[0]).replace("\0", "�"), m.end(), {}
        while True:
            at = _BLANK.match(src, at).end()
            c = src[at:at + 1]
            if not c:
                self.pos = size
                return None
            if c == ">":
                closing = False
                break
            if c == "/":
                if src[at + 1:at + 2] == ">":
                    at, closing = at + 1, True
                    break
                at += 1
                continue
            m = _ATTR.match(src, at)
            key, at = lower(m[0]).replace("\0", "�"), _BLANK.match(src, m.end()).end()
            value = ""
            if src[at:at + 1] == "=":
                at = _BLANK.match(src, at + 1).end()
                c = src[at:at + 1]
                if c in ('"', "'") and c:
                    stop = src.find(c, at + 1)
                    if stop < 0:
                        self.pos = size
                        return None
                    value, at = src[at + 1:stop], stop + 1
                elif c != ">":
                    m = _BARE.match(src, at)
                    value, at = m[0], m.end()
                value = unescape(value, True).replace("\0", "�")
            attrs.setdefault(key, value)
        self.pos = at + 1
        if end:
            return ("end", name)
        return ("start", name, attrs, closing)

    def _bogus(self, at: int) -> tuple:
        end = self.src.find(">", at)
        data = self.src[at:end if end >= 0 else len(self.src)]
        self.pos = end + 1 if end >= 0 else len(self.src)
        return ("comment", data.replace("\0", "�"))

    def _markup(self, at: int) -> tuple | None:
        src = self.src
        if src.startswith("--", at):
            at += 2
            for begin in (">", "->"):
                if src.startswith(begin, at):
                    self.pos = at + len(begin)
                    return ("comment", "")
            m = _COMMENT_END.search(src, at)
            data = src[at:m.start()] if m else _CUT_COMMENT.sub("", src[at:])
            self.pos = m.end() if m else len(src)
            return ("comment", data.replace("\0", "�"))
        if lower(src[at:at + 7]) == "doctype":
            return self._doctype(at + 7)
        if src.startswith("[CDATA[", at) and self.foreign():
            self.pos, self.state = at + 7, CDATA
            return None
        return self._bogus(at)

    def _doctype(self, at: int) -> tuple:
        """Name, then optionally PUBLIC or SYSTEM and quoted identifiers; anything else up to > is passed over."""
        src, size = self.src, len(self.src)
        name = public = system = None

        def done(where: int, quirks: bool) -> tuple:
            self.pos = min(where, size)
            return ("doctype", name, public, system, quirks)

        def skip(where: int) -> int:
            end = src.find(">", where)
            return end + 1 if end >= 0 else size

        def quoted(where: int) -> tuple[str | None, int, bool]:
            """(identifier, after it, whole); None if no quote stands there."""
            quote = src[where:where + 1]
            if quote not in ('"', "'") or not quote:
                return None, where, False
            stop = re.compile(f"[>{quote}]").search(src, where + 1)
            if stop is None:
                return src[where + 1:].replace("\0", "�"), size, False
            return src[where + 1:stop.start()].replace("\0", "�"), stop.end(), stop[0] == quote

        at = _BLANK.match(src, at).end()
        if at >= size or src[at] == ">":
            return done(at + 1, True)
        m = re.compile(r"[^\t\n\f >]*").match(src, at)
        name, at = lower(m[0]).replace("\0", "�"), _BLANK.match(src, m.end()).end()
        if at >= size:
            return done(size, True)
        if src[at] == ">":
            return done(at + 1, False)
        word = lower(src[at:at + 6])
        if word not in ("public", "system"):
            return done(skip(at), True)
        at = _BLANK.match(src, at + 6).end()
        first, after, whole = quoted(at)
        if first is None:
            return done(skip(at), True)
        if word == "public":
            public = first
        else:
            system = first
        if not whole:
            return done(after, True)
        at = _BLANK.match(src, after).end()
        if word == "public" and at < size and src[at] != ">":
            system, after, whole = quoted(at)
            if system is None:
                return done(skip(at), True)
            if not whole:
                return done(after, True)
            at = _BLANK.match(src, after).end()
        return done(skip(at), at >= size)


def tokenize(html: str, initial_state: str = DATA, last_start_tag: str | None = None, xml_violation_mode: bool = False) -> list[tuple]:
    """All tokens of a text, without a tree builder: start tags switch the state by their name."""
    t, out = Tokenizer(html, initial_state, last_start_tag, xml_violation_mode), []
    while (token := t.next()) is not None:
        if token[0] == "start":
            t.switch(token[1], token[3], False)
        out.append(token)
    return out

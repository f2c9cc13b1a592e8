"""The encoding of a page's bytes: transport label, byte order mark, meta prescan, then windows-1252."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Encoding of each label (fixed values).
LABELS = {
    "utf-8": ("utf-8", "utf8", "unicode-1-1-utf-8"),
    "windows-1252": ("iso-8859-1", "iso8859-1", "iso88591", "latin1", "latin-1", "l1", "ascii", "us-ascii", "cp819", "ibm819", "csisolatin1", "windows-1252", "windows1252", "cp1252", "x-cp1252"),
    "iso-8859-2": ("iso-8859-2", "iso8859-2", "iso88592", "latin2", "latin-2", "l2", "csisolatin2"),
    "euc-jp": ("euc-jp", "eucjp", "x-euc-jp", "cseucpkdfmtjapanese"),
    "utf-16": ("utf-16", "utf16"),
    "utf-16le": ("utf-16le", "utf16le"),
    "utf-16be": ("utf-16be", "utf16be"),
}
OF_LABEL = {label: name for name, labels in LABELS.items() for label in labels}
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
DEFAULT = "windows-1252"
#: Bytes outside comments that the prescan looks at.
BUDGET = 1024
_BLANK = b"\t\n\x0c\r "
_CHARSET = re.compile(rb"charset[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\t\n\f\r ;][^\t\n\f\r ;]*))", re.I)


def label(name: str | bytes | None) -> str | None:
    """The encoding a label stands for, or None."""
    if name is None:
        return None
    if isinstance(name, bytes):
        name = name.decode("latin-1")
    return OF_LABEL.get(name.strip("\t\n\f\r ").lower())


def _attributes(data: bytes, at: int) -> tuple[dict[bytes, bytes] | None, int]:
    """The attributes of a tag from at on, first ones win, and where it ends; None if it never does."""
    out: dict[bytes, bytes] = {}
    n = len(data)
    while True:
        while at < n and data[at] in _BLANK + b"/":
            at += 1
        if at >= n:
            return None, n
        if data[at] == 0x3E:
            return out, at + 1
        begin = at
        at += 1
        while at < n and data[at] not in _BLANK + b"/>=":
            at += 1
        name = data[begin:at].lower()
        while at < n and data[at] in _BLANK:
            at += 1
        value = b""
        if at < n and data[at] == 0x3D:
            at += 1
            while at < n and data[at] in _BLANK:
                at += 1
            if at < n and data[at] in b"\"'":
                end = data.find(data[at:at + 1], at + 1)
                if end < 0:
                    return None, n
                value, at = data[at + 1:end], end + 1
            else:
                begin = at
                while at < n and data[at] not in _BLANK + b">":
                    at += 1
                value = data[begin:at]
        out.setdefault(name, value)


def from_content(content: bytes) -> str | None:
    """The encoding that a content attribute names after charset=."""
    at = 0
    while m := _CHARSET.search(content, at):
        found = next(g for g in m.groups() if g is not None)
        return label(found)
    return None


def prescan(data: bytes) -> str | None:
    """The encoding that a meta tag declares within the budget; UTF-16 there means UTF-8."""
    at, spent = 0, 0
    while at < len(data) and spent < BUDGET:
        if data.startswith(b"<!--", at):
            end = data.find(b"-->", at + 2)
            if end < 0:
                return None
            at = end + 3
            continue
        begin = at
        head = data[at:at + 6].lower()
        if head[:5] == b"<meta" and (head[5:6] in (b"/", *(bytes([c]) for c in _BLANK)) and head[5:6]):
            attrs, at = _attributes(data, at + 5)
            if attrs is None:
                return None
            found = label(attrs[b"charset"]) if b"charset" in attrs else None
            if found is None and attrs.get(b"http-equiv", b"").lower() == b"content-type" and b"content" in attrs:
                found = from_content(attrs[b"content"])
            if found:
                return "utf-8" if found.startswith("utf-16") else found
        elif re.match(rb"</?[a-zA-Z]", data[at:at + 3]):
            while at < len(data) and data[at] not in _BLANK + b">":
                at += 1
            _, at = _attributes(data, at)
        elif data[at:at + 2] in (b"<!", b"</", b"<?"):
            end = data.find(b">", at)
            at = end + 1 if end >= 0 else len(data)
        else:
            less = data.find(b"<", at + 1)
            at = less if less >= 0 else len(data)
        spent += at - begin
        if spent > BUDGET:
            break
    return None


def sniff(data: bytes, transport: str | None = None) -> str:
    """The encoding of a page; an unknown transport label is passed over."""
    if found := label(transport):
        return found
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    return prescan(data) or DEFAULT


def decode_bytes(data: bytes, transport: str | None = None) -> str:
    """The text of a page in its encoding, without byte order mark; what can't be decoded is U+FFFD."""
    name = sniff(data, transport)
    for mark, own in MARKS:
        if own == name and data.startswith(mark):
            data = data[len(mark):]
    return data.decode({"windows-1252": "cp1252", "utf-16": "utf-16le"}.get(name, name), "replace")


def _columns(df: DataFrame, data: str, transport: str | Column | None) -> tuple[Column, Column]:
    told = transport if isinstance(transport, Column) else F.lit(transport).cast("string")
    return F.col(data).cast("binary"), told


@F.pandas_udf(StringType())
def sniff_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, told in parts:
        yield pd.Series([None if d is None else sniff(bytes(d), t) for d, t in zip(data, told, strict=True)])


@F.pandas_udf(StringType())
def decode_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, told in parts:
        yield pd.Series([None if d is None else decode_bytes(bytes(d), t) for d, t in zip(data, told, strict=True)])


def sniff_encoding(df: DataFrame, data: str = "data", transport: str | Column | None = None, out: str = "encoding") -> DataFrame:
    """df with the encoding of a column of bytes; null for null.  A byte order mark is seen without Python."""
    bytes_, told = _columns(df, data, transport)
    begins = lambda mark: F.substring(bytes_, 1, len(mark)) == F.lit(mark)
    if transport is None:
        marked = None
        for mark, name in MARKS:
            marked = F.when(begins(mark), name) if marked is None else marked.when(begins(mark), name)
        return df.withColumn(out, F.coalesce(marked, sniff_udf(bytes_, told)))
    return df.withColumn(out, sniff_udf(bytes_, told))


def decode(df: DataFrame, data: str = "data", transport: str | Column | None = None, out: str = "html") -> DataFrame:
    """df with the text of a column of bytes."""
    return df.withColumn(out, decode_udf(*_columns(df, data, transport)))

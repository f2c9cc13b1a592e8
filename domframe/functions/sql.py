"""SQL functions: table functions for nodes and tokens, and scalar functions over pages, texts and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..plans.schema import NODE_FIELDS
from .encoding import decode_udf, sniff_udf
from .entities import unescape


@F.pandas_udf(StringType())
def unescape_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(unescape, na_action="ignore")


NODES = "node_id int, parent_id int, subtree_end int, depth int, child_idx int, elem_idx int, kind string, ns string, tag string, attrs map<string,string>, text string"
TOKENS = "token_idx int, kind string, name string, attrs map<string,string>, self_closing boolean, data string"


class HtmlParse:
    """A row per node of a text; attributes as a map, namespaced ones as prefix:name."""

    def eval(self, html: str, context: str | None = None):
        from ..parser.builder import parse
        from ..parser.flatten import rows

        for r in rows(parse(html, context)) if html is not None else ():
            attrs = None if r[9] is None else {(f"{a}:{b}" if a and a != b else b): c for a, b, c in r[9]}
            yield (*r[:9], attrs, r[10])


class HtmlNodes:
    """A row of the node table per node of a text, but for the document's key."""

    def eval(self, html: str, context: str | None = None):
        from ..parser.builder import parse
        from ..parser.flatten import rows

        yield from rows(parse(html, context)) if html is not None else ()


class HtmlTokens:
    """A row per token of a text."""

    def eval(self, html: str):
        from ..parser.tokenizer import tokenize

        for k, t in enumerate(tokenize(html) if html is not None else ()):
            kind = {"start": "start_tag", "end": "end_tag", "chars": "character"}.get(t[0], t[0])
            named = t[0] in ("start", "end", "doctype")
            yield k, kind, t[1] if named else None, t[2] if t[0] == "start" else None, t[3] if t[0] == "start" else None, None if named else t[1]


def _found(html: str | None, selector: str | None):
    """(rows of the page, the rows that selector finds; without selector None for the page itself); None for a null page."""
    from ..parser.builder import parse
    from ..parser.flatten import rows
    from ..plans.match import find
    from ..plans.selector import compile_selector

    if html is None:
        return None
    nodes = rows(parse(html))
    return nodes, [None] if selector is None else find(nodes, compile_selector(selector))


@F.pandas_udf(ArrayType(StringType()))
def query_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from ..plans.match import to_html

    for pages, selectors in parts:
        yield pd.Series([None if got is None else [to_html(got[0], r) for r in got[1]] for got in map(_found, pages, selectors)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def text_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from ..plans.match import text

    for pages, selectors in parts:
        yield pd.Series([None if got is None else [text(got[0], r) for r in got[1]] for got in map(_found, pages, selectors)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def attr_udf(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from ..plans.match import attr

    for pages, selectors, names in parts:
        found = ((got, name) for got, name in zip(map(_found, pages, selectors), names, strict=True))
        yield pd.Series([None if got is None else [v for r in got[1] if r is not None and (v := attr(r, name)) is not None] for got, name in found], dtype=object)


@F.pandas_udf(StringType())
def to_html_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from ..plans.match import to_html

    for pages in parts:
        yield pages.map(lambda html: to_html(_found(html, None)[0]), na_action="ignore")


def register(spark: SparkSession) -> None:
    """Functions for SQL; all take Arrow batches.

    For LATERAL joins: html_nodes(html, context), rows of the node table but for doc_id; html_parse(html, context), its
    first columns with attributes as a map; html_tokens(html).  Of a page: html_query(html, selector), the HTML of the
    results; html_text(html, selector), their texts, or with a null selector the page's; html_attr(html, selector,
    name), the values of those that have the attribute; html_to_html(html).  Null for a null page.  html_unescape(text),
    html_sniff(bytes, label) and html_decode(bytes, label).
    """
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType=StructType(NODE_FIELDS), useArrow=True))
    spark.udtf.register("html_parse", F.udtf(HtmlParse, returnType=NODES, useArrow=True))
    spark.udtf.register("html_tokens", F.udtf(HtmlTokens, returnType=TOKENS, useArrow=True))
    for name, function in (("query", query_udf), ("text", text_udf), ("attr", attr_udf), ("to_html", to_html_udf), ("unescape", unescape_udf), ("sniff", sniff_udf), ("decode", decode_udf)):
        spark.udf.register(f"html_{name}", function)

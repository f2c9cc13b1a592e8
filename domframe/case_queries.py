"""Queries over the authored pages: what generated pages don't touch, against results written by hand."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases
from .functions.encoding import LABELS, decode, sniff_encoding
from .functions.sql import unescape_udf
from .operators.extract import attribute, children, text
from .operators.parse import parse_html, tokenize_html
from .operators.query import query, query_one
from .operators.serialize import to_dump, to_html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHOWN = str.maketrans("\0\r", "␀␍")  # SQL texts and these characters don't go together


def _sql(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _add(name: str, run: Callable[[SparkSession], DataFrame], columns: str, rows: list[tuple]) -> None:
    """A query (spark, sf_dir) over authored pages, and SQL with the rows it must give."""
    QUERIES[name] = lambda spark, sf_dir: run(spark)
    values = ", ".join(f"(CAST({k} AS BIGINT), {', '.join(map(_sql, r))})" for k, *r in rows)
    ORACLES[name] = f"SELECT * FROM (VALUES {values}) AS t({columns})"


def _pages(spark: SparkSession, pages: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def body_dump(page: str, short: str) -> str:
    """The whole dump of a page from the short form of its body."""
    out = ["| <!DOCTYPE html>"] if page.lower().startswith("<!doctype") else []
    out += ["| <html>", "|   <head>", "|   <body>"]
    for part in short.split("¦"):
        line = part.lstrip(" ")
        out.append("|     " + "  " * (len(part) - len(line)) + (line[1:] if line[0] == "@" else line if line[0] in '"<' else f"<{line}>"))
    return "\n".join(out)


TREES = {group: [(page, body_dump(page, short)) for page, short in rows] for group, rows in cases.BODIES.items()} | cases.DOCUMENTS
for _group, _rows in TREES.items():
    _add(f"cases_tree_{_group}", lambda spark, rows=_rows: to_dump(parse_html(_pages(spark, [p for p, _ in rows]))).select(F.col("doc_id").alias("k"), "dump"), "k, dump", [(k, want) for k, (_, want) in enumerate(_rows)])


def _fragments(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, html, inside) for k, (html, inside, _) in enumerate(cases.FRAGMENTS)], "page_id long, html string, inside string")
    return to_dump(parse_html(rows, context=F.col("inside"))).select(F.col("doc_id").alias("k"), "dump")


_add("cases_fragments", _fragments, "k, dump", [(k, want) for k, (_, _, want) in enumerate(cases.FRAGMENTS) if want])


def _written(t: tuple) -> str:
    quoted = lambda x: "-" if x is None else f'"{x}"'
    if t[0] == "doctype":
        return f"D {quoted(t[1])} {quoted(t[2])} {quoted(t[3])} {str(t[4]).lower()}"
    if t[0] == "start":
        return f"S {t[1]}[{','.join(sorted(f'{k}={v}' for k, v in t[2].items()))}]{'/' if t[3] else ''}"
    return {"end": "E ", "comment": "C ", "chars": "T "}[t[0]] + t[1]


def _tokens(rows: DataFrame) -> DataFrame:
    quoted = lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("-"))

    def written(t):
        held = F.array_join(F.array_sort(F.transform(t.attrs, lambda a: F.concat(a["name"], F.lit("="), a.value))), ",")
        return (F.when(t.kind == "doctype", F.concat_ws(" ", F.lit("D"), quoted(t["name"]), quoted(t.public_id), quoted(t.system_id), t.force_quirks.cast("string")))
                .when(t.kind == "start_tag", F.concat(F.lit("S "), t["name"], F.lit("["), held, F.lit("]"), F.when(t.self_closing, "/").otherwise("")))
                .when(t.kind == "end_tag", F.concat(F.lit("E "), t["name"])).when(t.kind == "comment", F.concat(F.lit("C "), t.data)).otherwise(F.concat(F.lit("T "), t.data)))

    return rows.select(F.col("page_id").alias("k"), F.translate(F.array_join(F.transform("tokens", written), " | "), "\0\r", "␀␍").alias("tokens"))


def _shown(tokens: list[tuple]) -> str:
    return " | ".join(map(_written, tokens)).translate(SHOWN)


_add("cases_tokens", lambda spark: _tokens(tokenize_html(_pages(spark, [p for p, _ in cases.TOKENS]))), "k, tokens", [(k, _shown(want)) for k, (_, want) in enumerate(cases.TOKENS)])


def _states(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, html, state) for k, (state, html, _) in enumerate(cases.STATES)], "page_id long, html string, state string")
    each = [_tokens(tokenize_html(rows.where(F.col("state") == s), initial_state=s, last_start_tag="title")) for s in sorted({s for s, _, _ in cases.STATES})]
    strict = tokenize_html(spark.createDataFrame([(99, "a￿\fb<!--x--y-->")], "page_id long, html string"), xml_violation_mode=True)
    return reduce(DataFrame.unionByName, [*each, _tokens(strict)])


_add("cases_token_states", _states, "k, tokens", [*((k, _shown(want)) for k, (_, _, want) in enumerate(cases.STATES)), (99, _shown([("chars", "a� b"), ("comment", "x- -y")]))])


def _references(spark: SparkSession) -> DataFrame:
    texts = _pages(spark, [t for t, _ in cases.REFERENCES]).select(F.col("page_id").alias("k"), unescape_udf("html").alias("text"))
    pages = spark.createDataFrame([(100 + k, f'<a x="{t}">') for k, (t, _) in enumerate(cases.ATTRIBUTE_REFERENCES)], "page_id long, html string")
    return texts.unionByName(attribute(parse_html(pages), "x").select(F.col("doc_id").alias("k"), F.col("value").alias("text")))


_add("cases_references", _references, "k, text", [*((k, want) for k, (_, want) in enumerate(cases.REFERENCES)), *((100 + k, want) for k, (_, want) in enumerate(cases.ATTRIBUTE_REFERENCES))])


def _selectors(spark: SparkSession) -> DataFrame:
    nodes = parse_html(_pages(spark, [p for p, _, _ in cases.SELECTORS]))
    each = [query(nodes.where(F.col("doc_id") == k), s).select("doc_id", "node_id", "subtree_end", "rank", "tag") for k, (_, s, _) in enumerate(cases.SELECTORS) if s]
    found = reduce(DataFrame.unionByName, each)
    words = text(nodes, found).select(F.col("doc_id").alias("k"), F.col("node_id").alias("n"), F.col("text").alias("words"))
    return found.join(words, (F.col("doc_id") == F.col("k")) & (F.col("node_id") == F.col("n"))).select("k", "rank", "tag", "words")


_add("cases_selectors", _selectors, "k, rank, tag, words", [(k, n + 1, *r) for k, (_, _, want) in enumerate(cases.SELECTORS) for n, r in enumerate(want)])


def _forms(spark: SparkSession) -> DataFrame:
    nodes, out = parse_html(_pages(spark, [h for h, _, _ in cases.FORMS]), context="div"), []
    for options in {repr(o): o for _, o, _ in cases.FORMS}.values():
        own = [k for k, (_, o, _) in enumerate(cases.FORMS) if o == options]
        out.append(to_html(nodes.where(F.col("doc_id").isin(own)), **options))
    whole = spark.createDataFrame([(100 + k, d) for k, d in enumerate(cases.DOCTYPES)], "page_id long, html string")
    return reduce(DataFrame.unionByName, [*out, to_html(parse_html(whole))]).select(F.col("doc_id").alias("k"), "html")


_add("cases_serializer", _forms, "k, html", [*((k, want) for k, (_, _, want) in enumerate(cases.FORMS)), *((100 + k, d + "<html><head></head><body></body></html>") for k, d in enumerate(cases.DOCTYPES))])

#: A page for each label that declares it; UTF-16 in a declaration means UTF-8.
LABELLED = [(f"<meta charset='{name.upper()}'>".encode(), "utf-8" if encoding.startswith("utf-16") else encoding) for encoding, names in LABELS.items() for name in names]


def _encodings(spark: SparkSession) -> DataFrame:
    rows = [(k, bytearray(d), t) for k, (d, t, _) in enumerate(cases.ENCODINGS)] + [(100 + k, bytearray(d), None) for k, (d, _) in enumerate(LABELLED)]
    df = spark.createDataFrame(rows, "k long, data binary, told string")
    bare = sniff_encoding(df.where("told IS NULL")).select("k", "encoding")  # without a label, marks are seen without Python
    return bare.unionByName(sniff_encoding(df.where("told IS NOT NULL"), transport=F.col("told")).select("k", "encoding"))


_add("cases_encodings", _encodings, "k, encoding", [*((k, want) for k, (_, _, want) in enumerate(cases.ENCODINGS)), *((100 + k, want) for k, (_, want) in enumerate(LABELLED))])


def _decoded(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(k, bytearray(d), t) for k, (d, t, _) in enumerate(cases.DECODED)], "k long, data binary, told string")
    return decode(df, "data", F.col("told"), out="text").select("k", "text")


_add("cases_decoded", _decoded, "k, text", [(k, want) for k, (_, _, want) in enumerate(cases.DECODED)])


def _texts(spark: SparkSession) -> DataFrame:
    nodes = parse_html(_pages(spark, [cases.TEXT_PAGE]))
    body = query(nodes, "body")
    return reduce(DataFrame.unionByName, [text(nodes, body, **o).select(F.lit(k).cast("long").alias("k"), "text") for k, (o, _) in enumerate(cases.TEXTS)])


_add("cases_text_options", _texts, "k, text", [(k, want) for k, (_, want) in enumerate(cases.TEXTS)])

FAMILY = "<ul id=u><li>a</li>t<!--c--><li class=''>b</li></ul><a href=x>1</a><a href=x>2</a><svg xlink:href=q></svg><b>d</b>"


def _children(spark: SparkSession) -> DataFrame:
    nodes = parse_html(_pages(spark, [FAMILY]))
    lists = query(nodes, "ul, b")
    name = F.coalesce("tag", "text").alias("name")
    return children(nodes, lists).select(F.lit(0).cast("long").alias("k"), "kind", name).unionByName(children(nodes, lists, include_text=False).select(F.lit(1).cast("long").alias("k"), "kind", name))


_add("cases_children", _children, "k, kind, name", [(0, "element", "li"), (0, "text", "t"), (0, "comment", "c"), (0, "element", "li"), (0, "text", "d"), (1, "element", "li"), (1, "element", "li")])


def _attributes(spark: SparkSession) -> DataFrame:
    nodes = parse_html(_pages(spark, [FAMILY]))
    return reduce(DataFrame.unionByName, [attribute(nodes, name, selector).select(F.lit(k).cast("long").alias("k"), "value") for k, (name, selector) in enumerate([("href", "a"), ("class", None), ("id", None), ("href", "svg")])])


_add("cases_attributes", _attributes, "k, value", [(0, "x"), (0, "x"), (1, ""), (2, "u")])


def _first_or_null(spark: SparkSession) -> DataFrame:
    nodes = parse_html(_pages(spark, ["<p>a<i>1</i><i>2</i>", "<p>b", "", None]))
    return query_one(nodes, "i, p > b", all_documents=True).select(F.col("doc_id").alias("k"), "tag", "rank")


_add("cases_query_one_null", _first_or_null, "k, tag, rank", [(0, "i", 1), (1, None, None), (2, None, None)])

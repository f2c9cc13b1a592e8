"""Node rows to HTML: an opening and a closing event for each node, put in order by one ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without end tag, and those whose text is written as it is (fixed values).
VOID = ("area", "base", "basefont", "bgsound", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr")
RAW_TEXT = ("script", "style", "xmp", "iframe", "noembed", "noframes", "plaintext")
KEEPS_BLANKS = ("pre", "textarea", "script", "style")
BARE = "^[^ \\t\\n\\r\\f\"'=>`]+$"


def _replace(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _attribute(a: Column, quote_char: str | None, minimize: bool, escape_lt: bool) -> Column:
    named = F.when(a["ns"].isNull() | (a["name"] == "xmlns"), a["name"]).otherwise(F.concat_ws(":", a["ns"], a["name"]))
    value = _replace(a["value"], ("&", "&amp;"), *([("<", "&lt;")] if escape_lt else []))
    double = F.concat(named, F.lit('="'), _replace(value, ('"', "&quot;")), F.lit('"'))
    single = F.concat(named, F.lit("='"), _replace(value, ("'", "&#39;")), F.lit("'"))
    short = named if minimize else F.concat(named, F.lit('=""'))
    out = F.when(a["value"] == "", short)
    if minimize:
        out = out.when(a["value"] == a["name"], named)
    if quote_char is not None:
        return out.otherwise(single if quote_char == "'" else double)
    return out.when(a["value"].rlike(BARE), F.concat(named, F.lit("="), a["value"])).when(F.contains(a["value"], F.lit('"')) & ~F.contains(a["value"], F.lit("'")), single).otherwise(double)


def to_html(nodes: DataFrame, of: DataFrame | None = None, quote_char: str | None = None, minimize_boolean_attributes: bool = True, use_trailing_solidus: bool = False,
            escape_lt_in_attrs: bool = False, escape_rcdata: bool = False, strip_whitespace: bool = False) -> DataFrame:
    """doc_id and html of each document; with of, doc_id, node_id and html of each of those nodes.

    Children of void elements are left out; a template's content stands in it; unquoted values aren't escaped.
    """
    void = (F.col("kind") == "element") & F.col("tag").isin(*VOID)
    attrs = F.transform(F.coalesce("attrs", F.array().cast(nodes.schema["attrs"].dataType)), lambda a: F.concat(F.lit(" "), _attribute(a, quote_char, minimize_boolean_attributes, escape_lt_in_attrs)))
    start = F.concat(F.lit("<"), F.col("tag"), F.array_join(attrs, ""), F.when(void & F.lit(use_trailing_solidus), " />").otherwise(">"))
    raw = F.coalesce(F.col("parent_tag").isin(*RAW_TEXT), F.lit(False)) & F.lit(not escape_rcdata)
    words = F.col("text")
    if strip_whitespace:
        blanks = F.regexp_replace(F.regexp_replace("text", "[\\t\\r\\n\\f]+", " "), " {2,}", " ")
        words = F.when(F.coalesce(F.col("parent_tag").isin(*KEEPS_BLANKS), F.lit(False)), F.col("text")).otherwise(blanks)
    written = F.when(raw, words).otherwise(_replace(words, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))
    name, public, system = (F.coalesce(f"doctype.{c}", F.lit("")) for c in ("name", "public_id", "system_id"))
    ids = F.when((public == "") & (system == ""), "").when(public == "", F.concat(F.lit(' SYSTEM "'), system, F.lit('"'))).when(
        system == "", F.concat(F.lit(' PUBLIC "'), public, F.lit('"'))).otherwise(F.concat(F.lit(' PUBLIC "'), public, F.lit('" "'), system, F.lit('"')))
    opened = (F.when(F.col("kind") == "element", start).when(F.col("kind") == "text", written).when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
              .when(F.col("kind") == "doctype", F.concat(F.lit("<!DOCTYPE "), name, ids, F.lit(">"))).otherwise(""))
    closed = F.when((F.col("kind") == "element") & ~void, F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise("")
    event = lambda at, phase, deep, s: F.struct(at.alias("at"), F.lit(phase).alias("phase"), deep.alias("deep"), s.alias("s"))
    # An end tag stands after everything up to its subtree's end; of several there, the deepest first.
    events = F.explode(F.array(event(F.col("node_id"), 0, F.lit(0), opened), event(F.col("subtree_end"), 1, -F.col("depth"), closed)))
    rows = nodes.where(~F.coalesce(F.col("parent_tag").isin(*VOID), F.lit(False)))
    if of is None:
        made = rows.select("doc_id", events.alias("e"))
        return made.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.s), "").alias("html"))
    tops = of.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_top"), F.col("subtree_end").alias("_end")).distinct()
    inside = rows.join(tops, (F.col("doc_id") == F.col("_doc")) & (F.col("node_id") >= F.col("_top")) & (F.col("node_id") <= F.col("_end")))
    made = inside.select("_doc", "_top", events.alias("e"))
    found = made.groupBy(F.col("_doc").alias("doc_id"), F.col("_top").alias("node_id"))
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.s), "").alias("html"))


def to_dump(nodes: DataFrame) -> DataFrame:
    """doc_id and dump: a line for each node, indented by its depth, attributes sorted on lines of their own; the form of golden cases."""
    pad = F.concat(F.lit("| "), F.repeat(F.lit("  "), F.col("depth")))
    spaced = lambda ns, name: F.when(ns.isNull() | (ns == name), name).otherwise(F.concat(ns, F.lit(" "), name))
    name, public, system = (F.coalesce(f"doctype.{c}", F.lit("")) for c in ("name", "public_id", "system_id"))
    ids = F.when((public == "") & (system == ""), "").otherwise(F.concat(F.lit(' "'), public, F.lit('" "'), system, F.lit('"')))
    kind = F.col("kind")
    own = (F.when(kind == "text", F.concat(F.lit('"'), "text", F.lit('"'))).when(kind == "comment", F.concat(F.lit("<!-- "), "text", F.lit(" -->")))
           .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE "), name, ids, F.lit(">"))).when(kind == "content", "content")
           .otherwise(F.concat(F.lit("<"), F.coalesce(F.concat("ns", F.lit(" ")), F.lit("")), "tag", F.lit(">"))))
    attrs = F.array_sort(F.transform(F.coalesce("attrs", F.array().cast(nodes.schema["attrs"].dataType)), lambda a: F.concat(spaced(a.ns, a["name"]), F.lit('="'), a.value, F.lit('"'))))
    held = F.array_join(F.transform(attrs, lambda a: F.concat(F.lit("\n"), pad, F.lit("  "), a)), "")
    line = nodes.select("doc_id", "node_id", F.concat(pad, own, held).alias("line"))
    return line.groupBy("doc_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY node_id)").alias("dump"))

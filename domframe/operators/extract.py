"""Children, text and attributes of nodes, as DataFrame plans over node rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selector import attr
from .query import query

#: Unicode White_Space at either end of a text.
EDGES = "^[\\p{IsWhite_Space}]+|[\\p{IsWhite_Space}]+$"


def children(nodes: DataFrame, of: DataFrame, include_text: bool = True) -> DataFrame:
    """The child nodes of the elements in of (doc_id, node_id, kind), with of_id; without text only elements.

    A child of several given elements has a row for each; nodes that aren't elements have no children.
    """
    tops = of.where("kind = 'element'").select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("of_id"))
    rows = nodes if include_text else nodes.where("kind = 'element'")
    return rows.join(tops, (F.col("doc_id") == F.col("_doc")) & (F.col("parent_id") == F.col("of_id"))).drop("_doc")


def _segments(nodes: DataFrame, include_script: bool, include_style: bool, include_inputs: bool) -> DataFrame:
    """Rows with a piece of text: text nodes outside templates, and, if asked for, the values of inputs."""
    value = attr("value")
    is_input = (F.col("kind") == "element") & (F.col("tag") == "input") & F.col("ns").isNull() & value.isNotNull()
    kept = (F.col("kind") == "text") | is_input if include_inputs else F.col("kind") == "text"
    rows = nodes.where(kept & ~F.col("in_content"))
    if not include_script:
        rows = rows.where("NOT in_script")
    if not include_style:
        rows = rows.where("NOT in_style")
    return rows.withColumn("_piece", F.when(F.col("kind") == "text", F.col("text")).otherwise(value))


def text(nodes: DataFrame, of: DataFrame | None = None, deep: bool = True, separator: str = "", strip: bool = False, include_script: bool = False, include_style: bool = False, include_inputs: bool = False) -> DataFrame:
    """doc_id, node_id (of the root) and text of each node in of; without of, one text for each document.

    deep=False takes only text directly below the roots (and roots that are texts).  separator stands between
    pieces; strip trims each piece and leaves out the empty ones.  Roots without text have an empty one.
    """
    pieces = _segments(nodes, include_script, include_style, include_inputs)
    if strip:
        pieces = pieces.withColumn("_piece", F.regexp_replace("_piece", EDGES, "")).where("_piece <> ''")
    joined = F.coalesce(F.expr(f"listagg(_piece, {_literal(separator)}) WITHIN GROUP (ORDER BY _at)"), F.lit(""))
    if of is None:
        if not deep:
            pieces = pieces.where("depth = 0 OR depth = 1")
        found = pieces.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_at"), "_piece").groupBy("_doc").agg(joined.alias("text"))
        docs = nodes.select("doc_id").distinct()
        return docs.join(found, (F.col("doc_id") == F.col("_doc")), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tops = of.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_top"), F.col("subtree_end").alias("_end")).distinct()
    within = (F.col("node_id") >= F.col("_top")) & (F.col("node_id") <= F.col("_end"))
    if not deep:
        within = (F.col("parent_id") == F.col("_top")) | (F.col("node_id") == F.col("_top"))
    inside = pieces.join(tops, (F.col("doc_id") == F.col("_doc")) & within).select(F.col("_doc"), "_top", F.col("node_id").alias("_at"), "_piece")
    found = inside.groupBy("_doc", "_top").agg(joined.alias("text"))
    roots = of.select("doc_id", "node_id").distinct()
    return roots.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("node_id") == F.col("_top")), "left").select("doc_id", "node_id", F.coalesce("text", F.lit("")).alias("text"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def get_attr(name: str) -> Column:
    """The value of an attribute of a node row; null for none, and for nodes that aren't elements."""
    return F.when(F.col("kind") == "element", attr(name))


def attribute(nodes: DataFrame, name: str, selector: str | None = None, **options) -> DataFrame:
    """The nodes (or those selector finds) that have an attribute, with its value; values can repeat, nodes are told apart by structure."""
    rows = query(nodes, selector, **options) if selector is not None else nodes
    return rows.withColumn("value", get_attr(name)).where("value IS NOT NULL")

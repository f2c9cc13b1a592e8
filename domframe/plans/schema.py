"""The node table: one row per node, numbered in page order, with the interval of its subtree."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRS = T.ArrayType(T.StructType([T.StructField("ns", T.StringType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
DOCTYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "public_id", "system_id")])
#: Everything but the document's key.
NODE_FIELDS = [
    T.StructField("node_id", T.IntegerType(), False),  # place in page order, from 0
    T.StructField("parent_id", T.IntegerType()),  # null at top level
    T.StructField("subtree_end", T.IntegerType(), False),  # the last node_id below, its own if none
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("child_idx", T.IntegerType(), False),  # among all siblings
    T.StructField("elem_idx", T.IntegerType()),  # among element siblings
    T.StructField("kind", T.StringType(), False),  # element, text, comment, doctype, content
    T.StructField("ns", T.StringType()),  # svg, math or null
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", ATTRS),
    T.StructField("text", T.StringType()),
    T.StructField("doctype", DOCTYPE),
    T.StructField("in_content", T.BooleanType(), False),  # below a template's content
    T.StructField("in_script", T.BooleanType(), False),  # in or below an HTML script
    T.StructField("in_style", T.BooleanType(), False),
    T.StructField("parent_tag", T.StringType()),
    T.StructField("subtree_hash", T.StringType()),  # equal for equal subtrees
    T.StructField("canon_parent", T.IntegerType()),  # where the first equal node stands: its parent, -1 at top level,
    T.StructField("canon_elem", T.IntegerType()),  # and its place among element siblings
]
TOKENS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("attrs", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("self_closing", T.BooleanType()), T.StructField("data", T.StringType()), T.StructField("public_id", T.StringType()), T.StructField("system_id", T.StringType()), T.StructField("force_quirks", T.BooleanType())]))


def nodes_schema(key: T.StructField) -> T.StructType:
    return T.StructType([key, *NODE_FIELDS])

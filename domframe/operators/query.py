"""Selector queries as DataFrame plans over node rows.

A chain is evaluated from left to right; each step joins the matches so far with the nodes by document and place.
order_key, the page places along a match's path, gives the result's order: by the selector's place in a list,
then by path.  Equal subtrees of a document are one result, the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.selector import compile_selector, predicate


def _slim(nodes: DataFrame, compound) -> DataFrame:
    """The nodes that match, with what a join needs."""
    return nodes.where(predicate(compound)).select("doc_id", F.col("node_id").alias("n"), F.coalesce("parent_id", F.lit(-1)).alias("p"), "elem_idx", "subtree_end", "canon_parent", "canon_elem")


def _step(left: DataFrame, nodes: DataFrame, combinator: str, compound, siblings: str) -> DataFrame:
    right = _slim(nodes, compound)
    at = left.select(F.col("doc_id"), F.col("n").alias("l"), F.col("subtree_end").alias("l_end"), F.col("canon_parent" if siblings == "reference" else "p").alias("l_parent"), F.col("canon_elem" if siblings == "reference" else "elem_idx").alias("l_elem"), "order_key")
    same = F.col("r.doc_id") == F.col("a.doc_id")  # plain equality, so that tables bucketed by document need no exchange
    on = {
        "descendant": same & (F.col("n") > F.col("l")) & (F.col("n") <= F.col("l_end")),
        "child": same & (F.col("p") == F.col("l")),
        "adjacent_sibling": same & (F.col("p") == F.col("l_parent")) & (F.col("elem_idx") == F.col("l_elem") + 1),
        "general_sibling": same & (F.col("p") == F.col("l_parent")) & (F.col("elem_idx") > F.col("l_elem")),
    }[combinator]
    joined = at.alias("a").join(right.alias("r"), on)
    found = joined.select("r.*", F.concat("order_key", F.array("n")).alias("order_key"))
    if combinator == "child":  # a node has one parent
        return found
    # A node reached over several paths keeps the first: what follows from it is first over that path too.
    keep = [F.first(c).alias(c) for c in ("p", "elem_idx", "subtree_end", "canon_parent", "canon_elem")]
    return found.groupBy("doc_id", "n").agg(*keep, F.min("order_key").alias("order_key"))


def _below(nodes: DataFrame, outer, inner) -> DataFrame:
    """The nodes' columns and order_key of inner's matches below one of outer's: one pass in page order, without a join.

    Subtrees nest, so the first path to a node leads over the outermost match around it, which is the last one
    that no other match holds.
    """
    before = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.where(predicate(outer) | predicate(inner)).withColumn("_outer", predicate(outer))
    rows = rows.withColumn("_end", F.max(F.when(F.col("_outer"), F.col("subtree_end"))).over(before))
    top = F.col("_outer") & (F.col("_end").isNull() | (F.col("node_id") > F.col("_end")))
    rows = rows.withColumn("_top", F.last(F.when(top, F.col("node_id")), ignorenulls=True).over(before))
    found = rows.where(predicate(inner) & (F.col("node_id") <= F.col("_end")))
    return found.withColumn("order_key", F.array(F.lit(0), F.col("_top"), F.col("node_id"))).drop("_outer", "_end", "_top")


def _after(nodes: DataFrame, earlier, later, siblings: str) -> DataFrame:
    """The nodes' columns and order_key of later's matches behind one of earlier's among the same siblings: one pass over siblings in order."""
    parent, elem = ("canon_parent", "canon_elem") if siblings == "reference" else ("parent_id", "elem_idx")
    at = lambda p: F.coalesce(p, F.lit(-1)).alias("_p")
    right = nodes.where(predicate(later)).select(F.col("doc_id").alias("_d"), at(F.col("parent_id")), F.col("elem_idx").alias("_e"), F.lit(None).cast("int").alias("_l"), F.struct(*nodes.columns).alias("_row"))
    left = nodes.where(predicate(earlier)).select(F.col("doc_id").alias("_d"), at(F.col(parent)), F.col(elem).alias("_e"), F.col("node_id").alias("_l"), F.lit(None).cast(right.schema["_row"].dataType).alias("_row"))
    before = Window.partitionBy("_d", "_p").orderBy("_e").rangeBetween(Window.unboundedPreceding, -1)
    first = left.unionByName(right).withColumn("_first", F.min("_l").over(before)).where("_row IS NOT NULL AND _first IS NOT NULL")
    return first.select("_row.*", F.array(F.lit(0), F.col("_first"), F.col("_row.node_id")).alias("order_key"))


def query(nodes: DataFrame, selector: str, siblings: str = "reference", dedupe: bool = True) -> DataFrame:
    """The nodes' columns, rank (from 1 in each document) and order_key for every node that selector finds.

    siblings="reference" looks for a node's siblings where the first node equal to it stands; "css" where it
    stands itself.  dedupe=False keeps equal subtrees apart.  A bad selector raises ValueError at once.  A single
    compound is a filter, and a single step down or along siblings is one ordered pass; longer chains join.
    """
    chains = compile_selector(selector)
    kinds = [combinator for combinator, _ in chains[0]] if len(chains) == 1 else None
    if kinds == [None]:
        rows = nodes.where(predicate(chains[0][0][1])).withColumn("order_key", F.array(F.lit(0), F.col("node_id")))
    elif kinds == [None, "descendant"]:
        rows = _below(nodes, chains[0][0][1], chains[0][1][1])
    elif kinds == [None, "general_sibling"]:
        rows = _after(nodes, chains[0][0][1], chains[0][1][1], siblings)
    else:
        rows = _joined(nodes, chains, siblings)
    if dedupe:
        rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("doc_id", "subtree_hash").orderBy("order_key"))).where("_turn = 1").drop("_turn")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("order_key")))


def _joined(nodes: DataFrame, chains, siblings: str) -> DataFrame:
    """The nodes' columns and order_key of what any chain finds, step by step; of several places in the list the first counts."""
    found = None
    for k, chain in enumerate(chains):
        now = _slim(nodes, chain[0][1]).withColumn("order_key", F.array("n"))
        for combinator, compound in chain[1:]:
            now = _step(now, nodes, combinator, compound, siblings)
        now = now.select("doc_id", "n", F.concat(F.array(F.lit(k)), "order_key").alias("order_key"))
        found = now if found is None else found.unionByName(now)
    if found is None:
        found = nodes.where(F.lit(False)).select("doc_id", F.col("node_id").alias("n"), F.array(F.lit(0)).alias("order_key"))
    first = found.groupBy(F.col("doc_id").alias("_doc"), F.col("n").alias("_n")).agg(F.min("order_key").alias("order_key")) if len(chains) > 1 else found.select(F.col("doc_id").alias("_doc"), F.col("n").alias("_n"), "order_key")
    return nodes.join(first, (F.col("doc_id") == F.col("_doc")) & (F.col("node_id") == F.col("_n"))).drop("_doc", "_n")


def query_one(nodes: DataFrame, selector: str, all_documents: bool = False, **options) -> DataFrame:
    """The first result of each document that has one; with all_documents also a row of nulls, but for doc_id, for each that has none."""
    first = query(nodes, selector, **options).where("rank = 1")
    if not all_documents:
        return first
    docs = nodes.select("doc_id").distinct()
    return docs.join(first.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")


def reroot(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The subtrees of a result as documents of their own nodes, in which the results are siblings at top level.

    Nodes below several results appear once for each, so node_id is numbered anew in the order of the results.
    """
    tops = found.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_top"), F.col("subtree_end").alias("_end"), F.col("depth").alias("_depth"), (F.col("rank") - 1).alias("_rank"), (F.col("subtree_end") - F.col("node_id") + 1).alias("_size"))
    before = Window.partitionBy("_doc").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("int"))
    inside = nodes.join(tops, (F.col("doc_id") == F.col("_doc")) & (F.col("node_id") >= F.col("_top")) & (F.col("node_id") <= F.col("_end")))
    top = F.col("node_id") == F.col("_top")
    shift = F.col("_base") - F.col("_top")
    moved = inside.select(*[{
        "node_id": F.col("node_id") + shift, "parent_id": F.when(~top, F.col("parent_id") + shift), "subtree_end": F.col("subtree_end") + shift, "depth": F.col("depth") - F.col("_depth"),
        "child_idx": F.when(top, F.col("_rank")).otherwise(F.col("child_idx")).cast("int"), "elem_idx": F.when(top, F.col("_rank")).otherwise(F.col("elem_idx")).cast("int"),
        "parent_tag": F.when(~top, F.col("parent_tag")),
    }.get(c, F.col(c)).alias(c) for c in nodes.columns])
    place = F.struct(F.coalesce("parent_id", F.lit(-1)).alias("p"), F.col("child_idx").alias("c"), F.col("elem_idx").alias("e"))
    first = F.min(F.when(~F.col("in_content"), place)).over(Window.partitionBy("doc_id", "subtree_hash"))
    return moved.withColumn("_first", first).withColumns({"canon_parent": F.coalesce("_first.p", "parent_id", F.lit(-1)), "canon_elem": F.coalesce("_first.e", "elem_idx")}).drop("_first")

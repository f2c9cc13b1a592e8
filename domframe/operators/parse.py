"""Parsing: pages to node rows, and texts to tokens, in one Arrow-batched pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..parser.builder import parse
from ..parser.flatten import rows
from ..parser.tokenizer import tokenize
from ..plans.schema import TOKENS, nodes_schema

#: Pages of an Arrow batch that are parsed before their rows are passed on.
STEP = 64


def parse_html(df: DataFrame, key: str = "page_id", html: str = "html", context: str | Column | None = None, columns: Sequence[str] | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """Node rows of every page: key as doc_id and the columns of NODE_FIELDS.

    With context, a tag like "ul" or "svg path" (or a column of such), html is a fragment in that element.  A null
    html has no nodes, as has a null context in a column or a null key; an empty html has html, head and body.  Keys
    need not be unique for parsing, but queries take rows of the same key as one document.  With columns, only these of
    NODE_FIELDS are made, and with tags only the rows of such elements, so that no more than needed leaves the pass.
    """
    name = df.schema[key]
    whole = nodes_schema(T.StructField("doc_id", name.dataType, name.nullable))
    places = [k for k, f in enumerate(whole.fields) if k == 0 or columns is None or f.name in columns]
    schema = T.StructType([whole.fields[k] for k in places])
    if unknown := set(columns or ()) - set(whole.names):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    hashed = not {"subtree_hash", "canon_parent", "canon_elem"}.isdisjoint(schema.names)
    wanted, tag_at = None if tags is None else frozenset(tags), whole.names.index("tag") - 1
    target = to_arrow_schema(schema)
    fixed = context if isinstance(context, str) else None
    read = [F.col(key).alias("doc_id"), F.col(html).cast("string").alias("html")]
    if isinstance(context, Column):
        read.append(context.alias("context"))
    by_row = isinstance(context, Column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                contexts = part.column(2).to_pylist() if by_row else [fixed] * len(keys)
                out = [(k, *r) for k, text, c in zip(keys, texts, contexts, strict=True) if text is not None and not (by_row and c is None) for r in rows(parse(text, c), hashed) if wanted is None or r[tag_at] in wanted]
                if out:
                    arrays = []
                    made = list(zip(*out, strict=True))
                    for field, values in zip(target, (made[k] for k in places), strict=True):
                        if field.name == "attrs":
                            values = [None if v is None else [{"ns": a, "name": b, "value": c} for a, b, c in v] for v in values]
                        elif field.name == "doctype":
                            values = [None if v is None else {"name": v[0], "public_id": v[1], "system_id": v[2]} for v in values]
                        arrays.append(pa.array(values, field.type))
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.where(F.col(key).isNotNull()).select(*read).mapInArrow(run, schema)


def tokenize_html(df: DataFrame, html: str = "html", tokens: str = "tokens", initial_state: str = "data", last_start_tag: str | None = None, xml_violation_mode: bool = False) -> DataFrame:
    """df with the tokens of each text as an array; null for null."""
    columns = [c for c in df.columns if c != tokens]
    schema = T.StructType([*df.select(*columns).schema.fields, T.StructField(tokens, TOKENS)])
    kind = to_arrow_schema(T.StructType([T.StructField(tokens, TOKENS)]))[0].type

    def row(t: tuple) -> dict:
        if t[0] == "doctype":
            return {"kind": "doctype", "name": t[1], "public_id": t[2], "system_id": t[3], "force_quirks": t[4]}
        if t[0] == "start":
            return {"kind": "start_tag", "name": t[1], "attrs": [{"name": k, "value": v} for k, v in t[2].items()], "self_closing": t[3]}
        if t[0] == "end":
            return {"kind": "end_tag", "name": t[1]}
        return {"kind": "comment" if t[0] == "comment" else "character", "data": t[1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                values = [None if x is None else [row(t) for t in tokenize(x, initial_state, last_start_tag, xml_violation_mode)] for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(values, kind)], names=[*columns, tokens])

    return df.select(*columns).mapInArrow(run, schema) if html in columns else df

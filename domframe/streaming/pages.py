"""Pages as a stream: parsing keeps no state, so it runs on a stream as it is; what aggregates nodes runs batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse_html


def stream_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", context: str | None = None) -> DataFrame:
    """A stream of node rows from a stream of pages, in append mode."""
    return parse_html(pages, key, html, context)


def stream_query(pages: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "page_id", html: str = "html", **trigger) -> StreamingQuery:
    """Runs work (any plan over nodes) on the nodes of every micro-batch and hands its result to sink(result, batch).

    A page's nodes are always in one batch, so queries, texts and HTML of pages are whole.  A batch can come
    again after a failure, with the same number; sinks should overwrite by it.
    """
    def each(batch: DataFrame, number: int) -> None:
        sink(work(parse_html(batch, key, html)), number)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

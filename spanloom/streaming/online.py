"""Incoming queries against a static index, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from spanloom.operators.index import Index
from spanloom.operators.retrieve import Bm25Config, bm25_search


def search_stream(queries: DataFrame, index: Index, config: Bm25Config, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = True):
    """Start a stream of (qid, text); each micro-batch is searched as a whole and its run given to ``sink``.

    Nothing is kept between batches: the index is static, so no state and no watermark are needed. With ``once`` the
    stream takes what is there and ends.
    """

    def handle(batch: DataFrame, number: int) -> None:
        sink(bm25_search(batch, index, config), number)

    writer = queries.writeStream.foreachBatch(handle)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Streams into graphs: a write statement for every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import GraphSession


def merge_stream(session: GraphSession, stream: DataFrame, text: str, checkpoint: str, parameter: str = "rows") -> StreamingQuery:
    """Runs ``text`` over each micro-batch of all that is there now. The statement sees the batch as the parameter
    ``$rows``, a table of maps: ``UNWIND $rows AS row ...`` reads it without gathering it.

    A session with a store commits each batch under its number, so that after a restart from the checkpoint the graph
    holds all batches, and one that is run again isn't counted twice. Without a store the graph lives as long as the
    session, and the checkpoint should too."""
    store, mark = session.store, f"batch of {checkpoint}"

    def one(batch: DataFrame, number: int) -> None:
        if store is None:
            session.cypher(text, {parameter: batch})
        elif session.marks.get(mark, -1) < number:
            session.cypher(text, {parameter: batch}, {mark: number})

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming into an index: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators.index import HybridIndex


def ingest(stream: DataFrame, index: HybridIndex, checkpoint: str, to_rows: Callable[[DataFrame], DataFrame] = lambda df: df, order: Sequence[str] = ("external_id",), deletes: str | None = None, once: bool = True) -> StreamingQuery:
    """Upsert every micro-batch of a stream of rows and commit it.

    deletes: a boolean column; rows where it holds delete their external_id. A batch that is delivered again after a
    failure writes the same rows again, which changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if deletes:
                index.delete(batch.where(f"`{deletes}`"))
                index.add(to_rows(batch.where(f"not coalesce(`{deletes}`, false)").drop(deletes)), order)
            else:
                index.add(to_rows(batch), order)
            index.commit()
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

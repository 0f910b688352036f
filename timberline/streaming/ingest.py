"""Streaming writes: each micro-batch is one commit, once, whatever is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """stream (key, seq, value). The batch id is the commit's tag, so a replayed batch finds its earlier commit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.commit_rows(batch.select("key", "seq", "value"), tag=(name, batch_id))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

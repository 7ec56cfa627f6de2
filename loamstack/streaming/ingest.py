"""Indexing as files or rows arrive: a structured stream whose micro-batches are passes over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loamstack.operators.embed import Embedder
from loamstack.operators.indexer import index_table
from loamstack.operators.store import Store


def ingest(rows: DataFrame, store: Store, checkpoint: str, embedder: Embedder | None = None, **trigger) -> StreamingQuery:
    """Index a stream of ``path`` and ``text``. A micro-batch that is repeated after a failure changes nothing, since
    documents whose content the store has are left out; so each batch takes effect once."""

    def batch(frame: DataFrame, _: int) -> None:
        index_table(store.refresh(), frame, embedder)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

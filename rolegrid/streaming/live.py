"""Streaming entry points that reuse the batch operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolegrid.operators.dedupe import canonicalize_postings
from rolegrid.sources.tables import BucketTable


def stream_upserts(postings: DataFrame, table: BucketTable, checkpoint: str, order: str = "seq", name: str = "upserts",
                   **trigger) -> StreamingQuery:
    """Upsert every micro-batch of extracted postings into a stored table, of which it reads and writes the touched buckets (SM1).

    A batch that is replayed after a failure is recognized by the id of the query, which belongs to its checkpoint,
    and its number, and is skipped. A new checkpoint under an old name starts a new count.
    """

    def apply(batch: DataFrame, number: int) -> None:
        query = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if not batch.isEmpty():
            table.upsert(canonicalize_postings(batch), order, batch=(f"{name}-{query}", number))

    writer = postings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_current_decisions(log: DataFrame) -> DataFrame:
    """Running current decision per posting over a stream of log rows (SM2). Write in update mode."""
    last = F.max_by(F.struct("decision", "decided_at", "note"), "seq").alias("d")
    return log.groupBy("posting_url").agg(last).select("posting_url", "d.decision", "d.decided_at", "d.note")

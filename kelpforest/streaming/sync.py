"""Structured Streaming front end of the sync: batches of file events go through the same comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kelpforest.operators import sync


def watch(events: DataFrame, ledger: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run every available batch of ``events`` (collection, path, hash) against the ledger; ``apply`` gets its changes once per batch."""

    def batch(rows: DataFrame, number: int) -> None:
        known = ledger().join(rows.select("collection", "path").distinct(), ["collection", "path"], "left_semi")
        apply(sync.diff(rows.dropDuplicates(["collection", "path"]), known), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

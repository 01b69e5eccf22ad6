"""Stream-static snapping: each micro-batch of entries is snapped like a table, so results equal the batch operator's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from streetweave.operators.snap import snap_entries


def snap_stream(entries: DataFrame, edges: DataFrame, path: str, checkpoint: str, reach: float = 100.0) -> StreamingQuery:
    """Start a query that appends snapped entries (streaming entry_id, x, y, ...) to Parquet files at `path`.

    A batch that is run again after a failure replaces its own files, which are partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        snap_entries(batch, edges, reach).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming additions: resumable appends and a windowed monitor.

The analytics themselves are batch; these serve feeds of new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.sources.manifests import append_missing


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's rows that the table at ``path`` lacks; a batch that is
    replayed after a failure adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        append_missing(batch.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monitor(stream: DataFrame, ts: str, by: str, value: str, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts and means by event-time window; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))

"""Keyframes and evidence that arrive as files, kept current by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinequery.sources.vector_store import VectorStore


def arriving(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1_000) -> DataFrame:
    """Rows of JSON Lines files as they come in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def keep_vectors(rows: DataFrame, store: VectorStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert by video: the vectors of every video in a batch replace those that are stored.

    A batch that is run again after a failure replaces the same videos with the same rows.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.replace_videos(batch, batch.select("video_id"))

    writer = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(events: DataFrame, at: str, key: str, width: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Counts a key and time window; rows later than ``late`` are not waited for."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("start"), key, "rows")


def run_to_end(query: StreamingQuery, after: Callable[[], None] | None = None) -> None:
    query.awaitTermination()
    if after:
        after()

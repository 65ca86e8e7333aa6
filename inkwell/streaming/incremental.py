"""Document queries over streams: row-local ones run unchanged, sessions gather a conversation's turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a folder's Parquet files, with their schema."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_query(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Appends a row-local operator's rows to a Parquet sink once for each input row, restarts included."""
    return operator(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a key gathered into sessions; events later than ``late`` are dropped in a stream."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")

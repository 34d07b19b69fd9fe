"""Streams of texts: incremental compression, duplicate flags, and postings, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as X
from textloom.operators.fingerprint import fingerprinted, postings


def read_texts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON lines that arrive as files in a folder."""
    return spark.readStream.schema(schema).json(folder)


def first_seen(stream: DataFrame, text: str = "text", time: str | None = None, keep: str = "1 day") -> DataFrame:
    """The stream without texts whose digest came before; with a time column, state is kept for so long only."""
    hashed = stream.withColumn("sha256", F.sha2(X.text_of(text), 256))
    return hashed.withWatermark(time, keep).dropDuplicatesWithinWatermark(["sha256"]) if time else hashed.dropDuplicates(["sha256"])


def append_postings(stream: DataFrame, key: str, text: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch's postings to a Parquet table, a folder for each batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        postings(fingerprinted(batch, key, text)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, change: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch operator to each micro-batch and writes its rows."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_window(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and token sums of usage events for each session and time window; late events within the bound count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "session_id").agg(F.count("*").alias("operations"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))

"""The corpus build as a stream: the batch transforms run unchanged on files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import FILING_CHUNKER, Chunker, chunked
from ..operators.filings import clean_text


def incoming(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cleaned_chunks(docs: DataFrame, text_col: str, chunker: Chunker = FILING_CHUNKER) -> DataFrame:
    """Clean and chunk row by row: no state, so late and early files count alike."""
    rows = docs.withColumn("clean_text", clean_text(F.col(text_col))).where("clean_text <> ''")
    return chunked(rows.drop(text_col), "clean_text", chunker).drop("clean_text")


def drain(chunks: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that has arrived, then stop; a rerun goes on after what the checkpoint knows."""
    chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events by type and time window, closed once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")

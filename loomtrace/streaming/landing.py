"""Sessions that arrive as immutable increments of lines in a landing folder, merged into saved tables batch by batch.

A growing file can't be tailed by a file stream, which takes files as immutable; a writer lands each increment as a
file of its own. Every batch is written under its number, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LINE = "file_path string, line_no int, raw_text string"


def lines_stream(spark: SparkSession, landing: str, files_per_batch: int = 1_000) -> DataFrame:
    """Lines (file_path, line_no, raw_text) that land as JSON records."""
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_batch).json(landing)


def append_batches(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch of the stream to ``{out}/batch={number}`` and end when nothing is left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, out: str) -> DataFrame:
    """All lines that have landed; of a line written again the one of the latest batch counts."""
    lines = spark.read.schema(LINE + ", batch long").option("basePath", out).parquet(out)
    return lines.groupBy("file_path", "line_no").agg(F.max_by("raw_text", "batch").alias("raw_text"))


def entry_counts(stream: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Entries per type and hour of their own stamps (a column ts), with late ones up to the delay."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "entry_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "entry_type", "n")

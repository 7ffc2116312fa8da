"""Progress of narration as a stream: what a poll would count is kept up as segments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "book string, chunk_idx int, frames bigint, sr int, written_at timestamp_ntz, loaded_at timestamp_ntz"


def segment_stream(spark: SparkSession, folder: str, schema: str = SEGMENTS, files_per_trigger: int = 16) -> DataFrame:
    """Segments as their Parquet files appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def made_by_window(segments: DataFrame, window: str = "10 minutes", late: str = "2 days") -> DataFrame:
    """(window_start, book, pieces, seconds): finished pieces by time of writing.

    A piece that is written again counts once per time of writing; rows later than ``late`` are dropped, those without
    frames or time don't count.
    """
    rows = segments.where(F.col("frames").isNotNull() & F.col("written_at").isNotNull()).withColumn("at", F.col("written_at").cast("timestamp"))
    rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["book", "chunk_idx", "at"])
    out = rows.groupBy(F.window("at", window).alias("w"), "book").agg(F.count("*").alias("pieces"), F.sum(F.col("frames") / F.col("sr")).alias("seconds"))
    return out.select(F.col("w.start").alias("window_start"), "book", "pieces", F.round("seconds", 3).alias("seconds"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what is there into an in-memory table; for tests and back-filling."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

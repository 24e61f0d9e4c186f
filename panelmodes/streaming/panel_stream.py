"""The panel as a stream: readings arrive in files, corrected or repeated, and windowed totals are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_totals(events: DataFrame, time: str, keys: list[str], value: str, length: str, step: str, late: str) -> DataFrame:
    """(window_start, window_end, keys, n, total) over sliding event-time windows; readings later than ``late`` behind the newest are dropped by the watermark.

    Works on streams and tables alike. State is one partial sum per key and open window.
    """
    rows = events.where(F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    g = rows.groupBy(F.window(time, length, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def first_seen(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Events without repeats of ``key`` within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now into a parquet folder, exactly once by the checkpoint folder."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

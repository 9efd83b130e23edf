"""Streaming forms of log operators: each gives, run to the end, what its batch form gives.

Policy of time: lateness of ten minutes, rows older than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a Parquet table (a folder, or one file), with the table's schema."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, slide: str | None = None) -> DataFrame:
    """start, keys, n, total of event-time windows (tumbling, or sliding with a slide)."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = events.withWatermark(time, LATENESS) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def session_counts(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """start, key, n of sessions that end after a gap."""
    rows = events.withWatermark(time, LATENESS) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def dedupe(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Repeated packs, prompts and endings dropped, within the watermark on a stream."""
    if events.isStreaming:
        return events.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table below the folder and read it.

    Complete results are rewritten by each batch, so only the last one stays.
    """
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)

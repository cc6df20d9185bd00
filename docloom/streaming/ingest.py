"""Streaming ingestion: a directory of text files into the chunk store, and windows over event streams.

A streaming file source sees each path once, so changed and deleted files need the batch index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.store import ChunkStore
from docloom.sources.files import parse_text


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """identity, name, suffix, hash and content of new files under root."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(F.col("path").alias("identity"), F.element_at(F.split("path", "/"), -1).alias("name"), suffix.alias("suffix"), F.sha2("content", 256).alias("hash"), "content")


def ingest(files: DataFrame, store: ChunkStore, build, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's documents into the store; a repeated batch rewrites the same partitions."""

    def write(batch: DataFrame, _: int) -> None:
        store.write_documents(build(parse_text(batch)))

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: event-time windows with a watermark, batch or streaming."""
    own = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return own.groupBy(F.window("__ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: session windows with a watermark."""
    own = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return own.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")

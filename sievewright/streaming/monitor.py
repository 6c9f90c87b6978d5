"""Streaming extensions: a weekly monitor, deduplication by digest, and watch-and-triage of a folder. The batch operators run unchanged inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files, pe


def weekly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """week, event_type, n, total: state is dropped once the watermark has passed a week."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "7 days", "7 days", "4 days"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("week"), "event_type", "n", "total")


def first_seen(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows with a digest not seen within the watermark."""
    return records.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["sha256"])


def watch(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, most: int = 128 << 20) -> StreamingQuery:
    """Parse what arrives in ``folder`` and hand each batch to ``sink``; ends when all that is there is done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    new = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{" + ",".join(files.SUFFIXES) + "}").load(folder)
    return pe.dissected(pe.readable(new, most)).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

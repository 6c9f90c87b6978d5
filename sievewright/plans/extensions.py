"""Extensions beyond batch evaluation: the weekly monitor as a stream over the events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import scratch, table
from ..streaming import monitor

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def stream_weekly_counts(spark, d):
    """All of the events file through a stream (available now); each batch writes the counts as a table, so none of them pass through the driver."""
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    path = scratch(spark)
    counts = monitor.weekly_counts(source).select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "n", F.round("total", 4).alias("total"))
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/counts")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/counts")


QUERIES["stream_weekly_counts"] = stream_weekly_counts
ORACLE_SQL["stream_weekly_counts"] = "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

"""Scans of Parquet tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the one that all executors share; without one, a temporary one in local mode and an error on a cluster."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="sievewright-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows that a Python kernel over files takes at a time.
ROWS = 256


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ``rows`` rows: Spark's have up to 10,000, whatever a row weighs."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: Folders made by ``written``: path -> session.
_written: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: evaluated once, read as often as needed, and gone when the program ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path, spark in _written.items():
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended; the folder's owner clears it
            pass

"""Scans of files, JSON records and line archives; sinks of scan results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RAW_V2

#: Fixed value: file name endings of a folder scan.
SUFFIXES = ("exe", "dll", "sys", "ocx", "scr", "cpl", "efi", "bin")


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, most: int = 128 << 20, limit: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of a folder's files, largest refused unread; a limit takes the first paths."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path).filter(F.col("length") <= most)
    return df.orderBy("path").limit(limit) if limit else df


def refused(spark: SparkSession, path: str, most: int = 128 << 20) -> DataFrame:
    """Files that are too large to read, by their metadata alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > most).select("path", "length")


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines (any codec Spark reads; bzip2 splits by block): unlabelled ones (label -1) go, imports become the ordered array."""
    schema = RAW_V2.replace("imports array<struct<dll:string,functions:array<string>>>", "imports map<string,array<string>>")
    lines = spark.read.text(path).filter("length(trim(value)) > 0")
    record = lines.select(F.from_json("value", schema).alias("r")).select("r.*").filter("label IS NULL OR label <> -1")
    return record.withColumn("imports", F.transform(F.map_entries("imports"), lambda e: F.struct(e["key"].alias("dll"), e["value"].alias("functions"))))


def write_scan(triaged: DataFrame, path: str) -> DataFrame:
    """Scan lines as JSON, and the summary: verdict, n."""
    lines = triaged.select("path", "verdict", "score", "packed", "route", F.transform("capabilities", lambda c: c["attack_id"]).alias("capabilities"), "error")
    lines.write.mode("overwrite").json(path)
    return lines.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Rule texts under one module import."""
    head = rules.sparkSession.createDataFrame([('import "pe"',)], "text string")
    head.unionByName(rules.select("text")).coalesce(1).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """One Parquet table by split, in place of matrices and side files."""
    features.write.mode("overwrite").partitionBy("split").parquet(path)


def benign_files(spark: SparkSession, path: str, limit: int = 400, most: int = 32 << 20) -> DataFrame:
    """A benign corpus for batch work: the first ``limit`` readable files by path (0: all), of 32 MiB each at most."""
    return files(spark, path, most=most, limit=limit or None)


def benign_programs(spark: SparkSession, path: str) -> DataFrame:
    """A benign corpus for a service: programs, libraries and drivers only, of any size that may be read."""
    return files(spark, path, suffixes=("exe", "dll", "sys"))


def features_of(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """One split of one dataset from a table partitioned by both; other partitions are never listed for reading."""
    return spark.read.parquet(path).filter((F.col("dataset") == dataset) & (F.col("split") == split))


def archive_members(archives: DataFrame, suffixes: tuple[str, ...] = ("exe", "dll", "pyd"), most: int = 32 << 20) -> DataFrame:
    """path, member, length, content of programs inside zip archives (path, content): by ending, begun by MZ, ``most`` bytes unpacked at most."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    members = zipfile.ZipFile(io.BytesIO(content or b""))
                    found = [i for i in members.infolist() if i.filename.lower().endswith(tuple(f".{x}" for x in suffixes)) and i.file_size <= most]
                    rows = [(i.filename, members.read(i)) for i in found]
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    continue
                rows = [(n, d) for n, d in rows if d.startswith(b"MZ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([n for n, _ in rows]), pa.array([len(d) for _, d in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["path", "member", "length", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, member string, length long, content binary")


def write_corpus(samples: DataFrame, path: str) -> None:
    """(family, number, content) as rows under a folder for each family, in files that Spark reads back in parts."""
    samples.write.mode("overwrite").partitionBy("family").parquet(path)


def write_result(result: DataFrame, path: str, command: str = "") -> None:
    """A result of one row (or few) as JSON with where it came from: command, Spark's version, time."""
    spark = result.sparkSession
    origin = F.struct(F.lit(command).alias("command"), F.lit(spark.version).alias("spark"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("written_utc"))
    safe = [F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in result.schema.fields]
    result.select(*safe, origin.alias("provenance")).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def analysis_text(triaged: DataFrame) -> DataFrame:
    """path, report: a few lines for a reader (verdict, score, family, capabilities, notes)."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n")
    head = F.concat_ws(" ", "path", "verdict", F.format_number("score", 4), F.coalesce("family", F.lit("")))
    return triaged.select("path", F.concat_ws("\n", head, F.lit("capabilities:"), listed("techniques"), F.lit("notes:"), listed("notes")).alias("report"))

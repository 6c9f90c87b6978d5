"""Shared plumbing of the training-data operators: tables, cut points, blocks of documents."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at a time.
BLOCK_BYTES = 1 << 20


#: Rows of one Arrow batch between Spark and a Python worker, at most: Spark's own default, 10,000 rows of text, has no bound in bytes that an executor could hold several times.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The session's Arrow batches are held to ``BATCH_ROWS`` from here on, unless they are smaller already."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a temporary one in local mode and an error on a cluster."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


#: Tables written by ``cut`` that are still there: path -> session, and name if the catalog knows them.
_written: dict[str, tuple[SparkSession, str | None]] = {}


def _remove(path: str) -> None:
    spark, name = _written.pop(path, (None, None))
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_written):
        _remove(path)


def cut(df: DataFrame, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and any executor can reread it.

    With ``by`` the table is bucketed by that column, and grouping the result by it needs no shuffle.
    """
    spark, name = df.sparkSession, f"sievewright_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _written[path] = spark, name if by else None
    if by:
        df.write.format("parquet").bucketBy(buckets, by).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = spark.table(name)
    else:
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        _remove(getattr(t, "_cut_path", ""))


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Deletes on leaving all tables cut inside but those put into the list."""
    before, stay = set(_written), []
    yield stay
    kept = {getattr(t, "_cut_path", "") for t in stay}
    for path in set(_written) - before - kept:
        _remove(path)


#: Keys with more than this part of all rows are hot. There can be no more than so many, which bounds their broadcast.
HOT_KEYS = 20_000


def meet(rows: DataFrame, one: DataFrame, key: str, many: str, how: str = "inner", least: int = 1_000, total: int | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``one``, which has one row a key and in ``many`` the number of rows that hold it.

    Keys held by more than a ``HOT_KEYS``-th of ``total`` rows (and ``least``) meet by broadcast, so that no task gets all rows of
    one of them; the others are left to a plain join. ``rows`` is read twice and should be a written table; so should ``one``, which tells
    first whether any key is hot.
    """
    if hasattr(one, "_cut_path"):
        # One row tells whether any key is hot. Mostly none is: then there is nothing to broadcast, and the driver has a plain join to plan.
        most = one.agg(F.max(many)).first()[0] or 0
        if most <= least or most <= (total := rows.count() if total is None else total) // HOT_KEYS:
            return rows.join(one, key, how)
    bound = max(least, (rows.count() if total is None else total) // HOT_KEYS)
    hot = one.filter(F.col(many) > bound)
    warm = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one, key, how)
    return warm.unionByName(cold)


#: Bits of a membership filter. Its table has a row for every 64, so that its size is fixed whatever the ids are.
FILTER_BITS = 1 << 24


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _maybe(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` (no columns that begin with an underscore) with ``_maybe``: false where ``key`` is surely not among the one column of ``ids``.

    A one-hash filter of fixed size is broadcast (262,144 rows at most). Beyond some ten million ids it lets more and more rows
    through, and the exact join that follows does all the work.
    """
    (name,) = ids.columns
    place = _place(F.col(name).cast("string"))
    words = ids.select(F.shiftright(place, 6).alias("_word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(cast(`%s` as string)), %d) & 63 as int))" % (name, FILTER_BITS)).alias("_bit"))
    bits = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    mine = df.withColumn("_p", _place(F.col(key).cast("string"))).withColumn("_word", F.shiftright("_p", 6))
    hit = F.expr("shiftright(_bits, cast(_p & 63 as int)) & 1") == 1
    return mine.join(F.broadcast(bits), "_word", "left").withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_p", "_word", "_bits")


def rows_with(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` (null equals null) is among ``ids``: only likely ones are shuffled."""
    (name,) = ids.columns
    return likely_rows(df, key, ids).join(ids.withColumnRenamed(name, "_id").hint("merge"), F.col(key).eqNullSafe(F.col("_id")), "left_semi")


def likely_rows(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """All rows of ``df`` whose ``key`` is among ``ids`` and few others: for a join with ``ids`` that follows."""
    return _maybe(df, key, ids).filter("_maybe").drop("_maybe")


def rows_without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``ids``: rows that the filter clears never move."""
    (name,) = ids.columns
    marked = _maybe(df, key, ids)
    likely = marked.filter("_maybe").drop("_maybe")
    rest = likely.join(ids.withColumnRenamed(name, "_id").hint("merge"), F.col(key).eqNullSafe(F.col("_id")), "left_anti")
    return marked.filter("NOT _maybe").drop("_maybe").unionByName(rest)


def digest(text: Column) -> Column:
    """SHA-256 of a text in hex; null as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def row_key(doc_id: Column, digest: Column) -> Column:
    """One row of a corpus by id and digest of its text, for ids that may be null or repeat with other texts."""
    return F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), F.lit(":"), digest)


def row_name(doc_id: Column, text: Column) -> Column:
    """``row_key`` as 256 bits (binary), so that rows of other ids or texts never share one."""
    return F.unhex(F.sha2(row_key(doc_id, digest(text)), 256))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``sums``, that column's sum over all rows before a row in the order.

    Rows are dealt by ranges of the order and written with their place; sums of ranges (a row a partition) are added up
    first, then running sums come inside a range. No task holds more than a range.
    """
    values = {f"v_{k}": c.alias(f"v_{k}") for k, c in sums.items()}
    placed = cut(df.select("*", *values.values()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("place", 33))
    inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"o_{k}") for k, v in zip(sums, values, strict=True)))
    out = placed.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in zip(sums, values, strict=True)}).join(F.broadcast(offsets), "range")
    return out.select(*df.columns, *((F.col(k) + F.col(f"o_{k}")).alias(k) for k in sums))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def given_back(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel`` whose worker returns to the system what it has freed when a task ends: several workers wait beside each other between a job's stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        # Only the C library of Linux can be asked for it.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).to_pylist()]


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``row``, each whole row of ``docs`` as one struct, and ``keys``: no helper column can clash with one of the rows'."""
    return docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in keys.items()))


def unpacked(df: DataFrame) -> DataFrame:
    """The rows of ``packed`` with their own columns and types again."""
    return df.select("row.*")

"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. A map task keys its documents by SHA-256 of the normalised text and takes ``BITS`` of each digest as fingerprint. Runs of up to
   ``RUN`` rows make a part: for each owner (a range of fingerprints) the task codes one sorted Golomb-Rice list right there, so that
   fingerprints leave it only as codes. Rows and lists are written together, rows bucketed by part.
2. An owner decodes the lists it got and answers each part with a bitmap: which of its fingerprints occur
   more than once anywhere. Owners are as many as the rows ask for.
3. The bitmaps go to the parts where they lie, bucket by bucket, and mark their suspects. Only suspects' texts are shuffled, grouped by
   their bytes (so equal bytes, not hashes, decide) after being combined before the shuffle; one row for each distinct text and partition travels.

Defined results: null text is empty text, and empty texts are copies of each other. Rows of one ``doc_id`` are one document
and share their outcome. Rows without ``doc_id`` count in group_size, but never stay when another copy has an id;
a group without any id keeps all its rows (keep_id null). Other columns are not read. Tables without rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, cut, discard, likely_rows, meet, packed, passing, row_key, rows_with, rows_without, table, unpacked

#: Bits of a fingerprint. Of n documents one has a namesake by chance with odds of n in 3 x 10^14; that costs a look at its bytes, no error.
BITS = 48
#: Rows of a part, at most.
RUN = 1 << 18
#: Fingerprints of an owner, about; more for very many rows, so that lists don't become too short to code.
OWNED = 1 << 17


def normalised(text) -> F.Column:
    """Each run of white space (0x20, 0x09-0x0D) as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted unsigned integers as (shift, unary bits, plain bits): gaps with ``shift`` low bits plain and the rest in unary."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    shift = max((int(values[-1]) // len(values)).bit_length() - 1, 0)
    end = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1)
    unary = np.ones(int(end[-1]), np.uint8)
    unary[end - 1] = 0
    plain = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)[::-1]) & np.uint64(1)
    return shift, np.packbits(unary).tobytes(), np.packbits(plain.astype(np.uint8)).tobytes()


def golomb_decode(n: int, shift: int, unary: bytes, plain: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    high = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(plain, np.uint8), count=n * shift).reshape(n, shift).astype(np.uint64)
    low = bits @ (np.uint64(1) << np.arange(shift, dtype=np.uint64)[::-1])
    return np.cumsum((high << np.uint64(shift)) | low)


def fingerprints(digests: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)[:, : BITS // 8]
    return np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).reshape(-1).view(">u8").astype(np.uint64)


_LIST = "owner long, n long, shift long, unary binary, plain binary, twice binary"


def _code(owners: int):
    """Rows (doc_id, sha) in, the same rows with their part out, and for each part and owner a coded list."""

    def lists(part: int, found: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        values, copies = np.unique(np.concatenate(found), return_counts=True)
        owner = (values * np.uint64(owners)) >> np.uint64(BITS) if owners < 1 << (64 - BITS) else values // np.uint64(-(-(1 << BITS) // owners))
        rows = []
        for o, first, n in zip(*np.unique(owner, return_index=True, return_counts=True), strict=True):
            mine = slice(first, first + n)
            rows.append((None, None, part, int(o), int(n), *golomb_encode(values[mine]), np.packbits(copies[mine] > 1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, held, found, schema = TaskContext.get().partitionId(), 0, 0, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                piece = batch.slice(at, RUN)
                if held + piece.num_rows > RUN:
                    yield lists(task << 24 | turn, found, schema)
                    turn, held, found = turn + 1, 0, []
                nothing = [pa.nulls(piece.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
                out = pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("sha"), pa.array(np.full(piece.num_rows, task << 24 | turn)), *nothing], ["doc_id", "sha", "part", "owner", "n", "shift", "unary", "plain", "twice"])
                schema, held = out.schema, held + piece.num_rows
                found.append(fingerprints(piece.column("sha").to_pylist()))
                yield out
        if held:
            yield lists(task << 24 | turn, found, schema)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One owner: the lists of all parts in, for each list a bitmap of what occurs again."""
    lists = [golomb_decode(r.n, r.shift, r.unary, r.plain) for r in pdf.itertuples()]
    values, lists_with = np.unique(np.concatenate(lists), return_counts=True)
    again = values[lists_with > 1]
    found = []
    for have, twice, n in zip(lists, pdf["twice"], pdf["n"], strict=True):
        own = np.unpackbits(np.frombuffer(twice, np.uint8), count=n).astype(bool)
        at = np.minimum(np.searchsorted(again, have), max(len(again) - 1, 0))
        found.append(np.packbits(own | (again[at] == have if len(again) else False)).tobytes())
    return pd.DataFrame({"owner": pdf["owner"], "part": pdf["part"], "n": pdf["n"], "bitmap": found})


def _mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """One part: its fingerprints in their sent order meet the bitmaps of their owners."""
    values, inverse = np.unique(fingerprints(rows["sha"].tolist()), return_inverse=True)
    flags = [np.unpackbits(np.frombuffer(a.bitmap, np.uint8), count=a.n) for a in answers.sort_values("owner").itertuples()]
    flag = np.concatenate(flags).astype(bool)
    if len(flag) != len(values):
        raise ValueError("a part's bitmaps don't match its fingerprints")
    return pd.DataFrame({"doc_id": rows["doc_id"], "sha": rows["sha"], "suspect": flag[inverse]})


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.count()
    owners = max(1, math.ceil(rows / max(OWNED, 20 * math.isqrt(rows))))
    with passing() as stay:
        keyed = docs.select("doc_id", F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)).alias("sha"))
        coded = keyed.mapInArrow(_code(owners), f"doc_id {kind}, sha binary, part long, {_LIST}")
        written = cut(coded, "part", min(100_000, max(8, 2 * math.ceil(rows / RUN))))
        answers = written.filter("owner IS NOT NULL").select("owner", "part", *(c.split()[0] for c in _LIST.split(", ")[1:])).groupBy("owner").applyInPandas(_answer, "owner long, part long, n long, bitmap binary")
        digests = written.filter("owner IS NULL").select("part", "doc_id", "sha")
        marked = cut(digests.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_mark, f"doc_id {kind}, sha binary, suspect boolean"))
        discard(written)
        suspects = cut(marked.filter("suspect").select("doc_id").distinct())
        # A row that only seems a suspect costs its text's way and changes nothing, so while the filter lets few such rows through, no exact join is needed.
        chosen = likely_rows if suspects.count() <= FILTER_BITS // 32 else rows_with
        texts = chosen(docs.select("doc_id", "text"), "doc_id", suspects)
        verified = texts.select("doc_id", normalised(F.col("text")).alias("norm")).groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = cut(verified.select(F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha"), "keep_id", "group_size"))
        stay += [marked, groups]
    out = meet(marked, groups, "sha", "group_size", "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each normalised text: that with the smallest id, null last; among rows of that id the smallest row.

    Rows are dropped by id and digest, so a null or repeated id drops no other text. Null and empty texts are copies of each other. Other columns
    come through whatever their names, but their types must have an order (no maps); tables without rows give none.
    """
    key = row_key(F.col("doc_id"), F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    keyed = packed(docs, key=key)
    with passing() as stay:
        several = exact_duplicates(docs.select("doc_id", "text")).filter("group_size > 1").groupBy(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
        found = cut(several.agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
        stay.append(found)
    gone, repeated = found.filter("NOT kept OR n > 1").select("key"), found.filter("kept AND n > 1").select("key")
    rest = rows_without(keyed, "key", gone)
    if repeated.isEmpty():
        return unpacked(rest)
    # Combined before the shuffle, likely rows first: a group of repeats may be large.
    one = likely_rows(keyed, "key", repeated).groupBy("key").agg(F.min("row").alias("row")).join(repeated.hint("merge"), "key", "left_semi")
    return unpacked(rest.unionByName(one.select("row", "key")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""

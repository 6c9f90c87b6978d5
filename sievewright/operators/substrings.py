"""Which strings stand in no text of a corpus: a join on each string's rarest gram.

Grams are windows of ``GRAM`` characters, known by a 64-bit rolling hash, so no window is ever made a string. One pass over the texts counts in how many texts the
strings' grams stand; every string is posted under its rarest gram. A second pass finds the texts that hold a posted gram. What is shuffled are digests of texts, hashes and
strings; a text is fetched once, by its digest, to look for the strings that it may hold. A gram that many texts hold is split by the texts' digests.

Both passes drop all other grams by a bit table of fixed size, so what is broadcast doesn't depend on the strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import sliced, written

#: Characters of a gram, which is also the least that a string may have.
GRAM = 6
#: Bits of the table of grams, and texts that one part of a gram's list holds, about.
BITS, PART = 1 << 24, 10_000
#: Texts that a task takes at a time.
TEXTS = 128
#: Odd multipliers of a polynomial hash modulo 2^64 and of its last mixing.
_FACTOR, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def grams(text: str) -> np.ndarray:
    """Hashes (63 bits) of all grams of a text, in their order."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * _FACTOR + code[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * _LAST
    return (h >> np.uint64(1)).astype(np.int64)


def _words(hashes: DataFrame) -> DataFrame:
    """w, b: 64 bits of the table that has a bit for each of the numbers in ``gram``; at most ``BITS`` / 64 rows."""
    place = F.pmod("gram", F.lit(BITS))
    return hashes.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(gram, {BITS}) & 63 AS int))")).alias("b"))


def _bits(hashes: DataFrame) -> Broadcast:
    """The table as 2 MB."""
    words = _words(hashes).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table.tobytes())


def _held(texts: DataFrame, text: str, bits: Broadcast) -> DataFrame:
    """digest, gram: each text's distinct grams that have their bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").view(bool)
        for batch in sliced(batches, TEXTS):
            digests, times, found = [], [], []
            for t in batch.column("text").to_pylist():
                g = np.unique(h[table[h & (BITS - 1)]]) if t is not None and len(h := grams(t)) else ()
                if len(g):
                    digests.append(hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
                    times.append(len(g))
                    found.append(g)
            digest = pa.array(digests, pa.binary()).take(pa.array(np.repeat(np.arange(len(digests)), np.array(times, np.int64))))
            yield pa.RecordBatch.from_arrays([digest, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["digest", "gram"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "digest binary, gram long")


def _of_strings(strings: DataFrame) -> DataFrame:
    """s, gram: each string's distinct grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s").to_pylist()
            g = [np.unique(grams(x)) for x in s]
            yield pa.RecordBatch.from_arrays([batch.column("s").take(pa.array(np.repeat(np.arange(len(s)), list(map(len, g))))), pa.array(np.concatenate(g) if g else np.zeros(0, np.int64))], ["s", "gram"])

    return strings.mapInArrow(run, "s string, gram long")


def held_strings(strings: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """s: strings (``GRAM`` characters at least; shorter ones and null are left out) that some text contains. Null texts contain none."""
    own = written(_of_strings(strings.select("s").filter(F.length("s") >= GRAM).distinct()))
    counts = _held(texts, text, _bits(own.select("gram").distinct())).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A string with a gram that no text has is in none of them.
    rarest = own.join(counts, "gram", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    posted = written(rarest.filter("r.n > 0").select("s", "r.gram", F.ceil(F.col("r.n") / PART).alias("parts")))
    parts = posted.select("gram", "parts").distinct()
    spread = posted.select("s", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    lists = _held(texts, text, _bits(parts.select("gram"))).join(parts, "gram").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    pairs = written(lists.join(spread, ["gram", "part"]).select("digest", "s").distinct())
    # Only texts that may have a pair move, and equal ones are one before they do.
    number = F.xxhash64("digest")
    likely = texts.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.col(text).alias("t")).withColumns({"gram": number, "w": F.shiftright(F.pmod(number, F.lit(BITS)), 6)})
    likely = likely.join(F.broadcast(_words(pairs.select(number.alias("gram")))), "w").filter(F.expr(f"shiftright(b, cast(pmod(gram, {BITS}) & 63 AS int)) & 1 = 1"))
    likely = likely.groupBy("digest").agg(F.first("t").alias("t"))
    return likely.join(pairs, "digest").filter(F.contains("t", F.col("s"))).select("s").distinct()


def absent_strings(strings: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Rows of ``strings`` (column s, ``GRAM`` characters at least; shorter ones are left out) that no text contains."""
    return strings.filter(F.length("s") >= GRAM).join(held_strings(strings, texts, text), "s", "left_anti")

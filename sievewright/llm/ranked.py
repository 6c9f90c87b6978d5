"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

The documents' statistics (how many, how many terms, how many hold each query term) are counted in one pass over all of them. A second pass ranks: each task
indexes its documents a block at a time (a posting list of document and contribution for each query term), and evaluates every item on the block:

* Lists of at most a ``SHORT``-th of the block are summed term at a time into accumulators. These become one more list, bounded by their largest sum.
* Document-at-a-time evaluation runs over that list and the long ones. The lists whose bounds together can't reach the item's tenth best score so far are only looked up:
  documents that stand in no other list are skipped, and a document is left as soon as its score and the bounds still open can't reach that score. The tenth largest accumulator is a
  threshold to begin with; the threshold goes on from block to block of the task.

A task hands on ten documents an item at most; they are ranked in two rounds, so an item's rows from all tasks don't meet at once. Items are taken in slices of at most ``SLICE`` characters of
text (one item at least), a pair of passes each, so what is broadcast has that bound however many items there are.

Defined results: null text has no terms; documents without terms count nowhere and never come; documents without ``doc_id`` come after others of equal score; repeated documents are
ranked each for itself; items repeated with equal text are one, with other texts each is ranked for itself; an item without terms gives no rows. Other columns are not read; no rows give none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import _begins, _gathered
from .common import as_bytes, blocks, cut, running, table

#: Documents of a result.
TOP = 10
#: Words and documents of a block, at most (one document at least), and the part of a block's documents that makes a list long.
WORDS, DOCS, SHORT = 2_000_000, 16_384, 32
#: Characters of items that are ranked in one pair of passes.
SLICE = 4_000_000
#: Stretches of documents in which a block is evaluated, each with the threshold that the one before has left.
STRETCHES = 4
#: Groups of tasks whose best are ranked among themselves first.
GROUPS = 64

_LETTERS = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Items:
    """A slice of the items: their ids, the terms of all, and for each item its terms' numbers and how often each stands in it."""

    def __init__(self, ids: list, texts: list[str | None]):
        counts = [Counter(terms((t or "").encode())) for t in texts]
        self.ids, self.number = ids, {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        self.terms = [np.array([self.number[t] for t in c], np.int64) for c in counts]
        self.times = [np.array(list(c.values()), np.int64) for c in counts]
        self.weight, self.documents, self.length = np.zeros(len(self.number), np.int64), 0, 0

    def weighed(self, holding: dict[int, int], documents: int, length: int) -> Items:
        self.documents, self.length = documents, length
        for k, df in holding.items():
            self.weight[k] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        return self


#: Numbers of the two rows that count documents and their terms, beside those of terms.
_DOCUMENTS, _LENGTH = -1, -2


def statistics(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """number, n: documents that hold each query term, all documents with terms, all their terms; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number
        known, held = set(number), Counter()
        for batch in batches:
            for text in as_bytes(batch):
                words = terms(text)
                held[_DOCUMENTS] += bool(words)
                held[_LENGTH] += len(words)
                held.update(known.intersection(words))
        rows = [(number.get(k, k), n) for k, n in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["number", "n"])

    return docs.select("text").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


class Block:
    """Posting lists of a block of documents in order of their ids: document and contribution, for each query term."""

    def __init__(self, items: Items, sizes: list[int], numbers: np.ndarray, of: np.ndarray):
        n = np.array(sizes, np.int64)
        m = 25 + 75 * n * items.documents // max(1, items.length)
        keys, tf = np.unique(numbers * len(n) + of, return_counts=True)
        term, self.doc = keys // len(n), keys % len(n)
        self.value = items.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc]))
        self.first = np.searchsorted(term, np.arange(len(items.number) + 1))
        self.bound = np.zeros(len(items.number), np.int64)
        if len(term):
            held = _begins(term)
            self.bound[term[held]] = np.maximum.reduceat(self.value, held)
        self.docs = len(n)

    def best(self, numbers: np.ndarray, times: np.ndarray, least: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """Documents (ascending) and scores of one item: those of at least ``least`` that can be among the ``top`` best, and few others."""
        sizes = self.first[numbers + 1] - self.first[numbers]
        numbers, times, sizes = numbers[sizes > 0], times[sizes > 0], sizes[sizes > 0]
        short = sizes * SHORT <= self.docs
        lists = []
        if short.any():
            docs, values = self._summed(numbers[short], times[short], sizes[short])
            lists.append((int(values.max()), docs, values, 1))
            if len(values) >= top:
                least = max(least, int(np.partition(values, -top)[-top]))
        lists += [(int(self.bound[k] * q), self.doc[a:b], self.value[a:b], q) for k, q, a, b in zip(numbers[~short].tolist(), times[~short].tolist(), self.first[numbers[~short]].tolist(), self.first[numbers[~short] + 1].tolist(), strict=True)]
        lists.sort(key=lambda x: x[0])
        bounds = np.cumsum([x[0] for x in lists])
        found_docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(STRETCHES):
            low, high = self.docs * k // STRETCHES, self.docs * (k + 1) // STRETCHES
            # Lists before ``kept`` can't reach the threshold together.
            kept = int(np.searchsorted(bounds, least))
            spans = [(int(np.searchsorted(d, low)), int(np.searchsorted(d, high)), d, v, q) for _, d, v, q in lists[kept:]]
            if not any(b > a for a, b, *_ in spans):
                continue
            docs = np.unique(np.concatenate([d[a:b] for a, b, d, *_ in spans])) if len(spans) > 1 else spans[0][2][spans[0][0] : spans[0][1]]
            score = np.zeros(len(docs), np.int64)
            for a, b, d, v, q in spans:
                score[np.searchsorted(docs, d[a:b])] += q * v[a:b]
            for j in range(kept - 1, -1, -1):
                stays = score + bounds[j] >= least
                docs, score = docs[stays], score[stays]
                if not len(docs):
                    break
                _, d, v, q = lists[j]
                at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
                score = score + np.where(d[at] == docs, q * v[at], 0)
            stays = score >= least
            found_docs, found = np.concatenate([found_docs, docs[stays]]), np.concatenate([found, score[stays]])
            if len(found) > top:
                best = np.sort(np.lexsort((found_docs, -found))[:top])
                found_docs, found = found_docs[best], found[best]
                least = max(least, int(found.min()))
        return found_docs, found

    def _summed(self, numbers: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _gathered(np.arange(len(self.doc)), self.first[numbers], sizes)
        order = np.argsort(self.doc[at], kind="stable")
        docs, values = self.doc[at][order], (self.value[at] * np.repeat(times, sizes))[order]
        first = _begins(docs)
        return docs[first], np.add.reduceat(values, first)


def candidates(docs: DataFrame, shared: Broadcast, key: str, item_type: pa.DataType, item_kind: str, top: int = TOP, words: int = WORDS, most: int = DOCS) -> DataFrame:
    """item (its place in the slice), item_id, ``key``, score: each task's ``top`` documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        get, best, kind = items.number.get, [[] for _ in items.ids], None
        # As in the results: ascending ids, none last.
        by_id = lambda x: (x is None, x)
        ids, sizes, numbers = [], [], []

        def ranked() -> None:
            order = sorted(range(len(ids)), key=lambda k: by_id(ids[k]))
            flat = np.array([x for k in order for x in numbers[k]], np.int64)
            block = Block(items, [sizes[k] for k in order], flat, np.repeat(np.arange(len(order)), [len(numbers[k]) for k in order]))
            for held, terms_, times in zip(best, items.terms, items.times, strict=True):
                found, scores = block.best(terms_, times, held[-1][0] if len(held) >= top else 1, top)
                if len(found):
                    held += [(s, ids[order[d]]) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
                    held.sort(key=lambda x: (-x[0], by_id(x[1])))
                    del held[top:]
            for x in (ids, sizes, numbers):
                x.clear()

        for batch in blocks(batches):
            kind = batch.column("key").type
            count = sum(map(len, numbers))
            for k, text in zip(batch.column("key").to_pylist(), as_bytes(batch), strict=True):
                found = terms(text)
                if not found:
                    continue
                known = [x for t in found if (x := get(t)) is not None]
                ids.append(k)
                sizes.append(len(found))
                numbers.append(known)
                count += len(known)
                if count >= words or len(ids) >= most:
                    ranked()
                    count = 0
        if ids:
            ranked()
        if kind is not None:
            rows = [(k, item, d, s) for k, (item, held) in enumerate(zip(items.ids, best, strict=True)) for s, d in held]
            arrays = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), item_type, kind, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "item_id", "key", "score"])

    named = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"item long, item_id {item_kind}, key {named}, score long")
    return out.withColumn("group", F.spark_partition_id() % GROUPS)


def _slices(items: DataFrame, size: int) -> Iterator[list]:
    """Rows (item_id, text) of distinct items, in slices of about ``size`` characters."""
    items = items.select("item_id", "text").distinct()
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    total = items.agg(F.sum(chars)).first()[0] or 0
    if total <= size:
        yield items.collect()
        return
    dealt = cut(running(items, [F.col("item_id"), F.col("text")], {"before": chars}).withColumn("slice", F.floor(F.col("before") / size)))
    for k in range(-(-total // size)):
        yield dealt.filter(F.col("slice") == k).select("item_id", "text").collect()


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", size: int = SLICE, words: int = WORDS, most: int = DOCS) -> DataFrame:
    """item_id, rank, ``key``, score of each item's ``top`` documents with a score above 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    out = None
    for rows in _slices(items, size):
        chosen = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        counted = dict(statistics(texts, spark.sparkContext.broadcast(chosen)).collect())
        documents, length = counted.pop(_DOCUMENTS, 0), counted.pop(_LENGTH, 0)
        shared = spark.sparkContext.broadcast(chosen.weighed(counted, documents, length))
        found = candidates(docs, shared, key, to_arrow_type(kind), kind.simpleString(), top, words, most)
        first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        ranked = ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
d AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM numbered WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, term, count(*)::BIGINT AS q FROM (SELECT i, unnest(terms) AS term FROM i) GROUP BY i, term),
scored AS (SELECT i, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN d USING (r), totals GROUP BY i, r),
ranked AS (SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN i USING (i) JOIN d USING (r) WHERE rank <= {TOP}
"""

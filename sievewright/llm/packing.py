"""Best-fit packing of whole documents into sequences, by hierarchical residual packing.

1. Every text is encoded in one pass; a document longer than a sequence is cut into full pieces after a first one that may be shorter.
   What goes on is a narrow table of pieces (id, place, length, checksum), never the tokens.
2. Each partition of that table packs its pieces: largest first, each into the open bin that it fills best. Bins that are full but for ``SLACK`` tokens are
   emitted. The emptiest others, ``CARRY`` at most, stay as items: they meet the partition's next block of pieces, and then the bins of ``FAN_IN`` partitions in the next round,
   up a tree to a root. Bins beyond ``CARRY`` are emitted as they are, so no task ever holds more than ``FAN_IN * CARRY`` bins or a block of pieces.

A bin is an item of its fill's size in later rounds, and its pieces stay together. Which sequence a piece gets depends on the partitions of the table, not on anything
random; a lost executor's tasks are repeated with the same result.

Defined results: null text is empty, a document of one token (id 0). Repeated rows are packed as often as they come; rows without ``doc_id`` too.
Special strings of the tokenizer inside texts are encoded as its library does. Other columns are not read; no rows give none.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ENCODED_BYTES, MergeReplay, _gathered, encoder_of, shared_words
from .common import as_bytes, blocks, cut, given_back, table
from .token_counts import BYTE_LEVEL_PATTERN

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Free tokens with which a bin counts as full.
SLACK = 8
#: Bins that a task hands on to the next round, at most, and tasks whose bins meet there.
CARRY, FAN_IN = 512, 8
#: Pieces that a task packs at a time.
BLOCK = 200_000

_PIECE = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
_PLACE = [("sequence_id", "long"), ("offset", "long"), ("node", "long"), ("done", "boolean")]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Items by bin: largest first (earlier first of equal ones), each into the fullest bin that has room.

    Bit r of ``rooms`` says that a bin with r free places is open, so the best one is the lowest bit from the item's size on.
    """
    rooms, bins = 0, []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = at[room].pop()
            if not at[room]:
                rooms ^= 1 << room
            bins[k].append(item)
        else:
            room, k = capacity, len(bins)
            bins.append([item])
        if left := room - size:
            at[left].append(k)
            rooms |= 1 << left
    return bins


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


#: A worker's encoder, kept from task to task: this job has no other stage that would need its room.
_encoder: list = [None, None]


def _own_encoder(path: str, shared: Broadcast) -> MergeReplay:
    key = path, hashlib.sha256(shared.value).digest()
    if _encoder[0] != key:
        _encoder[:] = key, encoder_of(path, BYTE_LEVEL_PATTERN, shared)
    return _encoder[1]


def _encoded(path: str, encoder: MergeReplay, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each with ``end`` after it, and where each text's begin (one more at the end)."""
    tokenizer, special = _library(path)
    marked = [k for k, t in enumerate(texts) if any(x in t for x in special)]
    plain = list(texts)
    for k in marked:
        plain[k] = ""
    ids, at = encoder.flat(plain)
    own = [np.array(tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4") for k in marked]
    sizes = np.diff(at)
    starts = at[:-1].copy()
    pool = np.concatenate([ids, *own, np.array([end], "<u4")])
    for k, x, start in zip(marked, own, len(ids) + np.cumsum([0, *map(len, own)]), strict=False):
        sizes[k], starts[k] = len(x), start
    # Spans of each text and of the closing id, in turn.
    spans = np.stack([starts, np.full(len(texts), len(pool) - 1)], 1).ravel()
    counts = np.stack([sizes, np.ones(len(texts), np.int64)], 1).ravel()
    return _gathered(pool, spans, counts), np.concatenate([[0], np.cumsum(sizes + 1)])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, piece, start, length, ids_crc32 of every document's pieces of at most ``capacity`` tokens, by a byte-level BPE tokenizer file."""
    shared = shared_words(docs, tokenizer, BYTE_LEVEL_PATTERN, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _own_encoder(tokenizer, shared)
        for batch in blocks(batches, size=2 * ENCODED_BYTES):
            ids, at = _encoded(tokenizer, encoder, [x.decode("utf-8", "replace") for x in as_bytes(batch)], end)
            n = np.diff(at)
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = (n - 1) % capacity + 1
            length = np.where(piece == 0, head[doc], capacity)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            raw, first = memoryview(ids.tobytes()), 4 * (at[:-1][doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            arrays = [batch.column("key").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", *(c for c, _ in _PIECE)])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(given_back(run), ", ".join([f"key {kind}", *(f"{c} {t}" for c, t in _PIECE)]))
    return out.withColumnRenamed("key", key)


class _Packer:
    """Packs one task's items, a block at a time. An item is successive rows: a piece, or a bin of an earlier round."""

    def __init__(self, level: int, capacity: int, slack: int, carry: int):
        self.capacity, self.slack, self.carry = capacity, slack, carry
        self.node = TaskContext.get().partitionId()
        self.next = level << 58 | self.node << 32

    def rows(self, t: pa.Table, first: np.ndarray, last: bool, whole: bool) -> tuple[pa.Table, pa.Table, np.ndarray]:
        """Rows to emit, rows that stay, and where the items of those begin. ``last``: what stays leaves the task; ``whole``: nothing stays."""
        length = t.column("length").to_numpy()
        counts = np.diff(np.append(first, len(length)))
        sizes = np.add.reduceat(length, first) if len(first) else np.zeros(0, np.int64)
        bins = best_fit(sizes, self.capacity)
        items = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
        own = np.fromiter(map(len, bins), np.int64, len(bins))
        of = np.repeat(np.arange(len(bins)), own)
        fill = np.bincount(of, weights=sizes[items], minlength=len(bins)).astype(np.int64)
        free = np.flatnonzero(fill < self.capacity - self.slack)
        stay = np.zeros(len(bins), bool)
        if not whole:
            stay[free[np.argsort(fill[free], kind="stable")][: self.carry]] = True
        rows = _gathered(np.arange(len(length)), first[items], counts[items])
        bin_of = np.repeat(of, counts[items])
        before = np.cumsum(length[rows]) - length[rows]
        offset = before - np.repeat((np.cumsum(fill) - fill), np.bincount(bin_of, minlength=len(bins)))
        placed = t.take(pa.array(rows)).select([c for c in t.column_names if c not in dict(_PLACE)])
        values = [self.next + bin_of, offset, np.full(len(rows), self.node), ~stay[bin_of]]
        for (c, _), v in zip(_PLACE, values, strict=True):
            placed = placed.append_column(c, pa.array(v))
        self.next += len(bins)
        done = placed.column("done")
        rest = placed.filter(pa.compute.invert(done))
        begins = np.flatnonzero(np.diff(rest.column("sequence_id").to_numpy(), prepend=-1))
        return (placed if last else placed.filter(done)), rest, begins


def _round(items: DataFrame, level: int, whole: bool, capacity: int, slack: int, carry: int, block: int) -> DataFrame:
    """Rows of ``items`` with their place in a bin; those of bins that later rounds may still fill aren't ``done``."""

    own = [f for f in items.schema.fields if f.name not in dict(_PLACE)]
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, rest, begins = _Packer(level, capacity, slack, carry), [], None, None
        plain = lambda t: pa.table({c: t.column(c) for c in [*names, "sequence_id"]})

        def packed(last: bool) -> pa.Table:
            nonlocal held, rest, begins
            new = plain(pa.Table.from_batches(held))
            first = np.flatnonzero(np.diff(new.column("sequence_id").to_numpy(), prepend=-1)) if level else np.arange(new.num_rows)
            if rest is not None:
                first = np.concatenate([first, new.num_rows + begins])
                new = pa.concat_tables([new, plain(rest)])
            out, rest, begins = packer.rows(new.combine_chunks(), first, last, whole)
            held = []
            return out

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from packed(last=False).to_batches()
        if held or rest is not None:
            held = held or [batch.slice(0, 0)]
            yield from packed(last=True).to_batches()

    return items.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), *(f"{c} {t}" for c, t in _PLACE)]))


def packed(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, carry: int = CARRY, fan_in: int = FAN_IN, block: int = BLOCK) -> DataFrame:
    """``items`` (a column ``length`` of 1 to ``capacity``, and any others but the ones added) with sequence_id and offset."""
    size = {"capacity": capacity, "slack": slack, "carry": carry, "block": block}
    out, level = [], 0
    t = cut(_round(items.withColumns({"sequence_id": F.lit(0).cast("long"), "done": F.lit(False)}), level, False, **size))
    while True:
        out.append(t.filter("done"))
        left = t.filter("NOT done")
        nodes = left.agg(F.count_distinct("node")).first()[0]
        if not nodes:
            break
        level += 1
        fewer = -(-nodes // fan_in)
        t = cut(_round(left.coalesce(fewer), level, fewer == 1, **size))
    return functools.reduce(DataFrame.unionByName, out).drop("node", "done")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(cut(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))))

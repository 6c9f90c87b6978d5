"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as its bytes' symbols. A heap holds (rank, place) of adjacent pairs; the lowest is popped, merged
if it still stands there, and its two new neighbours are pushed. The count is symbols minus merges: no ids are made.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows repeat as often as they come in; tables without rows
give none; other columns are not read. The tokenizer's added tokens found in a text count one each, as its library does.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, table
from .pieces import CACHE_ENTRIES, Generations, Parts

#: Fixed value: the splitting pattern of byte-level tokenizer files, which they name but don't hold.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOW = (1 << 32) - 1


def byte_symbols() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class HeapMerger:
    """Counts the tokens of pieces by the merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or spec.get("normalizer") or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError("a byte-level BPE tokenizer file without normalizer and prefix space is needed")
        vocab = model["vocab"]
        self.symbol = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.rule: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rule.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.known = Generations(entries)
        self.parts = Parts(BYTE_LEVEL_PATTERN, self._counts, entries)

    def merged(self, piece: bytes) -> int:
        """Symbols minus merges of one piece."""
        n, rule = len(piece), self.rule
        if n < 2:
            return n
        s = [self.symbol[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r[0] << 32 | i for i in range(n - 1) if (r := rule.get(s[i] << 32 | s[i + 1]))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & _LOW
            j = after[i]
            if s[i] < 0 or j >= n:
                continue
            r = rule.get(s[i] << 32 | s[j])
            if r is None or r[0] != top >> 32:
                continue
            s[i], s[j], merges = r[1], -1, merges + 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rule.get(s[i] << 32 | s[k]):
                    heapq.heappush(heap, r[0] << 32 | i)
            if (h := before[i]) >= 0 and (r := rule.get(s[h] << 32 | s[i])):
                heapq.heappush(heap, r[0] << 32 | h)
        return n - merges

    def _counts(self, parts: list[list[str]]) -> list[int]:
        new = self.known.missing({p for pieces in parts for p in pieces})
        known = self.known.young
        known.update(zip(new, [self.merged(p.encode()) for p in new]))
        get = known.__getitem__
        return [sum(map(get, pieces)) for pieces in parts]

    def count(self, texts: list[str]) -> list[int]:
        plain, where, extra = [], [], [0] * len(texts)
        for k, t in enumerate(texts):
            segments = [t]
            for token in self.added:
                if token in t:
                    segments = [x for s in segments for x in s.split(token)]
            extra[k] = len(segments) - 1
            plain += segments
            where += [k] * len(segments)
        for k, values in zip(where, self.parts.of(plain), strict=True):
            extra[k] += sum(values)
        return extra


@functools.cache
def merger_of(path: str) -> HeapMerger:
    """One merger for each Python worker, so that its caches serve all of the worker's tasks."""
    return HeapMerger(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; one narrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(tokenizer)
        for batch in blocks(batches):
            raw = as_bytes(batch)
            n = merger.count([x.decode("utf-8", "replace") for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Packing against the tokenizer's library, plain best fit and the bounds that every packing keeps."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import packing

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, length string, done string, node long, key string"


def plain_best_fit(sizes, capacity):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = [(capacity - sum(sizes[j] for j in b), k) for k, b in enumerate(bins) if capacity - sum(sizes[j] for j in b) >= sizes[i]]
        if room:
            bins[min(room)[1]].append(i)
        else:
            bins.append([i])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_a_plain_one(sizes):
    got, want = packing.best_fit(np.array(sizes, np.int64), 30), plain_best_fit(sizes, 30)
    # Which of two equally full bins takes an item may differ, fills may not.
    fills = lambda bins: sorted(sum(sizes[i] for i in b) for b in bins)
    assert fills(got) == fills(want) and sorted(i for b in got for i in b) == list(range(len(sizes)))


def check(rows, capacity):
    """Each sequence is gapless from 0 and no longer than the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, "", " ", "a", "one two  three\n\nfour", "x" * 9000, "word " * 5000, "ab<|endoftext|>cd ef", "l'état 日本 😀 ###", "déjà  vu\t "] + [f"text {i} " * (i % 97) for i in range(300)]
    texts += texts[3:6]
    rows = [(i, t, "a", "b", 1, "k") for i, t in enumerate(texts)] + [(3, "a", "a", "b", 1, "k"), (None, "nameless", "a", "b", 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = packing.packed(packing.pieces(docs, P.path("byte_bpe_50k.json"))).collect()
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=key) == sorted(want, key=key)
    used = check(got, 2048)
    total = sum(w[3] for w in want)
    assert -(-total // 2048) <= used <= len(plain_best_fit([w[3] for w in want], 2048)) + 1


@pytest.mark.parametrize("sizes", [[1] * 5000, [60] * 3000, [50, 51] * 1500, [1 + i * i % 100 for i in range(4000)], []])
def test_rounds_with_small_blocks(spark, sizes):
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long").repartition(23)
    got = packing.packed(items, capacity=100, slack=2, carry=5, fan_in=3, block=70).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(sizes))
    # Against best fit over all items at once.
    assert -(-sum(sizes) // 100) <= check(got, 100) <= 1.03 * len(packing.best_fit(np.array(sizes, np.int64), 100)) + 3


def test_no_documents(spark):
    assert packing.packed(packing.pieces(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json"))).collect() == []

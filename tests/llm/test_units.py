"""Kernels without Spark: hashing, merging, Golomb codes, trees, the recurrent network."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import boosting, exact_dedup, language_id, minhash, quality_rules
from sievewright.llm.byte_bpe import MergeReplay, Merges, read_ranks
from sievewright.llm.hashing import Block
from sievewright.llm.token_counts import HeapMerger

P = pytest.importorskip("public_tokenizers")

pieces = st.lists(st.sampled_from(list("ab 'sT\n\t\r1!é日😀\x1c\xa0|<>") + ["the", "  ", "<|endoftext|>", "'ll"]), max_size=40).map("".join)
texts = st.lists(pieces, min_size=1, max_size=8)


@pytest.fixture(scope="module")
def heap():
    return HeapMerger(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def replay():
    return MergeReplay(Merges.from_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), own


@settings(max_examples=150, deadline=None)
@given(texts)
def test_tokens_equal_the_libraries(heap, replay, libraries, batch):
    tokenizer, own = libraries
    assert heap.count(batch) == [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
    packed = replay.encode(batch)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [own.encode_ordinary(t) for t in batch]
    assert [replay.decode(p) for p in packed] == [t.encode() for t in batch]


def test_long_runs_and_small_caches(libraries):
    tokenizer, own = libraries
    batch = ["x" * 20_000, "ab" * 3_000, " " * 500, "word " * 2_000, "", "a\n\n b"]
    heap, replay = HeapMerger(P.path("byte_bpe_50k.json"), entries=3), MergeReplay(Merges.from_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for _ in range(3):
        assert heap.count(batch) == [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
        assert [np.frombuffer(p, "<u4").tolist() for p in replay.encode(batch)] == [own.encode_ordinary(t) for t in batch]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**exact_dedup.BITS - 1), min_size=1, max_size=200, unique=True))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert exact_dedup.golomb_decode(len(v), *exact_dedup.golomb_encode(v)).tolist() == v.tolist()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(t):
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\t#é|\x0b\x1c\xa0")), max_size=60), min_size=1, max_size=6))
def test_statistics_equal_brute_force(batch):
    s = quality_rules.statistics([t.encode() for t in batch])
    got = list(zip(*(s[c].tolist() for c in quality_rules.BASE)))
    assert got == [brute_statistics(t) for t in batch]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abA \n\té")), max_size=60), min_size=1, max_size=6), st.integers(1, 5))
def test_shingle_sets_have_the_sizes_and_overlaps_of_brute_force(batch, width):
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in batch]
    sets = []
    for t in lower:
        w = WORD.findall(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    got = Block([t.encode() for t in batch], lower=True).shingle_sets(width)
    assert [len(g) for g in got] == [len(s) for s in sets]
    for a, x in zip(got, sets):
        for b, y in zip(got, sets):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    salts = minhash._salts(400)
    other = np.concatenate([base[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)])
    agree = (minhash.signature(np.sort(base), salts) == minhash.signature(np.sort(other), salts)).mean()
    assert abs(agree - 320 / 480) < 0.08


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (800, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(0, 1, 800) < 0.1)).astype(float)
    trees = boosting.fit(x, y, np.array([-1, 1, 0]), rounds=25)
    assert ((trees.probability(x) > 0.5) == (y == 1)).mean() > 0.85
    grid = np.linspace(0, 1, 60)
    for _ in range(20):
        row = np.tile(rng.uniform(0, 1, 3), (60, 1))
        for j, sign in ((0, -1), (1, 1)):
            probe = row.copy()
            probe[:, j] = grid
            assert (sign * np.diff(trees.margin(probe)) >= -1e-12).all()


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.ByteGru(list("abc"), 4)
    x, y = rng.integers(97, 105, (9, 5)), np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(x, y)
    for k in net.p:
        flat = np.argsort(-np.abs(g[k]).reshape(-1))[:3]
        for i in flat:
            at, step = np.unravel_index(i, g[k].shape), np.float32(5e-3)
            old = net.p[k][at]
            net.p[k][at] = old + step
            up = net.gradients(x, y)[0]
            net.p[k][at] = old - step
            down = net.gradients(x, y)[0]
            net.p[k][at] = old
            assert abs((up - down) / (2 * float(step)) - g[k][at]) < 2e-3 + 0.03 * abs(g[k][at])


def test_network_learns_and_handles_odd_documents():
    rng = random.Random(3)
    make = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(language_id.WINDOW)).encode()
    windows = [make("abc ") for _ in range(60)] + [make("xyz ") for _ in range(60)]
    net = language_id.ByteGru(["p", "q"])
    net.train(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, language_id.WINDOW), np.repeat([0, 1], 60), steps=60, batch=32)
    p = net.documents([b"abcab abc cab", b"", b"zyx" * 500, b"x"])
    assert p[0].argmax() == 0 and p[2].argmax() == 1 and np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_stated_odds_of_a_missed_pair_are_the_exact_tail():
    from math import comb

    miss = sum(comb(48, k) * 0.8**k * 0.2 ** (48 - k) for k in range(minhash.required_matches(minhash.COORDS, 0.8)))
    assert miss <= minhash.MISS and minhash.COORDS == 48 and f"odds of {miss * 1e6:.1f} in a million" in minhash.__doc__

"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. Spark counts the corpus's words (runs between single spaces) and picks the ``VOCABULARY`` most frequent that occur again.
2. Merges are replayed on that table of distinct words, once for the corpus: all pieces of a task's words lie end to end in one array of symbols. An
   inverted index keeps the places of all adjacent pairs that have a rank, sorted by rank, and is worked off from the lowest ranks up; only the
   neighbours of touched places enter it again (``MergeReplay.replay``). A merge can create a pair of lower rank in its own piece; that one then goes first, and
   the piece's other places wait.
3. The encoded words, bounded in number and length, are broadcast. Texts are encoded by looking words up; words beyond the table
   are replayed where they stand, all new ones of a block together. So the table never changes a result.

Defined results: null text is empty (no ids, hashes of nothing); repeated rows and ties stay as they are; tables without rows
give none; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, cut, given_back, passing, table
from .pieces import regular
from .token_counts import byte_symbols

#: Words of the corpus's table, their bytes and the characters of one, at most. With an id of 4 bytes for each byte the table has 80 MB at most, some 15 MB in fact.
VOCABULARY, TABLE_BYTES, LONGEST = 1 << 19, 16 << 20, 64
#: Bytes of text that are encoded at a time, and words replayed at a time: the table's words of a task are, all at once, for tables of that size.
ENCODED_BYTES, REPLAYED = 1 << 20, 50_000
#: Words hashed at a time.
HASHED = 50_000
#: No rank: larger than any.
_NONE_BITS = 1 << 24
_NONE = _NONE_BITS - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Slots:
    """Values of 64-bit keys (0 or more) in a table with open slots, of which at most a quarter are taken: a key is at its slot or in the run that follows."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.missing, self.shift = missing, 64 - max(10, (4 * len(keys)).bit_length())
        self.key, self.value = np.full(1 << (64 - self.shift), -1, np.int64), np.full(1 << (64 - self.shift), missing, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.key[slot] < 0)
            taken, which = np.unique(slot[free], return_index=True)
            self.key[taken], self.value[taken] = keys[free[which]], values[free[which]]
            left = np.ones(len(keys), bool)
            left[free[which]] = False
            # A key that is there already stays as it is.
            left &= self.key[slot] != keys
            keys, values, slot = keys[left], values[left], (slot[left] + 1) % len(self.key)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        # Fixed value: 2^64 over the golden ratio, for multiplicative hashing.
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, out = self.key[slot], self.value[slot]
        out[found != keys] = self.missing
        far = np.flatnonzero((found != keys) & (found >= 0))
        slot = slot[far]
        while len(far):
            slot = (slot + 1) % len(self.key)
            found, hit = self.key[slot], self.key[slot] == keys[far]
            out[far[hit]] = self.value[slot[hit]]
            on = ~hit & (found >= 0)
            far, slot = far[on], slot[on]
        return out


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of strings, each one's start and size."""
    wide = words.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    return data, ends[:-1], np.diff(ends)


class Words:
    """Places of words in a table of the corpus's words, found by hash and then compared byte by byte."""

    def __init__(self, words: pa.Array):
        self.data, self.start, self.size = _buffers(words)
        parts = [(h, a + kept) for a in range(0, len(words), HASHED) for h, kept in [self._hashes(self.data, self.start[a : a + HASHED], self.size[a : a + HASHED])]]
        h, kept = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.slots = Slots(h, kept, -1)

    # Fixed value: the odd multiplier of a polynomial hash modulo 2^64.
    _POWERS = np.cumprod(np.full(4 * LONGEST, 0x5851F42D4C957F2D, np.uint64))

    def _hashes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words of 1 to 4 * LONGEST bytes, and which words those are."""
        kept = np.flatnonzero((size > 0) & (size <= len(self._POWERS)))
        size = size[kept]
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        each = (data[np.repeat(start[kept], size) + inside] + np.uint64(1)) * self._POWERS[inside]
        h = np.add.reduceat(each, first) if len(kept) else np.zeros(0, np.uint64)
        return (h >> np.uint64(1)).astype(np.int64), kept

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place; -1 without one."""
        return np.concatenate([self._places(words.slice(a, HASHED)) for a in range(0, len(words), HASHED)]) if len(words) else np.zeros(0, np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        data, start, size = _buffers(words)
        h, kept = self._hashes(data, start, size)
        at = self.slots.of(h).astype(np.int64)
        same = (at >= 0) & (self.size[at] == size[kept]) if len(self.size) else np.zeros(len(at), bool)
        at, kept = at[same], kept[same]
        own = size[kept]
        first = np.cumsum(own) - own
        equal = _gathered(data, start[kept], own) == _gathered(self.data, self.start[at], own)
        right = np.logical_and.reduceat(equal, first) if len(kept) else np.zeros(0, bool)
        out = np.full(len(words), -1)
        out[kept[right]] = at[right]
        return out


class Merges:
    """Tokens and the pairs that merge, with the merged token's id as rank: ``pairs`` sorted, ``merged`` beside it."""

    def __init__(self, token: list[bytes], single: list[int], every: dict[tuple[int, int], int]):
        self.width = len(token)
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.token_size = np.fromiter(map(len, token), np.int64, len(token))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.single_of = np.array(single, np.int32)
        keys, ranks = np.array([a * self.width + b for a, b in every], np.int64), np.array(list(every.values()), np.int64)
        self.slots = Slots(keys, ranks, _NONE)
        #: Ranks after whose merge a pair of lower rank can stand beside it.
        self.unruly = np.zeros(self.width, bool)
        for side in (keys // self.width, keys % self.width):
            self.unruly[side[ranks < side]] = True

    @classmethod
    def from_ranks(cls, path: str) -> Merges:
        """Of a file of ranks: any two neighbours merge whose bytes together have a rank."""
        ranks = read_ranks(path)
        token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            token[r] = t
        every = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        return cls(token, [ranks[bytes([b])] for b in range(256)], every)

    @classmethod
    def from_json(cls, path: str) -> Merges:
        """Of a byte-level BPE tokenizer file: the pairs that it lists merge, in their order, which must be that of the merged tokens' ids."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte = spec["model"]["vocab"], {c: b for b, c in byte_symbols().items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        every: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            every.setdefault((vocab[a], vocab[b]), vocab[a + b])
        if list(every.values()) != sorted(every.values()):
            raise ValueError("merges in the order of their tokens' ids are needed")
        token = [b""] * (max(vocab.values()) + 1)
        for t, r in vocab.items():
            token[r] = bytes(byte[c] for c in t) if all(c in byte for c in t) else b""
        return cls(token, [vocab[c] for _, c in sorted(byte_symbols().items())], every)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent symbols; ``_NONE`` without one, or beside a wall (-1)."""
        return np.where(b < 0, np.int32(_NONE), self.slots.of(a.astype(np.int64) * self.width + np.maximum(b, 0)))


class MergeReplay:
    """Encodes texts by a table of merges, all new pieces of a block together. ``ready``: encoded words of the corpus, columns word and ids."""

    def __init__(self, merges: Merges, pattern: str, ready: pa.Table | None = None):
        self.merges, self.find = merges, regex.compile(pattern).findall
        words, ids = (pa.concat_arrays([x for x in ready.column(c).chunks]) if ready is not None and ready.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("ids", pa.binary())))
        self.ready = Words(words)
        data, start, size = _buffers(ids)
        self.ready_size, self.ready_ids = size // 4, data[start[0] : start[-1] + size[-1]].view("<u4") if len(size) else np.zeros(0, "<u4")

    def replay(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, given as the bytes' symbols end to end and each piece's number of bytes: ids end to end, each piece's number of them.

        Bytes are linked to their neighbours. The inverted index holds the places of all pairs that have a rank, sorted by rank; it is
        taken in bands of ranks from the lowest up, all places of a band at once. Inside a band every piece applies its lowest rank first, at all of its places from
        the left, and only the two pairs around a merged place are ranked anew and enter the index: this band if their rank is in it or below, or a later one.
        Pieces don't touch each other, so each sees its merges in rank order, whatever the width of bands; long pieces have narrow ones, which hold few of their places.
        """
        m, n = self.merges, len(symbols)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(sizes), np.int64)
        symbol = np.append(symbols, np.int32(-1)).astype(np.int32)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        stops = np.cumsum(sizes[sizes > 0])
        after[stops - 1] = before[np.concatenate([[0], stops[:-1]])] = n
        rank = np.append(m.of_pairs(symbol[:n], symbol[after[:n]]), np.int32(_NONE))
        band = int(max(32, min(4096, (1 << 25) // sizes.max())))
        index = np.flatnonzero(rank < _NONE).astype(np.int32)
        index = index[np.argsort(rank[index], kind="stable")]
        edges = np.searchsorted(rank[index], np.arange(0, m.width + band, band))
        later = np.zeros(0, np.int32)
        for k, edge in enumerate(range(band, m.width + band, band)):
            due = rank[later] < edge
            waiting, later = np.concatenate([index[edges[k] : edges[k + 1]], later[due]]), [later[~due]]
            while True:
                # A place whose pair is gone or has another rank now was entered anew with that one.
                waiting = np.sort(waiting[rank[waiting] < edge])
                if not len(waiting):
                    break
                waiting = waiting[np.append(True, waiting[1:] != waiting[:-1])]
                own = rank[waiting]
                first = _begins(owner[waiting])
                chosen = own == np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
                at = self._unruled(self._apart(waiting[chosen], after), symbol, rank, owner, after, before)
                gone = after[at]
                symbol[at], symbol[gone], rank[gone] = rank[at], -2, _NONE
                after[at] = after[gone]
                before[after[at]] = at
                left = before[at]
                touched = np.concatenate([at, left[left < n]])
                now = rank[touched] = m.of_pairs(symbol[touched], symbol[after[touched]])
                waiting = np.concatenate([waiting, touched[now < edge]])
                later.append(touched[(now >= edge) & (now < _NONE)])
            later = np.concatenate(later)
            later = later[rank[later] < _NONE]
        stays = symbol[:n] >= 0
        return symbol[:n][stays].astype("<u4"), np.bincount(owner[stays], minlength=len(sizes))

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places that overlap, every other one from the left."""
        begins = np.append(True, at[1:] != after[at[:-1]])
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        return at[nth % 2 == 0]

    def _unruled(self, at: np.ndarray, symbol: np.ndarray, rank: np.ndarray, owner: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Each piece's places up to the first whose merge lets a pair of lower rank stand beside it: that one goes first then."""
        r = rank[at]
        if not self.merges.unruly[r].any():
            return at
        beside = np.append(False, at[1:] == after[after[at[:-1]]])
        left, right = np.where(beside, r, symbol[before[at]]), symbol[after[after[at]]]
        low = np.minimum(np.where(left < 0, _NONE, self.merges.of_pairs(left, r)), self.merges.of_pairs(r, right)) < r
        earlier, first = np.cumsum(low) - low, _begins(owner[at])
        return at[earlier == np.repeat(earlier[first], np.diff(np.append(first, len(at))))]

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, each distinct one replayed once: ids end to end, each piece's number of them, and whether it begins with a space."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        data, start, size = _buffers(coded.dictionary)
        ids, sizes = self.replay(self.merges.single_of[_gathered(data, start, size)], size)
        code = coded.indices.to_numpy(zero_copy_only=False)
        spaced = pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)
        return _gathered(ids, (np.cumsum(sizes) - sizes)[code], sizes[code]), sizes[code], spaced[code]

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular words that follow a space: ids end to end, each word's number of them.

        Such words never meet in a piece, so they are matched all at once; the piece that begins with a space is a word's first.
        """
        ids, sizes, spaced = self._ids(self.find(" " + " ".join(words)) if words else [])
        return ids, np.add.reduceat(sizes, np.flatnonzero(spaced)) if words else sizes

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more at the end).

        A single space between two characters that are no white space always begins a piece, so texts are cut there and each distinct word is
        looked up once in the corpus's table or replayed. A text in which words touch other white space is matched as a whole.
        """
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        words, code, first = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()
        place = self.ready.places(words)
        rare = np.flatnonzero(place < 0)
        missing = words.take(pa.array(rare)).to_pylist()
        fit = np.fromiter(map(regular, missing), bool, len(missing))
        odd = np.zeros(len(words), bool)
        odd[rare[~fit]] = True
        rare_ids, rare_sizes = self.of_words([w for w, f in zip(missing, fit.tolist()) if f])
        place[rare[fit]] = len(self.ready_size) + np.arange(fit.sum())
        several = np.diff(first) > 1
        inside = np.ones(len(code), bool)
        inside[first[:-1]] = False
        plain = np.logical_or.reduceat(odd[code] & inside, first[:-1]) if len(texts) else np.zeros(0, bool)
        heads = words.take(pa.array(code[first[:-1]])).to_pylist()
        plain |= several & np.fromiter((not h or h[-1].isspace() for h in heads), bool, len(heads))
        # Each text's first entry is its head, or all of it; then the others' entries, or nothing.
        found = [self.find(t if p else h) for t, h, p in zip(texts, heads, plain.tolist(), strict=True)]
        own_ids, each, _ = self._ids([x for f in found for x in f])
        ends = np.cumsum(np.append(0, each))[np.cumsum([0, *map(len, found)])]
        sizes = np.concatenate([self.ready_size, rare_sizes, np.diff(ends), [0]])
        starts = np.cumsum(sizes) - sizes
        entry = place[code]
        entry[np.repeat(plain, np.diff(first))] = len(sizes) - 1
        entry[first[:-1]] = len(self.ready_size) + len(rare_sizes) + np.arange(len(texts))
        ids = _gathered(np.concatenate([self.ready_ids, rare_ids, own_ids]), starts[entry], sizes[entry])
        return ids, np.concatenate([[0], np.cumsum(sizes[entry])])[first]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def flat_decoded(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and where those from each place in ``at`` begin."""
        m, sizes = self.merges, self.merges.token_size[ids]
        return _gathered(m.token_bytes, m.token_start[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])[at]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return self.flat_decoded(ids, np.array([0, len(ids)]))[0].tobytes()


def _begins(of: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, of[1:] != of[:-1]))


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all spans, end to end."""
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _as_stream(table: pa.Table) -> bytes:
    """A table as one stream of bytes: the driver makes no Python object of any row."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def encoder_of(path: str, pattern: str, shared: Broadcast) -> MergeReplay:
    """A task's encoder, with the words that ``shared_words`` gave; it goes with the task, the merges stay with the worker."""
    return MergeReplay(merges_of(path), pattern, ready=pa.ipc.open_stream(shared.value).read_all())


@functools.cache
def merges_of(path: str) -> Merges:
    """The merges of a tokenizer's file, once for each worker."""
    return Merges.from_json(path) if path.endswith(".json") else Merges.from_ranks(path)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each word of ``LONGEST`` characters at most follows a single space in all texts; blocks are counted, then their counts added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            parts = pc.split_pattern(pc.fill_null(batch.column("text"), ""), " ")
            inside = np.ones(len(parts.flatten()), bool)
            inside[parts.offsets.to_numpy()[:-1]] = False
            seen = parts.flatten().filter(pa.array(inside)).value_counts()
            t = pa.RecordBatch.from_arrays([seen.field(0), seen.field(1)], ["word", "n"])
            yield t.filter(pc.less_equal(pc.utf8_length(seen.field(0)), LONGEST))
            del parts, seen, t
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(given_back(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", most: int = VOCABULARY) -> pa.Table:
    """word, ids of the ``most`` most frequent words at most (ties at the edge stay out) that occur twice or more, replayed in Spark tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, held = MergeReplay(merges_of(ranks_path), pattern), []

        def out() -> pa.RecordBatch:
            ids, sizes = replay.of_words(held)
            raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([raw[a:b] for a, b in zip([0, *ends], ends)], pa.binary())], ["word", "ids"])

        for batch in batches:
            held += [w for w in batch.column("word").to_pylist() if regular(w)]
            if len(held) >= REPLAYED:
                yield out()
                held = []
        yield out()

    with passing():
        counts = cut(word_counts(docs, text).filter("n > 1").withColumn("level", F.floor(8 * F.log2("n"))))
        # How many words there are at each level of counts: a few hundred rows.
        level, room, space = None, most, TABLE_BYTES
        for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("level")).limit(1_000).collect():
            room, space = room - r["n"], space - r["bytes"]
            if room < 0 or space < 0:
                break
            level = r["level"]
        chosen = counts.filter(F.col("level") >= level) if level is not None else counts.limit(0)
        return chosen.select("word").mapInArrow(given_back(run), "word string, ids binary").toArrow()


def shared_words(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> Broadcast:
    """``encoded_words`` for all executors, as one stream of bytes."""
    return docs.sparkSession.sparkContext.broadcast(_as_stream(encoded_words(docs, ranks_path, pattern, text)))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids (array<int>) and decoded bytes."""
    keep = ["doc_id"] if keep is None else keep
    chosen = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("binary").alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    shared = shared_words(docs, ranks_path, pattern, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = encoder_of(ranks_path, pattern, shared)
        for batch in blocks(batches, size=ENCODED_BYTES):
            flat, at = replay.flat([x.decode("utf-8", "replace") for x in as_bytes(batch)])
            back, places = replay.flat_decoded(flat, at)
            spans = lambda values, p: [values[a:b] for a, b in zip(p[:-1].tolist(), p[1:].tolist())]
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array(np.diff(at)), *(pa.array([hashlib.sha256(v).hexdigest() for v in spans(values, p)], pa.string()) for values, p in ((flat, at), (back, places)))]
            if ids:
                arrays += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))), pa.array([v.tobytes() for v in spans(back, places)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *(c for c, _ in fields)])

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>"), ("decoded", "binary")] * ids
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, chosen.schema.fields)] + [f"{c} {t}" for c, t in fields])
    out = chosen.mapInArrow(given_back(run), schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), *(c for c, _ in fields))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

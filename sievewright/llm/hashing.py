"""Vectorised word splitting and 64-bit hashing of whole documents.

A block of documents is one byte array. A running sum of ``R[byte] * P**position`` (mod 2**64) gives the
hash of any span as a difference, so words, lines and windows are hashed without a Python loop over them.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(2**62, 2**63)) * 2 + 1
_PINV = pow(_P, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, at least ``n`` of each, grown by doubling."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Block:
    """Words of a block of documents: ``hash``, ``doc`` (index into the block), ``start``, ``end`` (bytes).

    Words are runs of bytes outside 0x20 and 0x09-0x0D. ``first[d]:first[d + 1]`` are the words of document d.
    """

    def __init__(self, docs: list[bytes], lower: bool = False):
        self.raw = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        buf = _LOWER[self.raw] if lower else self.raw
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        self.doc_end = np.cumsum(lengths + 1) - 1
        self.doc_start = self.doc_end - lengths
        self.space = SPACE[buf]
        power, self._inverse = _tables(len(buf))
        self._sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=self._sum[1:])
        edge = np.flatnonzero(np.diff(self.space.view(np.int8), prepend=1))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = self.span(self.start, self.end)
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(buf)))
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(docs)), self.n_words)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(np.uint64) * _A)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` consecutive words of one document, and the index of each window's first word."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        h = np.full(len(at), width, np.uint64)
        for k in range(width):
            h = mix(h * _B + self.hash[at + k] + _C)
        return h, at

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """Per document its distinct windows, sorted; with fewer words than ``width``, all words as one; without words, none."""
        h, at = self.windows(width)
        bounds = np.searchsorted(at, self.first)
        out = []
        for d, n in enumerate(self.n_words.tolist()):
            if n >= width:
                out.append(np.unique(h[bounds[d] : bounds[d + 1]]))
            elif n:
                x = np.full(1, n, np.uint64)
                for w in self.hash[self.first[d] : self.first[d + 1]]:
                    x = mix(x * _B + w + _C)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def per_doc(self, of_words: np.ndarray) -> np.ndarray:
        """Sum of a value per word, by document."""
        total = np.concatenate([[0], np.cumsum(of_words)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def per_doc_bytes(self, of_bytes: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, by document (separators left out)."""
        total = np.concatenate([[0], np.cumsum(of_bytes, dtype=np.int64)])
        return total[self.doc_end] - total[self.doc_start]

    def repeated_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per document: lines, and lines holding a word that equal an earlier line of it."""
        end = np.flatnonzero(self.raw == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        doc = np.searchsorted(self.doc_end, end)
        wordy = np.concatenate([[0], np.cumsum(~self.space)])
        has = wordy[end] > wordy[start]
        keys = mix(self.span(start[has], end[has]) + doc[has].astype(np.uint64) * _B)
        unique, index = np.unique(keys, return_index=True)
        n = len(self.doc_end)
        lines, distinct = np.bincount(doc[has], minlength=n), np.bincount(doc[has][index], minlength=n)
        return np.bincount(doc, minlength=n), lines - distinct

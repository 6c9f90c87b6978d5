"""Quality classification by co-training a text view and a page-metadata view.

The text view sees hashed words and document statistics of whole texts; the metadata view sees no word of them: language, source, length and the shares of
kinds of characters (symbols, marks, capitals, digits), each as a step of its scale.
Both start from a bounded sample of labelled rows. Each round, both score all documents, and a view's most confident ones outside the sample
(``CONFIDENT`` at least, the ``EXCHANGE`` best of each class, ties by hash) become labels of the other view: the classes' best of the whole table, a
bounded training set. On labelled rows that took no part in fitting, each view is calibrated. A view whose calibrated scores don't beat
the base rate there by two standard errors teaches nothing and gets no weight. The calibrated log-odds are added with weights that aren't
negative, and every document is scored once more.

Defined results: null text is empty; null metadata is a value of its own. Without labelled rows of both classes all scores are 0.5
and every document is kept. Repeated labels of an id count by their largest; of rows that share an id the smallest text is learned from, and rows
without an id are only scored. Rows stay as they come in; other columns are not read; tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, cut, given_back, passing, table
from .hashing import Block
from .quality_rules import FEATURES, features, statistics

#: Labelled rows that reach the driver, at most.
LABELLED = 4_000
#: Exchanges; each takes a pass over all documents.
ROUNDS = 2
CONFIDENT = 0.95
EXCHANGE = 150
WORD_BUCKETS = 1 << 10
LANGS, SOURCES, LENGTHS = 32, 256, 32
#: Kinds of characters of the metadata view, and steps of each one's share.
KINDS, SHARES = (b"#*$%&|<>", b".!?,;:", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"), 16
META = LANGS + SOURCES + LENGTHS + len(KINDS) * SHARES
_KIND = np.array([next((k for k, x in enumerate(KINDS) if bytes([b]) in x), len(KINDS)) for b in range(256)], np.uint8)
KEEP_GOOD = 0.998


def metadata_codes() -> list[F.Column]:
    """Positions of a row's first three ones in the metadata view."""
    size = F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)) + 1)).cast("int"))
    return [
        F.pmod(F.xxhash64(F.coalesce("lang", F.lit(""))), F.lit(LANGS)).cast("int").alias("m_lang"),
        (LANGS + F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(SOURCES))).cast("int").alias("m_source"),
        (LANGS + SOURCES + size).cast("int").alias("m_length"),
    ]


def profile_codes(raw: list[bytes]) -> np.ndarray:
    """Positions of a row's further ones: the step of each kind of character's share of the bytes, finer for small shares."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    kind, doc = _KIND[np.frombuffer(b"".join(raw), np.uint8)], np.repeat(np.arange(len(raw)), size)
    shares = np.bincount(doc * (len(KINDS) + 1) + kind, minlength=len(raw) * (len(KINDS) + 1)).reshape(len(raw), -1)[:, :-1] / np.maximum(size, 1)[:, None]
    step = np.minimum(SHARES - 1, np.floor(1.5 * np.log2(1 + 1000 * shares)).astype(np.int64))
    return LANGS + SOURCES + LENGTHS + SHARES * np.arange(len(KINDS)) + step


def bags(block: Block) -> np.ndarray:
    """Share of each word bucket in each document's words, dense (for the sample only)."""
    at = block.doc * WORD_BUCKETS + (block.hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    n = len(block.n_words)
    out = np.bincount(at, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS).astype(np.float32)
    return out / np.maximum(block.n_words, 1)[:, None]


@dataclass
class Logistic:
    """Logistic regression on standardised columns, fitted by accelerated gradient steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float, steps: int = 200) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-12, scale, 1.0)
        z = ((x - mean) / scale).astype(np.float32)
        row = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        w, b = np.zeros(x.shape[1]), 0.0
        v, vb, top = w.copy(), 0.0, 0.25 * float((row[:, None] * z * z).sum()) + l2
        top = min(top, 0.25 * x.shape[1] + l2)
        for k in range(steps):
            r = (1 / (1 + np.exp(-np.clip(z @ v + vb, -35, 35))) - y) * row
            nw, nb = v - (z.T @ r + l2 * v) / top, vb - r.sum() / 0.25
            v, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
            w, b = nw, nb
        return cls(mean, scale, w, float(b))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


@dataclass
class Views:
    """Both views as plain weight vectors, their calibration and the combination."""

    words: np.ndarray
    stats: np.ndarray
    text_bias: float
    meta: np.ndarray
    meta_bias: float
    text_line: tuple[float, float]
    meta_line: tuple[float, float]
    mix: tuple[float, float]
    threshold: float
    #: Pseudo-labels given: (round, from which view, class, how many).
    given: tuple[tuple[int, str, int, int], ...] = ()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _line(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope (not negative) and offset, by Newton steps with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * logit + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * logit).sum() + a - 1, (p - y).sum()])
        h = np.array([[(w * logit * logit).sum() + 1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(0.0, float(a)), float(b)


def one_hot(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), META), np.float32)
    np.put_along_axis(out, codes, 1.0, axis=1)
    return out


class CoTraining:
    """Labelled rows of both views (text, codes, label), and what each view has learned from."""

    def __init__(self, text: np.ndarray, codes: np.ndarray, label: np.ndarray):
        self.views, self.label = [text, one_hot(codes)], label
        rows = np.arange(len(label))
        self.aside, start = rows[::4], np.setdiff1d(rows, rows[::4])
        if len(set(label[self.aside].tolist())) < 2 or len(set(label[start].tolist())) < 2:
            self.aside = start = rows
        self.learned = [[(x[start], label[start])] for x in self.views]
        self.given: list[tuple[int, str, int, int]] = []

    def fitted(self) -> tuple[Views, list[bool]]:
        """Both views fitted to what they have, and which of them may teach."""
        fits = [Logistic.fit(np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own]), 0.01) for own in self.learned]
        y, rate = self.label[self.aside], self.label[self.aside].mean()
        base = np.where(y == 1, np.log(rate), np.log(1 - rate)) if 0 < rate < 1 else np.zeros(len(y))
        lines, even, gain, good = [], [], [], []
        for f, x in zip(fits, self.views, strict=True):
            raw = f.logit(x[self.aside])
            a, b = _line(raw, y)
            p = sigmoid(a * raw + b)
            more = np.log(np.where(y == 1, p, 1 - p) + 1e-12) - base
            lines.append((a, b))
            even.append(a * raw + b)
            gain.append(float(more.mean()))
            good.append(bool(more.mean() > 2 * more.std() / np.sqrt(len(y))))
        # What a view adds: its share of the log-likelihood gained over the base rate.
        share = [g if ok else 0.0 for g, ok in zip(gain, good)]
        mix = (share[0] / sum(share), share[1] / sum(share)) if sum(share) else (1.0, 0.0)
        score = sigmoid(mix[0] * even[0] + mix[1] * even[1])
        threshold = min(0.5, float(np.quantile(score[y == 1], 1 - KEEP_GOOD, method="lower")) * 0.999)
        t, m = fits
        w = t.w / t.scale
        v = Views(w[:WORD_BUCKETS], w[WORD_BUCKETS:], t.b - float(t.mean @ w), m.w / m.scale, m.b - float(m.mean @ (m.w / m.scale)), lines[0], lines[1], mix, threshold, tuple(self.given))
        return v, good

    def teach(self, turn: int, view: int, text: np.ndarray, codes: np.ndarray, label: np.ndarray) -> None:
        """Rows that ``view`` is sure of become labels of the other one."""
        if len(label):
            self.learned[1 - view].append(((one_hot(codes), text)[view], label))
        self.given += [(turn, ("text", "page")[view], k, int((label == k).sum())) for k in (0, 1)]


def _rows_of(docs: DataFrame, chosen: DataFrame) -> pd.DataFrame:
    """One row for each id of ``chosen`` (doc_id, others; bounded): its features x and codes, as bytes of float32 and int64."""
    others = [c for c in chosen.columns if c != "doc_id"]
    codes = ["m_lang", "m_source", "m_length"]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *metadata_codes(), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    d = d.groupBy("doc_id", *others).agg(F.min(F.struct("text", *codes)).alias("r")).select("doc_id", *others, *(f"r.{c}" for c in codes), F.col("r.text").cast("binary").alias("text"))
    names = ["doc_id", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw = as_bytes(batch)
            x = np.hstack([bags(Block(raw, lower=True)), features(statistics(raw))]).astype(np.float32)
            own = np.hstack([np.stack([batch.column(c).to_numpy() for c in codes], axis=1), profile_codes(raw)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, own))], [*names, "x", "codes"])

    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in names)
    return d.mapInArrow(given_back(run), f"{kinds}, x binary, codes binary").toPandas().sort_values("doc_id").reset_index(drop=True)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), WORD_BUCKETS + len(FEATURES))
    return x, np.frombuffer(b"".join(pdf["codes"]), np.int64).reshape(len(pdf), 3 + len(KINDS))


def fit_views(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Views | None:
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    sample = _rows_of(docs, chosen)
    label = sample["quality"].to_numpy(float)
    if len(set(label.tolist())) < 2:
        return None
    co, seen = CoTraining(*_arrays(sample), label), chosen.select("doc_id")
    for turn in range(rounds):
        views, may = co.fitted()
        # A view that doesn't count is taught once; if it doesn't count then either, further passes over the corpus would change nothing.
        if not any(may) or turn and not all(may):
            break
        with passing():
            scored = cut(score_views(docs.filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")), views).select("doc_id", "text_score", "page_score").join(F.broadcast(seen), "doc_id", "left_anti"))
            picks = None
            for view, score in enumerate(("text_score", "page_score")):
                for k in (0, 1):
                    sure = F.col(score) if k else 1 - F.col(score)
                    if may[view]:
                        best = scored.filter(sure >= CONFIDENT).orderBy(sure.desc(), F.xxhash64("doc_id"), "doc_id").limit(EXCHANGE).select("doc_id", F.lit(view).alias("view"), F.lit(k).alias("label"))
                        picks = best if picks is None else picks.unionByName(best)
            picks = cut(picks.distinct())
            rows = _rows_of(docs, picks)
        for view in (0, 1):
            mine = rows[rows["view"] == view]
            co.teach(turn, view, *_arrays(mine), mine["label"].to_numpy(float))
    return co.fitted()[0]


def score_views(docs: DataFrame, v: Views | None) -> DataFrame:
    """doc_id, text_score, page_score, score, kept for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n = batch.num_rows
            scores = [np.full(n, 0.5) for _ in range(3)]
            if v:
                docs_ = as_bytes(batch)
                b = Block(docs_, lower=True)
                bag = b.per_doc(v.words[(b.hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)]) / np.maximum(b.n_words, 1)
                text = bag + features(statistics(docs_)) @ v.stats + v.text_bias
                codes = np.hstack([np.stack([batch.column(c).to_numpy() for c in ("m_lang", "m_source", "m_length")], axis=1), profile_codes(docs_)])
                page = v.meta[codes].sum(axis=1) + v.meta_bias
                text, page = v.text_line[0] * text + v.text_line[1], v.meta_line[0] * page + v.meta_line[1]
                scores = [sigmoid(text), sigmoid(page), sigmoid(v.mix[0] * text + v.mix[1] * page)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, scores)], ["doc_id", "text_score", "page_score", "score"])

    rows = docs.select("doc_id", *metadata_codes(), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(given_back(run), f"doc_id {kind}, text_score double, page_score double, score double")
    return out.withColumn("kept", F.col("score") >= F.lit(v.threshold if v else 0.0))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_views(docs, fit_views(docs, table(spark, sf_dir, "labels")))

"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

In each direction a small gated unit reads the text byte by byte; at every byte both states give the languages' probabilities, and a document's are
the mean over all of its bytes. So that many stretches run side by side, a text is cut into windows of ``WINDOW`` bytes, each read together with
``CONTEXT`` bytes before and after it: these bring the states to where they would be, and give no probabilities of their own. Gates are
piecewise linear, so that a byte costs little. Training is backpropagation through time with Adam on windows of a bounded
sample: about ``PER_LANGUAGE`` documents of each language (fewer if there are more than ``SAMPLE / PER_LANGUAGE`` languages) and ``PER_DOCUMENT`` windows spread over each whole text.

Only text and language of rows outside the held-out quarter are learned from; a prediction reads the text alone. Defined results:
null text or text without a letter is ``und`` with score 0, as is every text if nothing can be learned. Rows stay as they
come; other columns are not read; tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, meet, table

WINDOW, CONTEXT = 96, 16
WIDTH = WINDOW + 2 * CONTEXT
PER_LANGUAGE = 400
#: Documents in the sample at most, about.
SAMPLE = 20_000
PER_DOCUMENT = 6
UNITS = 8
STEPS = 260
BATCH = 384
#: Windows that run through the network together when scoring.
SIDE_BY_SIDE = 2048


class ByteGru:
    """Two gated units and a softmax. Per direction, for update, reset and candidate: ``e`` (3 x 256 x units) and ``u`` (3 x units x units)."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        draw = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p["e" + d] = 0.2 * draw(3, 256, units)
            self.p["u" + d] = draw(3, units, units) * np.array([0.25, 0.25, 1], np.float32)[:, None, None] / np.sqrt(np.float32(units))
        self.p["w"] = draw(2 * units, len(languages)) / np.sqrt(np.float32(2 * units))
        self.p["c"] = np.zeros(len(languages), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of direction ``d`` after each byte; x: (time, batch). A gate is its input plus a half, held to 0..1."""
        e, u = self.p["e" + d].copy(), self.p["u" + d]
        e[:2] += np.float32(0.5)
        h = np.zeros((x.shape[1], self.units), np.float32)
        out = np.empty((*x.shape, self.units), np.float32)
        a, b = np.empty((3, *h.shape), np.float32), np.empty((3, *h.shape), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            if keep is not None:
                a, b = np.empty_like(a), np.empty_like(b)
            e.take(x[t], axis=1, out=a, mode="clip")
            np.matmul(h, u, out=b)
            g, q, c = b[:2], b[2], a[2]
            g += a[:2]
            np.maximum(g, 0, out=g)
            np.minimum(g, 1, out=g)
            np.add(c, np.multiply(g[1], q, out=a[0]), out=c)
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, h, g[0], g[1], q, c))
            step = np.subtract(c, h, out=a[0])
            step *= g[0]
            h = np.add(h, step, out=out[t])
        return out

    def _logits(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        n = self.units
        return hf @ self.p["w"][:n] + hb @ self.p["w"][n:] + self.p["c"]

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(axis=-1, keepdims=True))
        return a / a.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of windows x (time, batch) of languages y, and its gradients through time."""
        n, kept = self.units, {"f": [], "b": []}
        h = {d: self._run(x, d, kept[d]) for d in "fb"}
        p = self._softmax(self._logits(h["f"], h["b"]))
        rows = np.arange(len(y))
        loss = -float(np.log(p[:, rows, y] + 1e-9).mean())
        p[:, rows, y] -= 1
        p /= x.size
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = p.sum(axis=(0, 1))
        for i, d in enumerate("fb"):
            part = slice(i * n, (i + 1) * n)
            g["w"][part] = np.einsum("tbi,tbl->il", h[d], p, optimize=True)
            out = p @ self.p["w"][part].T
            u, dh = self.p["u" + d], np.zeros((x.shape[1], n), np.float32)
            da = np.empty((3, *x.shape, n), np.float32)
            for t, before, z, r, q, c in reversed(kept[d]):
                dh = dh + out[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * ((z > 0) & (z < 1))
                dr = dc * q * ((r > 0) & (r < 1))
                da[0, t], da[1, t], da[2, t] = dz, dr, dc
                db = np.stack([dz, dr, dc * r])
                g["u" + d] += before.T @ db
                dh = dh * (1 - z) + (db @ u.transpose(0, 2, 1)).sum(axis=0)
            flat = x.reshape(-1)
            order = np.argsort(flat, kind="stable")
            seen, start = np.unique(flat[order], return_index=True)
            g["e" + d][:, seen] = np.add.reduceat(da.reshape(3, -1, n)[:, order], start, axis=1)
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 6) -> float:
        """x: (windows, time) bytes; y: language numbers. Returns the last steps' mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        by = [k for k in by if len(k)]
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(k, max(1, batch // len(by))) for k in by])
            loss, g = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.98 * v[k] + 0.02 * a * a
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """(languages, time, windows) probabilities of every byte."""
        x = np.ascontiguousarray(windows.T)
        n, w = self.units, self.p["w"]
        a = w[:n].T @ self._run(x, "f").reshape(-1, n).T
        a += w[n:].T @ self._run(x, "b").reshape(-1, n).T
        a += self.p["c"][:, None]
        a -= a.max(axis=0)
        np.exp(a, out=a)
        a /= a.sum(axis=0)
        return a.reshape(-1, *x.shape)

    def documents(self, docs: list[bytes]) -> np.ndarray:
        """(documents, languages): mean of the probabilities at all bytes; even for empty texts."""
        out = np.full((len(docs), len(self.languages)), 1 / max(len(self.languages), 1))
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        count = -(-lengths // WINDOW)
        # Each document has its context's width before it and blanks after it, up to whole windows and once more the context.
        place = np.concatenate([[0], np.cumsum(count * WINDOW + 2 * CONTEXT)])
        buf = np.full(int(place[-1]), 32, np.uint8)
        for at, d in zip((place[:-1] + CONTEXT).tolist(), docs):
            buf[at : at + len(d)] = np.frombuffer(d, np.uint8)
        first = np.concatenate([[0], np.cumsum(count)])
        nth = np.arange(int(first[-1])) - np.repeat(first[:-1], count)
        starts = np.repeat(place[:-1], count) + nth * WINDOW
        some = np.flatnonzero(count)
        filled = np.full(len(starts), WINDOW)
        filled[first[some + 1] - 1] = lengths[some] - (count[some] - 1) * WINDOW
        sums = np.empty((len(starts), len(self.languages)))
        for at in range(0, len(starts), SIDE_BY_SIDE):
            p = self.positions(buf[starts[at : at + SIDE_BY_SIDE, None] + np.arange(WIDTH)])[:, CONTEXT : CONTEXT + WINDOW]
            p *= np.arange(WINDOW)[:, None] < filled[at : at + SIDE_BY_SIDE]
            sums[at : at + SIDE_BY_SIDE] = p.sum(axis=1).T
        if len(some):
            out[some] = np.add.reduceat(sums, first[some], axis=0) / lengths[some, None]
        return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteGru | None:
    """A network fitted to a bounded sample of rows outside the held-out quarter; None if there is no language."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("many")))
    n, total = counts.agg(F.count(F.lit(1)), F.sum("many")).first()
    if not n:
        return None
    least = max(4, min(per_language, SAMPLE // n))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = meet(rows.select("lang", draw.alias("draw"), F.encode("text", "UTF-8").alias("b")), counts, "lang", "many", total=total).filter(F.col("draw") < least / F.col("many"))
    spread = f"transform(sequence(0, {PER_DOCUMENT - 1}), k -> substring(b, 1 + cast(k * greatest(length(b) - {WIDTH}, 0) / {PER_DOCUMENT - 1} as int), {WIDTH}))"
    pdf = chosen.select("lang", F.explode(F.expr(spread)).alias("w")).distinct().toPandas().sort_values(["lang", "w"])
    pdf = pdf[pdf["w"].map(len) > 0]
    if not len(pdf):
        return None
    languages = sorted(set(pdf["lang"]))
    x = np.frombuffer(b"".join(bytes(w).ljust(WIDTH, b" ") for w in pdf["w"]), np.uint8).reshape(-1, WIDTH)
    net = ByteGru(languages)
    if len(languages) > 1:
        net.train(x, np.searchsorted(languages, pdf["lang"].to_numpy(str)))
    return net


def identify(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(lettered, F.col("text")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw = batch.column("text").to_pylist()
            pred, score = ["und"] * len(raw), [0.0] * len(raw)
            if net:
                p = net.documents([x or b"" for x in raw])
                for k, (x, best) in enumerate(zip(raw, p.argmax(axis=1).tolist(), strict=True)):
                    if x:
                        pred[k], score[k] = net.languages[best], min(1.0, float(p[k, best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))

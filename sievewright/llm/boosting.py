"""Gradient-boosted trees over histograms, with monotonic constraints, kept as flat node arrays.

Rows are strings of bins (a byte a feature). Gradients and Hessians are added as whole multiples of 2^-32, so sums don't depend on how rows
are dealt: ``Rows`` in memory and ``Passes`` over a written table give the same trees. Several models that leave out a fold each share the passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut as written
from .common import discard, given_back

#: Gradients are counted in units of 1 / UNIT.
UNIT = float(1 << 32)
#: Rows that a task turns into matrices at a time.
CHUNK = 50_000
#: Trees after which margins are written anew, so that a pass applies no more than these.
REFRESH = 10


@dataclass
class FlatTrees:
    """Node arrays of all trees: ``feature`` (-1 for a leaf), ``cut`` (left if value <= cut), ``left``, ``right``, ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Leaves of rows: every row walks all trees at once, one step a level."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            f = self.feature[node]
            go = x[rows, np.maximum(f, 0)] <= self.cut[node]
            node = np.where(f < 0, node, np.where(go, self.left[node], self.right[node]))
        return node

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows."""
        return self.bias + self.value[self.nodes(x)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


class Growing:
    """A model while it grows, level by level. ``cuts``: upper bounds of each feature's bins, the last bin is open.

    A split on a constrained feature must order its children's values, and both subtrees are held to their side of the
    middle, so the whole model is monotone. Ties between splits go to the first feature and cut.
    """

    def __init__(self, cuts: list[np.ndarray], monotone: np.ndarray, share: float, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: float = 2.0):
        p = float(np.clip(share, 1e-3, 1 - 1e-3))
        self.cuts, self.monotone, self.depth, self.rate, self.l2, self.least = cuts, monotone, depth, rate, l2, least
        self.bias = float(np.log(p / (1 - p)))
        self.feature, self.bin, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def node(self) -> int:
        for a, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def begin(self) -> None:
        self.roots.append(self.node())
        #: (node, its bounds, None or the parent's histogram and the sibling to take from it)
        self.open = [(self.roots[-1], -np.inf, np.inf, None)]

    def wanted(self) -> list[int]:
        """Nodes of the level whose histograms must be counted: of two siblings the left one."""
        return [at for at, *_, rest in self.open if rest is None]

    def weight(self, g, h, low: float, high: float):
        return np.clip(-g / (h + self.l2), low, high)

    def gain(self, g, h, w):
        return -(g * w + 0.5 * (h + self.l2) * w * w)

    def know(self, hist: dict[int, np.ndarray], last: bool) -> None:
        """``hist``: of each wanted node, 2 x features x bins (gradients, Hessians, in units). Splits the level's nodes or makes them leaves."""
        level, self.open = self.open, []
        for at, low, high, rest in level:
            if rest is not None:
                hist[at] = rest[0] - hist[rest[1]]
            (gs, hs), (g, h) = hist[at][:, 0].sum(axis=1) / UNIT, np.cumsum(hist[at], axis=2) / UNIT
            w0 = float(self.weight(gs, hs, low, high))
            best = (1e-6 + float(self.gain(gs, hs, w0)), -1, 0)
            for j, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                gl, hl = g[j, : len(cuts)], h[j, : len(cuts)]
                wl, wr = self.weight(gl, hl, low, high), self.weight(gs - gl, hs - hl, low, high)
                score = self.gain(gl, hl, wl) + self.gain(gs - gl, hs - hl, wr)
                score[(hl < self.least) | (hs - hl < self.least) | (self.monotone[j] * (wr - wl) < 0)] = -np.inf
                t = int(np.argmax(score))
                if score[t] > best[0]:
                    best = (float(score[t]), j, t)
            _, j, t = best
            if j < 0:
                self.value[at] = self.rate * w0
                continue
            self.feature[at], self.bin[at] = j, t
            self.left[at], self.right[at] = a, b = self.node(), self.node()
            wl, wr = (float(self.weight(x, y, low, high)) for x, y in ((g[j, t], h[j, t]), (gs - g[j, t], hs - h[j, t])))
            lows, highs = [low, low], [high, high]
            if self.monotone[j]:
                (highs if self.monotone[j] > 0 else lows)[0] = (wl + wr) / 2
                (lows if self.monotone[j] > 0 else highs)[1] = (wl + wr) / 2
            if last:
                for c, x, y, k in ((a, g[j, t], h[j, t], 0), (b, gs - g[j, t], hs - h[j, t], 1)):
                    self.value[c] = self.rate * float(self.weight(x, y, lows[k], highs[k]))
            else:
                self.open += [(a, lows[0], highs[0], None), (b, lows[1], highs[1], (hist[at], a))]

    def flat(self, coded: bool = False, since: int = 0) -> FlatTrees:
        """The trees from ``since`` on, over values or over bins."""
        cut = self.bin if coded else [float(self.cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(self.feature, self.bin, strict=True)]
        return FlatTrees(*(np.array(a) for a in (self.feature, cut, self.left, self.right, self.value)), np.array(self.roots[since:], np.int64), self.depth, self.bias)


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Rows of values as rows of bins."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _moved(margin: np.ndarray, trees: FlatTrees, code: np.ndarray) -> np.ndarray:
    """The rows' margins with trees added one after the other."""
    for values in trees.value[trees.nodes(code)].T:
        margin = margin + values
    return margin


def _counted(code: np.ndarray, y: np.ndarray, margin: np.ndarray, tree: FlatTrees, wanted: list[int], bins: int) -> np.ndarray:
    """Histograms of the wanted nodes of one model over rows that it may use: nodes x 2 x features x bins."""
    n, m = code.shape
    node = tree.nodes(code)[:, 0]
    q = 1 / (1 + np.exp(-margin))
    units = np.rint((q - y) * UNIT), np.rint(np.maximum(q * (1 - q), 1e-6) * UNIT)
    place = code + np.arange(m) * bins
    out = np.zeros((len(wanted), 2, m, bins), np.int64)
    for k, at in enumerate(wanted):
        here = node == at
        for i, v in enumerate(units):
            out[k, i] = np.bincount(place[here].ravel(), np.repeat(v[here], m), m * bins).reshape(m, bins).astype(np.int64)
    return out


class Rows:
    """Rows in memory. ``fold``: model k > 0 leaves out the rows of fold k - 1."""

    def __init__(self, code: np.ndarray, y: np.ndarray, fold: np.ndarray, models: list[Growing], bins: int):
        self.code, self.y, self.bins = code, y, bins
        self.use = [np.ones(len(y), bool) if not k else fold != k - 1 for k in range(len(models))]
        self.margin = [np.full(len(y), m.bias) for m in models]

    def counted(self, models: list[Growing], wanted: list[list[int]]) -> list[dict[int, np.ndarray]]:
        out = []
        for m, want, use, margin in zip(models, wanted, self.use, self.margin, strict=True):
            sums = np.zeros((len(want), 2, self.code.shape[1], self.bins), np.int64)
            for at in range(0, len(self.y) if want else 0, CHUNK):
                u = use[at : at + CHUNK]
                sums += _counted(self.code[at : at + CHUNK][u], self.y[at : at + CHUNK][u], margin[at : at + CHUNK][u], m.flat(True, -1), want, self.bins)
            out.append(dict(zip(want, sums, strict=True)))
        return out

    def moved(self, models: list[Growing]) -> None:
        self.margin = [_moved(margin, m.flat(True, -1), self.code) for m, margin in zip(models, self.margin, strict=True)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``CHUNK`` rows."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


class Passes:
    """The same over a table (bins binary, y, fold): a pass a level for all models; sums by node, feature and bin reach the driver, whatever the rows."""

    def __init__(self, rows: DataFrame, models: list[Growing], bins: int):
        self.rows, self.bins, self.features, self.since = rows, bins, len(models[0].cuts), 0
        self.bias = [m.bias for m in models]

    def _matrices(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        code = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(t.num_rows, self.features)
        if "margins" in t.column_names:
            margin = np.frombuffer(b"".join(t.column("margins").to_pylist()), float).reshape(t.num_rows, -1).T
        else:
            margin = np.repeat(np.array(self.bias)[:, None], t.num_rows, 1)
        return code, t.column("y").to_numpy(), t.column("fold").to_numpy(), margin

    def _kernel(self) -> Passes:
        """What a task needs, without the table."""
        out = object.__new__(Passes)
        out.bins, out.features, out.bias = self.bins, self.features, self.bias
        return out

    def counted(self, models: list[Growing], wanted: list[list[int]]) -> list[dict[int, np.ndarray]]:
        before = [m.flat(True, len(m.roots) - 1 - self.since) for m in models]
        for b in before:
            b.roots = b.roots[:-1]
        now, me, bins, features = [m.flat(True, -1) for m in models], self._kernel(), self.bins, self.features
        size = 2 * features * bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(want), 2, features, bins), np.int64) for want in wanted]
            for t in chunks(batches):
                code, y, fold, margin = me._matrices(t)
                for k, want in enumerate(wanted):
                    if want:
                        u = fold != k - 1
                        sums[k] += _counted(code[u], y[u], _moved(margin[k][u], before[k], code[u]), now[k], want, bins)
            flat = np.concatenate([x.ravel() for x in sums])
            place = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[place])], ["place", "units"])

        got = self.rows.mapInArrow(run, "place long, units long").groupBy("place").agg(F.sum("units").alias("units")).toArrow()
        flat = np.zeros(sum(len(want) for want in wanted) * size, np.int64)
        flat[got.column("place").to_numpy()] = got.column("units").to_numpy()
        out, at = [], 0
        for want in wanted:
            out.append(dict(zip(want, flat[at : at + len(want) * size].reshape(len(want), 2, features, bins), strict=True)))
            at += len(want) * size
        return out

    def moved(self, models: list[Growing]) -> None:
        self.since += 1
        if self.since < REFRESH:
            return
        trees, me = [m.flat(True, -self.since) for m in models], self._kernel()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in chunks(batches):
                code, _, _, margin = me._matrices(t)
                margin = np.stack([_moved(x, f, code) for x, f in zip(margin, trees, strict=True)], 1)
                kept = t.select(["bins", "y", "fold"]).append_column("margins", pa.array([x.tobytes() for x in margin], pa.binary()))
                yield from kept.combine_chunks().to_batches()

        before, self.rows, self.since = self.rows, written(self.rows.mapInArrow(given_back(run), "bins binary, y double, fold int, margins binary")), 0
        discard(before)


def boost(models: list[Growing], rows: Rows | Passes, rounds: int = 60) -> None:
    """Newton boosting of the logistic loss: ``rounds`` trees for each model."""
    depth = models[0].depth
    for _ in range(rounds):
        for m in models:
            m.begin()
        for level in range(depth):
            wanted = [m.wanted() for m in models]
            if not any(wanted):
                break
            for m, hist in zip(models, rows.counted(models, wanted), strict=True):
                m.know(hist, level == depth - 1)
        rows.moved(models)


def shares(bins: int) -> list[float]:
    """The quantiles that part the bins."""
    return np.linspace(0, 1, bins + 1)[1:-1].tolist()


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 2.0) -> FlatTrees:
    """One model of rows in memory over quantile bins. ``monotone``: +1, -1 or 0 for each feature."""
    cuts = [np.unique(np.quantile(x[:, j], shares(bins), method="lower")) for j in range(x.shape[1])]
    model = Growing(cuts, monotone, float(y.mean()), depth, rate, l2, least)
    boost([model], Rows(coded(x, cuts), y, np.zeros(len(y), int), [model], bins), rounds)
    return model.flat()


def kth(df: DataFrame, column: str, k: int, parts: int = 4096) -> float:
    """The value in place k (from 0) of a column of numbers, exactly: a pass counts a range's parts, the next one looks into the part that holds it."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high and (width := (high - low) / parts) > 0:
        part = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1))
        counts = df.filter(F.col(column).between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("part").collect()
        for _, n, low, high in counts:
            if k < n:
                break
            k -= n
    return low

"""Second-order gradient boosting over histograms, leaf by leaf, for any number of models in the same passes.

Features are cut at quantiles once and every row becomes a string of bins (a byte each), written with its label. A pass over that table adds up gradients, Hessians and
counts by node, feature and bin, in each task first; only those histograms, whose size doesn't depend on the rows, reach the driver, which picks the splits.

* Trees grow best leaf first. A pass serves all leaves of all models that the queue would take with what is known so far; leaves that it wouldn't take even without further
  competition are never looked at. So a tree costs at most a pass for each level, and is the same as if it had been grown a leaf at a time.
* Of two siblings only the smaller one is counted, the other is its parent's histogram less that.
* Rows with the same bins and label are one with their number, where that leaves a quarter of the rows or fewer (counted for the trees and seeds that draw them): few features
  have few combinations of bins, so passes then don't grow with the rows. The trees are the same.
* Gradients and Hessians are added as whole multiples of 2^-32: sums are exact, so results don't depend on how rows are dealt to tasks, and a repeated task gives the same.
* Models differ in the features they may use and in their seed (rows and features drawn for a tree): ablations and several seeds share every pass.

Missing values (null, NaN) are in a bin below all others and go left. Labels other than 0 and 1, and null ones, are left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written
from .resampling import mixed

FORMAT = "sievewright-boosted-1"
#: Gradients are counted in units of 1 / UNIT.
UNIT = float(1 << 32)
#: Trees after which margins are written anew, so that a pass never applies more than these.
REFRESH = 8
#: Rows are combined when no more than one of so many stays.
FEWER = 4
#: Histogram cells (models x nodes x features x bins) that the driver holds, at most; three 8-byte numbers each.
MAX_CELLS = 20_000_000


@dataclass(frozen=True)
class Params:
    rounds: int = 20
    leaves: int = 16
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    least_hessian: float = 1e-3
    least_rows: int = 20
    bins: int = 64
    row_share: float = 1.0
    feature_share: float = 1.0


@dataclass(frozen=True)
class Variant:
    """One of the models that are fitted together: numbers of the features it may use, and its seed."""

    features: tuple[int, ...]
    seed: int = 0


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[int] = field(default_factory=list)

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.cover, 0)):
            column.append(empty)
        return len(self.feature) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins ends in."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[at] >= 0).any():
            k = rows[inner]
            n = at[k]
            at[k] = np.where(bins[k, feature[n]] <= cut[n], left[n], right[n])
        return at


@dataclass
class Boosted:
    """A fitted model: its columns, their cuts, the margin to begin with and the trees."""

    columns: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    thresholds: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        """The whole model as a JSON text."""
        return json.dumps({"format": FORMAT, "columns": self.columns, "edges": [e.tolist() for e in self.edges], "base": self.base, "trees": [asdict(t) for t in self.trees], "thresholds": self.thresholds}, allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        if d.get("format") != FORMAT:
            raise ValueError("not a boosted model of this package")
        return cls(d["columns"], [np.array(e, float) for e in d["edges"]], d["base"], [Tree(**t) for t in d["trees"]], d["thresholds"])

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.nodes(bins)]
        return out

    def tables(self) -> list[dict[str, np.ndarray]]:
        """Trees as arrays (feature, cut, left, right, value, cover), for ``models.tree_contributions``."""
        cut = lambda t: np.array([self.edges[f][b - 1] if f >= 0 and b else -np.inf for f, b in zip(t.feature, t.bin, strict=True)])
        return [{"feature": np.array(t.feature), "cut": cut(t), "left": np.array(t.left), "right": np.array(t.right), "value": np.array(t.value), "cover": np.array(t.cover, float)} for t in self.trees]


def cuts(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Distinct upper bounds of each column's bins, at quantiles; the last bin is open."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*(F.percentile_approx(value(c), shares, F.lit(100 * bins)).alias(f"c{k}") for k, c in enumerate(columns))).first()
    return [np.unique(np.array(x or [], float)) for x in row]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers as rows of bins: 0 for a missing one, else 1 and the number of bounds below the value."""
    out = np.zeros(values.shape, np.uint8)
    for k, e in enumerate(edges):
        seen = ~np.isnan(values[:, k])
        out[seen, k] = 1 + np.searchsorted(e, values[seen, k])
    return out


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in names], 1) if batch.num_rows else np.zeros((0, len(names)))


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a column of binaries, one after the other."""
    if not len(column):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[column.offset] : ends[column.offset + len(column)]]


def _binaries(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    step = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return _bytes(batch.column("bins")).reshape(batch.num_rows, width)


def _margins_of(batch: pa.RecordBatch) -> np.ndarray:
    return _bytes(batch.column("margins")).copy().view(np.float64).reshape(batch.num_rows, -1)


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, in units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


def sampled(row: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by the hash of each."""
    return mixed(row.astype(np.uint32) ^ mixed(np.uint32(seed * 65_537 + tree))) < share * float(1 << 32) if share < 1 else np.ones(len(row), bool)


def allowed(v: Variant, tree: int, share: float) -> list[int]:
    """Features that a tree may use."""
    if share >= 1:
        return sorted(v.features)
    return sorted(np.random.default_rng((v.seed, tree)).choice(sorted(v.features), max(1, round(share * len(v.features))), replace=False).tolist())


def best_split(hist: np.ndarray, features: list[int], p: Params) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's histogram (3 x features x bins: gradient, Hessian, rows); the first of equal ones, gain 0 without any."""
    g, h, n = (np.cumsum(x[features], 1, dtype=np.float64) for x in hist)
    score = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + p.l2)
    G, H, N = g[:, -1:], h[:, -1:], n[:, -1:]
    gain = score(g, h) + score(G - g, H - h) - score(G, H)
    fits = (np.minimum(h, H - h) >= p.least_hessian * UNIT) & (np.minimum(n, N - n) >= p.least_rows)
    gain = np.where(fits, gain, 0.0)
    k = int(np.argmax(gain)) if gain.size else 0
    return (float(gain.flat[k]), features[k // gain.shape[1]], k % gain.shape[1]) if gain.size and gain.flat[k] > 1e-12 else (0.0, -1, 0)


class _Growing:
    """A tree while it grows: histograms and best splits of the nodes known so far."""

    def __init__(self, features: list[int], p: Params):
        self.tree, self.features, self.p = Tree(), features, p
        self.tree.add()
        self.hist: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[float, int, int]] = {}
        self.depth = {0: 0}
        self.total: dict[int, tuple[float, float, int]] = {}

    def know(self, node: int, hist: np.ndarray) -> None:
        self.hist[node] = hist
        g, h, n = hist[:, 0].sum(1)
        self.total[node] = g / UNIT, h / UNIT, int(n)
        self.best[node] = best_split(hist, self.features, self.p) if self.depth[node] < self.p.depth else (0.0, -1, 0)

    def taken(self) -> tuple[list[int], list[int]]:
        """Nodes that the queue takes, best gain first, and those of them without children yet."""
        queue, order, new = [(-self.best[0][0], 0)] if self.best.get(0, (0,))[0] > 0 else [], [], []
        while queue and len(order) < self.p.leaves - 1:
            _, node = heapq.heappop(queue)
            order.append(node)
            if self.tree.left[node] < 0:
                new.append(node)
            else:
                for child in (self.tree.left[node], self.tree.right[node]):
                    if self.best[child][0] > 0:
                        heapq.heappush(queue, (-self.best[child][0], child))
        return order, new

    def split(self, node: int) -> tuple[int, int, int]:
        """Gives the node children: (node, the smaller child, the other one)."""
        t, (_, f, b) = self.tree, self.best[node]
        t.feature[node], t.bin[node] = f, b
        t.left[node], t.right[node] = t.add(), t.add()
        self.depth[t.left[node]] = self.depth[t.right[node]] = self.depth[node] + 1
        rows = self.hist[node][2, f]
        small = rows[: b + 1].sum() * 2 <= rows.sum()
        return (node, t.left[node], t.right[node]) if small else (node, t.right[node], t.left[node])

    def done(self) -> Tree:
        """The tree of the nodes taken, with values and covers."""
        order, _ = self.taken()
        kept, out = set(order), Tree()
        stack = [(0, out.add())]
        while stack:
            node, to = stack.pop()
            g, h, n = self.total[node]
            out.cover[to] = n
            if node in kept:
                out.feature[to], out.bin[to] = self.tree.feature[node], self.tree.bin[node]
                out.left[to], out.right[to] = out.add(), out.add()
                stack += [(self.tree.left[node], out.left[to]), (self.tree.right[node], out.right[to])]
            else:
                out.value[to] = -g / (h + self.p.l2) * self.p.rate
        return out


def _sums(cell: np.ndarray, w: np.ndarray, many: np.ndarray | None, cells: int) -> np.ndarray:
    """Exact sums of whole numbers below 2^33, each taken ``many`` times, by cell."""
    if many is None:
        # Up to a million of them are exact in doubles.
        return np.bincount(cell, weights=w, minlength=cells).astype(np.int64)
    high = np.floor(w / 65_536)
    total = lambda part: np.bincount(cell, weights=part * many, minlength=cells).astype(np.int64)
    return total(high) * 65_536 + total(w - high * 65_536)


def _combined(rows: DataFrame, seeds: list[int], trees: range, share: float) -> DataFrame:
    """y, bins, many: rows with the same bins and label as one; how many of them each of ``trees`` draws by each of ``seeds`` (all of them, once, if ``share`` is 1)."""
    if share >= 1:
        return rows.groupBy("y", "bins").agg(F.array(F.count(F.lit(1))).alias("many"))
    draws = [(t, seed) for t in trees for seed in seeds]
    names = [f"d{k}" for k in range(len(draws))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            drawn = [pa.array(sampled(row, seed, t, share).astype(np.int32)) for t, seed in draws]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("bins"), *drawn], ["y", "bins", *names])

    drawn = rows.mapInArrow(run, "y double, bins binary, " + ", ".join(f"{n} int" for n in names))
    return drawn.groupBy("y", "bins").agg(*(F.sum(n).alias(n) for n in names)).select("y", "bins", F.array(*names).alias("many"))


def _histograms(rows: DataFrame, width: int, bins: int, models: list[tuple[list[Tree], int]], slots: dict[int, int], tree: int, share: float, growing: dict[int, Tree], wanted: dict[int, list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """(model, node) -> its histogram. ``models``: trees since the last writing of margins, and the seed, of each; ``slots``: a seed's place in ``many``, if rows are combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(m, node): np.zeros((3, width, bins), np.int64) for m, nodes in wanted.items() for node in nodes}
        for batch in batches:
            x, y, margins = _bins_of(batch, width), batch.column("y").to_numpy(), _margins_of(batch)
            if slots:
                each = batch.column("many").flatten().to_numpy().reshape(batch.num_rows, -1)
            else:
                row = batch.column("row").to_numpy()
            for m, nodes in wanted.items():
                trees, seed = models[m]
                seen = np.flatnonzero(each[:, slots[seed]] if slots else sampled(row, seed, tree, share))
                at = growing[m].nodes(x[seen])
                number = np.full(len(growing[m].feature), -1)
                number[nodes] = np.arange(len(nodes))
                inside = number[at] >= 0
                seen, at = seen[inside], number[at[inside]]
                margin = margins[seen, m].copy()
                for t in trees:
                    margin += np.array(t.value)[t.nodes(x[seen])]
                g, h = gradients(margin, y[seen])
                many = each[seen, slots[seed]] if slots else None
                for f in range(width):
                    cell = at * bins + x[seen, f]
                    for k, w in enumerate((g, h, np.ones(len(seen)))):
                        part = _sums(cell, w, many, len(nodes) * bins).reshape(len(nodes), bins)
                        for i, node in enumerate(nodes):
                            held[m, node][k, f] += part[i]
        for (m, node), hist in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([node]), pa.array([hist.tobytes()], pa.binary())], ["m", "node", "hist"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("hist").to_pylist())
        return pa.table({"m": t.column("m")[:1], "node": t.column("node")[:1], "hist": pa.array([total.tobytes()], pa.binary())})

    schema = "m long, node long, hist binary"
    found = rows.mapInArrow(run, schema).groupBy("m", "node").applyInArrow(added, schema).collect()
    return {(r["m"], r["node"]): np.frombuffer(r["hist"], np.int64).reshape(3, width, bins) for r in found}


def fit(df: DataFrame, label: Column, columns: list[str], key: list[str], p: Params = Params(), variants: list[Variant] | None = None) -> list[Boosted]:  # noqa: B008
    """Models of P(label = 1) by ``columns``, one for each of ``variants`` (by default one with all features). ``key`` names rows, for the draws of a tree."""
    width, variants = len(columns), variants or [Variant(tuple(range(len(columns))))]
    if p.bins > 255 or len(variants) * 2 * p.leaves * width * (p.bins + 1) > MAX_CELLS:
        raise ValueError("fewer bins (255 at most), leaves or models together are needed")
    names = [f"x{k}" for k in range(width)]
    x = df.select(label.cast("double").alias("y"), F.xxhash64(*key).alias("row"), *(F.col(_quoted(c)).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).filter("y IN (0, 1)")
    edges, bins = cuts(x, names, p.bins), p.bins + 1

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.array((batch.column("row").to_numpy().view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("y"), row, _binaries(binned(_matrix(batch, names), edges))], ["y", "row", "bins"])

    every = written(x.mapInArrow(coded, "y double, row long, bins binary"))
    n, positive, kinds = every.agg(F.count("y"), F.sum("y"), F.approx_count_distinct(F.xxhash64("y", "bins"))).first()
    share = min(max((positive or 0) / max(n, 1), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    models: list[list[Tree]] = [[] for _ in variants]
    seeds, combined, drawn = sorted({v.seed for v in variants}), kinds * FEWER <= n, p.row_share < 1
    for tree in range(p.rounds):
        if tree == 0 or tree % REFRESH == 0 and combined and drawn:
            # Later trees draw anew.
            source = written(_combined(every, seeds, range(tree, min(tree + REFRESH, p.rounds)), p.row_share)) if combined else every
            rows, recent = _refreshed(source, width, [[_constant(base), *trees] for trees in models]), [[] for _ in variants]
        elif tree % REFRESH == 0:
            rows, recent = _refreshed(rows, width, recent), [[] for _ in variants]
        slots = {seed: (tree % REFRESH * len(seeds) + k) * drawn for k, seed in enumerate(seeds)} if combined else {}
        growing = [_Growing(allowed(v, tree, p.feature_share), p) for v in variants]
        ask = lambda nodes: _histograms(rows, width, bins, [(t, v.seed) for t, v in zip(recent, variants, strict=True)], slots, tree, p.row_share, {m: growing[m].tree for m in nodes}, nodes)  # noqa: B023, E731
        for (m, node), hist in ask({m: [0] for m in range(len(variants))}).items():
            growing[m].know(node, hist)
        while splits := {m: [g.split(node) for node in new] for m, g in enumerate(growing) if g.hist and (new := g.taken()[1])}:
            found = ask({m: [small for _, small, _ in s] for m, s in splits.items()})
            for m, s in splits.items():
                for parent, small, other in s:
                    growing[m].know(small, found[m, small])
                    growing[m].know(other, growing[m].hist[parent] - found[m, small])
                    del growing[m].hist[parent]
        for m, g in enumerate(growing):
            if g.hist:
                models[m].append(g.done())
                recent[m].append(models[m][-1])
    return [Boosted(columns, edges, base, trees) for trees in models]


def _constant(value: float) -> Tree:
    t = Tree()
    t.value[t.add()] = value
    return t


def _refreshed(rows: DataFrame, width: int, recent: list[list[Tree]]) -> DataFrame:
    """``rows`` with the trees' values added to the margins (0 if they have none yet), in the trees' order."""
    kept = [c for c in rows.columns if c != "margins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bins_of(batch, width)
            margins = _margins_of(batch) if "margins" in batch.schema.names else np.zeros((batch.num_rows, len(recent)))
            for m, trees in enumerate(recent):
                for t in trees:
                    margins[:, m] += np.array(t.value)[t.nodes(x)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _binaries(margins)], [*kept, "margins"])

    return written(rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept]).add("margins", "binary")))


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _stacked(values: tuple[pa.Array, ...]) -> np.ndarray:
    return np.stack([np.asarray(v.to_numpy(zero_copy_only=False), float) for v in values], 1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])), pa.array(np.ascontiguousarray(rows).ravel()))


def scored(df: DataFrame, fitted: list[Boosted], names: list[str] | None = None) -> DataFrame:
    """``df`` with the probability of each model in a column of ``names`` (score, or score0 and so on)."""
    names = names or (["score"] if len(fitted) == 1 else [f"score{k}" for k in range(len(fitted))])
    columns = fitted[0].columns

    @F.arrow_udf("array<double>")
    def kernel(*values: pa.Array) -> pa.Array:
        x = binned(_stacked(values), fitted[0].edges)
        p = np.stack([1 / (1 + np.exp(-m.margins(x))) for m in fitted], 1)
        return _lists(p)

    d = df.withColumn("_p", kernel(*(F.col(_quoted(c)).cast("double") for c in columns)))
    return d.select(*map(_quoted, df.columns), *(F.col("_p")[k].alias(n) for k, n in enumerate(names)))


def contributions(df: DataFrame, model: Boosted) -> DataFrame:
    """``df`` with contributions (array over the model's columns), base and margin: exact Shapley values that add up with base to the margin."""
    from .models import tree_contributions

    trees = model.tables()

    @F.arrow_udf("struct<contributions: array<double>, base: double, margin: double>")
    def kernel(*values: pa.Array) -> pa.Array:
        x = _stacked(values)
        # Missing values are below every cut.
        phi, expected = tree_contributions(trees, np.where(np.isnan(x), -np.inf, x))
        margin = model.margins(binned(x, model.edges))
        return pa.StructArray.from_arrays([_lists(phi), pa.array(np.full(len(x), expected + model.base)), pa.array(margin)], ["contributions", "base", "margin"])

    return df.withColumn("_k", kernel(*(F.col(_quoted(c)).cast("double") for c in model.columns))).select(*map(_quoted, df.columns), "_k.*")


def ablation(df: DataFrame, label: Column, columns: list[str], key: list[str], drops: dict[str, list[str]], seeds: list[int], held_out: Column, p: Params = Params()) -> DataFrame:  # noqa: B008
    """dropped, seed, auc, difference: what leaving features out does to the held-out area under the curve, by refitting without them.

    All refits (and the full models, dropped = '') are fitted in the same passes over the rows that aren't held out, with the same draws for a seed.
    """
    from .evaluation import roc_auc

    sets = {"": [], **drops}
    variants = [Variant(tuple(k for k, c in enumerate(columns) if c not in dropped), seed) for dropped in sets.values() for seed in seeds]
    fitted = fit(df.filter(~held_out), label, columns, key, p, variants)
    names = [(name, seed) for name in sets for seed in seeds]
    s = scored(df.filter(held_out).withColumn("_y", label.cast("double") == 1), fitted, [f"_s{k}" for k in range(len(fitted))])
    long = s.select("_y", F.explode(F.array(*(F.struct(F.lit(n).alias("dropped"), F.lit(seed).alias("seed"), F.col(f"_s{k}").alias("score")) for k, (n, seed) in enumerate(names)))).alias("x")).select("_y", "x.*")
    auc = roc_auc(long, "score", F.col("_y"), ["dropped", "seed"]).select("dropped", "seed", "auc")
    full = auc.filter("dropped = ''").select("seed", F.col("auc").alias("full"))
    return auc.join(full, "seed").select("dropped", "seed", "auc", (F.col("auc") - F.col("full")).alias("difference"))

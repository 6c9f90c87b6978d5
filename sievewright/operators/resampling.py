"""Stratified bootstrap at a thousand replicates and more: every replicate draws exactly as many rows of each class as there are.

A row's weight in a replicate follows from its class, its place in the class's order and the replicate's number, so any task can compute it and
no weight is ever stored or moved. It has two parts:

* a Poisson draw by hash at a rate a little under 1, whose total over the class therefore stays under the class's size;
* the draws that are missing to that size, each at a hashed place: together the weights are multinomial, as drawing with replacement gives.
  (Should a Poisson total exceed the size after all, that replicate draws all its rows by hashed places.)

Totals of the first part depend on the class's size alone and are counted over a range of numbers, without the table. Places of the second are a few times the root of the
size in each replicate; they meet their rows in one join.

Rank metrics order the rows once by score, in ranges. A range adds up its rows' weights, a matrix of rows by replicates that is made a block of a cache's size at a time, into totals and
into what its rows win among themselves. Only totals by range and replicate move. A range's first and last score may go on in its neighbours, so they are totals of their own, by score. Where a replicate's curve
crosses a bound on false positives inside a range, that range alone is looked at once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .evaluation import roc_metrics
from .ranking import numbered

#: Standard deviations by which the Poisson part stays under a class's size.
MARGIN = 6
#: Cells of weights that are made at a time (they stay in a core's cache), replicates that a range works on at a time, and rows of a range, about.
CELLS, REPS, RANGE_ROWS = 1 << 16, 256, 50_000
#: Numbers that one row of the count of the Poisson part stands for, draws made at a time, places whose draws are grouped together at most, rows of a task of the join.
NUMBERS, DRAWS, PLACES, JOIN_ROWS = 4_000, 500_000, 1 << 16, 250_000
#: Multipliers and shifts of a 32-bit finaliser, and the two seeds.
_MIX = ((16, 0x85EBCA6B), (13, 0xC2B2AE35))
SEED, EXTRA_SEED = 0x2545F491, 0x5BD1E995
_MASK = 0xFFFFFFFF
#: Rows whose Poisson parts are added up at a time.
_ADDED = 1_024


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers."""
    x = np.asarray(x, np.uint32).copy()
    for shift, factor in _MIX:
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return x ^ (x >> np.uint32(16))


@cache
def _space(which: int, width: int) -> np.ndarray:
    """Memory of one block of hashes, used again for every block."""
    return np.empty((max(1, CELLS // width), width), np.uint32)


def steps(size: int) -> list[int]:
    """The Poisson part of a class: a hash's upper 16 bits at or above the k-th of these numbers give at least k draws."""
    rate, total, out = max(0.0, 1 - MARGIN / math.sqrt(size)) if size else 0.0, 0.0, []
    for k in range(12):
        total += math.exp(-rate) * rate**k / math.factorial(k)
        out.append(min(65536, math.floor(total * 65536 + 0.5)))
    return out


class Classes:
    """Classes by number, their sizes, and the replicates' totals of the Poisson part."""

    def __init__(self, sizes: list[int], reps: int):
        self.sizes, self.reps = sizes, reps
        self.table = [(np.arange(65536)[:, None] >= np.array(steps(n))[None, :]).sum(1).astype(np.uint8) for n in sizes]
        self.drawn = np.zeros((len(sizes), reps), np.int64)

    def base(self, which: int, places: np.ndarray, reps: np.ndarray) -> np.ndarray:
        """The Poisson part, rows by replicates; 0 where the replicate draws all its rows by places."""
        row = mixed(mixed(mixed(np.full(1, SEED ^ which)) ^ (places & _MASK).astype(np.uint32)) ^ (places >> 32).astype(np.uint32))
        rep, out = reps.astype(np.uint32), np.empty((len(row), len(reps)), np.uint8)
        for part in _blocks(len(row), len(rep)):
            x, y = (_space(k, len(rep))[: part.stop - part.start] for k in range(2))
            np.bitwise_xor(row[part, None], rep[None, :], out=x)
            for shift, factor in _MIX:
                np.right_shift(x, np.uint32(shift), out=y)
                x ^= y
                x *= np.uint32(factor)
            # The last step of ``mixed`` leaves the upper half as it is.
            x >>= np.uint32(16)
            np.take(self.table[which], x, out=out[part], mode="clip")
        over = self.drawn[which, reps] > self.sizes[which]
        if over.any():
            out[:, over] = 0
        return out

    def weights(self, which: int, places: np.ndarray, more: Draws, reps: np.ndarray, kind: type) -> Iterator[tuple[slice, np.ndarray]]:
        """Weights of a class's rows by replicates (ascending), some rows at a time."""
        at = np.minimum(np.searchsorted(reps, more.rep), len(reps) - 1)
        held = reps[at] == more.rep
        row, at = more.row[held], at[held]
        for part in _blocks(len(places), len(reps)):
            w = self.base(which, places[part], reps).astype(kind)
            mine = slice(*np.searchsorted(row, [part.start, part.stop]))
            np.add.at(w, (row[mine] - part.start, at[mine]), 1)
            yield part, w


@dataclass(frozen=True)
class Draws:
    """Draws beside the Poisson part: rows (numbers, ascending) and replicates."""

    row: np.ndarray
    rep: np.ndarray

    def of(self, rows: np.ndarray) -> Draws:
        """Those of ``rows`` (numbers), in their order."""
        first, last = np.searchsorted(self.row, rows), np.searchsorted(self.row, rows, side="right")
        n = last - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return Draws(np.repeat(np.arange(len(rows)), n), self.rep[at])


def _draws(more: pa.Array | pa.ChunkedArray) -> Draws:
    """Of a column of lists."""
    n = pc.fill_null(pc.list_value_length(more), 0).to_numpy(zero_copy_only=False) if isinstance(more, pa.Array) else pc.fill_null(pc.list_value_length(more), 0).to_numpy()
    return Draws(np.repeat(np.arange(len(n)), n), np.asarray(pc.list_flatten(more)).astype(np.int64))


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def _sizes(df: DataFrame, reps: int) -> Classes:
    """Classes of ``_class``, with totals counted over ranges of numbers."""
    spark = df.sparkSession
    known = {r["_class"]: r["n"] for r in df.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = Classes([known.get(c, 0) for c in range(max(known, default=-1) + 1)], reps)
    rows, every = NUMBERS, np.arange(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, first, last in zip(*(batch.column(k).to_pylist() for k in ("c", "first", "last")), strict=True):
                for a in range(first, last, _ADDED):
                    w = classes.base(c, np.arange(a, min(last, a + _ADDED)), every)
                    # At most 12 a row, so 16 rows fit a byte.
                    whole = len(w) // 16 * 16
                    t = np.add.reduce(w[:whole].reshape(-1, 16, reps), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
                    totals[c] = totals.get(c, 0) + t + w[whole:].sum(0, dtype=np.int64)
        for c, t in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([t.tolist()], pa.list_(pa.int64()))], ["c", "t"])

    of = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in enumerate(classes.sizes) if n)))
    if known:
        work = spark.range(max(1, -(-max(classes.sizes) // rows))).select("id", of.alias("x")).select(F.col("x.c").cast("long").alias("c"), (F.col("id") * rows).alias("first"), F.least(F.col("x.n").cast("long"), (F.col("id") + 1) * rows).alias("last"))
        found = work.filter("first < last").mapInArrow(run, "c long, t array<long>").select("c", F.posexplode("t").alias("r", "t")).groupBy("c", "r").agg(F.sum("t").alias("t"))
        for r in found.collect():
            classes.drawn[r["c"], r["r"]] = r["t"]
    return classes


def _more(df: DataFrame, classes: Classes) -> DataFrame:
    """_class, _place, _more: replicates of the draws that are missing after the Poisson part, by the row that they hit.

    A replicate's draws move as one row for each span of places, and a span puts its draws in the order of their places.
    """
    spark, sizes = df.sparkSession, classes.sizes
    rows = [(c, r, int(n - d if d <= n else n)) for c, n in enumerate(sizes) for r, d in enumerate(classes.drawn[c].tolist())]
    span = min(PLACES, max(1, -(-max(sizes, default=1) // (4 * spark.sparkContext.defaultParallelism))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, r, n in zip(*(batch.column(k).to_pylist() for k in "crn"), strict=True):
                for first in range(0, n, DRAWS):
                    j = np.arange(first, min(n, first + DRAWS))
                    high = mixed(mixed(mixed(np.full(1, EXTRA_SEED ^ c)) ^ np.uint32(r)) ^ (j & _MASK).astype(np.uint32) ^ (j >> 32).astype(np.uint32))
                    low = mixed(high ^ np.uint32(EXTRA_SEED)) >> np.uint32(12)
                    place = np.sort(np.floor((high * 1048576.0 + low) / float(1 << 52) * sizes[c]).astype(np.int64))
                    begin = np.flatnonzero(np.append(True, np.diff(place // span) != 0))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(place)).astype(np.int32)), pa.array(place))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), c)), pa.array(place[begin] // span), pa.array(np.full(len(begin), r, np.int32)), lists], ["_class", "_span", "r", "places"])

    def ordered(t: pa.Table) -> pa.Table:
        place = np.asarray(pc.list_flatten(t.column("places")))
        rep = np.repeat(t.column("r").to_numpy(), pc.list_value_length(t.column("places")).to_numpy())
        order = np.argsort(place, kind="stable")
        place, rep = place[order], rep[order]
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(place)).astype(np.int32)), pa.array(rep, pa.int32()))
        return pa.table({"_class": np.full(len(begin), t.column("_class")[0].as_py(), np.int64), "_place": place[begin], "_more": lists})

    missing = spark.createDataFrame(rows, "c long, r long, n long").repartition(spark.sparkContext.defaultParallelism)
    spans = missing.mapInArrow(run, "_class long, _span long, r int, places array<long>")
    return spans.groupBy("_class", "_span").applyInArrow(ordered, "_class long, _place long, _more array<int>")


def drawn(df: DataFrame, key: str, of: Column, keep: dict[str, Column], reps: int) -> tuple[DataFrame, Classes]:
    """A written table of _class, _place, _more and ``keep``, and the classes. ``of`` numbers the classes from 0, few of them; ``key`` is numeric and orders them."""
    d = df.select(F.col(key).alias("_key"), of.cast("long").alias("_class"), *(c.alias(k) for k, c in keep.items()))
    n = numbered(d, "_key", ["_class"]).withColumn("_place", F.col("place") - 1).drop("place", "all", "_key")
    classes = _sizes(d, reps)
    # Spark takes the draws for as small as the numbers that they are made from, though there may be one for every row: never by broadcast, and as many tasks as the rows ask for.
    parts, at = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(classes.sizes) // JOIN_ROWS)), ["_class", "_place"]
    return written(n.repartition(parts, *at).join(_more(df, classes).repartition(parts, *at).hint("merge"), at, "left")), classes


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy()) for c in names]


def sums(df: DataFrame, key: str, of: Column, values: dict[str, Column], reps: int) -> DataFrame:
    """class, rep and for each of ``values`` its weighted sum over the class's rows in the replicate."""
    rows, classes = drawn(df, key, of, {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in values.items()}, reps)
    every, names = np.arange(reps), list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(classes.sizes), len(names), reps))
        for batch in batches:
            which, places, *v = _columns(batch, "_class", "_place", *names)
            more = _draws(batch.column("_more"))
            for c in np.unique(which):
                mine = np.flatnonzero(which == c)
                x = np.stack(v)[:, mine]
                for part, w in classes.weights(int(c), places[mine], more.of(mine), every, np.float64):
                    totals[c] += x[:, part] @ w
        arrays = [pa.array(np.repeat(np.arange(len(totals)), reps)), pa.array(np.tile(every, len(totals)))]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(totals[:, k].ravel()) for k in range(len(names)))], ["class", "rep", *names])

    out = rows.mapInArrow(run, ", ".join(["class long", "rep long", *(f"`{k}` double" for k in names)]))
    return out.groupBy("class", "rep").agg(*(F.sum(k).alias(k) for k in names))


@dataclass(frozen=True)
class Run:
    """One order of rows: those of ``classes`` (negative, positive) by ``score``, in the replicates that are ``residue`` modulo ``modulo``."""

    score: str
    classes: tuple[int, int]
    modulo: int = 1
    residue: int = 0


def _groups(t: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray], Draws]]:
    """A range's rows by run, highest scores first."""
    run, score, which, place = _columns(t, "run", "score", "_class", "_place")
    more = _draws(t.column("_more"))
    for k in np.unique(run):
        mine = np.flatnonzero(run == k)
        mine = mine[np.argsort(-score[mine], kind="stable")]
        yield int(k), {"score": score[mine], "class": which[mine], "place": place[mine]}, more.of(mine)


def _chunks(reps: np.ndarray) -> Iterator[slice]:
    for a in range(0, len(reps), REPS):
        yield slice(a, min(len(reps), a + REPS))


def _at_scores(classes: Classes, spec: Run, rows: dict[str, np.ndarray], more: Draws, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores (descending), and the weights of negatives and positives at each, scores by replicates."""
    first = np.flatnonzero(np.append(True, rows["score"][1:] != rows["score"][:-1]))
    neg, pos = (np.zeros((len(first), len(reps)), np.int64) for _ in range(2))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows["score"]))))
    for into, c in ((neg, spec.classes[0]), (pos, spec.classes[1])):
        mine = np.flatnonzero(rows["class"] == c)
        for part, w in classes.weights(c, rows["place"][mine], more.of(mine), reps, np.int64):
            g = group[mine[part]]
            begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            into[g[begin]] += np.add.reduceat(w, begin, axis=0)
    return rows["score"][first], neg, pos


def _range_totals(classes: Classes, spec: Run, rows: dict[str, np.ndarray], more: Draws, reps: np.ndarray) -> list[tuple[float, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """score, tie, weights of negatives, of positives and what these win: of a range's first score, its last one and those between."""
    score = rows["score"]
    # Ends of the three parts; where there is one score only, the others are empty.
    ends = np.array([np.searchsorted(-score, -score[0], side="right"), np.searchsorted(-score, -score[-1])])
    ends = np.array([0, ends[0], max(ends), len(score)])
    neg, pos, won = (np.zeros((3, len(reps))) for _ in range(3))
    side = [np.flatnonzero(rows["class"] == c) for c in spec.classes]
    draws, place = [more.of(x) for x in side], [rows["place"][x] for x in side]
    above, least = np.searchsorted(-score[side[1]], -score[side[0]]), np.searchsorted(-score[side[1]], -score[side[0]], side="right")
    cuts = [np.searchsorted(x, ends) for x in side]
    for chunk in _chunks(reps):
        width = chunk.stop - chunk.start
        # Running sums of the positives, by their number; positives of the first score are the first.
        running = np.zeros((len(side[1]) + 1, width))
        for part, w in classes.weights(spec.classes[1], place[1], draws[1], reps[chunk], np.float64):
            np.cumsum(w, axis=0, out=running[part.start + 1 : part.stop + 1])
            running[part.start + 1 : part.stop + 1] += running[part.start]
        pos[:, chunk] = np.diff(running[cuts[1]], axis=0)
        for part, w in classes.weights(spec.classes[0], place[0], draws[0], reps[chunk], np.float64):
            for k in range(3):
                a, b = (min(max(x, part.start), part.stop) for x in cuts[0][k : k + 2])
                if a < b:
                    inside = w[a - part.start : b - part.start]
                    neg[k, chunk] += inside.sum(0)
                    if k == 1:
                        x, y = above[a:b], least[a:b]
                        begin = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
                        half = (running[x[begin]] + running[y[begin]]) / 2 - running[cuts[1][1]]
                        won[k, chunk] += np.einsum("ij,ij->j", inside, half[np.cumsum(begin) - 1])
    return [(score[ends[k]], k != 1, neg[k].astype(np.int64), pos[k].astype(np.int64), won[k]) for k in range(3) if ends[k] < ends[k + 1]]


def _own(run: Run) -> Column:
    """The draws of the run's replicates."""
    return F.filter("_more", lambda r: r % run.modulo == run.residue) if run.modulo > 1 else F.col("_more")


def roc_draws(df: DataFrame, key: str, of: Column, runs: list[Run], reps: int, rates: dict[str, float]) -> DataFrame:
    """run, rep, auc and for each of ``rates`` the true-positive rate at the last point of the curve with at most that rate of false positives.

    Ties count half. Runs without one of their classes give no rows; rows with a null score are left out of the curve, though not of the draws.
    """
    scores = {f"s{k}": F.col(c).cast("double") for k, c in enumerate(sorted({r.score for r in runs}))}
    column = dict(zip(sorted({r.score for r in runs}), scores, strict=True))
    rows, classes = drawn(df, key, of, scores, reps)
    # One scan a run: a task's rows aren't repeated for all runs before they are dealt out.
    each = [rows.filter(F.col("_class").isin(*r.classes)).select(F.lit(k).alias("run"), F.col(column[r.score]).alias("score"), "_class", "_place", _own(r).alias("_more")) for k, r in enumerate(runs)]
    flat = reduce(DataFrame.unionByName, each).filter("score IS NOT NULL")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(classes.sizes) * len(runs) // RANGE_ROWS))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, parts // 4)
    ranged = written(flat.repartitionByRange(parts, "run", "score", "_class", "_place").withColumn("range", F.spark_partition_id()))
    of_run = [np.arange(r.residue, reps, r.modulo) for r in runs]
    schema = "run int, range int, score double, tie boolean, rep long, neg long, pos long, won double"
    names = [x.split()[0] for x in schema.split(", ")]

    def totals(t: pa.Table) -> pa.Table:
        at = t.column("range")[0].as_py()
        out = []
        for k, own, more in _groups(t):
            pieces = _range_totals(classes, runs[k], own, more, of_run[k])
            for s, tie, n, p, won in pieces:
                m = len(of_run[k])
                out.append(pa.table(dict(zip(names, [np.full(m, k, np.int32), np.full(m, at, np.int32), np.full(m, s), np.full(m, tie), of_run[k], n, p, won], strict=True))))
        return pa.concat_tables(out)

    # Scores that go on in a neighbouring range are one.
    whole = ranged.repartition(tasks, "range").groupBy("range").applyInArrow(totals, schema).groupBy("run", "rep", "score", "tie").agg(F.max("range").alias("range"), *(F.sum(c).alias(c) for c in ("neg", "pos", "won")))
    before = Window.partitionBy("run", "rep").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    place = whole.withColumns({"fp": F.coalesce(F.sum("neg").over(before), F.lit(0)), "tp": F.coalesce(F.sum("pos").over(before), F.lit(0))})
    size = lambda side: F.element_at(F.array(*(F.lit(classes.sizes[r.classes[side]] if r.classes[side] < len(classes.sizes) else 0).cast("long") for r in runs)), F.col("run") + 1)
    place = written(place.withColumns({"n": size(0), "p": size(1)}).filter("n > 0 AND p > 0"))
    auc = place.groupBy("run", "rep").agg((F.sum(F.col("won") + F.col("neg") * F.col("tp") + F.when(F.col("tie"), F.col("neg") * F.col("pos") / 2).otherwise(0.0)) / F.max(F.col("p") * F.col("n").cast("double"))).alias("auc"))
    crossings = place.select("*", F.explode(F.array(*(F.lit(float(r)) for r in rates.values()))).alias("rate")).filter((F.col("fp") / F.col("n") <= F.col("rate")) & ((F.col("fp") + F.col("neg")) / F.col("n") > F.col("rate")))
    found = "run int, rep long, rate double, hit double"

    def inside(t: pa.Table, c: pa.Table) -> pa.Table:
        out, asked = [], c.to_pylist()
        for k, own, more in _groups(t):
            mine = [x for x in asked if x["run"] == k]
            if mine:
                want = np.unique([x["rep"] for x in mine])
                for chunk in _chunks(want):
                    some = want[chunk]
                    _, neg, pos = _at_scores(classes, runs[k], own, more, some)
                    neg, pos = np.cumsum(neg[1:-1], 0), np.cumsum(pos[1:-1], 0)
                    for x in mine:
                        if some[0] <= x["rep"] <= some[-1]:
                            r = int(np.searchsorted(some, x["rep"]))
                            reached = int(np.searchsorted((x["fp"] + neg[:, r]) / x["n"], x["rate"], side="right"))
                            out.append({"run": k, "rep": x["rep"], "rate": x["rate"], "hit": (x["tp"] + (int(pos[reached - 1, r]) if reached else 0)) / x["p"]})
        return pa.Table.from_pylist(out, pa.schema([("run", pa.int32()), ("rep", pa.int64()), ("rate", pa.float64()), ("hit", pa.float64())]))

    looked = crossings.filter("NOT tie")
    needed = ranged.join(looked.select("range").distinct(), "range", "left_semi")
    hits = needed.groupBy("range").cogroup(looked.groupBy("range")).applyInArrow(inside, found).unionByName(crossings.filter("tie").select("run", "rep", "rate", (F.col("tp") / F.col("p")).alias("hit")))
    wide = hits.groupBy("run", "rep").agg(*(F.max(F.when(F.col("rate") == float(r), F.col("hit"))).alias(m) for m, r in rates.items()))
    return auc.join(wide, ["run", "rep"])


METRICS = ("auc", "tpr_1", "tpr_01")
RATES = {"tpr_1": 0.01, "tpr_01": 0.001}


def bounds(draws: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """metric, mean, low, high: mean and percentiles 2.5 and 97.5 over replicates."""
    each = draws.unpivot(["rep"], list(metrics), "metric", "v").groupBy("metric")
    return each.agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


def _long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("model", "score"))


def _points(per_model: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    return per_model.agg(*(F.avg(m).alias(m) for m in metrics)).unpivot([], list(metrics), "metric", "point")


def _in_turn(scores: list[str], classes: tuple[int, int] = (0, 1)) -> list[Run]:
    """Replicate i has the scores of model i modulo their number."""
    return [Run(c, classes, len(scores), k) for k, c in enumerate(scores)]


def _differences(draws: DataFrame, first: int) -> DataFrame:
    """rep and the metrics of the first ``first`` runs less those of the others."""
    sign = F.when(F.col("run") < first, 1).otherwise(-1)
    return draws.groupBy("rep").agg(*(F.sum(sign * F.col(m)).alias(m) for m in METRICS), F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")


def bootstrap_roc(df: DataFrame, key: str, positive: str, scores: list[str], reps: int = 1_000) -> DataFrame:
    """metric, point (mean over models), low, high: the interval covers the sample and, models taking turns, their variance."""
    draws = roc_draws(df, key, F.col(positive).cast("int"), _in_turn(scores), reps, RATES)
    point = roc_metrics(_long(df, scores, positive), "score", F.col(positive), ["model"])
    return _points(point, METRICS).join(bounds(draws, METRICS).drop("mean"), "metric")


def paired_bootstrap(df: DataFrame, key: str, positive: str, a: list[str], b: list[str], reps: int = 1_000) -> DataFrame:
    """metric, point, mean, low, high of the difference of two models' metrics on the same resamples."""
    draws = _differences(roc_draws(df, key, F.col(positive).cast("int"), _in_turn(a) + _in_turn(b), reps, RATES), len(a))
    k = max(len(a), len(b))
    pairs = [f"{side}{i}" for side in "ab" for i in range(k)]
    wide = df.select(F.col(positive).alias("y"), *(F.col((a, b)[j][i % len((a, b)[j])]).alias(f"{'ab'[j]}{i}") for j in (0, 1) for i in range(k)))
    point = roc_metrics(_long(wide, pairs, "y"), "score", F.col("y"), ["model"])
    sign = F.when(F.col("model") < k, 1).otherwise(-1)
    point = point.agg(*((F.sum(sign * F.col(m)) / k).alias(m) for m in METRICS)).unpivot([], list(METRICS), "metric", "point")
    return point.join(bounds(draws, METRICS), "metric")


def independent_bootstrap(df: DataFrame, key: str, positive: str, first: str, scores: list[str], reps: int = 1_000) -> DataFrame:
    """metric, point, low, high of the difference of the same models' metrics on two test sets (``first`` or not), each resampled on its own."""
    of = F.col(positive).cast("int") + F.when(F.col(first), 0).otherwise(2)
    draws = _differences(roc_draws(df, key, of, _in_turn(scores) + _in_turn(scores, (2, 3)), reps, RATES), len(scores))
    sign = F.when(F.col(first), 1).otherwise(-1)
    point = roc_metrics(_long(df.withColumn("sign", sign), scores, positive, "sign"), "score", F.col(positive), ["model", "sign"])
    point = point.agg(*((F.sum(F.col("sign") * F.col(m)) / len(scores)).alias(m) for m in METRICS)).unpivot([], list(METRICS), "metric", "point")
    return point.join(bounds(draws, METRICS).drop("mean"), "metric")


def bootstrap_threshold(df: DataFrame, key: str, positive: str, scores: list[str], thresholds: list[float], reps: int = 1_000) -> DataFrame:
    """metric (recall, fpr), point (mean over models), low, high at fixed thresholds, one a model; models take turns in the replicates."""
    hits = {f"h{k}": (F.col(c) >= t).cast("int") for k, (c, t) in enumerate(zip(scores, thresholds, strict=True))}
    drawn_hits = sums(df, key, F.col(positive).cast("int"), {"rows": F.lit(1), **hits}, reps)
    hit = F.get(F.array(*hits), (F.col("rep") % len(scores)).cast("int")) / F.col("rows")
    draws = drawn_hits.groupBy("rep").agg(F.max(F.when(F.col("class") == 1, hit)).alias("recall"), F.max(F.when(F.col("class") == 0, hit)).alias("fpr"))
    point = df.agg(*(F.avg(F.when(c, h)).alias(f"{m}_{k}") for m, c in (("recall", F.col(positive)), ("fpr", ~F.col(positive))) for k, h in hits.items()))
    point = point.select(*((sum((F.col(f"{m}_{k}") for k in hits), F.lit(0.0)) / len(hits)).alias(m) for m in ("recall", "fpr"))).unpivot([], ["recall", "fpr"], "metric", "point")
    return point.join(bounds(draws, ("recall", "fpr")).drop("mean"), "metric")


def bootstrap_rate(df: DataFrame, key: str, flag: Column, reps: int = 1_000) -> DataFrame:
    """One row: rate, low, high (percentiles 2.5 and 97.5 of the replicates' rates)."""
    draws = sums(df, key, F.lit(0), {"rows": F.lit(1), "hits": flag.cast("int")}, reps).select("rep", (F.col("hits") / F.col("rows")).alias("rate"))
    return df.agg(F.avg(flag.cast("int")).alias("rate")).crossJoin(bounds(draws, ("rate",)).select("low", "high"))


def paired_difference(df: DataFrame, key: str, a: Column, b: Column, reps: int = 1_000) -> DataFrame:
    """One row: difference of two rates on the same rows, with percentile bounds; both see the same rows in every replicate."""
    apart = a.cast("int") - b.cast("int")
    draws = sums(df, key, F.lit(0), {"rows": F.lit(1), "apart": apart}, reps).select("rep", (F.col("apart") / F.col("rows")).alias("difference"))
    return df.agg(F.avg(apart).alias("difference")).crossJoin(bounds(draws, ("difference",)).select("low", "high"))


def family_bootstrap(families: DataFrame, key: str, coverage: Column, size: Column, reps: int = 10_000) -> DataFrame:
    """metric (macro: mean over families; pooled: by size), point, low, high, over resampled families. One row a family comes in; ``key`` is numeric."""
    f = families.select(F.col(key).alias("k"), F.coalesce(coverage, F.lit(0.0)).alias("c"), size.cast("double").alias("n"))
    rates = lambda *c: ((c[0] / c[1]).alias("macro"), (c[2] / c[3]).alias("pooled"))
    point = f.agg(*rates(F.sum("c"), F.count("c"), F.sum(F.col("c") * F.col("n")), F.sum("n"))).unpivot([], ["macro", "pooled"], "metric", "point")
    drawn_families = sums(f, "k", F.lit(0), {"c": F.col("c"), "rows": F.lit(1), "cn": F.col("c") * F.col("n"), "n": F.col("n")}, reps)
    return point.join(bounds(drawn_families.select("rep", *rates(*map(F.col, ("c", "rows", "cn", "n")))), ("macro", "pooled")).drop("mean"), "metric")

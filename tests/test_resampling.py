"""Resampling with fixed class totals against drawing and scoring in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import resampling


def plain_weights(sizes, reps):
    """Weights (class -> places x replicates) by drawing one after the other, from the definition."""
    out = []
    for c, n in enumerate(sizes):
        steps = resampling.steps(n)
        w = np.zeros((n, reps), int)
        for i in range(n):
            for r in range(reps):
                row = resampling.mixed(resampling.mixed(resampling.mixed(np.uint32(resampling.SEED ^ c)) ^ np.uint32(i)) ^ np.uint32(0))
                h = int(resampling.mixed(row ^ np.uint32(r))) >> 16
                w[i, r] = sum(h >= s for s in steps)
        for r in range(reps):
            drawn = w[:, r].sum()
            if drawn > n:
                w[:, r], drawn = 0, 0
            for j in range(n - drawn):
                high = resampling.mixed(resampling.mixed(resampling.mixed(np.uint32(resampling.EXTRA_SEED ^ c)) ^ np.uint32(r)) ^ np.uint32(j))
                low = int(resampling.mixed(high ^ np.uint32(resampling.EXTRA_SEED))) >> 12
                w[int((int(high) * 1048576 + low) / 2**52 * n), r] += 1
        out.append(w)
    return out


def plain_metrics(score, y, w, n_neg, n_pos):
    neg, pos = w * (y == 0), w * (y == 1)
    auc = sum(neg[i] * (pos[score > score[i]].sum() + pos[score == score[i]].sum() / 2) for i in range(len(score))) / n_neg / n_pos
    best = {0.01: 0.0, 0.2: 0.0}
    for s in np.unique(score):
        for rate in best:
            if neg[score >= s].sum() / n_neg <= rate:
                best[rate] = max(best[rate], pos[score >= s].sum() / n_pos)
    return [auc, best[0.01], best[0.2]]


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_ranks_equal_plain_ones(spark, monkeypatch, range_rows):
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    reps, g = 6, np.random.default_rng(3)
    rows = [(1000 - i, int(i % 3 == 0), float(g.integers(0, 12)), float(g.normal()) if i % 17 else None) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double").repartition(5)
    runs = [resampling.Run("a", (0, 1), 2, 0), resampling.Run("b", (0, 1), 2, 1)]
    got = {(r["run"], r["rep"]): [r["auc"], r["low"], r["mid"]] for r in resampling.roc_draws(df, "id", F.col("y"), runs, reps, {"low": 0.01, "mid": 0.2}).collect()}
    assert set(got) == {(r % 2, r) for r in range(reps)}
    sizes = [sum(r[1] == c for r in rows) for c in (0, 1)]
    weights = plain_weights(sizes, reps)
    ordered = [sorted(r for r in rows if r[1] == c) for c in (0, 1)]
    for (run, rep), values in got.items():
        table = [(r[2 + run], c, weights[c][k, rep]) for c in (0, 1) for k, r in enumerate(ordered[c]) if r[2 + run] is not None]
        score, y, w = (np.array(x) for x in zip(*table))
        assert values == pytest.approx(plain_metrics(score, y, w, *sizes))


def test_every_replicate_has_all_rows(spark):
    df = spark.range(1, 1200).select("id", F.when(F.col("id") < 3, 2).when(F.col("id") % 4 == 0, 1).otherwise(0).alias("c")).repartition(7)
    got = resampling.sums(df, "id", F.col("c"), {"n": F.lit(1), "odd": F.col("id") % 2}, 300).collect()
    sizes = {0: 898, 1: 299, 2: 2}
    assert len(got) == 900 and all(r["n"] == sizes[r["class"]] for r in got)
    odd = np.array([r["odd"] for r in got if r["class"] == 0])
    p = sum(i % 2 for i in range(3, 1200) if i % 4) / 898
    # Mean and spread of drawing 898 rows with replacement.
    spread = np.sqrt(898 * p * (1 - p))
    assert abs(odd.mean() - 898 * p) < 4 * spread / np.sqrt(300) and odd.std() == pytest.approx(spread, rel=0.2)


def test_weights_are_multinomial():
    c = resampling.Classes([4000], 200)
    c.drawn[0] = c.base(0, np.arange(4000), np.arange(200)).sum(0)
    w = c.base(0, np.arange(4000), np.arange(200))
    rate = 1 - resampling.MARGIN / np.sqrt(4000)
    assert (c.drawn <= 4000).all() and w.mean() == pytest.approx(rate, rel=0.005) and w.var() == pytest.approx(rate, rel=0.02)


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.25)], "id long, y int, a double")
    run = [resampling.Run("a", (0, 1))]
    assert resampling.roc_draws(df, "id", F.col("y"), run, 5, {"t": 0.1}).collect() == []
    assert resampling.roc_draws(df.limit(0), "id", F.col("y"), run, 5, {"t": 0.1}).collect() == []
    assert resampling.sums(df.limit(0), "id", F.col("y"), {"n": F.lit(1)}, 5).collect() == []
    assert {r["n"] for r in resampling.sums(df, "id", F.col("y"), {"n": F.lit(1)}, 5).collect()} == {2.0}


def test_draws_are_not_broadcast(spark, monkeypatch):
    """The places that a replicate's missing draws hit grow with the table: they must not pass through the driver."""
    plans = []
    monkeypatch.setattr(resampling, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    resampling.drawn(spark.range(500).withColumn("y", F.col("id") % 2), "id", F.col("y"), {}, 20)
    assert "SortMergeJoin" in next(line for line in plans[-1].splitlines() if "Join" in line)


def test_a_range_needs_no_table_of_scores_by_replicates(monkeypatch):
    """Weights are made some rows and replicates at a time, whatever a range holds, and every part's totals are those of all weights."""
    monkeypatch.setattr(resampling, "CELLS", 64)
    monkeypatch.setattr(resampling, "REPS", 8)
    resampling._space.cache_clear()
    reps, g = 20, np.random.default_rng(5)
    c = resampling.Classes([90, 60], reps)
    made, base = [], c.base
    monkeypatch.setattr(c, "base", lambda *a: made.append(base(*a)) or made[-1])
    which, place = np.repeat([0, 1], [90, 60]), np.append(np.arange(90), np.arange(60))
    score = np.sort(g.integers(0, 25, 150).astype(float))[::-1]
    mixed = g.permutation(150)
    which, place = which[mixed], place[mixed]
    more = resampling.Draws(np.sort(g.integers(0, 150, 300)), g.integers(0, reps, 300))
    got = resampling._range_totals(c, resampling.Run("s", (0, 1)), {"score": score, "class": which, "place": place}, more, np.arange(reps))
    assert max(w.size for w in made) <= 64
    w = np.stack([base(int(k), np.array([p]), np.arange(reps))[0].astype(int) for k, p in zip(which, place)])
    np.add.at(w, (more.row, more.rep), 1)
    assert [(s, tie) for s, tie, *_ in got] == [(score[0], True), (score[score < score[0]][0], False), (score[-1], True)]
    for part, (_, tie, neg, pos, won) in zip([score == score[0], (score < score[0]) & (score > score[-1]), score == score[-1]], got):
        n, p = w[part & (which == 0)], w[part & (which == 1)]
        s, t = score[part & (which == 0)][:, None], score[part & (which == 1)][None]
        assert (neg == n.sum(0)).all() and (pos == p.sum(0)).all()
        assert (won == (0 if tie else (n * (((t > s) + (t == s) / 2) @ p)).sum(0))).all()
    resampling._space.cache_clear()


def test_draws_move_by_span(spark, monkeypatch):
    """Missing draws are shuffled as one row for each replicate and span of places, not one a draw; no draw is lost."""
    monkeypatch.setattr(resampling, "DRAWS", 700)
    df = spark.range(4000).select(F.lit(0).alias("_class"))
    c = resampling._sizes(df, 30)
    more = resampling._more(df, c)
    rows = more.collect()
    assert sum(len(r["_more"]) for r in rows) == 30 * 4000 - c.drawn.sum() and len({r["_place"] for r in rows}) == len(rows)
    plan = more._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan
    w = plain_weights([4000], 2)[0]
    base = c.base(0, np.arange(4000), np.arange(2)).astype(int)
    for r in rows:
        for k in (0, 1):
            base[r["_place"], k] += r["_more"].count(k)
    assert (base == w).all()

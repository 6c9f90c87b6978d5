"""Histogram boosting against a plain version on one machine that grows a leaf at a time from the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import boosting
from sievewright.operators.boosting import Params, Variant


def plain(x, y, edges, p, v, row):
    """Margins of the rows after all trees."""
    bins = np.array([[0 if np.isnan(a) else 1 + int((edges[k] < a).sum()) for k, a in enumerate(r)] for r in x])
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for tree in range(p.rounds):
        g, h = boosting.gradients(margin, y)
        seen = boosting.sampled(row, v.seed, tree, p.row_share)
        leaves = [seen.nonzero()[0]]
        every = [np.arange(len(y))]
        depth = [0]
        score = lambda r: (g[r].sum() / boosting.UNIT) ** 2 / (h[r].sum() / boosting.UNIT + p.l2)  # noqa: B023, E731

        def best(k):
            out = (0.0, -1, 0)
            if depth[k] < p.depth:
                r = leaves[k]
                for f in boosting.allowed(v, tree, p.feature_share):
                    for b in range(p.bins + 1):
                        a, c = r[bins[r, f] <= b], r[bins[r, f] > b]
                        if min(len(a), len(c)) >= p.least_rows and min(h[a].sum(), h[c].sum()) >= p.least_hessian * boosting.UNIT:
                            gain = score(a) + score(c) - score(r)
                            if gain > out[0] + 1e-12:
                                out = (gain, f, b)
            return out

        gains = [best(0)]
        while len(leaves) < p.leaves and max(x[0] for x in gains) > 0:
            k = int(np.argmax([x[0] for x in gains]))
            _, f, b = gains[k]
            for part in (leaves, every):
                r = part[k]
                part[k] = r[bins[r, f] <= b]
                part.append(r[bins[r, f] > b])
            depth[k] += 1
            depth.append(depth[k])
            gains[k] = best(k)
            gains.append(best(len(leaves) - 1))
        for r, to in zip(leaves, every):
            margin[to] += -(g[r].sum() / boosting.UNIT) / (h[r].sum() / boosting.UNIT + p.l2) * p.rate
    return margin


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(400, 3)).round(2)
    x[::11, 1] = np.nan
    y = ((x[:, 0] + np.nan_to_num(x[:, 1]) * x[:, 2] + g.normal(size=400) / 2) > 0).astype(float)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)
    hashed = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    return df, x, y, np.array([hashed[i] & 0xFFFFFFFF for i in range(400)])


@pytest.mark.parametrize("p", [Params(rounds=10, leaves=5, depth=3, bins=12, least_rows=5), Params(rounds=4, leaves=9, depth=6, bins=20, least_rows=3, row_share=0.7, feature_share=0.7, rate=0.3)])
def test_equals_a_plain_version_for_all_models_at_once(spark, data, p):
    df, x, y, row = data
    variants = [Variant((0, 1, 2), 1), Variant((0, 2), 1), Variant((1, 2), 5)]
    fitted = boosting.fit(df, F.col("y"), ["a", "b", "c"], ["id"], p, variants)
    got = {r["id"]: [r[f"score{k}"] for k in range(3)] for r in boosting.scored(df, fitted).collect()}
    for k, v in enumerate(variants):
        want = 1 / (1 + np.exp(-plain(x, y, fitted[0].edges, p, v, row)))
        assert np.allclose([got[i][k] for i in range(400)], want, atol=1e-9)
        assert not {f for t in fitted[k].trees for f in t.feature} - {-1, *v.features}
        # Fitted alone, a model is the same.
        alone = boosting.fit(df, F.col("y"), ["a", "b", "c"], ["id"], p, [v])[0]
        assert [t.value for t in alone.trees] == [t.value for t in fitted[k].trees]


def test_contributions_add_up(spark, data):
    df = data[0]
    model = boosting.fit(df, F.col("y"), ["a", "b", "c"], ["id"], Params(rounds=3, leaves=4, bins=10))[0]
    for r in boosting.contributions(df, model).collect():
        assert sum(r["contributions"]) + r["base"] == pytest.approx(r["margin"])


def test_ablation_is_a_refit(spark, data):
    df, p = data[0], Params(rounds=4, leaves=4, bins=10)
    held = F.col("id") % 4 == 0
    got = {(r["dropped"], r["seed"]): r for r in boosting.ablation(df, F.col("y"), ["a", "b", "c"], ["id"], {"a": ["a"], "bc": ["b", "c"]}, [1, 2], held, p).collect()}
    assert len(got) == 6 and got["", 1]["difference"] == 0 and got["a", 1]["difference"] < 0
    alone = boosting.scored(df.filter(held), boosting.fit(df.filter(~held), F.col("y"), ["a", "b", "c"], ["id"], p, [Variant((0,), 2)]))
    rows = [(r["score"], r["y"]) for r in alone.collect()]
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert got["bc", 2]["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_odd_tables(spark):
    schema = "id long, a double, y double"
    for rows in ([], [(1, None, 1.0)], [(1, 1.0, 1.0), (2, float("nan"), 0.0), (3, 5.0, None), (4, 2.0, 7.0)]):
        df = spark.createDataFrame(rows, schema)
        fitted = boosting.fit(df, F.col("y"), ["a"], ["id"], Params(rounds=2, least_rows=1))
        assert boosting.scored(df, fitted).count() == len(rows)


@pytest.mark.parametrize("p", [Params(rounds=10, leaves=6, depth=3, bins=12, least_rows=5), Params(rounds=10, leaves=6, depth=3, bins=12, least_rows=5, row_share=0.7, feature_share=0.7)])
def test_equal_rows_are_one(spark, monkeypatch, p):
    """Passes over rows of few values don't see more rows than these have combinations, and trees are those of all rows."""
    g = np.random.default_rng(8)
    x = g.integers(0, 4, size=(1500, 2)).astype(float)
    y = (g.random(1500) < 0.2 + 0.15 * x[:, 0] - 0.04 * x[:, 1]).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, y double").repartition(3)
    hashed = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    passed, histograms = [], boosting._histograms

    def counting(rows, *others):
        passed.append(rows.count())
        return histograms(rows, *others)

    monkeypatch.setattr(boosting, "_histograms", counting)
    variants = [Variant((0, 1), 1), Variant((0, 1), 2), Variant((1,), 1)]
    fitted = boosting.fit(df, F.col("y"), ["a", "b"], ["id"], p, variants)
    assert max(passed) <= 32
    got = {r["id"]: [r[f"score{k}"] for k in range(3)] for r in boosting.scored(df, fitted).collect()}
    row = np.array([hashed[i] & 0xFFFFFFFF for i in range(1500)])
    for k, v in enumerate(variants):
        assert np.allclose([got[i][k] for i in range(1500)], 1 / (1 + np.exp(-plain(x, y, fitted[0].edges, p, v, row))), atol=1e-9)
    monkeypatch.setattr(boosting, "FEWER", 1_000_000)
    apart = boosting.fit(df, F.col("y"), ["a", "b"], ["id"], p, variants)
    assert max(passed) == 1500 and [m.to_json() for m in apart] == [m.to_json() for m in fitted]

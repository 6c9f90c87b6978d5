"""Statistics against plain formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import drift, evaluation, resampling


def test_wilson_edges(spark):
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in spark.createDataFrame([(0, 2999), (7, 7), (50, 100), (0, 0)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()]
    assert got[0][0] == 0 and got[0][1] == pytest.approx(0.00128, abs=1e-4) and got[1][1] == 1 and got[2] == (pytest.approx(0.4038, abs=1e-3), pytest.approx(0.5962, abs=1e-3)) and got[3] == (0, 1)


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 20, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y)], "s int, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluation.roc_auc(df, "s", F.col("y") == 1).first()["auc"] == pytest.approx(want)
    cut = np.sort(neg)[min(len(neg) - 1, int(len(neg) * (1 - 0.1)))]
    assert evaluation.threshold_for_fpr(df, "s", F.col("y") == 0, 0.1).first()[0] == cut


def test_exact_tests():
    assert evaluation.sign_flip_p([1.0, 1.0, 1.0]) == pytest.approx(0.25)


def test_mcnemar_p(spark):
    r = spark.createDataFrame([(0, 0), (5, 10), (0, 4)], "k long, n long").select(evaluation.exact_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    assert [x["p"] for x in r] == [1.0, 1.0, pytest.approx(2 / 16)]


def test_bootstrap_brackets_the_rate(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "i int, f boolean")
    r = resampling.bootstrap_rate(df, "i", F.col("f"), 60).first()
    assert r["low"] < r["rate"] < r["high"] and r["rate"] == 0.25


def test_psi_of_a_point_mass_and_of_itself(spark):
    rng = np.random.default_rng(0)
    a = [(True, 0.0)] * 900 + [(True, float(x)) for x in rng.exponential(1, 100)]
    b = [(False, 0.0)] * 700 + [(False, float(x)) for x in rng.exponential(3, 300)]
    v = spark.createDataFrame([("f", *r) for r in a + b] + [("g", x, y) for x in (True, False) for _, y in a], "feature string, ref boolean, value double")
    got = {r["feature"]: r["psi"] for r in drift.psi(v, F.col("ref"), drift.psi_bins(v.filter("ref"))).collect()}
    assert got["f"] > 0.1 and got["g"] == pytest.approx(0, abs=1e-12)


def test_alignment_maps_ranks(spark):
    t = spark.createDataFrame([(i, "a", float(i)) for i in range(10)], "k int, g string, x double")
    r = spark.createDataFrame([(i, "a", float(i * 100)) for i in range(20)], "k int, g string, x double")
    got = [x["aligned"] for x in drift.aligned(t, r, "x", ["g"], "k").orderBy("k").collect()]
    ref = np.array([i * 100.0 for i in range(20)])
    assert got == [float(ref[max(1, math.ceil((i + 0.5) / 10 * 20)) - 1]) for i in range(10)]


def test_fisher_equals_all_tables(spark):
    rows = [(3, 1, 1, 3), (0, 0, 0, 0), (10, 2, 3, 15), (0, 5, 5, 0), (7, 0, 0, 0), (1, 9, 11, 3)] + [(a, 6 - a, 9 - a, 5 + a) for a in range(7)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    for r in df.select("*", evaluation.fisher_exact(*map(F.col, "abcd")).alias("p")).collect():
        a, b, c, d = (r[x] for x in "abcd")
        n, m, k = a + b + c + d, a + b, a + c
        p = {x: math.comb(m, x) * math.comb(n - m, k - x) / math.comb(n, k) for x in range(max(0, k - n + m), min(m, k) + 1)}
        assert r["p"] == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-9)))
    big = spark.createDataFrame([(10**8, 10**8, 10**8, 10**8), (10**6, 0, 0, 10**6)], "a long, b long, c long, d long").select(evaluation.fisher_exact(*map(F.col, "abcd")).alias("p")).collect()
    assert big[0]["p"] == pytest.approx(1.0) and big[1]["p"] < 1e-12


def test_signed_rank_equals_all_signs(spark):
    groups = {"a": [1.0, 2, 3, 4, 5], "b": [1.0, -1, 2, 2, -3, 0, 0.5], "c": [0.0, 0], "d": [-4.0], "e": [float((-1) ** i * (i % 5) + 1) for i in range(14)]}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None)], "g string, v double")
    got = {r["g"]: r for r in evaluation.signed_rank(df, F.col("v"), ["g"]).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    for g, r in got.items():
        x = np.array([v for v in groups[g] if v])
        size = np.abs(x)
        ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        signs = np.array([[(k >> i) & 1 for i in range(len(x))] for k in range(1 << len(x))])
        sums, won = signs @ ranks, ranks[x > 0].sum()
        assert (r["n"], r["w_plus"]) == (len(x), won)
        assert r["p"] == pytest.approx((np.abs(sums - ranks.sum() / 2) >= abs(won - ranks.sum() / 2) - 1e-9).mean())


def test_signed_rank_of_many(spark):
    df = spark.range(2000).select(((F.col("id") * 7919 % 2000) - 950).cast("double").alias("v"))
    p = evaluation.signed_rank(df, F.col("v")).first()["p"]
    exact = evaluation.EXACT
    evaluation.EXACT = 5000
    try:
        assert evaluation.signed_rank(df, F.col("v")).first()["p"] == pytest.approx(p, rel=0.02)
    finally:
        evaluation.EXACT = exact


def test_bins_meet_values_by_broadcast(spark):
    """All rows of one feature must not be sorted in one task to meet the feature's one row of bins."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        v = spark.range(200).select(F.concat(F.lit("f"), F.col("id") % 2).alias("feature"), F.col("id").cast("double").alias("value"), (F.col("id") % 3 == 0).alias("ref"))
        plan = drift.binned(v, drift.psi_bins(v.filter("ref")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in first


def test_replicate_weights_are_taken_once_a_row(spark):
    """Weights hashed once a row give what weights hashed for each row and replicate give, by a plain computation."""
    import hashlib
    from collections import Counter

    rows = spark.range(300).select("id", (F.col("id") % 3 == 0).alias("ref"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    v = drift.long_form(rows.withColumn("w", drift.replicate_weights(F.col("id"), 2)), ["a", "b"], ["id", "ref", "w"])
    bins = drift.psi_bins(v.filter("ref"))
    got = {(r["rep"], r["feature"]): r["psi"] for r in drift.resampled_psi(v, "id", "ref", bins, 2, weights="w").collect()}

    def weight(key, rep):
        u, total, term, out = int(hashlib.md5(f"{key}:{rep}".encode()).hexdigest()[:8], 16) / 2**32, 0.0, math.exp(-1), 0
        for k in range(8):
            total += term / math.factorial(k)
            out += u >= total
        return out

    for rep in range(2):
        for name, m in (("a", 7), ("b", 5)):
            p, q = Counter(), Counter()
            for i in range(300):
                (p if i % 3 == 0 else q)[i % m] += weight(i, rep)
            share = lambda c, k: max(c[k] / sum(c.values()), 1e-4)
            assert got[rep, name] == pytest.approx(sum((share(q, k) - share(p, k)) * math.log(share(q, k) / share(p, k)) for k in range(m)))

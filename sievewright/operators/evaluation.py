"""Model evaluation as DataFrame queries: ROC, thresholds, confusion, intervals, paired tests, bootstrap.

A curve first counts both classes by distinct score, a map-side combined aggregation; only that table is ordered, in slices of the
score's range (``ranking.below``). ``by`` columns give one curve per group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import below

Z = 1.959963984540054


def curve(df: DataFrame, score: str, positive: Column, by: list[str] = [], weight: Column | None = None) -> DataFrame:  # noqa: B006
    """by, score, pos, neg (weight of the rows at the score; 1 a row by default), tp, fp (at the score or above), all_pos, all_neg."""
    w = F.lit(1).cast("long") if weight is None else weight
    sum_if = lambda c: F.sum(F.when(c, w).otherwise(F.lit(0)))
    at = df.groupBy(*by, F.col(score).alias("score")).agg(sum_if(positive).alias("pos"), sum_if(~positive).alias("neg"))
    c = below(at, "score", ["pos", "neg"], by)
    return c.select(*by, "score", "pos", "neg", (F.col("all_pos") - F.col("below_pos")).alias("tp"), (F.col("all_neg") - F.col("below_neg")).alias("fp"), "all_pos", "all_neg")


def roc_auc(df: DataFrame, score: str, positive: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, auc, n_pos, n_neg; groups with one class are left out. Ties count half."""
    c = curve(df, score, positive, by).groupBy(*by).agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("won"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"))
    return c.filter("n_pos > 0 AND n_neg > 0").select(*by, (F.col("won") / F.col("n_pos") / F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def tpr_at_fpr(df: DataFrame, score: str, positive: Column, fpr: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The last point of the curve with a false-positive rate of at most ``fpr``: by, tpr, threshold (null before the first point)."""
    c = curve(df, score, positive, by).withColumn("ok", F.col("fp") / F.col("all_neg") <= fpr)
    best = c.groupBy(*by).agg(F.max_by(F.struct("tp", "score"), F.when(F.col("ok"), -F.col("score"))).alias("b"), F.max("all_pos").alias("p"))
    return best.select(*by, (F.coalesce(F.col("b.tp"), F.lit(0)) / F.col("p")).alias("tpr"), F.col("b.score").alias("threshold"))


def average_precision(df: DataFrame, score: str, positive: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    c = curve(df, score, positive, by)
    return c.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))) / F.max("all_pos")).alias("average_precision"))


def threshold_for_fpr(df: DataFrame, score: str, negative: Column, fpr: float) -> DataFrame:
    """One row, threshold: a score strictly above it is flagged; its place among the negatives is floor(n * (1 - fpr)), from 0.

    Counts by distinct score come first, so the ordered table has a row for each score, not for each negative.
    """
    at = df.filter(negative).groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    c = below(at, "score", ["n"])
    place = F.least(F.col("all_n") - 1, F.floor(F.col("all_n") * F.lit(1 - fpr)))
    return c.filter(F.col("below_n") + F.col("n") > place).agg(F.min("score").alias("threshold"))


def confusion(df: DataFrame, flagged: Column, positive: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, tp, fp, fn, tn, precision, recall, f1, fpr; 0 where a denominator is 0."""
    c = df.groupBy(*by).agg(
        F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"), F.count_if(~flagged & positive).alias("fn"), F.count_if(~flagged & ~positive).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 1 without trials, exactly 0 and 1 at the edges."""
    p, z2 = k / n, Z * Z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.when(n == 0, 0.0).when(k == 0, 0.0).otherwise(middle - half)
    high = F.when(n == 0, 1.0).when(k == n, 1.0).otherwise(middle + half)
    return low, high


def rule_of_three(n: Column) -> Column:
    return F.lit(3.0) / n


def discordant(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """only_a, only_b: pairs in which one of two verdicts holds."""
    return df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))


def exact_two_sided(k: Column, n: Column) -> Column:
    """Two-sided binomial(1/2) p of min(k, n - k) or less, 1 at most: the exact McNemar test on n discordant pairs."""
    @F.pandas_udf("double")
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        import numpy as np

        n, k = n.to_numpy(np.int64), k.to_numpy(np.int64)
        k, out = np.minimum(k, n - k), np.ones(len(n))
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(1, n.max(initial=0)) + 1)))])
        # One running sum of the tail for each n that occurs.
        for trials in np.unique(n[n > 0]):
            i = np.arange(trials // 2 + 1)
            tail = np.cumsum(np.exp(logs[trials] - logs[i] - logs[trials - i] - trials * np.log(2)))
            mine = n == trials
            out[mine] = np.minimum(1.0, 2 * tail[k[mine]])
        return pd.Series(out)

    return p(k, n)


def hash_weights(key: Column, rep: Column) -> Column:
    """Poisson(1) weights of a bootstrap, from md5 of key and replicate: the same in every engine and run."""
    # 32 bits in hex compare as their number does, which saves turning every digest into one.
    u = F.substring(F.md5(F.concat_ws(":", key.cast("string"), rep.cast("string"))), 1, 8)
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term / [1, 1, 2, 6, 24, 120, 720, 5040][k]
        steps.append(f"{math.ceil(total * 4294967296.0):08x}")
    out = F.lit(0)
    for s in steps:
        out = out + F.when(u >= s, 1).otherwise(0)
    return out


def total_variation(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Half the summed difference of the shares of each value in the two parts of ``df``."""
    c = df.groupBy(value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    sums = c.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return c.crossJoin(F.broadcast(sums)).agg((F.sum(F.abs(F.col("a") / F.col("sa") - F.col("b") / F.col("sb"))) / 2).alias("total_variation"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks, from counts by distinct value; null if one side does not vary."""

    def ranks(c: str) -> DataFrame:
        at = below(df.groupBy(F.col(c).alias(c)).agg(F.count(F.lit(1)).alias("n")), c, ["n"])
        return at.select(c, (F.col("below_n") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    a, b = f"rank_{x}", f"rank_{y}"
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return df.join(ranks(x), x).join(ranks(y), y).agg(F.when(varies, F.corr(a, b)).alias("spearman"))


def close_agreement(df: DataFrame, a: Column, b: Column, share: float = 0.01) -> DataFrame:
    """exact and close: shares of rows in which two columns are equal, or differ by ``share`` of the larger at most."""
    close = F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))
    return df.agg(F.avg((a == b).cast("int")).alias("exact"), F.avg(close.cast("int")).alias("close"))


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """Area under y over x in steps of one, divided by the steps; one ordered table of a row a period."""
    before = F.lag(y).over(Window.orderBy(x))
    return df.select(((F.col(y) + before) / 2).alias("piece")).agg((F.sum("piece") / F.count("piece")).alias("area"))


def roc_metrics(df: DataFrame, score: str, positive: Column, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, auc, tpr_1 and tpr_01 (true-positive rate at the last point with at most 1 % and 0.1 % false positives), from one curve."""
    c = curve(df, score, positive, by, weight)
    best = lambda fpr: F.max(F.when(F.col("fp") / F.col("all_neg") <= fpr, F.col("tp")))
    m = c.groupBy(*by).agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("won"), best(0.01).alias("t1"), best(0.001).alias("t01"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n"))
    return m.filter("p > 0 AND n > 0").select(*by, (F.col("won") / F.col("p") / F.col("n")).alias("auc"), (F.coalesce("t1", F.lit(0)) / F.col("p")).alias("tpr_1"), (F.coalesce("t01", F.lit(0)) / F.col("p")).alias("tpr_01"))


def sign_flip_p(values: list[float]) -> float:
    """Two-sided p of the mean over all sign patterns of at most 20 values."""
    import numpy as np

    v = np.asarray(values, float)
    if not 0 < len(v) <= 20:
        raise ValueError("between 1 and 20 values")
    signs = 1 - 2 * ((np.arange(1 << len(v))[:, None] >> np.arange(len(v))) & 1)
    return float((np.abs(signs @ v) >= abs(v.sum()) - 1e-12).mean())


#: Standard deviations around the mode beyond which a hypergeometric term counts as nothing.
_REACH = 40
#: Nonzero differences of a group up to which a signed-rank p is exact; above it is the normal one, with corrections for ties and continuity.
EXACT = 500


def _fisher(a: int, b: int, c: int, d: int) -> float:
    import numpy as np

    n, r, k = a + b + c + d, a + b, a + c
    if not n:
        return 1.0
    low, high = max(0, k - (n - r)), min(r, k)
    # Terms by the ratios of neighbours, from a term next to the mode on.
    mode = min(high, max(low, (r + 1) * (k + 1) // (n + 2)))
    reach = int(_REACH * np.sqrt(r * k / n * (n - r) / n * (n - k) / max(1, n - 1))) + 50
    x = np.arange(max(low, min(mode, a) - reach), min(high, max(mode, a) + reach) + 1, dtype=float)
    steps = np.log((r - x[:-1]) * (k - x[:-1])) - np.log((x[:-1] + 1) * (n - r - k + x[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[int(a - x[0])] * (1 + 1e-9)].sum()))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher p of each row's 2 x 2 table of counts: all tables as likely or less likely. Any counts; null with a null one."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in x) else _fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)

    return p(a, b, c, d)


def _signed_rank(ties: list, won: float) -> float:
    """Exact two-sided p of the rank sum of positive differences, from (doubled rank, how many) of the distinct sizes, by convolution."""
    import numpy as np

    shares = np.ones(1)
    for rank, many in ties:
        for _ in range(many):
            wider = np.zeros(len(shares) + rank)
            wider[: len(shares)] += shares / 2
            wider[rank:] += shares / 2
            shares = wider
    middle = (len(shares) - 1) / 2
    far = np.abs(np.arange(len(shares)) - middle) >= abs(won - middle) - 1e-9
    return float(min(1.0, shares[far].sum()))


def signed_rank(df: DataFrame, difference: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, n (nonzero differences), w_plus (rank sum of the positive ones, ties sharing their mean rank), p (two-sided Wilcoxon signed-rank).

    Ranks come from counts by distinct size, in slices. Groups of up to ``EXACT`` differences are tested exactly: only these groups' ties, so many at most, meet in a row.
    """
    d = df.select(*by, difference.cast("double").alias("_d")).filter("_d <> 0")
    at = d.groupBy(*by, F.abs("_d").alias("_size")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_pos"))
    r = below(at, "_size", ["_n"], by).withColumn("_rank", F.col("below__n") + (F.col("_n") + 1) / 2)
    small = F.col("all__n") <= EXACT
    g = r.groupBy(*by).agg(
        F.max("all__n").alias("n"), F.sum(F.col("_rank") * F.col("_pos")).alias("w_plus"), F.sum(F.pow(F.col("_n").cast("double"), F.lit(3)) - F.col("_n")).alias("_t"),
        F.array_sort(F.collect_list(F.when(small, F.struct((2 * F.col("_rank")).cast("int").alias("rank"), F.col("_n").cast("int").alias("n"))))).alias("_ties"),
    )

    @F.pandas_udf("double")
    def exact(ties: pd.Series, won: pd.Series) -> pd.Series:
        return pd.Series([_signed_rank([(t["rank"], t["n"]) for t in x], 2 * w) if len(x) else None for x, w in zip(ties, won, strict=True)], dtype=float)

    n = F.col("n").cast("double")
    middle, spread = n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    z = F.greatest(F.lit(0.0), F.abs(F.col("w_plus") - middle) - 0.5) / spread
    return g.select(*by, "n", "w_plus", F.when(F.size("_ties") > 0, exact("_ties", "w_plus")).otherwise(normal_tail(z)).alias("p"))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal z >= 0: a rational approximation with an error below 1.5e-7."""
    # Coefficients of the approximation of the complementary error function.
    t = 1 / (1 + 0.3275911 * z / 2**0.5)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z / 2)


def monte_carlo_p(df: DataFrame, extreme: Column) -> DataFrame:
    return df.agg(((1 + F.count_if(extreme)) / (1 + F.count(F.lit(1)))).alias("p"))

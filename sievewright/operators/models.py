"""Models over feature tables: standardising, linear and boosted scores, exact attributions, centroids, clustering and agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Centers that ``nearest`` compares every row with, at most.
CENTERS = 10_000


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mu and sigma (population, 1 for a constant column) as arrays, in one aggregation."""
    sd = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return df.agg(F.array(*map(F.avg, columns)).alias("mu"), F.array(*map(sd, columns)).alias("sigma"))


def standardized(df: DataFrame, columns: list[str], fitted: DataFrame) -> DataFrame:
    """``df`` with z (array). ``fitted`` is the one row of ``moments``."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    m = df.crossJoin(F.broadcast(fitted))
    return m.withColumn("z", F.zip_with(F.zip_with(x, "mu", lambda a, b: a - b), "sigma", lambda a, b: a / b)).drop("mu", "sigma")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(35.0)), F.lit(-35.0))))


def linear_score(z: Column, weights: list[float], bias: float) -> Column:
    w = F.array(*map(F.lit, weights))
    return sigmoid(F.aggregate(F.zip_with(z, w, lambda a, b: a * b), F.lit(float(bias)), lambda a, x: a + x))


def attributions(names: list[str], contributions: Column, top: int) -> Column:
    """array<struct<feature, contribution>>: the ``top`` largest by size, zeros left out, ties in feature order."""
    n = F.array(*map(F.lit, names))
    pairs = F.zip_with(F.arrays_zip(n.alias("feature"), F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("i")), contributions, lambda f, c: F.struct((-F.abs(c)).alias("k"), f["i"].alias("i"), f["feature"].alias("feature"), c.alias("contribution")))
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["k"] != 0)), 1, top)
    return F.transform(best, lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution")))


def linear_attributions(z: Column, names: list[str], weights: list[float], top: int) -> Column:
    return attributions(names, F.zip_with(z, F.array(*map(F.lit, weights)), lambda a, b: a * b), top)


def centroids(df: DataFrame, vector: str, group: str, most: int | None = None) -> DataFrame:
    """group, centroid (array): means by position; the ``most`` frequent groups if given."""
    p = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    c = p.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))
    return (c.orderBy(F.desc("n"), group).limit(most) if most else c).select(group, "centroid")


def nearest(df: DataFrame, vector: str, centers: DataFrame, group: str) -> DataFrame:
    """``df`` with nearest (group) and distance (squared); ties go to the first group. The centers are one broadcast array: more than ``CENTERS`` are an error."""
    few = F.when(F.count(F.lit(1)) > CENTERS, F.raise_error(F.lit(f"more than {CENTERS} centers")).cast("boolean"))
    every = centers.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "centroid"))).alias("_all"), few.alias("_few")).filter("_few IS NULL").select("_all")
    far = lambda c: F.aggregate(F.zip_with(F.col(vector), c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    d = df.crossJoin(F.broadcast(every)).withColumn("_best", F.array_min(F.transform("_all", lambda c: F.struct(far(c).alias("d"), c["g"].alias("g")))))
    return d.withColumn("nearest", F.col("_best.g")).withColumn("distance", F.col("_best.d")).drop("_all", "_best")


def agreement(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: ari, nmi, homogeneity, completeness, purity. From the contingency table, a count by (label, cluster)."""
    n = df.groupBy(label, cluster).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    plogp = lambda c: F.sum(c * F.log(c))
    cells = n.agg(pairs(F.col("n")).alias("p"), plogp(F.col("n")).alias("h"), F.sum("n").alias("N"))
    rows = n.groupBy(label).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("pa"), plogp(F.col("n")).alias("ha"))
    cols = n.groupBy(cluster).agg(F.sum("n").alias("n"), F.max("n").alias("m")).agg(pairs(F.col("n")).alias("pb"), plogp(F.col("n")).alias("hb"), F.sum("m").alias("pure"))
    t = cells.crossJoin(rows).crossJoin(cols)
    N = F.col("N")
    ha, hb, mi = F.log(N) - F.col("ha") / N, F.log(N) - F.col("hb") / N, F.log(N) + (F.col("h") - F.col("ha") - F.col("hb")) / N
    expected = F.col("pa") * F.col("pb") / (N * (N - 1) / 2)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return t.select(
        ratio(F.col("p") - expected, (F.col("pa") + F.col("pb")) / 2 - expected).alias("ari"), ratio(mi, (ha + hb) / 2).alias("nmi"),
        ratio(mi, ha).alias("homogeneity"), ratio(mi, hb).alias("completeness"), (F.col("pure") / N).alias("purity"),
    )


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def fit_logistic(df: DataFrame, label: str, l2: float = 0.01):
    return LogisticRegression(labelCol=label, regParam=l2, elasticNetParam=0.0).fit(df)


def fit_boosted(df: DataFrame, label: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 0) -> GBTClassificationModel:
    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed).fit(df)


def boosted_score(df: DataFrame, model: GBTClassificationModel) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def tree_table(model: GBTClassificationModel) -> list[dict[str, np.ndarray]]:
    """The model's trees as flat arrays (feature, cut, left, right, value, cover), by walking its nodes on the driver: size of the model, not of the data."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees):
        rows: list[list[float]] = []

        def walk(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, -1, -1, node.prediction() * weight, float(node.impurityStats().count())])
            if node.numDescendants():
                split = node.split()
                rows[at][0], rows[at][1] = split.featureIndex(), split.threshold()
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        a = np.array(rows)
        out.append({"feature": a[:, 0].astype(int), "cut": a[:, 1], "left": a[:, 2].astype(int), "right": a[:, 3].astype(int), "value": a[:, 4], "cover": a[:, 5]})
    return out


def tree_contributions(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact Shapley values of the path-dependent expectation of a sum of trees: (rows x features), and the expected sum.

    A leaf's value is reached with probability 1 or 0 for features in the coalition, by covers else. Features on its path (few) form
    a product game whose Shapley weights follow from elementary symmetric sums.
    """
    from math import factorial

    rows, m = x.shape
    phi, base = np.zeros((rows, m)), 0.0
    for t in trees:
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = t["feature"][node]
            if f >= 0:
                go = x[:, f] <= t["cut"][node]
                for child, passes in ((t["left"][node], go), (t["right"][node], ~go)):
                    share = t["cover"][child] / t["cover"][node]
                    have = path.get(f, (np.ones(rows, bool), 1.0))
                    stack.append((child, path | {f: (have[0] & passes, have[1] * share)}))
                continue
            value, names, k = t["value"][node], list(path), len(path)
            one = [path[n][0].astype(float) for n in names]
            zero = [path[n][1] for n in names]
            base += value * float(np.prod(zero))
            for i in range(k):
                # Polynomial over coalition size of the product of the others' factors.
                poly = [np.ones(rows)]
                for j in range(k):
                    if j != i:
                        poly = [(poly[s] * zero[j] if s < len(poly) else 0) + (poly[s - 1] * one[j] if s else 0) for s in range(len(poly) + 1)]
                weight = sum(factorial(s) * factorial(k - 1 - s) / factorial(k) * p for s, p in enumerate(poly))
                phi[:, names[i]] += value * (one[i] - zero[i]) * weight
    return phi, base


def boosted_contributions(df: DataFrame, model: GBTClassificationModel, features: str = "features") -> DataFrame:
    """``df`` with contributions (array, log-odds / 2 as the model's margin) and base; they add up to the margin."""
    trees = tree_table(model)

    @F.pandas_udf("struct<contributions: array<double>, base: double, margin: double>")
    def kernel(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))
        phi, base = tree_contributions(trees, x)
        margin = np.zeros(len(x))
        for t in trees:
            at = np.zeros(len(x), int)
            while (t["feature"][at] >= 0).any():
                f = t["feature"][at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= t["cut"][at]
                at = np.where(f < 0, at, np.where(go, t["left"][at], t["right"][at]))
            margin += t["value"][at]
        return pd.DataFrame({"contributions": phi.tolist(), "base": base, "margin": margin})

    return df.withColumn("_k", kernel(vector_to_array(features))).select(*df.columns, "_k.*")


def clustered(df: DataFrame, vector: str, k: int, dims: int | None = None, seed: int = 0) -> DataFrame:
    """``df`` with cluster: k-means on sign * log1p of the vector, standardised and reduced to ``dims`` components."""
    x = df.withColumn("_x", array_to_vector(F.transform(vector, lambda v: F.signum(v) * F.log1p(F.abs(v))).cast("array<double>")))
    x = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(x).transform(x)
    if dims:
        x = PCA(k=dims, inputCol="_z", outputCol="_p").fit(x).transform(x)
    last = "_p" if dims else "_z"
    return KMeans(k=k, seed=seed, featuresCol=last, predictionCol="cluster").fit(x).transform(x).drop("_x", "_z", "_p")


def noise_share(df: DataFrame, cluster: str) -> DataFrame:
    return df.agg(F.avg((F.col(cluster) < 0).cast("int")).alias("noise"))


def with_noise(df: DataFrame, key: str, cluster: str, singletons: bool) -> DataFrame:
    """``df`` with noise (negative clusters) as clusters of one row each, or as one cluster (-1)."""
    own = -2 - F.abs(F.xxhash64(key)) % (1 << 60) if singletons else F.lit(-1)
    return df.withColumn(cluster, F.when(F.col(cluster) < 0, own.cast("long")).otherwise(F.col(cluster).cast("long")))


def mean_sizes(df: DataFrame, contributions: str, names: list[str], top: int = 20) -> DataFrame:
    """feature, mean_size, place: mean absolute contribution of each feature over all rows, the largest ``top``."""
    m = df.agg(*(F.avg(F.abs(F.col(contributions)[i])).alias(f"c{i}") for i in range(len(names)))).select(F.posexplode(F.array(*(f"c{i}" for i in range(len(names))))).alias("i", "mean_size"))
    m = m.select(F.get(F.array(*map(F.lit, names)), F.col("i")).alias("feature"), "mean_size").orderBy(F.desc("mean_size"), "feature").limit(top)
    return m.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_size"), "feature")))


def save_boosted(model: GBTClassificationModel, columns: list[str], path: str, thresholds: dict[str, float] = {}) -> None:  # noqa: B006
    """The model with the names of its features, in order, and its thresholds beside it (one JSON row)."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(columns, thresholds)], "columns array<string>, thresholds map<string,double>").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load_boosted(path: str, columns: list[str]) -> tuple[GBTClassificationModel, dict[str, float]]:
    """The saved model and its thresholds; an error if it was fitted to other features or another order of them."""
    from pyspark.sql import SparkSession

    row = SparkSession.getActiveSession().read.schema("columns array<string>, thresholds map<string,double>").json(f"{path}/features").first()
    if list(row["columns"]) != list(columns):
        raise ValueError("the model was fitted to other features")
    return GBTClassificationModel.load(f"{path}/model"), dict(row["thresholds"] or {})


def without(columns: list[str], dropped: list[str]) -> list[str]:
    """Columns of an ablation: fit again on these."""
    return [c for c in columns if c not in set(dropped)]

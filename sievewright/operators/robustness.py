"""Parity of extractions, perturbed records and ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import md5_number, numbered


def parity(a: DataFrame, b: DataFrame, key: str, columns: list[str], share: float = 0.01) -> DataFrame:
    """feature, n, exact, close: agreement of two extractions of the same files, joined by digest."""
    wide = lambda df, side: df.select(key, *(F.col(c).cast("double").alias(f"{side}_{c}") for c in columns))
    j = wide(a, "a").join(wide(b, "b"), key)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns))).alias("p")
    p = j.select(pairs).select("p.*")
    close = F.abs(F.col("a") - F.col("b")) <= share * F.greatest(F.abs("a"), F.abs("b"))
    return p.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("exact"), F.avg(close.cast("int")).alias("close"))


def with_donors(targets: DataFrame, donors: DataFrame, key: str, draw: int) -> DataFrame:
    """``targets`` with donor (struct of the donor's columns): a fixed donor for each key and draw, by md5 of both.

    ``donors`` is numbered once; targets meet their number by an equi join. The donor table is a bounded pool.
    """
    d = donors.select(F.struct("*").alias("donor"), F.col(key).alias("_k"), md5_number(F.col(key)).alias("_d"))
    pool = numbered(d, "_d", [], [F.col("_d"), F.md5(F.col("_k").cast("string")), F.col("_k")])
    pool = pool.select("donor", (F.col("place") - 1).alias("_n"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(draw))), 1, 8), 16, 10).cast("long")
    return targets.withColumn("_n", pick % donors.agg(F.count(F.lit(1))).scalar()).join(pool, "_n").drop("_n")


def merged_counts(own: Column, donor: Column) -> Column:
    """Position by position sum of two count arrays: bytes or strings appended to a file."""
    return F.zip_with(own, donor, lambda a, b: a + b)


def merged_imports(own: Column, donor: Column) -> Column:
    return F.array_union(own, donor)


def deleted(values: Column, contributions: Column, medians: Column, k: int) -> Column:
    """``values`` with the k largest contributions' positions replaced by the benign medians."""
    order = F.array_sort(F.transform(contributions, lambda c, i: F.struct((-F.abs(c)).alias("c"), i.alias("i"))))
    top = F.transform(F.slice(order, 1, k), lambda s: s["i"])
    return F.transform(values, lambda v, i: F.when(F.array_contains(top, i), F.element_at(medians, i + 1)).otherwise(v))


def without_most_common(df: DataFrame, group: str) -> DataFrame:
    """Rows outside the most frequent group (ties by name): the exclusion control."""
    most = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(1)
    return df.join(F.broadcast(most.select(group)), group, "left_anti")


def frequent_rule(group: DataFrame, benign: DataFrame, most: int = 8, filtered: bool = False) -> DataFrame:
    """Baseline rule: a family's most frequent atoms, all required; filtered ones must not occur in a benign sample."""
    c = group.groupBy("atom").agg(F.countDistinct("sample").alias("support"))
    if filtered:
        c = c.join(benign.select("atom").distinct(), "atom", "left_anti")
    return c.orderBy(F.desc("support"), "atom").limit(most)


def summary(validated: DataFrame) -> DataFrame:
    """One row over rules: mean coverage with abstention as 0 and among those given, mean specificity, all false positives."""
    return validated.agg(
        F.avg(F.coalesce("coverage", F.lit(0.0))).alias("coverage_all"), F.avg("coverage").alias("coverage_given"), F.avg("specificity").alias("specificity"),
        F.sum("benign_hits").alias("false_positives"), F.avg("cross_hits").alias("cross_hits"),
    )

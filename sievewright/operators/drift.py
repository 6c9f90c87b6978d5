"""Drift statistics: population stability, ranks, alignment, matched draws, shift patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import hash_weights
from .ranking import below, md5_number, numbered

FLOOR = 1e-4


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, column): keep, feature, value."""
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keep, columns, "feature", "value")


def quantiles(counts: DataFrame, at: list[float], by: str) -> DataFrame:
    """by, q, quantile: exact quantiles (linear between neighbours) of a table of counts (by, value, n), by ranks instead of one sorted group."""
    c = below(counts, "value", ["n"], [by]).withColumn("q", F.explode(F.array(*map(F.lit, at))))
    place = F.col("q") * (F.col("all_n") - 1)
    holds = lambda i: (F.col("below_n") <= i) & (i < F.col("below_n") + F.col("n"))
    low, high = F.floor(place), F.ceil(place)
    c = c.select(by, "q", (place - low).alias("part"), F.when(holds(low), F.col("value")).alias("l"), F.when(holds(high), F.col("value")).alias("h")).filter("l IS NOT NULL OR h IS NOT NULL")
    c = c.groupBy(by, "q").agg(F.max("l").alias("l"), F.max("h").alias("h"), F.max("part").alias("part"))
    return c.select(by, "q", F.when(F.col("l") == F.col("h"), F.col("l")).otherwise((1 - F.col("part")) * F.col("l") + F.col("part") * F.col("h")).alias("quantile"))


def legacy_bins(values: DataFrame, others: DataFrame, bins: int = 10, by: str = "feature") -> DataFrame:
    """The older binning, kept for comparison: by -> atoms and edges as ``psi_bins`` has them.

    With ``bins`` reference values or fewer, and under 64 in both parts together, each value is a bin; else the distinct interior deciles of all values cut.
    """
    at = values.groupBy(by, "value").agg(F.count(F.lit(1)).alias("n"))
    few = at.groupBy(by).agg(F.count(F.lit(1)).alias("own"))
    seen = at.select(by, "value").union(others.select(by, "value")).distinct().join(F.broadcast(few.filter(F.col("own") <= bins)), by)
    atoms = seen.join(F.broadcast(seen.groupBy(by).agg(F.count(F.lit(1)).alias("both")).filter("both < 64")), by).groupBy(by).agg(F.array_sort(F.collect_list("value")).alias("atoms"))
    edges = quantiles(at, [i / bins for i in range(bins + 1)], by).groupBy(by).agg(F.array_sort(F.collect_set("quantile")).alias("e")).select(by, F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0))).alias("edges"))
    none = F.array().cast("array<double>")
    j = edges.join(atoms, by, "left")
    return j.select(by, F.coalesce("atoms", none).alias("atoms"), F.when(F.col("atoms").isNotNull(), none).otherwise(F.col("edges")).alias("edges"))


def psi_bins(values: DataFrame, bins: int = 10, by: str = "feature") -> DataFrame:
    """by -> atoms (values with a share of 1/bins at least; all values if there are 2 * bins or fewer) and edges of the rest.

    ``values``: by, value; the reference part. Edges are the distinct interior quantiles of what isn't an atom, from counts by value.
    """
    at = values.groupBy(by, "value").agg(F.count(F.lit(1)).alias("n"))
    whole = at.groupBy(by).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("distinct"))
    at = at.join(F.broadcast(whole), by).withColumn("atom", (F.col("n") >= F.col("all") / bins) | (F.col("distinct") <= 2 * bins))
    atoms = at.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("atom"), F.col("value")))).alias("atoms"))
    edges = quantiles(at.filter("NOT atom").select(by, "value", "n"), [i / bins for i in range(1, bins)], by).groupBy(by).agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
    return atoms.join(edges, by, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))


def binned(values: DataFrame, bins: DataFrame, by: str = "feature") -> DataFrame:
    """``values`` with bin: 'a<i>' for the i-th atom, else 'i<j>', j edges being at or below the value.

    ``bins`` has one short row a feature and is broadcast: joined by feature, all rows of one would be sorted in one task.
    """
    atom = F.array_position("atoms", F.col("value"))
    interval = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return values.join(F.broadcast(bins), by).withColumn("bin", F.when(atom > 0, F.concat(F.lit("a"), atom)).otherwise(F.concat(F.lit("i"), interval))).drop("atoms", "edges")


def psi(values: DataFrame, reference: Column, bins: DataFrame, by: str = "feature", floor: float = FLOOR) -> DataFrame:
    """by, psi: sum of (q - p) ln(q / p) over all bins, empty ones at ``floor``. Rows are combined before the shuffle to counts by bin."""
    c = binned(values, bins, by).groupBy(by, "bin").agg(F.count_if(reference).alias("a"), F.count_if(~reference).alias("b"))
    return _psi_of(c, _every_bin(bins, by), [by], floor)


def psi_by_floor(values: DataFrame, reference: Column, bins: DataFrame, floors: list[float], by: str = "feature") -> DataFrame:
    """by, floor, psi at several floors, from one count by bin."""
    c = binned(values, bins, by).groupBy(by, "bin").agg(F.count_if(reference).alias("a"), F.count_if(~reference).alias("b"))
    every = _every_bin(bins, by).withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    return _psi_of(c.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))), every, [by, "floor"], F.col("floor"))


def _every_bin(bins: DataFrame, by: str) -> DataFrame:
    names = F.concat(F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: F.concat(F.lit("i"), i)), F.transform("atoms", lambda _, i: F.concat(F.lit("a"), i + 1)))
    return bins.select(by, F.explode(names).alias("bin"))


def _psi_of(counts: DataFrame, every: DataFrame, by: list[str], floor: float | Column) -> DataFrame:
    c = every.join(counts, [*by, "bin"], "left").na.fill(0, ["a", "b"])
    w = Window.partitionBy(*by)
    p, q = (F.greatest(F.col(x) / F.sum(x).over(w), floor if isinstance(floor, Column) else F.lit(floor)) for x in "ab")
    return c.select(*by, ((q - p) * F.log(q / p)).alias("d")).groupBy(*by).agg(F.sum("d").alias("psi"))


def drift_rank(psi_by_part: DataFrame, weight: Column, k: int) -> DataFrame:
    """feature, part, psi rows -> feature, worst psi, weight, rank by worst * weight (ties by name), in_top."""
    w = psi_by_part.groupBy("feature").agg(F.max("psi").alias("psi")).withColumn("weighted", F.col("psi") * weight)
    return w.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weighted"), "feature"))).withColumn("in_top", F.col("rank") <= k)


def rank_intervals(draws: DataFrame, k: int) -> DataFrame:
    """(rep, feature, psi by class and weight already multiplied: weighted) -> feature, rank_low, rank_high (95 % of replicates) and p_top (share in the top k)."""
    r = draws.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("weighted"), "feature")))
    return r.groupBy("feature").agg(F.percentile("rank", F.lit(0.025)).alias("rank_low"), F.percentile("rank", F.lit(0.975)).alias("rank_high"), F.avg((F.col("rank") <= k).cast("int")).alias("p_top"))


def replicate_weights(key: Column, reps: int) -> Column:
    """array<int>: a row's Poisson weights in all replicates. Taken before ``long_form`` they are hashed once a row, not once a row and column."""
    return F.array(*(hash_weights(key, F.lit(r)) for r in range(reps)))


def resampled_psi(values: DataFrame, key: str, reference: str, bins: DataFrame, reps: int, by: str = "feature", floor: float = FLOOR, weights: str | None = None) -> DataFrame:
    """rep, by, psi of resampled rows (Poisson weights by hash of ``key``) over fixed bins: rows are combined to weights by bin before the shuffle.

    ``weights`` names a column of ``replicate_weights``, where ``values`` has one. All replicates are added up side by side, so no row is repeated for them.
    """
    w = F.col(weights) if weights else replicate_weights(F.col(key), reps)
    b = binned(values, bins, by).select(by, "bin", F.col(reference).alias("ref"), w.alias("w"))
    c = b.groupBy(by, "bin", "ref").agg(*(F.sum(F.get("w", F.lit(r))).alias(f"w{r}") for r in range(reps)))
    c = c.select(by, "bin", "ref", F.posexplode(F.array(*(f"w{r}" for r in range(reps)))).alias("rep", "w"))
    c = c.groupBy("rep", by, "bin").agg(F.sum(F.when(F.col("ref"), F.col("w")).otherwise(0)).alias("a"), F.sum(F.when(F.col("ref"), 0).otherwise(F.col("w"))).alias("b"))
    return _psi_of(c, _every_bin(bins, by).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), ["rep", by], floor)


def shift_pattern(benign: Column, malicious: Column) -> Column:
    """In which class a feature shifts; 0.25 counts as a shift, below 0.1 as stable."""
    b, m = benign >= 0.25, malicious >= 0.25
    return (
        F.when(b & m, "both_classes").when(b & (malicious < 0.1), "benign_only").when(m & (benign < 0.1), "malicious_only").when(F.greatest(benign, malicious) < 0.1, "stable").otherwise("mixed")
    )


def aligned(target: DataFrame, reference: DataFrame, column: str, by: list[str], tie: str) -> DataFrame:
    """``target`` with aligned: the reference value at the target's position (rank - 1/2) / n within its group, by inverted distribution.

    Ties are ordered by ``tie``. Both sides are ranked within their groups and meet in one equi join on the reference rank.
    """
    order = [F.col(column), F.col(tie)]
    t = numbered(target, column, by, order).withColumnsRenamed({"place": "_r", "all": "_n"})
    r = numbered(reference.select(*by, column, tie), column, by, order).select(*by, F.col(column).alias("aligned"), F.col("place").alias("_at"), F.col("all").alias("_m"))
    sizes = r.groupBy(*by).agg(F.max("_m").alias("_m"))
    place = F.greatest(F.lit(1), F.ceil((F.col("_r") - 0.5) / F.col("_n") * F.col("_m")))
    return t.join(sizes, by).withColumn("_at", place.cast("long")).join(r.drop("_m"), [*by, "_at"]).drop("_r", "_n", "_m", "_at")


def matched_draw(pool: DataFrame, wanted: DataFrame, by: str, key: str) -> DataFrame:
    """As many rows of each group as ``wanted`` (by, n) has, without replacement, in the order of the key's md5."""
    p = pool.withColumn("_d", md5_number(F.col(key)))
    p = numbered(p, "_d", [by], [F.col("_d"), F.md5(F.col(key).cast("string")), F.col(key)])
    return p.join(wanted, by).filter("place <= n").drop("_d", "place", "all", "n")


def zero_share(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    return long_form(df, columns, by).groupBy(*by, "feature").agg(F.avg((F.col("value") == 0).cast("int")).alias("zero_share"))


def top_overlap(ranks: list[DataFrame], k: int) -> DataFrame:
    """Features in the top k of every ranking."""
    return reduce(lambda a, b: a.intersect(b), [r.filter(F.col("rank") <= k).select("feature") for r in ranks])

"""Rule mining and validation over atoms: support, rarity, smallest N, sweep, substrings.

Samples are sets of atoms in exploded form (sample, atom), so that all steps are counts and equi joins on the atom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .substrings import GRAM, absent_strings


def exploded(df: DataFrame, sample: str, atoms: Column, *others: str) -> DataFrame:
    return df.select(F.col(sample).alias("sample"), *others, F.explode(F.array_distinct(atoms)).alias("atom"))


def supported(group: DataFrame, n_group: int | Column, support: float = 0.3) -> DataFrame:
    """atom, n_in: atoms of at least max(1, ceil(support * n)) of the group, written. They are at most a sample's mean number of atoms / support, however many samples there are."""
    n = F.lit(n_group) if isinstance(n_group, int) else n_group
    return written(group.groupBy("atom").agg(F.countDistinct("sample").alias("n_in")).filter(F.col("n_in") >= F.greatest(F.lit(1), F.ceil(support * n))))


def mined(group: DataFrame, benign: DataFrame, n_group: int | Column, n_benign: int | Column, support: float = 0.3, rate: float = 0.002, most: int = 8, order: list[Column] = []) -> DataFrame:  # noqa: B006
    """``rarest`` of the group's atoms with enough support."""
    return rarest(supported(group, n_group, support), benign, n_group, n_benign, rate, most, order)


def among(samples: DataFrame, inside: DataFrame) -> DataFrame:
    """Rows of ``samples`` with an atom of ``inside``. Only they move, since Spark knows how small a written table is."""
    return samples.join(inside.select("atom"), "atom", "left_semi")


def rarest(inside: DataFrame, benign: DataFrame, n_group: int | Column, n_benign: int | Column, rate: float = 0.002, most: int = 8, order: list[Column] = []) -> DataFrame:  # noqa: B006
    """atom, n_in, n_out, place: of atoms (atom, n_in; written) those of at most ``rate`` of the others, the best ``most``.

    Order: share in the group less five times the others' share, then ``order``, then the atom.
    """
    n, m = (F.lit(x) if isinstance(x, int) else x for x in (n_group, n_benign))
    outside = among(benign, inside).groupBy("atom").agg(F.countDistinct("sample").alias("n_out"))
    c = inside.join(outside, "atom", "left").na.fill(0, ["n_out"]).filter(F.col("n_out") / F.greatest(m, F.lit(1)) <= rate)
    worth = F.col("n_in") / n - 5 * F.col("n_out") / F.greatest(m, F.lit(1))
    best = c.orderBy(worth.desc(), *order, F.col("atom")).limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(worth.desc(), *order, F.col("atom"))))


def smallest_n(rule: DataFrame, benign: DataFrame, n_benign: int | Column, fpr: float = 0.0) -> DataFrame:
    """One row, threshold: the least N with a share of at most ``fpr`` of the others having N of the rule's atoms; null if none.

    One pass: hits a sample, then how many samples have N hits or more.
    """
    m = F.lit(n_benign) if isinstance(n_benign, int) else n_benign
    hits = benign.join(F.broadcast(rule.select("atom")), "atom").groupBy("sample").agg(F.countDistinct("atom").alias("hits"))
    have = hits.groupBy("hits").agg(F.count(F.lit(1)).alias("n"))
    steps = rule.agg(F.count(F.lit(1)).alias("size")).select(F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(1), F.col("size").cast("int")))).alias("least"))
    over = steps.join(have, F.col("hits") >= F.col("least"), "left").groupBy("least").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wrong"))
    return over.filter(F.col("wrong") / F.greatest(m, F.lit(1)) <= fpr).agg(F.min("least").cast("long").alias("threshold"))


def mined_by(atoms: DataFrame, support: float = 0.3, rate: float = 0.002, most: int = 8, order: list[Column] = []) -> DataFrame:  # noqa: B006
    """family, atom, n_in, n_out, place: ``mined`` for every family at once. ``atoms``: sample, family (null for benign), atom.

    One count by atom serves all families. A family's atoms with enough support are at most sum of its atoms / support, so its ranking is short.
    """
    counts = atoms.groupBy("family", "atom").agg(F.countDistinct("sample").alias("n"))
    totals = atoms.groupBy("family").agg(F.countDistinct("sample").alias("all"))
    m = F.coalesce(totals.filter("family IS NULL").select("all").scalar(), F.lit(0))
    own = counts.filter("family IS NOT NULL").join(totals, "family").filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(support * F.col("all"))))
    benign = counts.filter("family IS NULL").select("atom", F.col("n").alias("n_out"))
    c = own.withColumnRenamed("n", "n_in").join(benign, "atom", "left").na.fill(0, ["n_out"]).filter(F.col("n_out") / F.greatest(m, F.lit(1)) <= rate)
    worth = F.col("n_in") / F.col("all") - 5 * F.col("n_out") / F.greatest(m, F.lit(1))
    place = F.row_number().over(Window.partitionBy("family").orderBy(worth.desc(), *order, F.col("atom")))
    return c.withColumn("place", place).filter(F.col("place") <= most).select("family", "atom", "n_in", "n_out", "place")


def smallest_n_by(rules: DataFrame, benign: DataFrame, fpr: float = 0.0) -> DataFrame:
    """family, atoms, threshold: for every rule (family, atom) the least N of which at most ``fpr`` of the benign samples have as many; null if none."""
    hits = benign.join(rules.select("family", "atom"), "atom").groupBy("family", "sample").agg(F.countDistinct("atom").alias("hits"))
    have = hits.groupBy("family", "hits").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.collect_list(F.struct("hits", "n")).alias("have"))
    sets = rules.groupBy("family").agg(F.array_sort(F.collect_list("atom")).alias("atoms")).join(have, "family", "left").withColumn("have", F.coalesce("have", F.array().cast("array<struct<hits:bigint,n:bigint>>")))
    sets = sets.withColumn("m", F.greatest(benign.agg(F.countDistinct("sample")).scalar(), F.lit(1)))
    wrong = lambda n: F.aggregate(F.filter("have", lambda h: h["hits"] >= n), F.lit(0).cast("long"), lambda a, h: a + h["n"])
    steps = F.filter(F.sequence(F.lit(1), F.size("atoms")), lambda n: wrong(n) / F.col("m") <= fpr)
    return sets.select("family", "atoms", F.array_min(steps).cast("long").alias("threshold"))


def sweep(samples: DataFrame, rule_atoms: DataFrame) -> DataFrame:
    """(rule, sample) that fire. ``samples``: sample, atom; ``rule_atoms``: rule, threshold, atom. One equi join, no rules x samples product.

    The rule table is small and Spark broadcasts it when its measured size allows; else both sides meet by atom.
    """
    hits = samples.join(rule_atoms, "atom").groupBy("rule", "threshold", "sample").agg(F.countDistinct("atom").alias("hits"))
    return hits.filter("hits >= threshold").select("rule", "sample")


def validated(fired: DataFrame, rules: DataFrame, samples: DataFrame) -> DataFrame:
    """rule, benign_hits, benign_total, own_hits, own_total, cross_hits, specificity, coverage (null without a denominator).

    ``rules``: rule, family; ``samples``: sample, family (null for benign).
    """
    f = fired.join(samples, "sample").withColumnRenamed("family", "of").join(rules, "rule")
    hits = f.groupBy("rule").agg(F.count_if(F.col("of").isNull()).alias("benign_hits"), F.count_if(F.col("of") == F.col("family")).alias("own_hits"), F.count_if(F.col("of") != F.col("family")).alias("cross_hits"))
    totals = samples.groupBy("family").agg(F.count(F.lit(1)).alias("own_total"))
    benign = samples.agg(F.count_if(F.col("family").isNull()).alias("benign_total"))
    out = rules.join(hits, "rule", "left").join(totals, "family", "left").crossJoin(F.broadcast(benign)).na.fill(0, ["benign_hits", "own_hits", "cross_hits", "own_total"])
    return out.select(
        "rule", "family", "benign_hits", "benign_total", "own_hits", "own_total", "cross_hits",
        (1 - F.try_divide("benign_hits", "benign_total")).alias("specificity"), F.try_divide("own_hits", "own_total").alias("coverage"),
    )


def candidate_strings(group: DataFrame, benign: DataFrame, names: DataFrame, support: float = 0.6, most: int = 8) -> DataFrame:
    """s, support, place: strings that tell a group from benign texts.

    ``group``: sample, strings (array), header (text in which a string is an artifact of the format); ``benign``: text; ``names``: name, of imported
    functions, which families share and which only fill in if nothing else is left. A string needs ``GRAM`` characters and ``support`` of the samples, and
    no benign text may contain it. Most shared first, then longest, then by text; the best ``most``.
    """
    own = group.select("sample", "header", F.explode(F.array_distinct("strings")).alias("s")).filter((F.length("s") >= GRAM) & (F.instr(F.coalesce("header", F.lit("")), F.col("s")) == 0))
    n = group.agg(F.countDistinct("sample")).scalar()
    shared = own.groupBy("s").agg(F.countDistinct("sample").alias("support")).filter(F.col("support") >= F.greatest(F.lit(1), F.ceil(support * n)))
    c = absent_strings(shared, benign, "text").join(names.select(F.col("name").alias("s"), F.lit(True).alias("api")).distinct(), "s", "left")
    c = c.withColumn("distinctive", F.coalesce(c.agg(F.count_if(F.col("api").isNull())).scalar(), F.lit(0))).filter(F.col("api").isNull() | (F.col("distinctive") == 0))
    order = [F.desc("support"), F.desc(F.length("s")), F.asc("s")]
    best = c.select("s", "support").orderBy(*order).limit(most)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def synthesized(candidates: DataFrame) -> DataFrame:
    """One row, strings in order and threshold (half of them, rounded up); no row without candidates."""
    s = candidates.agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("x")).filter(F.size("x") > 0)
    return s.select(F.transform("x", lambda x: x["s"]).alias("strings"), F.ceil(F.size("x") / 2).cast("int").alias("threshold"))


def filtered_mode(keys: DataFrame, benign: DataFrame, tries: int = 5) -> DataFrame:
    """family, key: the most common of a family's ``tries`` most common keys (sample, family, key) that no benign row (key) has. Empty keys don't count."""
    c = keys.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "key"))).filter((F.col("r") <= tries) & (F.col("key") != ""))
    return c.join(benign.select("key").distinct(), "key", "left_anti").groupBy("family").agg(F.min_by("key", "r").alias("key"))


def without_abstention(rules: DataFrame, fallback: DataFrame) -> DataFrame:
    """family, atoms, threshold of ``rules``, and of ``fallback`` for families that have no rule."""
    return rules.unionByName(fallback.join(rules.select("family"), "family", "left_anti"))


def quoted(s: Column) -> Column:
    """A string as rule text has it: backslash and quote escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

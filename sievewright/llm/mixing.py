"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality weight, with u a fixed hash of its id. Within a source complete passes come
first; what is left of the word budget goes to documents by ascending key, found by prefix sums. A source is cut into
slices of the key's range, sums of slices are added up first, and only then come running sums inside a slice: a source
with a third of all rows spreads over as many tasks as it has slices.

Defined results: null text has size 0; a null source is a source of its own, last in order; size 0 takes 0; rows without doc_id draw by
their text. Rows that share source and doc_id (or text) have the same key and are ordered by size; exact repeats are one after the other: they are counted
first, planned as one row and dealt out again. Tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, meet, packed, passing, row_name, running, table, unpacked

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix by words of all documents.
SHARE = 1.5
#: Passes over a source at most.
MOST = 2
#: Rows of a source in one slice of the key's range at least, about; ten times the root of its rows if that is more.
SLICE_ROWS = 1_000
#: Repeats of a row that one task deals out at a time.
COPIES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0)).cast("long")


def quality_weight(size: Column, symbols: Column) -> Column:
    """Words by words and symbols, symbols counting four times; 0.05 at least."""
    return F.greatest(F.lit(0.05), size / (size + 4 * symbols + 1))


def uniform(key: Column) -> Column:
    """A number in (0, 1) by md5 of a text: the same in every run and engine."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, any others) -> with target: share of all words by weight, none above ``most`` times its source.

    The excess of full sources is reshared by weight until none is above. Sorted by words a unit of weight, the full ones are
    a prefix, so running sums find the level that the others get. One row a source comes in; ranks and sums run over ranges of rows.
    """
    by_name = F.col("source").asc_nulls_last()
    t = running(sources, [by_name], {"rank": F.lit(1)})
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("per_weight", F.col("cap") / F.col("w"))
    t = running(t, [F.col("per_weight").asc(), by_name], {"place": F.lit(1), "caps": F.col("cap"), "ws": F.col("w")})
    size, weight = t.agg(F.sum("source_size").cast("double")).scalar(), t.agg(F.sum("w")).scalar()
    t = t.withColumn("level", (size * share - F.col("caps")) / (weight - F.col("ws")))
    level = t.filter("level <= per_weight").agg(F.min(F.struct("place", "level"))["level"]).scalar()
    t = t.withColumn("target", F.least(F.col("cap"), F.col("w") * F.coalesce(level, F.col("per_weight"))))
    return t.select(*(c for c in sources.columns if c != "source"), "target")


def mixed(docs: DataFrame) -> DataFrame:
    """A table like ``measured`` gives, with source_size, target and taken."""
    d = docs.withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sizes = d.groupBy("src").agg(F.max("source").alias("source"), F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"), (F.sum(F.col("weight") * F.col("copies")) / F.sum("copies")).alias("usual"))
    with passing() as stay:
        targets = cut(source_targets(sizes))
        stay.append(targets)
    d = meet(d, targets, "src", "n")
    d = d.withColumn("key", -F.log(uniform(F.col("draw"))) / F.col("weight"))
    # 1 - exp(-key * usual weight) runs from 0 to 1 with the key, about evenly: slices of the key's range in its order.
    slices = F.ceil(F.col("n") / F.greatest(F.lit(SLICE_ROWS), 10 * F.sqrt("n")))
    d = d.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("usual"))) * slices), slices - 1))
    words = F.col("size") * F.col("copies")
    sums = d.groupBy("src", "slice").agg(F.sum(words).alias("slice_size"))
    before = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    d = d.join(offsets, ["src", "slice"])
    inside = Window.partitionBy("src", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = _apart(d.withColumn("prefix", F.col("offset") + F.coalesce(F.sum(words).over(inside), F.lit(0))))
    prefix = F.col("prefix") + F.col("copy") * F.col("size")
    words = F.floor(F.col("target") + F.lit(0.5))
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - prefix))
    return d.withColumn("taken", (passes * F.col("size") + part).cast("long")).drop("src", "key", "slice", "offset", "n", "usual", "weight", "draw", "prefix", "copies", "copy")


def _apart(d: DataFrame) -> DataFrame:
    """A row for each of ``copies``, with copy (from 0). Rows with very many copies are dealt to several tasks first."""
    each = lambda first: F.explode(F.sequence(first, F.least(F.col("copies"), first + COPIES) - 1))
    few = d.filter(F.col("copies") <= COPIES).withColumn("copy", each(F.lit(0).cast("long")))
    many = d.filter(F.col("copies") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    return few.unionByName(many.repartition("from").withColumn("copy", each(F.col("from"))).drop("from"))


def measured(docs: DataFrame, **others: Column) -> DataFrame:
    """doc_id, source, size, weight, draw, ``others`` and copies, the number of rows that are equal in all of these. What a row draws by is its id, or without one a digest of its text."""
    draw = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    size = docs.select("doc_id", "source", draw.alias("draw"), *(c.alias(k) for k, c in others.items()), word_count(F.col("text")).alias("size"), symbol_count(F.col("text")).alias("symbols"))
    size = size.withColumn("weight", quality_weight(F.col("size"), F.col("symbols"))).drop("symbols")
    return size.groupBy(*size.columns).agg(F.count(F.lit(1)).alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(cut(measured(table(spark, sf_dir, "documents")))).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)::BIGINT AS symbols,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / greatest(0.05, size / (size + 4 * symbols + 1)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (list_value(5, 2, 1)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)])::DOUBLE AS w
      FROM d GROUP BY source),
c AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / w AS per_weight, sum(source_size) OVER ()::DOUBLE * 1.5 AS words, sum(w) OVER () AS w_all FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY per_weight, source NULLS LAST) AS place, (words - coalesce(sum(cap) OVER f, 0)) / (w_all - coalesce(sum(w) OVER f, 0)) AS level FROM c
      WINDOW f AS (ORDER BY per_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * coalesce(arg_min(level, place) FILTER (level <= per_weight) OVER (), per_weight)) AS target FROM l),
m AS (SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM m)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, words - passes * source_size - prefix)))::BIGINT AS taken FROM p
"""


def mix_stage(docs: DataFrame) -> DataFrame:
    """The mix itself: a document comes whole, once for each pass that takes it.

    The document on a source's budget edge is taken when that is nearer to the target than leaving it. Rows are planned by id and
    text; exact repeats of a row get the same number of copies. Rows without ``doc_id`` draw by their text; null and wordless texts take
    no words and don't come. Other columns come through whatever their names; tables without rows give none.
    """
    number = row_name(F.col("doc_id"), F.col("text"))
    with passing() as stay:
        plan = mixed(cut(measured(docs, num=number))).filter("taken > 0").groupBy("num").agg(F.max(F.struct("taken", "size")).alias("p"))
        copies = F.floor(F.col("p.taken") / F.col("p.size")) + (2 * (F.col("p.taken") % F.col("p.size")) > F.col("p.size")).cast("long")
        plan = cut(plan.select(F.col("num").alias("planned"), copies.cast("int").alias("copies")).filter("copies > 0"))
        stay.append(plan)
    d = packed(docs, num=number).join(plan.hint("merge"), F.col("num") == F.col("planned"))
    return unpacked(d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))

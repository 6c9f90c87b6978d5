"""Queries of parity, perturbation, baselines and rule text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rule_text
from ..operators import drift, evaluation, robustness
from ..sources.tables import table
from .mining import _TOKENS, _atoms, specificity_coverage
from .mining import ORACLE_SQL as MINING_SQL
from .statistics import _LONG, _long, _psi

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""WITH p AS (SELECT unnest(['n', 'spend', 'items']) AS feature, unnest([a.n, a.spend, a.items]) AS a, unnest([b.n, b.spend, b.items]) AS b FROM
(SELECT o_custkey AS k, count(*)::DOUBLE AS n, round(sum(o_totalprice))::DOUBLE AS spend, max(o_orderkey % 7)::DOUBLE AS items FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) a JOIN
(SELECT o_custkey AS k, count(*)::DOUBLE AS n, round(sum(o_totalprice))::DOUBLE AS spend, max(o_orderkey % 7)::DOUBLE AS items FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) b USING (k))
SELECT feature, count(*) AS n, round(avg((a = b)::INT), 9) AS exact, round(avg((abs(a - b) <= 0.1::DOUBLE * greatest(abs(a), abs(b)))::INT), 9) AS close FROM p GROUP BY feature""")
def extractor_parity(spark, d):
    def side(k):
        o = table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == k)
        return o.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice")).alias("spend"), F.max(F.col("o_orderkey") % 7).alias("items"))

    return robustness.parity(side(0), side(1), "k", ["n", "spend", "items"], 0.1).withColumns({"exact": F.round("exact", 9), "close": F.round("close", 9)})


@query("""WITH c AS (SELECT len(regexp_extract_all(html, '(?i)<p')) AS a, len(regexp_extract_all(html, '[.] ')) AS b FROM pages), t AS (SELECT unnest([a, b]) AS v, unnest([1, 0]) AS side FROM c),
s AS (SELECT v, sum(side) / (SELECT count(*) FROM c) AS p, sum(1 - side) / (SELECT count(*) FROM c) AS q FROM t GROUP BY v),
k AS (SELECT a, b, row_number() OVER (ORDER BY a) AS i, row_number() OVER (ORDER BY b) AS j FROM c), r AS (SELECT avg(i) OVER (PARTITION BY a) AS x, avg(j) OVER (PARTITION BY b) AS y FROM k)
SELECT round(avg((a = b)::INT), 9) AS exact, round(avg((abs(a - b) <= 0.01 * greatest(a, b))::INT), 9) AS close, round((SELECT sum(abs(p - q)) / 2 FROM s), 9) AS total_variation, round((SELECT corr(x, y) FROM r), 9) AS spearman FROM c""")
def definition_parity(spark, d):
    """Two definitions of a count on the same pages: agreement, total variation of their distributions, correlation of ranks."""
    c = table(spark, d, "pages").select(F.regexp_count("html", F.lit("(?i)<p")).alias("a"), F.regexp_count("html", F.lit("[.] ")).alias("b"))
    sides = c.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(True).alias("first")), F.struct(F.col("b").alias("v"), F.lit(False).alias("first")))).alias("s")).select("s.*")
    one = evaluation.close_agreement(c, F.col("a"), F.col("b")).withColumns({"total_variation": evaluation.total_variation(sides, "v", F.col("first")).scalar(), "spearman": evaluation.spearman(c, "a", "b").scalar()})
    return one.select(*(F.round(x, 9).alias(x) for x in ("exact", "close", "total_variation", "spearman")))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT v AS donor, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS n FROM v WHERE label = 0),
t AS (SELECT vec_id, v, (('0x' || substr(md5(vec_id || '/1'), 1, 8))::BIGINT % (SELECT count(*) FROM p)) AS n FROM v WHERE label <> 0)
SELECT vec_id, round(v[1] + donor[1], 6) AS first, round(list_sum(v) + list_sum(donor), 4) AS total FROM t JOIN p USING (n)""")
def perturbed_records(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    t = robustness.with_donors(e.filter("label <> 0"), e.filter("label = 0"), "vec_id", 1).withColumn("m", robustness.merged_counts(F.col("v"), F.col("donor.v")))
    return t.select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH m AS (SELECT list_transform([median(l_quantity), median(l_extendedprice), median(l_tax)], lambda x: x) AS m FROM lineitem WHERE l_returnflag = 'N'),
r AS (SELECT l_quantity AS a, l_extendedprice AS b, l_tax AS c, l_quantity / 10 AS ca, l_extendedprice / -20000 AS cb, l_tax * 30 AS cc, m FROM lineitem, m WHERE l_returnflag = 'A')
SELECT round(avg(CASE WHEN abs(ca) >= abs(cb) AND abs(ca) >= abs(cc) THEN m[1] ELSE a END), 6) AS a, round(avg(CASE WHEN abs(cb) > abs(ca) AND abs(cb) >= abs(cc) THEN m[2] ELSE b END), 4) AS b,
round(avg(CASE WHEN abs(cc) > abs(ca) AND abs(cc) > abs(cb) THEN m[3] ELSE c END), 6) AS c FROM r""")
def deletion_test(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_tax")
    m = li.filter("l_returnflag = 'N'").agg(F.array(*(F.percentile(c, F.lit(0.5)) for c in ("l_quantity", "l_extendedprice", "l_tax"))).alias("m"))
    x = li.filter("l_returnflag = 'A'").crossJoin(F.broadcast(m))
    values, parts = F.array("l_quantity", "l_extendedprice", "l_tax"), F.array(F.col("l_quantity") / 10, F.col("l_extendedprice") / -20000, F.col("l_tax") * 30)
    y = x.select(robustness.deleted(values, parts, F.col("m"), 1).alias("y"))
    return y.agg(F.round(F.avg(F.col("y")[0]), 6).alias("a"), F.round(F.avg(F.col("y")[1]), 4).alias("b"), F.round(F.avg(F.col("y")[2]), 6).alias("c"))


_FLOORS = [1e-5, 1e-4, 1e-3, 1e-2]


@query(f"""WITH {_LONG}, {_psi('feature', 'ref')}, raw AS (SELECT feature, bin, coalesce(a, 0) / sum(coalesce(a, 0)) OVER (PARTITION BY feature) AS p, coalesce(b, 0) / sum(coalesce(b, 0)) OVER (PARTITION BY feature) AS q FROM bins LEFT JOIN c USING (feature, bin)),
s4 AS (SELECT raw.*, unnest({_FLOORS})::DOUBLE AS floor FROM raw)
SELECT feature, floor, round(sum((greatest(q, floor) - greatest(p, floor)) * ln(greatest(q, floor) / greatest(p, floor))), 9) AS psi FROM s4 GROUP BY ALL""")
def psi_floor_sensitivity(spark, d):
    v = _long(spark, d)
    return drift.psi_by_floor(v, F.col("ref"), drift.psi_bins(v.filter("ref")), _FLOORS).select("feature", "floor", F.round("psi", 9).alias("psi"))


@query("""WITH m AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1) SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM m)""")
def family_exclusion(spark, d):
    return robustness.without_most_common(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


@query(f"""WITH {_TOKENS}, f AS (SELECT atom, count(DISTINCT doc_id) AS support FROM a WHERE lang = 'de' AND atom NOT IN (SELECT atom FROM a WHERE lang <> 'de') GROUP BY atom)
SELECT atom, support FROM f ORDER BY support DESC, atom LIMIT 8""")
def frequency_baseline(spark, d):
    a = _atoms(spark, d)
    return robustness.frequent_rule(a.filter("lang = 'de'"), a.filter("lang <> 'de'"), filtered=True)


@query("WITH v AS (" + MINING_SQL["specificity_coverage"] + ") SELECT round(avg(coalesce(coverage, 0)), 6) AS coverage_all, round(avg(coverage), 6) AS coverage_given, round(avg(specificity), 6) AS specificity, sum(benign_hits)::BIGINT AS false_positives, round(avg(cross_hits), 6) AS cross_hits FROM v")
def rule_summary(spark, d):
    s = robustness.summary(specificity_coverage(spark, d))
    return s.select("false_positives", *(F.round(c, 6).alias(c) for c in ("coverage_all", "coverage_given", "specificity", "cross_hits")))


@query("""WITH b AS (SELECT p_brand, count(*) FILTER (p_size <= 25) AS train, count(*) FILTER (p_size > 25) AS test FROM part GROUP BY p_brand) SELECT p_brand, train, test FROM b WHERE test >= 3 ORDER BY train DESC, p_brand LIMIT 15""")
def family_selection(spark, d):
    b = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") <= 25).alias("train"), F.count_if(F.col("p_size") > 25).alias("test"))
    return b.filter("test >= 3").orderBy(F.desc("train"), "p_brand").limit(15)


_RULE = 'rule words\n{\n  strings:\n    $a = "the"\n    $b = "and \\\\ \\"x\\"" wide\n    $c = "ation"\n    $d = "ing "\n  condition:\n    2 of them\n}\n'


@query("""SELECT doc_id, starts_with('MZ' || text, 'MZ') AND contains('MZ' || text, 'the')::INT + contains('MZ' || text, 'and \\ "x"')::INT + contains('MZ' || text, 'ation')::INT + contains('MZ' || text, 'ing ')::INT >= 2 AS hit FROM documents""")
def rule_text_match(spark, d):
    """A parsed rule over texts; the rule table is one row, written by hand."""
    r = rule_text.parsed(spark, {"words": _RULE})
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("MZ"), "text").alias("t")).crossJoin(F.broadcast(r))
    return t.select("doc_id", rule_text.matches(F.col("t"), F.col("strings"), F.col("threshold")).alias("hit"))


@query("""SELECT l_returnflag, round(stddev_samp(m), 6) AS sd, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, l_linenumber AS seed, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def seed_variance(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("m"))
    return s.groupBy("l_returnflag").agg(F.round(F.stddev_samp("m"), 6).alias("sd"), F.round(F.avg("m"), 6).alias("mean"))

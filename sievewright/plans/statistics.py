"""Queries of model evaluation and drift over events, labels, lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, evaluation
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _error():
    return F.col("event_type") == "error"


_CURVE = """c AS (SELECT {by} value, count(*) FILTER (event_type = 'error') AS pos, count(*) FILTER (event_type <> 'error') AS neg FROM events GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY value DESC) AS tp, sum(neg) OVER (PARTITION BY {part} ORDER BY value DESC) AS fp, sum(pos) OVER (PARTITION BY {part}) AS p, sum(neg) OVER (PARTITION BY {part}) AS n FROM c)"""
_ONE, _WEEK = _CURVE.format(by="", part="1"), _CURVE.format(by="date_trunc('week', ts)::TIMESTAMP AS week,", part="week")


def _events(spark, d):
    return table(spark, d, "events").withColumn("week", F.date_trunc("week", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))


@query(f"WITH {_ONE} SELECT round(sum(neg * (tp - pos / 2)) / max(p) / max(n), 9) AS auc, max(p)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg FROM r")
def roc_auc(spark, d):
    return evaluation.roc_auc(table(spark, d, "events"), "value", _error()).withColumn("auc", F.round("auc", 9))


@query(f"WITH {_WEEK} SELECT week, round(sum(neg * (tp - pos / 2)) / max(p) / max(n), 9) AS auc, max(p)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg FROM r GROUP BY week HAVING max(p) > 0 AND max(n) > 0")
def weekly_auc(spark, d):
    return evaluation.roc_auc(_events(spark, d), "value", _error(), ["week"]).withColumn("auc", F.round("auc", 9))


@query(f"""WITH {_WEEK}, a AS (SELECT week, sum(neg * (tp - pos / 2)) / max(p) / max(n) AS auc FROM r GROUP BY week HAVING max(p) > 0 AND max(n) > 0),
t AS (SELECT (auc + lag(auc) OVER (ORDER BY week)) / 2 AS piece FROM a) SELECT round(sum(piece) / count(piece), 9) AS area FROM t""")
def aut_trapezoid(spark, d):
    return evaluation.trapezoid(evaluation.roc_auc(_events(spark, d), "value", _error(), ["week"]), "week", "auc").select(F.round("area", 9).alias("area"))


@query(f"""WITH {_ONE}, f AS (SELECT unnest([0.01, 0.001, 0.1]) AS fpr)
SELECT f.fpr::DOUBLE AS fpr, round(coalesce(max(tp) FILTER (fp / n <= f.fpr), 0) / max(p), 9) AS tpr, min(value) FILTER (fp / n <= f.fpr) AS threshold FROM r, f GROUP BY f.fpr""")
def tpr_at_fpr(spark, d):
    parts = [evaluation.tpr_at_fpr(table(spark, d, "events"), "value", _error(), f).select(F.lit(f).alias("fpr"), F.round("tpr", 9).alias("tpr"), "threshold") for f in (0.01, 0.001, 0.1)]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {_ONE} SELECT round(sum(pos * (tp / (tp + fp))) / max(p), 9) AS average_precision FROM r")
def average_precision(spark, d):
    return evaluation.average_precision(table(spark, d, "events"), "value", _error()).select(F.round("average_precision", 9).alias("average_precision"))


@query("""WITH n AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE event_type <> 'error')
SELECT value AS threshold FROM n WHERE i = least(n - 1, floor(n * (1 - 0.01::DOUBLE)))""")
def threshold_for_fpr(spark, d):
    return evaluation.threshold_for_fpr(table(spark, d, "events"), "value", ~_error(), 0.01)


_CONFUSION = """SELECT {by} count(*) FILTER (f AND y) AS tp, count(*) FILTER (f AND NOT y) AS fp, count(*) FILTER (NOT f AND y) AS fn, count(*) FILTER (NOT f AND NOT y) AS tn FROM s GROUP BY ALL"""


@query(f"""WITH s AS (SELECT value > 100 AS f, event_type = 'error' AS y FROM events), c AS ({_CONFUSION.format(by='')})
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr FROM c""")
def confusion_at_threshold(spark, d):
    c = evaluation.confusion(table(spark, d, "events"), F.col("value") > 100, _error())
    return c.select("tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1", "fpr")))


@query("""WITH m(model, cut) AS (VALUES ('low', 20.0), ('middle', 60.0), ('high', 150.0)),
s AS (SELECT model, date_part('day', ts) <= 15 AS early, value > cut AS f, event_type = 'error' AS y FROM events, m)
SELECT model, early, count(*) FILTER (f AND y) AS tp, count(*) FILTER (f AND NOT y) AS fp, round(coalesce(count(*) FILTER (f AND y) / nullif(count(*) FILTER (y), 0), 0), 9) AS recall FROM s GROUP BY ALL""")
def cross_eval_grid(spark, d):
    models = F.array(*(F.struct(F.lit(n).alias("model"), F.lit(c).alias("cut")) for n, c in (("low", 20.0), ("middle", 60.0), ("high", 150.0))))
    e = table(spark, d, "events").select("event_type", "value", (F.dayofmonth("ts") <= 15).alias("early"), F.inline(models))
    return evaluation.confusion(e, F.col("value") > F.col("cut"), _error(), ["model", "early"]).select("model", "early", "tp", "fp", F.round("recall", 9).alias("recall"))


@query("""WITH c AS (SELECT event_type, count(*) FILTER (value > 100)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY event_type), w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c)
SELECT event_type, k::BIGINT AS k, n::BIGINT AS n,
round(CASE WHEN k = 0 THEN 0 ELSE (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) END, 9) AS low,
round(CASE WHEN k = n THEN 1 ELSE (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) END, 9) AS high,
round(3 / n, 9) AS rule_of_three FROM w""")
def wilson_ci(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return c.select("event_type", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(evaluation.rule_of_three(F.col("n")), 9).alias("rule_of_three"))


@query("SELECT count(*) FILTER (value > 50 AND user_id % 3 <> 0) AS only_a, count(*) FILTER (NOT value > 50 AND NOT user_id % 3 <> 0) AS only_b FROM events")
def mcnemar_counts(spark, d):
    return evaluation.discordant(table(spark, d, "events"), F.col("value") > 50, F.col("user_id") % 3 == 0)


@query("""WITH u AS (SELECT user_id, count(*) FILTER (value > 60) AS a, count(*) FILTER (value < 20) AS b FROM events GROUP BY user_id),
t AS (SELECT user_id, a, b, unnest(range(0, least(a, b) + 1)) AS i FROM u)
SELECT user_id, round(least(1, 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))), 6) AS p FROM t GROUP BY user_id""")
def mcnemar_p(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 60).alias("a"), F.count_if(F.col("value") < 20).alias("b"))
    return u.select("user_id", F.round(evaluation.exact_two_sided(F.least("a", "b"), F.col("a") + F.col("b")), 6).alias("p"))


def _poisson_case(u: str) -> str:
    steps, total = [], 0.0
    for f in (1, 1, 2, 6, 24, 120, 720, 5040):
        total += 2.718281828459045**-1 / f
        steps.append(f"CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(steps)


@query("""WITH c AS (SELECT l_partkey, l_suppkey FROM lineitem), a AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS k, l_suppkey, row_number() OVER (ORDER BY l_suppkey) AS j FROM c),
r AS (SELECT avg(k) OVER (PARTITION BY l_partkey) AS x, avg(j) OVER (PARTITION BY l_suppkey) AS y FROM a) SELECT round(corr(x, y), 9) AS spearman FROM r""")
def spearman(spark, d):
    return evaluation.spearman(table(spark, d, "lineitem"), "l_partkey", "l_suppkey").select(F.round("spearman", 9).alias("spearman"))


@query("""WITH c AS (SELECT l_quantity, count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS a, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS b FROM lineitem GROUP BY l_quantity)
SELECT round(sum(abs(a / (SELECT sum(a) FROM c) - b / (SELECT sum(b) FROM c))) / 2, 9) AS total_variation FROM c""")
def total_variation(spark, d):
    return evaluation.total_variation(table(spark, d, "lineitem"), "l_quantity", F.expr("l_shipdate < TIMESTAMP '1998-01-01'")).select(F.round("total_variation", 9).alias("total_variation"))


@query("""SELECT round(avg((round(p_retailprice) = round(l_extendedprice / l_quantity))::INT), 9) AS exact, round(avg((abs(p_retailprice - l_extendedprice / l_quantity) <= 0.3 * greatest(abs(p_retailprice), abs(l_extendedprice / l_quantity)))::INT), 9) AS close
FROM lineitem JOIN part ON l_partkey = p_partkey""".replace("(round(p_retailprice) = round(l_extendedprice / l_quantity))", "(p_retailprice = l_extendedprice / l_quantity)"))
def close_agreement(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return evaluation.close_agreement(j, F.col("p_retailprice"), F.col("l_extendedprice") / F.col("l_quantity"), 0.3).select(F.round("exact", 9).alias("exact"), F.round("close", 9).alias("close"))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_CUT = "l_shipdate < TIMESTAMP '1998-01-01'"
_LONG = "v AS (SELECT l_returnflag AS part, " + _CUT + " AS ref, unnest([" + ", ".join(f"'{c}'" for c in _COLUMNS) + "]) AS feature, unnest([" + ", ".join(f"{c}::DOUBLE" for c in _COLUMNS) + "]) AS value FROM lineitem)"
_PSI = """vals AS (SELECT {key}, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY {key}) AS total, count(*) OVER (PARTITION BY {key}) AS d FROM v WHERE {where} GROUP BY {key}, value),
atoms AS (SELECT {key}, value, row_number() OVER (PARTITION BY {key} ORDER BY value) AS i FROM vals WHERE n >= total / 10 OR d <= 20),
rest AS (SELECT v.* FROM v ANTI JOIN atoms ON {on} AND v.value = atoms.value),
q AS (SELECT {key}, unnest(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edge FROM rest WHERE {where} GROUP BY {key}),
edges AS (SELECT {key}, list(edge ORDER BY edge) AS edges FROM q GROUP BY {key}),
keys AS (SELECT DISTINCT {key} FROM v WHERE {where}),
bins AS (SELECT {key}, 'a' || i AS bin FROM atoms UNION ALL SELECT {key}, 'i' || unnest(range(0, len(coalesce(edges, [])) + 1)) FROM keys LEFT JOIN edges USING ({key})),
b AS (SELECT {vkey}, v.ref, CASE WHEN atoms.i IS NOT NULL THEN 'a' || atoms.i ELSE 'i' || len(list_filter(coalesce(edges, []), lambda e: e <= v.value)) END AS bin
      FROM v LEFT JOIN atoms ON {on} AND v.value = atoms.value LEFT JOIN edges ON {eon}),
c AS (SELECT {key}, bin, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM b GROUP BY {key}, bin),
s AS (SELECT {key}, bin, greatest(coalesce(a, 0) / sum(coalesce(a, 0)) OVER (PARTITION BY {key}), 1e-4) AS p, greatest(coalesce(b, 0) / sum(coalesce(b, 0)) OVER (PARTITION BY {key}), 1e-4) AS q FROM bins LEFT JOIN c USING ({key}, bin)),
psi AS (SELECT {key}, sum((q - p) * ln(q / p)) AS psi FROM s GROUP BY {key})"""


def _psi(key: str, where: str) -> str:
    return _PSI.format(key=key, where=where, vkey=f"v.{key}", on=f"v.{key} = atoms.{key}", eon=f"v.{key} = edges.{key}")


def _long(spark, d):
    return drift.long_form(table(spark, d, "lineitem").withColumn("ref", F.expr(_CUT)).withColumn("part", F.col("l_returnflag")), _COLUMNS, ["part", "ref"])


@query(f"WITH {_LONG}, {_psi('feature', 'ref')} SELECT feature, round(psi, 9) AS psi FROM psi")
def psi_reference(spark, d):
    v = _long(spark, d)
    return drift.psi(v, F.col("ref"), drift.psi_bins(v.filter("ref"))).select("feature", F.round("psi", 9).alias("psi"))


@query(f"WITH {_LONG}, {_psi('feature', 'true')} SELECT feature, round(psi, 9) AS psi FROM psi")
def psi_pooled(spark, d):
    v = _long(spark, d)
    return drift.psi(v, F.col("ref"), drift.psi_bins(v)).select("feature", F.round("psi", 9).alias("psi"))


_BY_PART = _LONG.replace("AS feature", "AS name").replace("v AS (", "v0 AS (") + ", v AS (SELECT ref, part || '/' || name AS feature, value FROM v0)"
_WEIGHT = {"l_quantity": 1.0, "l_extendedprice": 2.0, "l_discount": 0.5, "l_tax": 1.5, "l_linenumber": 0.25}


@query(f"""WITH {_BY_PART}, {_psi('feature', 'ref')}, w(name, weight) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _WEIGHT.items())}),
f AS (SELECT split_part(feature, '/', 2) AS name, max(psi) AS psi FROM psi GROUP BY ALL)
SELECT name AS feature, round(psi, 9) AS psi, round(psi * weight, 9) AS weighted, row_number() OVER (ORDER BY psi * weight DESC, name)::INT AS rank FROM f JOIN w USING (name)""")
def drift_rank(spark, d):
    v = _long(spark, d).withColumn("feature", F.concat_ws("/", "part", "feature"))
    p = drift.psi(v, F.col("ref"), drift.psi_bins(v.filter("ref"))).withColumn("feature", F.split_part("feature", F.lit("/"), F.lit(2)))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in _WEIGHT.items() for x in kv)), F.col("feature"))
    return drift.drift_rank(p, weight, 3).select("feature", F.round("psi", 9).alias("psi"), F.round("weighted", 9).alias("weighted"), "rank")


@query(f"""WITH {_BY_PART}, {_psi('feature', 'ref')}, f AS (SELECT split_part(feature, '/', 2) AS name, max(psi) FILTER (feature LIKE 'A/%') AS a, max(psi) FILTER (feature LIKE 'R/%') AS r FROM psi GROUP BY ALL)
SELECT name AS feature, CASE WHEN a >= 0.25 AND r >= 0.25 THEN 'both_classes' WHEN a >= 0.25 AND r < 0.1 THEN 'benign_only' WHEN r >= 0.25 AND a < 0.1 THEN 'malicious_only' WHEN greatest(a, r) < 0.1 THEN 'stable' ELSE 'mixed' END AS pattern FROM f""")
def shift_pattern(spark, d):
    v = _long(spark, d).withColumn("feature", F.concat_ws("/", "part", "feature"))
    p = drift.psi(v, F.col("ref"), drift.psi_bins(v.filter("ref"))).select(F.split("feature", "/").alias("f"), "psi")
    w = p.groupBy(F.col("f")[1].alias("feature")).agg(F.max(F.when(F.col("f")[0] == "A", F.col("psi"))).alias("A"), F.max(F.when(F.col("f")[0] == "R", F.col("psi"))).alias("R"))
    return w.select("feature", drift.shift_pattern(F.col("A"), F.col("R")).alias("pattern"))


@query("""WITH t AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
r AS (SELECT o_orderpriority AS g, o_totalprice AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT o_orderkey, x AS o_totalprice, y AS aligned FROM t JOIN r ON t.g = r.g AND k = greatest(1, ceil((r - 0.5::DOUBLE) / n * m))""")
def quantile_align(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    old, new = o.filter("o_orderdate < TIMESTAMP '1998-01-01'"), o.filter("o_orderdate >= TIMESTAMP '1998-01-01'")
    return drift.aligned(new, old, "o_totalprice", ["o_orderpriority"], "o_orderkey").select("o_orderkey", "o_totalprice", "aligned")


@query("""WITH w AS (SELECT p_type, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY p_type), p AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS r FROM part WHERE p_size > 10)
SELECT p_partkey, p_type FROM p JOIN w USING (p_type) WHERE r <= n""")
def matched_random_draw(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    wanted = p.filter("p_size <= 10").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return drift.matched_draw(p.filter("p_size > 10"), wanted, "p_type", "p_partkey").select("p_partkey", "p_type")


@query(f"WITH {_LONG} SELECT part, feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, median(value) AS median, min(value) AS low, max(value) AS high FROM v GROUP BY part, feature")
def feature_unpivot_stats(spark, d):
    v = F.col("value")
    return _long(spark, d).groupBy("part", "feature").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


@query(f"WITH {_LONG} SELECT part, ref, feature, round(avg((value = 0)::INT), 9) AS zero_share FROM v GROUP BY ALL")
def zero_share(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), F.expr(_CUT).alias("ref"), *_COLUMNS)
    return drift.zero_share(li, _COLUMNS, ["part", "ref"]).withColumn("zero_share", F.round("zero_share", 9))


_SOME = ["n_imports", "size_kb", "max_section_entropy", "file_entropy", "capability_count", "api_gui", "cap:create process", "entry_missing"]


@query(f"""SELECT CASE WHEN f IN ('capability_count', 'cap:create process') THEN 'capability' WHEN f IN ('n_imports', 'api_gui') THEN 'imports' WHEN f IN ('max_section_entropy', 'entry_missing') THEN 'sections'
WHEN f = 'file_entropy' THEN 'bytes_strings' ELSE 'header' END AS grp, count(*) AS n FROM (SELECT (list_value({", ".join(f"'{x}'" for x in _SOME)}))[p_size % 8 + 1] AS f FROM part) GROUP BY ALL""")
def feature_groups(spark, d):
    from ..operators.features import feature_groups

    f = table(spark, d, "part").select(F.get(F.array(*map(F.lit, _SOME)), (F.col("p_size") % 8).cast("int")).alias("feature"))
    return f.join(feature_groups(spark), "feature").groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT l_linenumber, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS a, count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 25) AS b,
count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS c, count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25) AS d FROM lineitem GROUP BY l_linenumber),
m AS (SELECT *, a + b + c + d AS n, a + b AS r, a + c AS k FROM t), x AS (SELECT *, unnest(range(greatest(0, k - (n - r)), least(r, k) + 1)) AS x FROM m),
p AS (SELECT l_linenumber, a, x, exp(lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) AS p FROM x),
o AS (SELECT l_linenumber, max(p) FILTER (x = a) AS own FROM p GROUP BY l_linenumber)
SELECT l_linenumber, round(sum(p) FILTER (p <= own * (1 + 1e-7)), 6) AS p FROM p JOIN o USING (l_linenumber) GROUP BY l_linenumber""")
def fisher_by_group(spark, d):
    """Whether large quantities come back more often, for each line number."""
    t = table(spark, d, "lineitem").withColumns({"r": F.col("l_returnflag") == "R", "q": F.col("l_quantity") > 25})
    t = t.groupBy("l_linenumber").agg(*(F.count_if(c).alias(n) for n, c in zip("abcd", (F.col("r") & F.col("q"), F.col("r") & ~F.col("q"), ~F.col("r") & F.col("q"), ~F.col("r") & ~F.col("q")), strict=True)))
    return t.select("l_linenumber", F.round(evaluation.fisher_exact(*map(F.col, "abcd")), 6).alias("p"))


@query("""WITH e AS (SELECT l_linenumber, l_quantity - 25 AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT l_linenumber, d, rank() OVER w + (count(*) OVER (PARTITION BY l_linenumber, abs(d)) - 1) / 2 AS r FROM e WINDOW w AS (PARTITION BY l_linenumber ORDER BY abs(d))),
s AS (SELECT l_linenumber, count(*) AS n, sum(r) FILTER (d > 0) AS w FROM r GROUP BY l_linenumber), t AS (SELECT l_linenumber, sum(c * c * c - c) AS t FROM (SELECT l_linenumber, count(*)::DOUBLE AS c FROM e GROUP BY l_linenumber, abs(d)) GROUP BY l_linenumber),
z AS (SELECT l_linenumber, n, w, greatest(0, abs(w - n * (n + 1) / 4) - 0.5) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - t / 48) AS z FROM s JOIN t USING (l_linenumber)), q AS (SELECT *, 1 / (1 + 0.3275911 * z / sqrt(2)) AS q FROM z)
SELECT l_linenumber, n, w AS w_plus, round(q * (0.254829592 + q * (-0.284496736 + q * (1.421413741 + q * (-1.453152027 + q * 1.061405429)))) * exp(-z * z / 2), 9) AS p FROM q""")
def signed_rank_by_group(spark, d):
    """Whether quantities lie around 25, for each line number."""
    t = table(spark, d, "lineitem")
    return evaluation.signed_rank(t, F.col("l_quantity") - 25, ["l_linenumber"]).withColumn("p", F.round("p", 9))
